"""Scoring and filtering by a weighted lexicon."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import DIGIT, SPACE, WORD, any_case, fold_yo

# The patterns of each category, the weights, the categories that open the gate for years, and the years.
PATTERNS = {
    "stalin": [r"\bсталин(?!град)\w*", r"\bиосиф\s+виссарионович", r"\bджугашвили"],
    "weak_stalin": [r"\bкоба\b"],
    "cult": [
        r"культ\s+личности",
        r"вождь\s+народ(?:а|ов)?",
        r"великий\s+вождь",
        r"отец\s+народ(?:а|ов)?",
        r"гениальн\w*\s+вождь",
        r"мудр\w*\s+(?:руководств|вождь|сталин)",
    ],
    "repression": [
        r"\bрепресс\w*",
        r"\bгулаг\w*",
        r"\bнквд\b",
        r"\bогпу\b",
        r"\bнкгб\b",
        r"\bбольшой\s+террор",
        r"\bмассов\w+\s+террор",
        r"\bполитическ\w+\s+террор",
        r"\bчистк[аи]\b",
        r"\bраскулачива\w*",
        r"\bвраг\w*\s+народа",
        r"\bтройк[аи]\b",
        r"\bлагер[яьей]\w*",
        r"\bссылк\w*",
        r"\bдепортац\w*",
        r"\bвыселен\w*",
        r"\bрасстрел\w*",
        r"\bарест\w*(?:\s+\w+){0,2}\s*(?:1930|1937|1938|194\d)",
    ],
    "events": [
        r"коллективизаци[яи]",
        r"индустриализаци[яи]",
        r"пятилет\w*\s*план",
        r"первая\s+пятилетка",
        r"вторая\s+пятилетка",
        r"стахановск\w*",
        r"ударни[кч]\w*",
        r"социалистическ\w+\s+соревнован\w*",
        r"голод\w*\s*(?:1932|1933|голодомор)",
        r"голодомор",
    ],
    "trials": [
        r"московск\w+\s+процесс",
        r"показательн\w+\s+процесс",
        r"дело\s+врач\w*",
        r"ленинградское\s+дело",
        r"антипартийн\w+\s+групп\w*",
        r"троцкист\w*",
        r"зиновьев\w*",
        r"каменев\w*",
        r"бухарин\w*",
        r"рыков\w*",
        r"тухачевск\w*",
        r"ежов\w*",
        r"берия",
        r"ягода",
    ],
}
WEIGHTS = {"stalin": 3, "weak_stalin": 1, "cult": 2, "repression": 2, "trials": 1, "events": 1}
STRONG = ["stalin", "cult", "repression", "trials", "events"]
RANKED = ["repression", "cult", "events", "trials"]
KEY_YEARS = ["1929", "1930", "1932", "1933", "1934", "1936", "1937", "1938", "1939", "1946", "1948", "1949", "1952", "1953"]
YEAR_CAP = 3
MIN_SCORE = 2


def spelled_out(pattern: str) -> str:
    r"""The pattern with \b, \w, \s and \d written as the classes of textloom.functions.text, as Java's own differ."""
    borders = re.sub(r"^\\b", lambda _: f"(?<!{WORD})", re.sub(r"\\b$", lambda _: f"(?!{WORD})", pattern))
    return borders.replace(r"\w", WORD).replace(r"\s", SPACE).replace(r"\d", DIGIT)


def without_groups(pattern: str) -> str:
    """What stands outside of parentheses."""
    while (rest := re.sub(r"\([^()]*\)", "", pattern)) != pattern:
        pattern = rest
    return pattern


@dataclass(frozen=True)
class Lexicon:
    """Injectable: any categories may be replaced. Strong categories open the gate for years; the first one is enough alone."""

    patterns: dict[str, list[str]] = field(default_factory=lambda: PATTERNS)
    weights: dict[str, int] = field(default_factory=lambda: WEIGHTS)
    strong: list[str] = field(default_factory=lambda: STRONG)
    ranked: list[str] = field(default_factory=lambda: RANKED)
    key_years: list[str] = field(default_factory=lambda: KEY_YEARS)
    direct: str = "stalin"

    def initials(self, category: str) -> str:
        """The lower-case letters with which all matches of a category begin; empty where a pattern doesn't begin with a letter."""
        own = [p.removeprefix(r"\b") for p in self.patterns[category]]
        if not all(p[:1].islower() and len(p[0].upper()) == 1 for p in own) or any(re.match(r"\w[?*{]", p) or "|" in without_groups(p) for p in own):
            return ""
        return "".join(sorted({p[0] for p in own}))

    def pattern(self, category: str) -> str:
        """All patterns of a category. Where all begin with a letter, looks ahead and behind spare most places, and of the
        patterns only those of the letter are tried, in their order."""
        own, letters = self.patterns[category], self.initials(category)
        if not letters:
            return "(?iu)" + "|".join(f"(?:{spelled_out(p)})" for p in own)
        border = rf"(?<!{WORD})" if all(p.startswith(r"\b") for p in own) else ""
        groups = []
        for c in letters:
            alike = "|".join(f"(?:{spelled_out(p.removeprefix(chr(92) + 'b') if border else p)})" for p in own if p.removeprefix(r"\b")[0] == c)
            groups.append(f"(?=(?-iu:[{any_case(c)}]))(?:{alike})")
        return f"{border}(?=[{any_case(letters)}])(?iu)(?:{'|'.join(groups)})"

    def may_match(self, text: Column) -> Column | None:
        """Whether a text has a letter with which a match can begin; None where some match may begin with another sign."""
        letters = [self.initials(c) for c in self.patterns]
        if not all(letters):
            return None
        found = text.rlike(f"[{any_case(''.join(sorted(set(''.join(letters)))))}]")
        # A text of as many bytes as characters has no other letters than ASCII's.
        return found if any(c.isascii() for x in letters for c in x) else (F.octet_length(text) > F.length(text)) & found

    @property
    def key_year_pattern(self) -> str:
        return rf"(?<!{DIGIT})({'|'.join(self.key_years)})(?!{DIGIT})"


#: Fixed value: any year.
ANY_YEAR = rf"(?<!{DIGIT})(18{DIGIT}{{2}}|19{DIGIT}{{2}}|20{DIGIT}{{2}})(?!{DIGIT})"


def distinct_matches(c: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1))))


def score_segments(segs: DataFrame, lexicon: Lexicon | None = None, text_col: str = "text", min_score: int = MIN_SCORE, all_years: bool = False) -> DataFrame:
    """segs with n_<category> for each category, key_years, n_key_years, strong, thematic, score and reason.

    reason is null for what is rejected. Years count only behind a strong category, at most YEAR_CAP of them. The ranked
    categories are compared by weighted count; a tie goes to the one with most matches, or is "strong_mixed".
    """
    lex = lexicon or Lexicon()
    folded = "_folded"
    out = segs.withColumn(folded, fold_yo(F.col(text_col)))
    may, same = lex.may_match(F.col(folded)), os.path.commonprefix(lex.key_years)
    out = out.withColumn("_may", F.lit(True) if may is None else may)
    counts = {f"n_{c}": F.when(F.col("_may") | F.col("_may").isNull(), F.regexp_count(folded, F.lit(lex.pattern(c)))).otherwise(0) for c in lex.patterns}
    years = F.when(F.contains(folded, F.lit(same)) | F.col(folded).isNull(), distinct_matches(F.col(folded), lex.key_year_pattern)).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(counts | {"key_years": years})
    if all_years:
        out = out.withColumn("all_years", distinct_matches(F.col(folded), ANY_YEAR))

    def n(c: str) -> Column:
        return F.col(f"n_{c}")

    strong = F.greatest(*(n(c) for c in lex.strong)) > 0
    out = out.drop(folded, "_may").withColumns({"n_key_years": F.size("key_years"), "strong": strong, "thematic": F.greatest(*(n(c) for c in lex.patterns)) > 0})
    score = sum((n(c) * w for c, w in lex.weights.items()), F.lit(0)) + F.when(F.col("strong"), F.least("n_key_years", F.lit(YEAR_CAP))).otherwise(0)
    ranks = F.array(*(F.struct((n(c) * lex.weights[c]).alias("weight"), n(c).alias("count"), F.lit(c).alias("name")) for c in lex.ranked))
    top = F.filter(ranks, lambda r: r["weight"] == F.array_max(F.transform(ranks, lambda x: x["weight"])))
    most = F.filter(top, lambda r: r["count"] == F.array_max(F.transform(top, lambda x: x["count"])))
    named = F.when(F.size(most) == 1, F.concat(F.lit("strong_"), F.get(most, F.lit(0))["name"])).otherwise("strong_mixed")
    reason = F.when(n(lex.direct) > 0, F.lit(f"{lex.direct}_direct")).when(F.col("strong") & (F.col("score") >= min_score), named)
    return out.withColumn("score", score).withColumn("reason", reason)


def retained(scored: DataFrame) -> DataFrame:
    return scored.where("reason is not null")


def rejected(scored: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The rest, with matched_categories in alphabetical order."""
    names = sorted((lexicon or Lexicon()).patterns)
    matched = F.array_compact(F.array(*(F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in names)))
    return scored.where("reason is null").withColumn("matched_categories", matched)


def date_only(scored: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Segments with key years and no strong category; date_strong if the years alone would reach min_score."""
    weak = F.col("n_weak_stalin") > 0
    return scored.where("not strong and n_key_years > 0").withColumns(
        {
            "date_points": F.least("n_key_years", F.lit(YEAR_CAP)),
            "date_strong": F.least("n_key_years", F.lit(YEAR_CAP)) >= min_score,
            "date_reason": F.when(weak, "date_plus_weak_stalin").otherwise("date_only_pure"),
        }
    )


def category_stats(scored: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """For retained segments: how many have each category, and its matches in all; categories without any show with 0."""
    names = list((lexicon or Lexicon()).patterns)
    sums = retained(scored).agg(*(F.count_if(F.col(f"n_{c}") > 0).alias(f"s_{c}") for c in names), *(F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"m_{c}") for c in names))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"s_{c}").alias("n_segments"), F.col(f"m_{c}").alias("n_matches")) for c in names))))


def reason_stats(scored: DataFrame) -> DataFrame:
    counts = retained(scored).groupBy("reason").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("reason", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def retention_stats(scored: DataFrame) -> DataFrame:
    """Per period and in all: segments, retained, and the share in percent."""
    return scored.rollup("period").agg(
        F.count("*").alias("n_segments"),
        F.count("reason").alias("n_retained"),
        (F.count("reason") * 100.0 / F.count("*")).alias("retention_pct"),
        F.count_if(~F.col("strong") & (F.col("n_key_years") > 0)).alias("n_date_only"),
    )


def score_histogram(scored: DataFrame, width: int = 5) -> DataFrame:
    low = (F.floor(F.col("score") / width) * width).cast("bigint")
    return retained(scored).groupBy(F.concat(low, F.lit("-"), low + width - 1).alias("bucket")).agg(F.count("*").alias("n"))


def year_frequency(scored: DataFrame, col: str = "key_years") -> DataFrame:
    """In how many segments each year stands."""
    return scored.select(F.explode(col).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def top_scoring(scored: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    return retained(scored).orderBy(F.desc("score"), *keys).limit(n)


def borderline(scored: DataFrame, keys: list[str], n: int = 50, min_score: int = MIN_SCORE) -> DataFrame:
    return retained(scored).where(F.col("score") == min_score).orderBy(*keys).limit(n)


def sample_order(keys: list[str], seed: int) -> Column:
    """A seeded hash of the keys as the order of a sample: the same rows for the same seed, on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_rows(rows: DataFrame, keys: list[str], n: int = 50, seed: int = 42) -> DataFrame:
    return rows.orderBy(sample_order(keys, seed), *keys).limit(n)
