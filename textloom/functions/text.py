"""Scalar text functions as column expressions.

Regular expressions run on the JVM. Classes are written out, so that they mean what Unicode-aware expressions elsewhere
mean: SPACE is all white space including the separators U+001C to U+001F, WORD a letter, number or underscore, and
line anchors hold at line feeds only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
#: What counts as a word, letters that hyphenation may divide, dashes, and the limits of the repair step.
COUNTED_WORD = "[A-Za-zА-Яа-яЁё0-9]+"
LETTER = "[A-Za-zА-Яа-яЁё]"
DASHES = "‐‑‒–—―"
REPAIR_MAX_BREAKS = 20
REPAIR_MIN_CHARS = 10_000


#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c evaluated once, however often body names it: a column that is named twice is written out twice."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


@cache
def any_case(letters: str) -> str:
    """A regular expression's class (without brackets) of all characters that are one of these lower-case letters in any case."""
    own = [i for i in range(0x10000) if chr(i).upper().lower() in letters or chr(i).lower() in letters] if letters else []
    runs = [(a, b) for a, b in zip([x for x in own if x - 1 not in own], [x for x in own if x + 1 not in own])]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


def where_any(c: Column, parts: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
    """body(c) where c holds one of the parts, which is found in its bytes; else c, which isn't decoded for a regular expression then."""
    return bind(c, lambda text: F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts)), body(text)).otherwise(text))


def strip(c: Column) -> Column:
    """Without white space, in the sense of SPACE, at both ends."""
    return F.trim(c, F.lit(SPACES))


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n")


def one_space(c: Column) -> Column:
    """Runs of spaces and tabs to one space; single spaces, nearly all of them, aren't matched."""
    return where_any(c, ("\t", "  "), lambda text: F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " "))


def line_feeds(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def plain_spaces(c: Column) -> Column:
    """No-break space to space, zero-width space out, form feed to a paragraph break."""
    c = F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    return F.replace(c, F.lit("\f"), F.lit("\n\n"))


def plain_dashes(c: Column) -> Column:
    return reduce(lambda text, dash: F.replace(text, F.lit(dash), F.lit("-")), DASHES, c)


def drop_page_numbers(c: Column) -> Column:
    """Lines that hold a number of up to four digits and perhaps hyphens; white space around it may cross lines."""
    return F.regexp_replace(c, rf"(?md)^{SPACE}*-?{SPACE}*{DIGIT}{{1,4}}{SPACE}*-?{SPACE}*$", "")


def drop_page_references(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?=[{any_case('с')}])(?iu)(?<!{WORD})стр\.?{SPACE}*{DIGIT}{{1,4}}(?!{WORD})", "")


def drop_bracket_references(c: Column) -> Column:
    """[1], [см. 5], [1, 2], [1-3]: numbers of up to three digits; [1937] stays."""
    s, n = SPACE, rf"{DIGIT}{{1,3}}"
    return where_any(c, ("[",), lambda text: F.regexp_replace(text, rf"\[{s}*(?:см\.?{s}*)?{n}(?:{s}*[-–—]{s}*{n})?(?:{s}*[,;]{s}*{n})*{s}*\]", ""))


def two_breaks(c: Column) -> Column:
    return where_any(c, ("\n\n\n",), lambda text: F.regexp_replace(text, r"\n{3,}", "\n\n"))


def join_hyphenated(c: Column) -> Column:
    def joined(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("-")) & F.contains(text, F.lit("\n")), F.regexp_replace(text, rf"({LETTER})-{SPACE}*\n{SPACE}*({LETTER})", "$1$2")).otherwise(text)

    return bind(c, joined)


def join_lines(c: Column) -> Column:
    """Single line feeds become spaces."""
    return F.regexp_replace(c, r"\n(?!\n)(?<!\n\n)", " ")


def repair_breaks(c: Column) -> Column:
    """For long texts with hardly any line breaks: a paragraph break after a full stop before a capital, and before sections."""

    def repaired(text: Column) -> Column:
        broken = F.regexp_replace(text, r"(?<![тТгГ])\.([А-ЯЁA-Z])", ".\n\n$1")
        broken = F.regexp_replace(broken, rf"§{SPACE}*({DIGIT}+)", "\n\n§ $1")
        few = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < REPAIR_MAX_BREAKS
        return F.when(few & (F.length(text) > REPAIR_MIN_CHARS), broken).otherwise(text)

    return bind(c, repaired)


#: The steps of normalization, in their order.
NORMALIZATION = (
    line_feeds,
    plain_spaces,
    plain_dashes,
    one_space,
    drop_page_numbers,
    drop_page_references,
    drop_bracket_references,
    two_breaks,
    join_hyphenated,
    join_lines,
    one_space,
    strip_lines,
    repair_breaks,
    strip,
)


def normalize(c: Column) -> Column:
    return reduce(lambda text, step: step(text), NORMALIZATION, c)


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(COUNTED_WORD))


def has_words(c: Column, least: int) -> Column:
    """count_words(c) >= least, without reading on."""
    other = COUNTED_WORD.replace("[", "[^")
    return c.rlike(f"(?:{COUNTED_WORD}+{other}+){{{least - 1}}}{COUNTED_WORD}")


def count_tokens(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"))


def fold_yo(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("ё"), F.lit("е")), F.lit("Ё"), F.lit("Е"))


def comparison_form(c: Column) -> Column:
    """Lower case, ё folded, all but letters, numbers and _ to spaces, single spaces, stripped."""
    folded = F.replace(F.lower(c), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def text_hash(c: Column) -> Column:
    return F.md5(comparison_form(c))


def ngrams(c: Column, n: int = 3) -> Column:
    """The set of character n-grams of a text in comparison form; a shorter text is its own n-gram, an empty one has none."""
    one = F.lit(1)

    def grams(chars: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.array_join(F.slice(chars, i + one, F.lit(n)), ""))
        return F.when(F.size(chars) >= n, F.array_distinct(cut)).otherwise(F.array(F.array_join(chars, "")))

    # Cutting the bound characters is linear in the text's length.
    found = bind(F.split(c, ""), grams)
    return F.when(F.length(c) > 0, found).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def truncate(c: Column, n: int = 150) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int = 150) -> Column:
    """For tables: cut without a mark, on one line."""
    return F.replace(F.left(c, F.lit(n)), F.lit("\n"), F.lit(" "))


def first_value(*aliases: Column) -> Column:
    """The first alias that is neither null nor empty."""
    return F.coalesce(*(F.nullif(a, F.lit("")) for a in aliases))


def first_int(*aliases: Column) -> Column:
    """first_value() as an integer; if that one is no number, null: later aliases aren't tried."""
    return first_value(*aliases).try_cast("int")


#: Country names.
COUNTRIES = {
    "СССР": "URSS",
    "CCCР": "URSS",
    "СССР(Эстония)": "RSS d'Estonie",
    "СССР(Молдавия)": "RSS moldave",
    "СССР(Украина)": "RSS d'Ukraine",
    "СССР(Казахстан)": "RSS kazakhe",
    "Россия": "Russie",
}


def country_name(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.element_at(names, c), c)
