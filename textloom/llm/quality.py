"""Quality rules: base counts, and the divergence of a document from references of its language."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import materialize

WORD = re.compile("[^\x20\x09-\x0d]+")  # fixed value of the contract
SYMBOLS = "#*$%&|<>"  # fixed value of the contract
CLASSES = ["lower", "upper", "letter", "digit", "space", "stop", "mark", "other"]
STOPS = ".,;:!?"

#: Parameters of the method.
COMMON_WORDS = 40
MAX_REFERENCE_DOCS = 4000  # labelled documents of good quality, of a language, that its reference is fitted on
MIN_REFERENCE_WORDS = 2000  # a language with fewer has no reference: its documents get no verdict
MIN_WORDS = 50  # shorter documents get no verdict
LIMIT = 0.06  # of both divergences together, where no labelled documents of bad quality are there to fit it on
BINS = 500  # of the histograms that the limit is fitted on, each a thousandth of a bit wide


@lru_cache(1)
def class_table():
    """The class of each code point of the basic plane; beyond it: other."""
    import numpy as np

    table = np.full(65537, 7, np.uint8)
    for i in range(65536):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L" or kind[0] == "M":
            table[i] = {"Ll": 0, "Lu": 1}.get(kind, 2)
        elif kind[0] == "N":
            table[i] = 3
        elif chr(i).isspace():
            table[i] = 4
        elif kind[0] == "P" and chr(i) not in SYMBOLS:
            table[i] = 6
    for c in STOPS:
        table[ord(c)] = 5
    return table


def class_counts(text: str) -> list[int]:
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(class_table()[np.minimum(points, 65536)], minlength=8).tolist()


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, as the contract has them."""
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace() or WORD.search(line):
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(found := set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        reach = 0
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    del found
    return sum(map(len, words)), symbols, again, repeated


def plain_words(words: list[str]) -> Counter:
    """Words in lower case without the stops at their ends."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w.lower().strip(STOPS)] += n
    return out


def divergence(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon divergence in bits of two histograms; the distance is its square root."""
    a, b = sum(p), sum(q)
    if not a or not b:
        return 0.0
    out = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        out += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return max(out, 0.0)


def expected(kinds: int, n: int) -> float:
    """What a sample of n from the reference itself diverges by, roughly: (kinds - 1) / (8 n ln 2) bits."""
    return (kinds - 1) / (8 * max(n, 1) * math.log(2))


class References(dict):
    """{language: (class counts, [(common word, count)], words)}, and the limit of both divergences together."""

    limit: float = LIMIT


def fit_references(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", limit: int = MAX_REFERENCE_DOCS) -> References:
    """References from at most `limit` documents a language labelled as of good quality; the limit also from as many bad ones.

    Of the labelled documents with a text and a language, each language's are taken from the smallest hash of their ids
    on, so its reference does not depend on the labels of others. Hashes are taken by levels a 64th of an octave wide,
    a level whole or not at all. What comes to the driver is bounded by the number of languages: sums per language and
    its COMMON_WORDS most frequent words, and two histograms. Null labels count as none; rows that repeat an id, or
    labels that repeat, count each document once a label. Without labelled documents there are no references.
    """
    good = labels.where("quality is not null").select(F.col("doc_id").alias("labelled"), (F.col("quality") == 1).alias("good")).distinct()
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    there = usable.select("id", "lang").join(good, F.col("id") == F.col("labelled")).select("id", "lang", "good")
    level = F.floor(-64 * F.log2(F.shiftrightunsigned(F.xxhash64("id"), 11) / 2.0**53 + 2.0**-54))
    there = materialize(there.withColumn("level", level), "labelled")
    sums = there.groupBy("lang", "good", "level").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang", "good").orderBy(F.desc("level")))
    levels = sums.withColumn("upto", upto).where(F.col("upto") <= limit).select("lang", "good", "level")
    ids = there.join(levels, ["lang", "good", "level"], "left_semi").select("id", "good").distinct()
    chosen = materialize(usable.join(materialize(ids, "chosen"), "id"), "samples")  # `limit` documents a language and label

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # summed before they become rows, as a worker's memory counts
                part, sums = batch.slice(at, 256), Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, n in enumerate(class_counts(text)):
                        if n:
                            sums[lang, CLASSES[i], True] += n
                    for w, n in plain_words(WORD.findall(text)).items():
                        sums[lang, w, False] += n
                langs, names, kinds = zip(*sums) if sums else ((), (), ())
                columns = [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(sums.values(), pa.int64()), pa.array(kinds, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "name", "n", "is_class"])

    counted = chosen.where("good").selectExpr("cast(lang as string) as lang", "cast(text as string) as text").mapInArrow(count, "lang string, name string, n bigint, is_class boolean")
    sums = materialize(counted.groupBy("lang", "name", "is_class").agg(F.sum("n").alias("n")), "counts")
    place = W.partitionBy("lang", "is_class").orderBy(F.desc("n"), "name")  # the planner keeps COMMON_WORDS a task before the shuffle
    rows = sums.withColumn("place", F.row_number().over(place)).where(F.col("place") <= COMMON_WORDS).collect()
    totals = {r["lang"]: r["n"] for r in sums.where("not is_class").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    out = References()
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        classes = {r["name"]: r["n"] for r in own if r["is_class"]}
        words = sorted((r for r in own if not r["is_class"]), key=lambda r: r["place"])
        out[lang] = ([classes.get(c, 0) for c in CLASSES], [(r["name"], r["n"]) for r in words], totals.get(lang, 0))
    out.limit = fit_limit(chosen, out)
    return out


def best_limit(good: dict[int, int], bad: dict[int, int]) -> float:
    """The limit, in bins of a thousandth, of the fewest mistakes among both shares; of equal ones the middle."""
    if not bad or not good:
        return LIMIT
    g, b = sum(good.values()), sum(bad.values())
    wrong = []
    for at in range(BINS + 1):  # what lies in a bin of `at` or beyond is rejected
        lost = sum(n for x, n in good.items() if x >= at) / g
        kept = sum(n for x, n in bad.items() if x < at) / b
        wrong.append(round(lost + kept, 12))
    best = [at for at, x in enumerate(wrong) if x == min(wrong)]
    return (best[0] + best[-1]) / 2 / 1000


def fit_limit(chosen: DataFrame, references: dict) -> float:
    """best_limit() over chosen(text, lang, good): documents that the base rules fail, or that get no verdict, don't count."""
    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for text, lang, good in zip(*(column.to_pylist() for column in batch.slice(at, 256).columns)):
                    got = assess(text, lang, references)
                    known = references.get(lang)
                    if not got[5] and known and known[2] >= MIN_REFERENCE_WORDS:
                        rows.append((bool(good), min(BINS, int(1000 * (got[7] + got[8])))))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.bool_()), pa.array([x for _, x in rows], pa.int32())], ["good", "bin"])

    given = chosen.selectExpr("cast(text as string) as text", "cast(lang as string) as lang", "good")
    found = given.mapInArrow(score, "good boolean, bin int").groupBy("good", "bin").count().collect()  # 2 * BINS rows
    return best_limit(*({r["bin"]: r["count"] for r in found if r["good"] == kind} for kind in (True, False)))


def diverges(lang: str | None, classes: list[int], words: Counter, n_words: int, references: dict) -> tuple[float, float, bool]:
    """Both distances, less what chance explains, and whether the document is rejected."""
    known = references.get(lang)
    if known is None or known[2] < MIN_REFERENCE_WORDS or n_words < MIN_WORDS:
        return 0.0, 0.0, False
    by_class = divergence(classes, known[0]) - expected(len(CLASSES), sum(classes))
    common = [words.get(w, 0) for w, _ in known[1]]
    usual = [n for _, n in known[1]]
    by_word = divergence([*common, n_words - sum(common)], [*usual, known[2] - sum(usual)]) - expected(len(common) + 1, n_words)
    by_class, by_word = max(by_class, 0.0), max(by_word, 0.0)
    return by_class, by_word, by_class + by_word > getattr(references, "limit", LIMIT)


def assess(text: str | None, lang: str | None, references: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class and word divergence."""
    text = text or ""
    words = WORD.findall(text)
    counts = base_counts(text, words)
    failed = len(words) < 50 or 100 * counts[3] > 50 * len(words)
    by_class, by_word, rejected = (0.0, 0.0, False) if failed else diverges(lang, class_counts(text), plain_words(words), len(words), references)
    return (len(words), *counts, failed, not failed and not rejected, by_class, by_word)


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_divergence double, word_divergence double"


def assess_documents(docs: DataFrame, references: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col and the columns of SCHEMA.

    A document is kept unless the base rules fail it (under 50 words, or over half of its words in repeated windows of
    three) or its character classes and its common words diverge from its language's reference by more bits together than
    the fitted limit, above what its length explains. Languages without a reference get no verdict. A null text has no
    words and fails. Rows are independent: repeated rows and ties change nothing. Other columns of docs are ignored.
    """
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [assess(t, g, references) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [id_col, *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def keep_good(docs: DataFrame, references: dict, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are kept, all columns as they were; one narrow pass. Null texts fail the base rules and go."""
    import pyarrow as pa

    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = [assess(t, g, references)[6] for t, g in zip(part.column(text_at).to_pylist(), part.column(lang_at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
