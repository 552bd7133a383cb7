"""Secret scanning: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as column expressions. Spark has no function that gives the places of all matches of a pattern, so
places are counted from the gaps (split) and the matches (regexp_extract_all) of one pattern, which interleave.
"""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import unused

# Fixed values of the contract: kinds in order, patterns, least lengths.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # all of AKIA[A-Z0-9]+ that have 16 characters or more: a run is taken whole either way
HEX = r"[0-9a-f]{32,}"  # all maximal runs of 32 or more
LEAST_VALUE = 8

#: What the Markov models are asked about: long runs of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_CANDIDATE = 20
#: Items of a block of running().
BLOCK = 256


def random_samples(n: int = 600) -> list[str]:
    """Labelled samples of the class random: digests of a counter written in hex, base 64, base 32 and base 62."""
    out = []
    for i in range(n):
        raw = hashlib.sha512(f"sample {i}".encode()).digest()
        size = 20 + i % 29
        forms = (
            raw.hex(),
            base64.b64encode(raw).decode(),
            base64.b32encode(raw).decode().rstrip("="),
            base64.urlsafe_b64encode(raw).decode().rstrip("="),
            "".join(ALPHABET[b % 62] for b in raw),
        )
        out.append(forms[i % len(forms)][:size])
    return out


#: Words that ordinary identifiers are built from.
STEMS = (
    "account address after before block buffer build cache client column config content context count create current "
    "data date default delete document driver element entry error event field file filter first folder format frame "
    "function group handler header image index input install instance item label language last length level library "
    "license line list load local manager message method model module name network next node number object option "
    "order output package page parameter parent parser path pattern point position process project property query "
    "queue reader record remote report request resource response result return schema script search section select "
    "server service session setting shared source start state status storage stream string style system table target "
    "template text thread time title token type update user value version view window worker writer"
).split()
ENDINGS = ("", "s", "ing", "ed", "er", "tion", "ation", "ment", "ness", "able", "ly", "ity", "ism", "heit", "keit", "ung", "eaux", "idad")


def identifier_samples(n: int = 3000) -> list[str]:
    """Labelled samples of the class ordinary: identifiers, paths, dates and ruled lines, by a fixed walk over STEMS."""
    out, k = [], len(STEMS)
    for i in range(n):
        words = [STEMS[(i * 7 + j * (11 + i % 13)) % k] + ENDINGS[(i + j * 5) % len(ENDINGS)] for j in range(2 + i % 3)]
        forms = (
            "_".join(words),
            words[0] + "".join(w.capitalize() for w in words[1:]),
            "/".join(words),
            "-".join(words),
            "".join(words),
            "_".join(words).upper(),
            "-".join(words) + f"-20{i % 100:02d}-{1 + i % 12:02d}-{1 + i % 28:02d}",
            "".join(w.capitalize() for w in words) + str(i % 100),
            ("-", "=", "_", "/")[i // 9 % 4] * (20 + i % 40),
        )
        out.append(forms[i % len(forms)])
    return out


def train(random: list[str], ordinary: list[str], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio, in nats, of each bigram: ln P(b | a, random) - ln P(b | a, ordinary), row by row.

    The rows are the characters of ALPHABET and, last, the start. Both models are first-order Markov chains over the
    same alphabet with additive smoothing; characters outside it don't occur in candidates.
    """
    n, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}

    def chain(samples: list[str]) -> list[list[float]]:
        counts = [[smooth] * n for _ in range(n + 1)]
        for s in samples:
            row = n
            for c in s:
                if c in place:
                    counts[row][place[c]] += 1
                    row = place[c]
        return [[math.log(x / sum(row)) for x in row] for row in counts]

    return [round(a - b, 4) for x, y in zip(chain(random), chain(ordinary)) for a, b in zip(x, y)]


def log_ratio(token: str, model: list[float]) -> float:
    """Mean log-likelihood ratio per character: the plain form of ratio_column(), for tests."""
    n, row, total = len(ALPHABET), len(ALPHABET), 0.0
    for c in token:
        i = ALPHABET.index(c)
        total += model[row * n + i]
        row = i
    return total / len(token) if token else 0.0


def ratio_column(token: Column, model: list[float]) -> Column:
    """log_ratio() as a column expression. The model is one string literal, split once by constant folding."""
    n = len(ALPHABET)
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def step(state: Column, i: Column) -> Column:
        return F.struct(i.alias("row"), (state["total"] + F.get(weights, state["row"] * n + i)).alias("total"))

    start = F.struct(F.lit(n).alias("row"), F.lit(0.0).alias("total"))
    return F.aggregate(F.filter(place, lambda i: i >= 0), start, step, lambda s: s["total"]) / F.length(token)


def running(items: Column, zero: Column, step) -> Column:
    """The state before each item of a fold of items by `step`, which starts from zero.

    A fold that appends copies its array at every item, so items are taken in blocks: one fold gives the state before
    each block, and each block is folded from there. For n items that copies n * BLOCK states, not n * n.
    """
    def fold(part: Column, start: Column, nxt) -> Column:
        first = F.struct(start.alias("at"), F.slice(F.array(start), F.lit(1), F.lit(0)).alias("seen"))
        return F.aggregate(part, first, lambda s, x: F.struct(nxt(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")), lambda s: s["seen"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    blocks = F.when(F.size(items) > 0, F.transform(numbers, lambda k: F.slice(items, k * BLOCK + F.lit(1), F.lit(BLOCK)))).otherwise(F.slice(F.array(items), F.lit(1), F.lit(0)))
    starts = fold(blocks, zero, lambda at, part: F.aggregate(part, at, step))
    return F.flatten(F.zip_with(blocks, starts, lambda part, at: fold(part, at, step)))


def matches(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """All leftmost non-overlapping matches of pattern as array<struct<start, end, g0, ...>>, places in code points."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), *[F.regexp_extract_all(text, p, F.lit(g)).alias(f"g{g}") for g in {0, *groups}])

    def placed(m: Column, at: Column) -> Column:
        start = at + m["gap"]
        return F.struct(start.alias("start"), (start + F.length(m["g0"])).alias("end"), *[m[f"g{g}"].alias(f"g{g}") for g in groups])

    def all_placed(found: Column) -> Column:
        return F.zip_with(found, running(found, F.lit(0), lambda at, m: at + m["gap"] + F.length(m["g0"])), placed)

    kind = "array<struct<start:int,end:int," + ",".join(f"g{g}:string" for g in groups) + ">>"
    # The one-element array binds the parts, which are named several times.
    bound = F.get(F.transform(F.array(parts), all_placed), F.lit(0))
    return F.when(F.regexp_count(text, p) > 0, bound).otherwise(F.array().cast(kind))


def spans_column(text: Column, model: list[float], threshold: float) -> Column:
    """Spans of all kinds as array<struct<start, rank, end>>, sorted by start, then by kind as listed in KINDS."""

    def kind(found: Column, rank: int, ok) -> Column:
        return F.transform(
            F.filter(found, ok), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))
        )

    return F.array_sort(
        F.concat(
            kind(matches(text, ASSIGN, (2,)), 0, lambda m: F.length(m["g2"]) >= LEAST_VALUE),
            kind(matches(text, ACCESS), 1, lambda m: F.lit(True)),
            kind(matches(text, HEX), 2, lambda m: F.lit(True)),
            kind(matches(text, CANDIDATE), 3, lambda m: ratio_column(m["g0"], model) > threshold),
        )
    )


def scan_secrets(
    docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", model: list[float] | None = None, threshold: float = 0.45
) -> DataFrame:
    """docs with out_col: array<struct<start, rank, end>> of all secrets in the whole text; rank indexes KINDS.

    A null or empty text has no spans. Spans of different kinds may overlap; each kind's own don't. A projection
    only: no shuffle, and rows are independent, so repeated rows, ties and extra columns change nothing. If docs has
    a column named out_col, it is replaced.
    """
    model = train(random_samples(), identifier_samples()) if model is None else model
    return docs.withColumn(out_col, spans_column(F.coalesce(docs[text_col], F.lit("")), model, threshold))


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **scan) -> DataFrame:
    """docs with every secret replaced by mask; overlapping spans become one mask. Texts without secrets, null ones too, stay as they are.

    All other columns stay, whatever their names; rows are independent, so repeated rows change nothing.
    """
    out = unused(docs, "secret_spans")
    text = F.col(text_col)

    def piece(s: Column, at: Column) -> Column:
        before = F.substring(text, at + 1, s["start"] - at)
        return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(before, F.lit(mask)))

    ends = running(F.col(out), F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    last = F.array_max(F.transform(out, lambda s: s["end"]))
    done = F.concat(F.array_join(F.zip_with(out, ends, piece), ""), F.substring(text, last + 1, F.length(text)))
    return scan_secrets(docs, text_col, out, **scan).withColumn(text_col, F.when(F.size(out) > 0, done).otherwise(text)).drop(out)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


