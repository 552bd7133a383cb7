"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.runs import Runs, ordered_scans
from textloom.session import materialize, release, unused

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"  # fixed value of the contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case; lower() does that alone where all is ASCII."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(line: Column, least: int) -> Column:
    """128-bit hash of the line's key, in hex; null for keys under `least` code points."""
    return F.when(F.length(F.trim(line, F.lit(SPACE))) >= least, F.md5(line_key(line)))


def text_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


class LineRuns:
    """A store of line hashes: sorted runs in levels; each run holds (key, n, last).

    A key is born in the run of the first batch that holds it: the batch, summed per key, is merge-anti-joined with
    all runs, and what is left becomes a new run on level 0. What the runs hold already goes to the revisions as a
    small sum of its own. `fan_in` runs of one level are compacted into one on the next by merge joins, so there are few
    runs and each key is rewritten once a level. Runs lie in hash buckets and are sorted in them: neither an anti-join
    nor a compaction shuffles or sorts them.
    """

    def __init__(self, spark, fan_in: int = 2):
        self.store = Runs(spark, "key")
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = [[]]
        self.revisions: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """batch(doc, key): each document's distinct keys; documents of different batches differ."""
        own = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        known = [run for level in self.levels for run in level]
        if not known:
            self._push(0, self.store.write(own, "run"))
            return
        own = self.store.write(own, "batch")
        fresh = own
        for run in known:
            fresh = fresh.hint("merge").join(run.select("key"), "key", "left_anti")
        fresh = self.store.write(fresh, "run")
        self.revisions.append(self.store.write(own.hint("merge").join(fresh.select("key"), "key", "left_anti"), "revisions"))
        self._push(0, fresh)

    def _compacted(self, runs: list[DataFrame], tag: str) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:  # births are disjoint: each key has one side
            out = self.store.write(self.store.merged(out, run, [F.coalesce("a_n", "b_n").alias("n"), F.coalesce("a_last", "b_last").alias("last")]), tag)
        return out

    def _push(self, k: int, run: DataFrame) -> None:
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) == self.fan_in:
            whole, self.levels[k] = self._compacted(self.levels[k], f"level{k + 1}"), []
            self._push(k + 1, whole)

    def frequent(self, least_docs: int) -> DataFrame:
        """(key, n, last) of the keys found in at least `least_docs` documents."""
        births = self._compacted([run for level in self.levels for run in level], "births")
        if not self.revisions:
            return births.where(F.col("n") >= least_docs)
        more = self.revisions[0]
        for x in self.revisions[1:]:
            more = more.unionByName(x)
        more = more.groupBy("key").agg(F.sum("n").alias("n2"), F.max("last").alias("last2"))
        total = F.col("n") + F.coalesce("n2", F.lit(0))
        both = births.hint("merge").join(more, "key", "left")
        return both.select("key", total.alias("n"), F.greatest("last", "last2").alias("last")).where(F.col("n") >= least_docs)


def line_ledger(docs: DataFrame, id_col: str, text_col: str, least_chars: int, batches: int) -> DataFrame:
    """(batch, doc, key): the distinct keys of each document; rows that repeat an id are one document.

    Ids that repeat are looked for first, by the ids alone: only their rows need a distinct over (doc, key).
    """
    keys = F.array_compact(F.array_distinct(F.transform(F.split(text_of(docs, text_col), "\n", -1), lambda x: key_hash(x, least_chars))))
    doc = docs[id_col].cast("bigint")
    repeated = materialize(docs.groupBy(doc.alias("doc")).count().where("count > 1 and doc is not null").select("doc"), "repeated")

    def exploded(rows: DataFrame) -> DataFrame:
        cells = rows.where(doc.isNotNull()).select(doc.alias("doc"), F.explode(keys).alias("key"))
        return cells.select(F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), "doc", F.unhex("key").alias("key"))

    if repeated.isEmpty():
        return materialize(exploded(docs), "lines", ("batch",))
    again = repeated.withColumnRenamed("doc", unused(docs, "again"))
    same = doc == again[again.columns[0]]
    once = exploded(docs.join(again, same, "left_anti"))
    return materialize(once.unionByName(exploded(docs.join(again, same, "left_semi")).distinct()), "lines", ("batch",))


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int, batches: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The ledger of all documents' distinct keys, and the frequent keys by LineRuns."""
    ledger = line_ledger(docs, id_col, text_col, least_chars, batches)
    runs = LineRuns(docs.sparkSession, fan_in)
    try:
        for k in range(batches):
            runs.add(ledger.where(F.col("batch") == k).select("doc", "key"))
        with ordered_scans(docs.sparkSession):
            return ledger, materialize(runs.frequent(least_docs), "frequent")
    finally:
        runs.store.close(files=True)


def mark_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "lost_keys",
    least_chars: int = 20,
    least_docs: int = 3,
    batches: int = 4,
    fan_in: int = 2,
) -> DataFrame:
    """docs with out_col: the hashes (hex) of the keys whose lines this document loses; null where it loses none.

    A key is a line without white space at its ends and with A-Z in lower case. Keys of at least least_chars code
    points found in at least least_docs documents lose all their lines except in the document with the largest
    id. A null text counts as empty: one empty line. Rows that repeat an id are one document: a key counts once for
    them, and they all lose or keep it. Rows with a null id neither count nor lose lines. If docs has a column named
    out_col, it is replaced; no other name is used up. An empty table gives an empty result.

    The text is read once for the ledger of hashes and once for the result. A line that a large part of all
    documents hold is summed before it is shuffled; the join that finds its documents has two scanned sides, so
    that it can be split where it is skewed.
    """
    ledger, frequent = frequent_lines(docs, id_col, text_col, least_chars, least_docs, batches, fan_in)
    lost = ledger.join(frequent, "key").where("doc < last").select("doc", F.hex("key").alias("key"))
    lost = lost.groupBy("doc").agg(F.collect_set(F.lower("key")).alias("keys"))  # at most a document's own lines
    lost = materialize(lost, "lost")
    release(ledger, frequent)
    kept = [docs[c] for c in docs.columns if c.lower() != out_col.lower()]
    return docs.join(lost, docs[id_col].cast("bigint") == lost["doc"], "left").select(*kept, lost["keys"].alias(out_col))


def kept_lines(text: Column, drop: Column, least_chars: int = 20) -> Column:
    """The lines of text that stay, in order. Texts without losses aren't hashed again."""
    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drop, key_hash(x, least_chars)), F.lit(False)))
    return F.when(drop.isNull(), lines).otherwise(stays)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, **options) -> DataFrame:
    """docs, all columns as they were, with the text of the lines that stay, joined by newlines; see mark_lines().

    Texts that lose no line stay as they are, null ones null.
    """
    drop = unused(docs, "lost_keys")
    marked = mark_lines(docs, id_col, text_col, drop, least_chars, **options)
    left = F.array_join(kept_lines(F.col(text_col), F.col(drop), least_chars), "\n")
    return marked.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(left)).drop(drop)
