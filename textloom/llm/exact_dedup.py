"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.runs import Runs
from textloom.session import materialize, unused

RUNS = 8


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def tree_merge(rows: DataFrame, keep: str, runs: int) -> DataFrame:
    """(digest, best, size) of rows(run, digest, best): `best` is the least or largest of the digest's, size its rows.

    The rows of each run, summed before they are shuffled, become a table sorted by digest. Then, in binomial rounds,
    each two neighbouring runs merge into one: a merge join of two sorted tables, without Exchange or Sort, that retains
    one identifier and one sum a digest. A text that a third of all rows hold is one row in each run.
    """
    pick, pick2 = (F.min, F.least) if keep == "smallest" else (F.max, F.greatest)
    store = Runs(rows.sparkSession, "digest")
    try:
        level = []
        for k in range(runs):
            own = rows.where(F.col("run") == k).groupBy("digest").agg(pick("best").alias("best"), F.count("*").alias("size"))
            level.append(store.write(own, f"digests{k}"))
        size = F.coalesce("a_size", F.lit(0)) + F.coalesce("b_size", F.lit(0))
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [
                store.write(store.merged(*pair, [pick2("a_best", "b_best").alias("best"), size.alias("size")]), "digests") if len(pair) == 2 else pair[0]
                for pair in pairs
            ]
        return store.kept(level[0])
    finally:
        store.close()


def collided(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The digests of groups that texts(digest, text) with different bytes share. Only texts with copies are compared."""
    copies = texts.join(groups.where("size > 1").select("digest"), "digest", "left_semi")
    ends = copies.groupBy("digest").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    return ends.where("first <> last").select("digest")


def grouped(rows: DataFrame, keep: str, runs: int, digest: Callable[[Column], Column]) -> DataFrame:
    """rows(best, text, ...) without text, with digest, winner (the best of the rows of the same text) and size.

    `best` is an orderable struct. Equal digests are verified by their bytes; should texts differ, the digest gives way
    to the text itself.
    """
    keyed = rows.withColumn("digest", digest(F.col("text")))
    slim = materialize(keyed.drop("text").withColumn("run", F.pmod(F.xxhash64("best"), F.lit(runs)).cast("int")), "digests")
    groups = tree_merge(slim, keep, runs)
    bad = materialize(collided(keyed.select("digest", "text"), groups), "collided")
    if not bad.isEmpty():
        parted = keyed.join(bad.withColumnRenamed("digest", "bad"), F.col("digest") == F.col("bad"), "left")
        split = F.when(F.col("bad").isNull(), F.col("digest")).otherwise(F.concat(F.col("digest"), F.encode("text", "UTF-8")))
        slim = materialize(parted.withColumn("digest", split).drop("text", "bad").withColumn("run", F.pmod(F.xxhash64("best"), F.lit(runs)).cast("int")), "digests")
        groups = tree_merge(slim, keep, runs)
    return slim.drop("run").join(groups.withColumnRenamed("best", "winner"), "digest")


def ranked(identifier: Column, keep: str, *ties: Column) -> Column:
    """A struct whose least (smallest) or largest value is the row that stays; null identifiers come last."""
    known = identifier.isNull() if keep == "smallest" else identifier.isNotNull()
    return F.struct(known.alias("known"), identifier.alias("id"), *ties)


def text_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    runs: int = RUNS,
    digest: Callable[[Column], Column] = text_digest,
) -> DataFrame:
    """One row per document with the group of documents that have the same text, by tree_merge().

    Columns: id_col, keep_id, group_size, kept, text_sha256. A null text counts as empty. keep is "smallest" or
    "largest". Texts are equal when their bytes are: digests only find them. Repeated rows of one id are counted each in
    group_size, and all those with the text it stays for are marked kept. Rows with a null id stay only if the whole
    group has null ids. Other columns of docs are ignored; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = text_of(docs, text_col)
    rows = docs.select(ranked(docs[id_col], keep).alias("best"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    if digest is text_digest:
        rows = rows.drop("sha")
    found = grouped(rows, keep, runs, digest)
    sha = F.lower(F.hex(F.substring("digest", 1, 32))) if digest is text_digest else F.col("sha")
    return found.select(
        F.col("best.id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("best.id").eqNullSafe(F.col("winner.id")).alias("kept"),
        sha.alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, digest: Callable[[Column], Column] = text_digest) -> DataFrame:
    """One row of docs for each different text, all columns as they were.

    Of the rows of a text, the one with the smallest (or largest) id stays; of rows that repeat that id too, one; rows
    with a null id only where there are no others. Null texts count as empty. An empty table gives an empty result. The
    rows are written once with a number of their own, so that rows alike in all columns can be told apart.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    row = unused(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    tie = F.col(row) if keep == "smallest" else -F.col(row)
    rows = numbered.select(ranked(numbered[id_col], keep, tie.alias("tie")).alias("best"), text_of(numbered, text_col).alias("text"))
    stay = grouped(rows, keep, runs, digest).where(F.col("best").eqNullSafe(F.col("winner")))
    stay = materialize(stay.select((F.col("winner.tie") if keep == "smallest" else -F.col("winner.tie")).alias("stays")), "stay")
    return numbered.join(stay, numbered[row] == stay["stays"], "left_semi").drop(row)
