"""Sorted runs: tables dealt over hash buckets of one key and sorted by it, which merge without being shuffled or sorted again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from textloom.session import release, scratch_dir, shuffles_removed

#: Lets a scan of buckets of one file each report the order the files are written in.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside know that the runs are sorted."""
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class Runs:
    """Writes runs of one key and merges them. All runs of one object have the same buckets, so a merge has no Exchange.

    A run is a table in the shared scratch folder, under a name in the session's catalog that close() drops; the files
    stay for whoever still reads a result.
    """

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key = spark, key
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a run: what was grouped by the key, or came from runs, lies in its buckets already."""
        name = f"textloom_{tag}_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark)}/{self.spark.sparkContext.applicationId}/{name}"
        with ordered_scans(self.spark), shuffles_removed(self.spark):
            df.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", path).saveAsTable(name)
        self.names.append(name)
        self.path = path
        return self.spark.table(name)

    def merged(self, a: DataFrame, b: DataFrame, columns: Iterable) -> DataFrame:
        """The merge of two runs with at most one row a key each, whose other columns are to be called a_x and b_x: a full outer merge join."""
        left = a.select(self.key, *(a[c].alias(f"a_{c}") for c in a.columns if c != self.key))
        right = b.select(self.key, *(b[c].alias(f"b_{c}") for c in b.columns if c != self.key))
        return left.hint("merge").join(right, self.key, "full_outer").select(self.key, *columns)

    def kept(self, run: DataFrame) -> DataFrame:
        """The run that was written last as a plain table, which outlives close()."""
        return self.spark.read.schema(run.schema).parquet(self.path)

    def close(self, files: bool = False) -> None:
        """Forget the runs; with `files` delete them too: no result reads them any more."""
        for name in self.names:
            if files:
                release(self.spark.table(name))
            self.spark.sql(f"drop table if exists `{name}`")
        self.names = []
