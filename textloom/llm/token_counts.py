"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.word_tokens import chunk_tokenizer, default_path

GROUP = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, version: str = "word_bpe_49k", path: str | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, lang, tokenizer_version, n_tokens.

    A null or empty text has 0 tokens; null sources and languages stay null and form groups of their own. Repeated
    rows and rows with null ids are counted each; other columns of docs are ignored; an empty table gives no rows. A narrow
    pass, with no shuffle.
    """
    import pyarrow as pa

    def run(batches):
        tokenizer = chunk_tokenizer(path or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = [len(tokenizer.encode(t)) // 4 for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = given.mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("bigint").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Revised counts: what the documents had goes out, what they have now comes in. The group may change too."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that all executors share, kept up by signed batches.

    A commit sums a batch's signed rows per group (summed before the shuffle, so a source with a third of all rows is
    no burden) into a folder of its own and then renames a small record file, which names that folder, to the batch's
    name. The rename is the commit: it fails where the record is there already, so of two committers of a batch one
    wins and the other's sums are deleted, and a commit that broke off leaves only files that nothing reads.

    Every `compact_after` commits the totals are written anew as a snapshot, which names the batches it holds and is
    committed the same way; reading takes the latest snapshot and the few batches after it. Batches may come in any order.
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 4):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.Path("/".join((self.root, *parts)))

    def _names(self, folder: str) -> list[str]:
        there = self._fs.exists(self._path(folder))
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder))) if there else []

    def _record(self, folder: str, name: str) -> dict:
        stream = self._fs.open(self._path(folder, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, folder: str, name: str, record: dict) -> bool:
        """Puts a whole record under a name that is free, or nothing."""
        pending = self._path("pending", uuid.uuid4().hex)
        stream = self._fs.create(pending)
        stream.write(json.dumps(record).encode())
        stream.close()
        self._fs.mkdirs(self._path(folder))
        if not self._fs.exists(self._path(folder, name)) and self._fs.rename(pending, self._path(folder, name)):
            return True
        self._fs.delete(pending, False)
        return False

    def _write(self, rows: DataFrame) -> str:
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{data}")
        return data

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path("batches", batch))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """False, and nothing computed, if the batch is there already. A batch without rows is committed like any other."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch is named by letters, digits, - and _, not {batch!r}")
        if self.committed(batch):
            return False
        data = self._write(summed(deltas))
        if not self._publish("batches", batch, {"data": data}):
            self._fs.delete(self._path(data), True)
            return False
        if len(self._names("batches")) - len(self._snapshot()["batches"]) >= self.compact_after:
            self.compact()
        return True

    def _snapshot(self) -> dict:
        names = self._names("snapshots")
        return {"number": int(names[-1]), **self._record("snapshots", names[-1])} if names else {"number": 0, "data": None, "batches": []}

    def _state(self) -> tuple[dict, list[str], DataFrame | None]:
        last = self._snapshot()
        held = set(last["batches"])
        new = [b for b in self._names("batches") if b not in held]
        folders = [x for x in (last["data"], *(self._record("batches", b)["data"] for b in new)) if x]
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{x}" for x in folders)) if folders else None
        return last, new, rows

    def compact(self) -> bool:
        """The totals as a snapshot; False if there is nothing new or another one was quicker."""
        last, new, rows = self._state()
        if not new:
            return False
        data = self._write(summed(rows))
        if self._publish("snapshots", f"{last['number'] + 1:09d}", {"data": data, "batches": [*last["batches"], *new]}):
            return True
        self._fs.delete(self._path(data), True)
        return False

    def totals(self) -> DataFrame:
        """One row per group with documents or tokens left; none before the first commit."""
        rows = self._state()[2]
        return self.spark.createDataFrame([], SCHEMA) if rows is None else summed(rows)


def summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")
