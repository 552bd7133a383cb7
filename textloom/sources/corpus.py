"""Reading corpora, metadata, JSON records and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import count_tokens, line_feeds
from textloom.operators.metadata import last_by_key

METADATA = "idx string, doc_id string, pays string, annee string, niveau string, auteur string, titre string"


def valid_text(content: Column) -> Column:
    """UTF-8 with bad bytes dropped. A replacement character that stands in the source itself is kept."""
    raw = content.cast("string")
    own = F.lit("\x00textloom\x00")  # stands for replacement characters of the source while bad bytes go
    guarded = F.replace(raw, F.lit("\ufffd"), own)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.replace(F.make_valid_utf8(guarded), F.lit("\ufffd"), F.lit("")), own, F.lit("\ufffd")))


def scan_corpus(spark: SparkSession, path: str, hidden: bool = False, lenient: bool = True) -> DataFrame:
    """period, doc_id, source_file, text of <path>/<period>/<doc_id>.txt.

    Other files and deeper folders don't count. Hidden folders are left out unless asked for, __pycache__ always.
    Lenient reading drops bad bytes; strict reading gives such files an empty text. Line ends become line feeds.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/*/*")
    name = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(name, "/")
    rows = files.select(F.element_at(parts, -2).alias("period"), F.element_at(parts, -1).alias("source_file"), "content")
    rows = rows.where((F.col("period") != "__pycache__") & ~F.startswith("source_file", F.lit(".")))
    if not hidden:
        rows = rows.where(~F.startswith("period", F.lit(".")))
    raw = F.col("content").cast("string")
    text = valid_text(F.col("content")) if lenient else F.when(F.is_valid_utf8(raw), raw).otherwise("")
    stem = F.regexp_replace("source_file", r"\.txt$", "") if not hidden else F.replace("source_file", F.lit(".txt"), F.lit(""))
    return rows.select("period", stem.alias("doc_id"), "source_file", line_feeds(text).alias("text"))


def count_folder_words(spark: SparkSession, path: str) -> DataFrame:
    """n_words of the *.txt directly in a folder."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").text(path, wholetext=True)
    return files.agg(F.coalesce(F.sum(count_tokens(F.col("value"))), F.lit(0)).alias("n_words"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per doc_id, the last one of the file; short rows are filled with nulls. Columns are found by the header."""
    header = spark.read.text(path).limit(1).first()
    names = [c.strip().lstrip("\ufeff") for c in header[0].split(",")] if header else []
    schema = ", ".join(f"`{c}` string" for c in names) or METADATA
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", multiLine=True, enforceSchema=True)
    return last_by_key(rows.withColumn("_at", F.monotonically_increasing_id()), "doc_id", "_at").drop("_at")


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of objects, or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """A table of clustered segments, coerced; the columns x_2d, y_2d, cluster and period must be there."""
    from textloom.operators.periods import coerce_clusters

    raw = spark.read.csv(path, header=True)
    if missing := [c for c in ("x_2d", "y_2d", "cluster", "period") if c not in raw.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return coerce_clusters(raw)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The bundle that sinks.write_embeddings() wrote; each vector must have its metadata and text."""
    rows = spark.read.parquet(path)
    if not rows.where("embedding is null or text is null").isEmpty():
        raise ValueError("vectors, metadata and texts differ in length")
    return rows


def optional_json(spark: SparkSession, path: str) -> DataFrame | None:
    """None where the file isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.json(path, multiLine=True) if there else None
