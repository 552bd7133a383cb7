"""Writers. Parquet is the form between stages; CSV, JSON and text are for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import preview, truncate

INDEX = ["idx", "doc_id", "period", "year", "paragraph_idx", "segment_idx", "char_count", "word_count", "filter_score"]


def write_periods(rows: DataFrame, path: str) -> None:
    """Parquet by period, so that readers of one period read it alone."""
    rows.write.mode("overwrite").partitionBy("period").parquet(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header. one_file is for small reports only: it writes by one task."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str) -> None:
    """One text per row, partitioned by period."""
    rows.select("period", F.col("text").alias("value")).write.mode("overwrite").partitionBy("period").option("lineSep", "\n").text(path)


def write_bom_csv(rows: DataFrame, path: str, limit: int = 100_000) -> None:
    """A report in UTF-8 with a byte-order mark, by the driver, at a path of its own; `limit` rows at most."""
    import csv

    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; use write_csv()")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(found)


def number_rows(rows: DataFrame, order: list[str], period: bool = False) -> DataFrame:
    """idx from 0: over all rows, or from 0 in each period.

    Over all rows the number is the row's place in a range sort: counts per partition are summed, and each partition
    numbers its own rows, so no task sees them all.
    """
    if period:
        return rows.withColumn("idx", F.row_number().over(W.partitionBy("period").orderBy(*order)) - 1)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    counts = placed.groupBy("_part").count().collect()  # one row per partition
    first, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        first[r["_part"]] = total
        total += r["count"]
    table = F.create_map(*(F.lit(x) for p, n in first.items() for x in (p, n))) if first else F.create_map()
    offset = F.element_at(table, F.col("_part")) if first else F.lit(0)
    return placed.withColumn("idx", F.col("_at") + offset).drop("_part", "_at")


def write_embeddings(rows: DataFrame, path: str, per_period: bool = False) -> None:
    """Vectors with metadata and text as one table, and the index of nine columns as CSV."""
    writer = rows.withColumn("text_preview", truncate(F.col("text"), 200)).write.mode("overwrite")
    (writer.partitionBy("period") if per_period else writer).parquet(f"{path}/embeddings")
    write_csv(rows.select(*(c for c in INDEX if c in rows.columns)), f"{path}/index")


def write_clusters(rows: DataFrame, path: str) -> None:
    """segments_with_clusters: previews on one line, noise flag, coordinates to four and probability to four places."""
    from textloom.operators.periods import cluster_stats, period_distribution, period_totals, probability_summary

    out = rows.select(
        "idx",
        "cluster",
        (F.col("cluster") == -1).alias("is_noise"),
        F.round("probability", 4).alias("probability"),
        *[c for c in ("doc_id", "period", "year") if c in rows.columns],
        *[F.round(c, 4).alias(c) for c in ("x_2d", "y_2d")],
        preview(F.col("text")).alias("text_preview"),
    )
    write_csv(out, f"{path}/segments_with_clusters")
    for name, frame in (("stats", cluster_stats(rows)), ("distribution", period_distribution(rows)), ("totals", period_totals(rows)), ("probabilities", probability_summary(rows))):
        write_json(frame, f"{path}/{name}")
