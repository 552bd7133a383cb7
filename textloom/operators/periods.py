"""Clusters over periods, and the frames behind the charts. rows: idx, period, cluster (-1: noise), probability, x_2d, y_2d."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
TOP_CLUSTERS = 20
CORE_PROBABILITY = 0.8
BINS = 30


def coerce_clusters(raw: DataFrame) -> DataFrame:
    """Typed columns from text: bad numbers are null, a missing cluster is noise, a missing period "unknown"."""
    out = raw.withColumns({c: F.col(c).try_cast("double") for c in ("x_2d", "y_2d", "probability") if c in raw.columns})
    out = out.withColumns({"cluster": F.coalesce(F.col("cluster").try_cast("double").cast("int"), F.lit(-1)), "period": F.coalesce("period", F.lit("unknown"))})
    if "is_noise" in raw.columns:
        return out.withColumn("is_noise", F.lower(F.trim("is_noise")).isin("true", "1", "yes"))
    return out.withColumn("is_noise", F.col("cluster") == -1)


def clustered(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("cluster") != -1)


def cluster_sizes(rows: DataFrame) -> DataFrame:
    return clustered(rows).groupBy("cluster").agg(F.count("*").alias("n"))


def cluster_stats(rows: DataFrame) -> DataFrame:
    noise = F.count_if(F.col("cluster") == -1)
    return rows.agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        noise.alias("n_noise"),
        F.count_if(F.col("cluster") != -1).alias("n_clustered"),
        F.when(F.count("*") > 0, F.round(noise * 100.0 / F.count("*"), 2)).alias("noise_pct"),
    )


def period_totals(rows: DataFrame) -> DataFrame:
    """All rows, noise too."""
    return rows.groupBy("period").agg(F.count("*").alias("n"))


def period_distribution(rows: DataFrame) -> DataFrame:
    """period, cluster, n, pct: the share among the period's clustered rows, in percent to two places."""
    counts = clustered(rows).groupBy("period", "cluster").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy("period"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / whole, 2))


def dominant_clusters(rows: DataFrame) -> DataFrame:
    """The cluster of the largest rounded share per period; ties go to the lowest number."""
    order = W.partitionBy("period").orderBy(F.desc("pct"), "cluster")
    return period_distribution(rows).withColumn("place", F.row_number().over(order)).where("place = 1").select("period", "cluster", "pct")


def probability_summary(rows: DataFrame, high: float = 0.8, low: float = 0.5) -> DataFrame:
    p = F.col("probability")
    return clustered(rows).agg(
        F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"), F.count_if(p > high).alias("n_high"), F.count_if(p < low).alias("n_low")
    )


def top_clusters(rows: DataFrame, k: int = TOP_CLUSTERS) -> DataFrame:
    return cluster_sizes(rows).orderBy(F.desc("n"), "cluster").limit(k)


def core_points(rows: DataFrame, least: float = CORE_PROBABILITY, k: int = TOP_CLUSTERS) -> DataFrame:
    """Likely members of the k clusters that have most of them, and all noise: idx, cluster, layer."""
    likely = clustered(rows).where(F.coalesce("probability", F.lit(0.0)) >= least)
    core = likely.join(F.broadcast(top_clusters(likely, k).select("cluster")), "cluster", "left_semi")  # k rows
    noise = rows.where(F.col("cluster") == -1)
    cols = ["idx", "cluster"]
    return core.select(*cols, F.lit("core").alias("layer")).unionByName(noise.select(*cols, F.lit("noise").alias("layer")))


def points_by_period(rows: DataFrame) -> DataFrame:
    return rows.select("idx", "x_2d", "y_2d", F.when(F.col("cluster") == -1, F.lit("noise")).otherwise(F.col("period")).alias("layer"))


def probability_histogram(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """bin (from 0), n: equal bins from the least to the largest value, the last one closed; one value: 0.5 either way."""
    p = clustered(rows).where(F.col("probability").isNotNull()).select("probability")
    ends = p.agg(F.min("probability").alias("lo"), F.max("probability").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col("probability") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return p.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def heatmap(rows: DataFrame, k: int = TOP_CLUSTERS) -> DataFrame:
    """period, cluster, n, pct in long form for the k largest clusters: absent pairs are 0, the share is among these k.

    A period with no row in these clusters has shares of 0.
    """
    top = F.broadcast(top_clusters(rows, k).select("cluster"))  # k rows
    counts = clustered(rows).where("idx is not null").groupBy("period", "cluster").agg(F.count("*").alias("n"))
    grid = counts.select("period").distinct().join(top)
    full = grid.join(counts, ["period", "cluster"], "left").fillna(0, ["n"])
    whole = F.sum("n").over(W.partitionBy("period"))
    return full.withColumn("pct", F.when(whole > 0, F.col("n") * 100.0 / whole).otherwise(0.0))


def heatmap_wide(rows: DataFrame, k: int = TOP_CLUSTERS) -> DataFrame:
    """The same as one row per period with a column of shares per cluster, ascending."""
    ids = sorted(r["cluster"] for r in top_clusters(rows, k).collect())
    return heatmap(rows, k).groupBy("period").pivot("cluster", ids).agg(F.first("pct")).orderBy("period")


def color_ranks(rows: DataFrame) -> DataFrame:
    """A dense rank per cluster, which a palette is indexed by."""
    return cluster_sizes(rows).select("cluster", (F.dense_rank().over(W.orderBy("cluster")) - 1).alias("color"))
