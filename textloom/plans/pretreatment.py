"""The whole chain: corpus and metadata to normalized, segmented, filtered and deduplicated segments; then vectors and clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import first_int, first_value, normalize
from textloom.operators import dedup, encoder, lexicon, metadata, periods, segment, vectors
from textloom.session import materialize

#: Names of the same field in several languages.
YEAR = ["year", "annee", "год"]
LEVEL = ["level", "niveau", "уровень"]
COUNTRY = ["country", "pays", "espace_narratif", "страна"]


def unified(meta: DataFrame) -> DataFrame:
    """doc_id, year, level, country under whatever names the table has."""

    def own(names: list[str]):
        found = [F.col(f"`{c}`").cast("string") for c in names if c in meta.columns]
        return found or [F.lit(None).cast("string")]

    return meta.select("doc_id", first_int(*own(YEAR)).alias("year"), first_value(*own(LEVEL)).alias("level"), first_value(*own(COUNTRY)).alias("country"))


@dataclass
class Pretreated:
    segments: DataFrame
    scored: DataFrame
    found: DataFrame
    kept: DataFrame
    log: DataFrame
    missing: DataFrame
    stats: dict[str, DataFrame]


def pretreat(docs: DataFrame, meta: DataFrame, min_score: int = lexicon.MIN_SCORE, all_years: bool = False, fuzzy_threshold: float = dedup.THRESHOLD, exact: bool = True, fuzzy: bool = True) -> Pretreated:
    """docs: period, doc_id, source_file, text. Up to the scores this is one narrow plan; it is written once."""
    clean = docs.withColumn("text", normalize(F.col("text")))
    segs = segment.segments(metadata.enrich(clean, unified(meta)))
    scored = materialize(lexicon.score_segments(segs, min_score=min_score, all_years=all_years), "scored")
    order = F.struct("period", "source_file", "paragraph_idx", "segment_idx")
    found = lexicon.retained(scored).withColumn("seq", order)
    kept, log = dedup.dedup(found, "seq", exact=exact, fuzzy=fuzzy, threshold=fuzzy_threshold)
    stats = {
        "normalization": metadata.normalization_stats(docs),
        "segmentation": segment.segmentation_stats(scored),
        "retention": lexicon.retention_stats(scored),
        "reasons": lexicon.reason_stats(scored),
        "categories": lexicon.category_stats(scored),
        "scores": lexicon.score_histogram(scored),
        "years": lexicon.year_frequency(lexicon.retained(scored)),
        "dedup": dedup.dedup_stats(found, log),
    }
    return Pretreated(scored.select(*segs.columns), scored, found, kept, log, metadata.missing_metadata(docs, meta), stats)


def cluster(rows: DataFrame, encode: Callable | None = None, reduce_dims: int | None = 50, **options) -> DataFrame:
    """rows (idx, period, text, ...) with embedding, cluster, probability, x_2d and y_2d.

    The reducer is principal components: deterministic, and linear in the rows. None clusters the raw vectors.
    """
    vecs = materialize(encoder.encode_documents(rows, encode or encoder.HashingEncoder()), "vectors")
    low = vectors.pca_project(vecs, reduce_dims, "idx") if reduce_dims else vecs.select("idx", F.col("embedding").alias("c"))
    flat = vectors.pca_project(vecs, 2, "idx").select("idx", F.get("c", F.lit(0)).alias("x_2d"), F.get("c", F.lit(1)).alias("y_2d"))
    labels = vectors.hdbscan_labels(low, "idx", "c", **options).withColumnRenamed("id", "idx")
    return vecs.join(labels, "idx").join(flat, "idx")


__all__ = ["Pretreated", "cluster", "periods", "pretreat", "unified"]
