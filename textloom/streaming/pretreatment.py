"""Normalization, segmentation and scoring over a stream: the same narrow plan, with counts per period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import normalize
from textloom.operators import lexicon, segment


def score_stream(docs: DataFrame, min_score: int = lexicon.MIN_SCORE) -> DataFrame:
    """docs: a stream of period, doc_id, text. No state: each document is cut and scored as it comes."""
    return lexicon.score_segments(segment.segments(docs.withColumn("text", normalize(F.col("text")))), min_score=min_score)


def retention_counts(scored: DataFrame) -> DataFrame:
    """Running counts per period; the state is one row per period."""
    return scored.groupBy("period").agg(F.count("*").alias("n_segments"), F.count("reason").alias("n_retained"))
