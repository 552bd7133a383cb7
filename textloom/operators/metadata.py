"""Metadata joins and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import count_tokens, country_name, normalize


def last_by_key(meta: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in the given order."""
    latest = W.partitionBy(key).orderBy(F.desc(order))
    return meta.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


def enrich(docs: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left join; broadcasting is left to the planner, which checks the size of meta."""
    return docs.join(meta, key, "left")


def missing_metadata(docs: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(meta, key, "left_anti").select(key)


def normalization_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: characters and lines before and after, change in percent, paragraphs after."""
    rows = docs.withColumn("_norm", normalize(F.col(text_col)))

    def lines(c: Column) -> Column:
        return F.size(F.split(c, "\n", -1))

    before, after = F.length(text_col), F.length("_norm")
    blocks = F.size(F.filter(F.split("_norm", "\n\n", -1), lambda p: p.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")))
    return rows.select(
        *[c for c in docs.columns if c != text_col],
        before.alias("original_chars"),
        after.alias("normalized_chars"),
        F.when(before == 0, 0.0).otherwise((before - after) * 100.0 / before).alias("reduction_pct"),
        lines(F.col(text_col)).alias("original_lines"),
        lines(F.col("_norm")).alias("normalized_lines"),
        blocks.alias("paragraphs"),
    )


def corpus_totals(stats: DataFrame) -> DataFrame:
    sums = stats.agg(*(F.sum(c).alias(c) for c in ("original_chars", "normalized_chars", "paragraphs")))
    return sums.withColumn("reduction_pct", F.when(F.col("original_chars") > 0, (F.col("original_chars") - F.col("normalized_chars")) * 100.0 / F.col("original_chars")).otherwise(0.0))


def subcorpora(docs: DataFrame, meta: DataFrame, key: str = "doc_id", country_col: str = "country", text_col: str = "text") -> DataFrame:
    """Per period: documents, words, and the sorted distinct country names; documents without metadata count too."""
    rows = docs.join(meta.select(key, F.col(country_col).alias("_country")), key, "left")
    names = F.array_sort(F.collect_set(country_name(F.nullif("_country", F.lit("")))))
    return rows.groupBy("period").agg(F.count("*").alias("n_docs"), F.sum(count_tokens(F.col(text_col))).alias("n_words"), F.array_join(names, ", ").alias("countries"))
