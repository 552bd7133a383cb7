"""Reports for reading by people: samples of bounded size with running numbers, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import comparison_form, truncate
from textloom.operators import lexicon
from textloom.operators.dedup import MIN_LENGTH

#: Sizes of the samples.
SAMPLE = 50
TOP_YEARS = 20
FIRST_PAIRS = 100
LOW_PAIRS = 50
LOW = 0.9


def first_rows(rows: DataFrame, section: str, order: list, n: int) -> DataFrame:
    """The first n rows in an order with a section name and a place from 1; n rows are all that one task numbers."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("section", F.lit(section)).withColumn("place", F.row_number().over(W.orderBy(*order)))


def quality_report(scored: DataFrame, keys: list[str], min_score: int = lexicon.MIN_SCORE, n: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Samples of a filter's results: section, place, keys, score, reason, text (300 characters).

    Sections: top_scoring, borderline (retained with just min_score), rejected_date_only, random_retained and
    random_rejected (by a seeded hash of the keys). Ties go by the keys.
    """
    kept, gone = lexicon.retained(scored), lexicon.rejected(scored)
    sections = [
        first_rows(kept, "top_scoring", [F.desc("score"), *keys], n),
        first_rows(kept.where(F.col("score") == min_score), "borderline", keys, n),
        first_rows(lexicon.date_only(scored, min_score), "rejected_date_only", keys, n),
        first_rows(kept, "random_retained", [lexicon.sample_order(keys, seed), *keys], n),
        first_rows(gone, "random_rejected", [lexicon.sample_order(keys, seed), *keys], n),
    ]
    cols = ["section", "place", *keys, "score", "reason", truncate(F.col("text"), 300).alias("text")]
    return reduce(DataFrame.unionByName, (s.select(*cols) for s in sections))


def quality_counts(scored: DataFrame, min_score: int = lexicon.MIN_SCORE) -> DataFrame:
    """One row of totals beside the samples."""
    kept = F.col("reason").isNotNull()
    return scored.agg(
        F.count_if(kept).alias("total_retained"),
        F.count_if(~kept).alias("total_rejected"),
        F.count_if(kept & (F.col("score") == min_score)).alias("borderline_total"),
        F.count_if(~F.col("strong") & (F.col("n_key_years") > 0)).alias("date_only_total"),
    )


def top_years(scored: DataFrame, n: int = TOP_YEARS, text_col: str = "text") -> DataFrame:
    """The years, any of three centuries, that stand in most rejected segments: place, year, n; ties by year."""
    years = scored.where("reason is null").select(lexicon.distinct_matches(F.col(text_col), lexicon.ANY_YEAR).alias("years"))
    found = first_rows(lexicon.year_frequency(years, "years"), "years", [F.desc("n"), "year"], n)
    return found.select("place", "year", "n")


def duplicate_samples(log: DataFrame, rows: DataFrame, seq_col: str, text_col: str = "text", period_col: str = "period") -> DataFrame:
    """The first removed pairs: section (exact, fuzzy, fuzzy_low), place, removed_seq, kept_seq, similarity, and both texts and forms, cut."""
    log = log.withColumn("similarity", F.round("similarity", 3))
    fuzzy = log.where("method = 'fuzzy'")
    order = ["period", "removed_seq"]
    sections = [
        first_rows(log.where("method = 'exact'"), "exact", order, FIRST_PAIRS),
        first_rows(fuzzy, "fuzzy", order, FIRST_PAIRS),
        first_rows(fuzzy.where(F.col("similarity") < LOW), "fuzzy_low", order, LOW_PAIRS),
    ]
    pairs = reduce(DataFrame.unionByName, sections).select("section", "place", "period", "removed_seq", "kept_seq", "similarity")
    texts = rows.select(F.coalesce(period_col, F.lit("unknown")).alias("period"), F.col(seq_col).alias("seq"), F.col(text_col).alias("text"))
    for side in ("removed", "kept"):
        form = truncate(comparison_form(F.col("text")), 100)
        own = texts.select("period", F.col("seq").alias(f"{side}_seq"), truncate(F.col("text")).alias(f"{side}_text"), form.alias(f"{side}_form"))
        pairs = pairs.join(own, ["period", f"{side}_seq"], "left")
    return pairs


def fuzzy_counters(rows: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """What the fuzzy pass leaves out: texts that are missing, empty in comparison form, or too short; and what it compares."""
    length = F.length(comparison_form(F.col(text_col)))
    return rows.agg(
        F.count_if(F.col(text_col).isNull()).alias("n_invalid"),
        F.count_if(length == 0).alias("n_empty"),
        F.count_if((length > 0) & (length < min_length)).alias("n_short"),
        F.count_if(length >= min_length).alias("n_compared"),
    )


def embedding_stats(rows: DataFrame, vec_col: str = "embedding", seconds: float | None = None) -> DataFrame:
    """Per period and, with a null period, in all: n and the vectors' dim; with `seconds` the throughput of the whole."""
    sums = rows.rollup("period").agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("dim"))
    return sums if seconds is None else sums.withColumn("per_second", F.when(F.col("period").isNull(), F.col("n") / F.lit(seconds)))


