"""One query per operator group, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html, text
from textloom.operators import dedup, encoder, lexicon, metadata, periods, reports, segment, vectors
from textloom.plans.dirty import DIRTY
from textloom.session import materialize, spread

KEYS = ["doc_id", "paragraph_idx", "segment_idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the language as the period."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("period"), "text")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang as period", f"{DIRTY} as text")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).withColumn("text", text.normalize(F.col("text")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(normalized(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the reports read the scores several times, and segmentation isn't worth repeating."""
    return materialize(lexicon.score_segments(segments(spark, sf_dir)), "scored")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a derived period, label as cluster (some made noise) and a derived probability."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("p"), F.col("vec_id") % 5).alias("period"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
        ((F.col("vec_id") * 37 % 101) / 100.0).alias("probability"),
    )


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def q_text_scalars(s: SparkSession, d: str) -> DataFrame:
    form = text.comparison_form(F.col("text"))
    return documents(s, d).select("doc_id", F.md5(form).alias("form_md5"), text.truncate(F.col("text")).alias("short"), text.preview(F.col("text")).alias("line"), F.size(text.ngrams(form)).alias("n_grams"))


def q_subcorpora(s: SparkSession, d: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 0
    country = F.when(good & toxic, "Россия").when(good, "СССР").otherwise(F.concat(F.lit("c"), "toxic"))
    return metadata.subcorpora(documents(s, d), table(s, d, "labels").select("doc_id", country.alias("country")))


def q_years(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d)
    kept = lexicon.year_frequency(lexicon.retained(rows)).withColumn("kept", F.lit(True))
    return kept.unionByName(lexicon.year_frequency(rows.where("reason is null")).withColumn("kept", F.lit(False)))


def q_union(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, n).select(F.lit(n).alias("source"), "text") for n in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def q_dedup_stats(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d)
    return rounded(dedup.dedup_stats(rows, dedup.dedup(rows, "doc_id")[1]), "removed_pct")


def q_knn(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings")
    return rounded(vectors.knn_cosine(rows.where("vec_id % 50 = 0"), rows, 5), "cosine")


def q_pca(s: SparkSession, d: str) -> DataFrame:
    rows = vectors.pca_project(table(s, d, "embeddings"), 2)
    return rows.select("vec_id", F.round(F.get("c", F.lit(0)), 6).alias("x"), F.round(F.get("c", F.lit(1)), 6).alias("y"))


def q_hdbscan(s: SparkSession, d: str) -> DataFrame:
    rows = vectors.hdbscan_labels(table(s, d, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "cluster", F.round("probability", 6).alias("probability"))


def q_encode(s: SparkSession, d: str) -> DataFrame:
    rows = encoder.encode_documents(documents(s, d), encoder.HashingEncoder(256))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


def q_html(s: SparkSession, d: str) -> DataFrame:
    return html.page_text(table(s, d, "pages")).select("page_id", F.size("paragraphs").alias("n_paragraphs"), F.md5("text").alias("text_md5"))


def first_pairs(s: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_exact(documents(s, d), "doc_id")


def q_duplicate_samples(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d)
    found = reports.duplicate_samples(dedup.dedup(rows, "doc_id")[1], rows, "doc_id")
    return found.select("section", "place", "period", "removed_seq", "kept_seq", "similarity", *(F.md5(c).alias(c) for c in ("removed_text", "kept_text", "removed_form", "kept_form")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_docs": lambda s, d: normalized(s, d).select("doc_id", F.md5("text").alias("norm_md5"), F.length("text").alias("norm_len")),
    "normalize_ocr_repair": lambda s, d: documents(s, d).where("text is not null").select("doc_id", text.repair_breaks(F.concat(F.replace("text", F.lit("\n"), F.lit("")), F.lit("§ 12 раздел"))).alias("y")).select("doc_id", (F.size(F.split("y", "\n", -1)) - 1).alias("n_breaks"), F.md5("y").alias("text_md5")),
    "normalization_stats": lambda s, d: rounded(metadata.normalization_stats(dirty(s, d)), "reduction_pct"),
    "corpus_totals": lambda s, d: metadata.corpus_totals(metadata.normalization_stats(dirty(s, d))).select("original_chars", "normalized_chars"),
    "word_counts": lambda s, d: documents(s, d).select("doc_id", text.count_words(F.col("text")).alias("n_regex"), text.count_tokens(F.col("text")).alias("n_ws")),
    "folder_words": lambda s, d: documents(s, d).agg(F.sum(text.count_tokens(F.col("text"))).alias("n_words")),
    "text_scalars": q_text_scalars,
    "paragraphs": lambda s, d: segment.explode_paragraphs(normalized(s, d)).select("doc_id", "paragraph_idx", text.count_words(F.col("paragraph")).alias("n_words"), F.md5("paragraph").alias("text_md5")),
    "sentences": lambda s, d: normalized(s, d).select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("sent_idx", "text")),
    "segments": lambda s, d: segments(s, d).select(*KEYS, F.md5("text").alias("text_md5"), "char_count", "word_count", "sentence_count"),
    "segmentation_stats": lambda s, d: rounded(segment.segmentation_stats(segments(s, d)), "avg_words"),
    "metadata_enrich": lambda s, d: metadata.enrich(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels")),
    "metadata_missing": lambda s, d: metadata.missing_metadata(table(s, d, "documents"), table(s, d, "labels")),
    "subcorpora": q_subcorpora,
    "lexicon_counts": lambda s, d: scored(s, d).select(*KEYS, *(f"n_{c}" for c in lexicon.PATTERNS), "n_key_years", F.array_join("key_years", ",").alias("years")),
    "lexicon_filter": lambda s, d: lexicon.retained(scored(s, d)).select(*KEYS, "score", "reason"),
    "lexicon_rejected": lambda s, d: lexicon.rejected(scored(s, d)).select(*KEYS, "score", F.array_join("matched_categories", ",").alias("matched")),
    "date_only": lambda s, d: lexicon.date_only(scored(s, d)).select(*KEYS, "date_points", "date_strong", "date_reason"),
    "filter_retention": lambda s, d: rounded(lexicon.retention_stats(scored(s, d)), "retention_pct"),
    "filter_stats_reason": lambda s, d: rounded(lexicon.reason_stats(scored(s, d)), "pct"),
    "filter_stats_category": lambda s, d: lexicon.category_stats(scored(s, d)),
    "filter_stats_bucket": lambda s, d: lexicon.score_histogram(scored(s, d)),
    "filter_stats_years": q_years,
    "top_scoring": lambda s, d: lexicon.top_scoring(scored(s, d), KEYS).select(*KEYS, "score"),
    "borderline": lambda s, d: lexicon.borderline(scored(s, d), KEYS).select(*KEYS, "score"),
    "sample_retained": lambda s, d: lexicon.sample_rows(lexicon.retained(scored(s, d)), KEYS).select(*KEYS, "score"),
    "quality_report": lambda s, d: reports.quality_report(scored(s, d), KEYS).select("section", "place", *KEYS, "score", F.md5("text").alias("text_md5")),
    "quality_counts": lambda s, d: reports.quality_counts(scored(s, d)),
    "top_years_rejected": lambda s, d: reports.top_years(scored(s, d)),
    "duplicate_samples": q_duplicate_samples,
    "fuzzy_counters": lambda s, d: reports.fuzzy_counters(first_pairs(s, d)),
    "embedding_stats": lambda s, d: reports.embedding_stats(table(s, d, "embeddings").withColumn("period", F.concat(F.lit("p"), F.col("vec_id") % 5))),
    "dedup_exact": lambda s, d: dedup.dedup_exact(documents(s, d), "doc_id").select("period", "doc_id"),
    "dedup_exact_log": lambda s, d: dedup.exact_log(documents(s, d), "doc_id").select("period", "removed_seq", "kept_seq"),
    "similar_pairs": lambda s, d: rounded(dedup.pairs_with_copies(documents(s, d), "doc_id"), "similarity"),
    "dedup_fuzzy_log": lambda s, d: rounded(dedup.fuzzy_matches(first_pairs(s, d), "doc_id"), "similarity"),
    "dedup_fuzzy": lambda s, d: dedup.dedup(documents(s, d), "doc_id")[0].select("doc_id"),
    "dedup_stats": q_dedup_stats,
    "duplicate_report": lambda s, d: dedup.duplicate_report(dedup.dedup(documents(s, d), "doc_id")[1]),
    "l2_normalize": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vectors.l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("first")),
    "knn_cosine": q_knn,
    "pca_project": q_pca,
    "hdbscan_labels": q_hdbscan,
    "encode_hashing": q_encode,
    "centroid_representatives": lambda s, d: rounded(vectors.centroid_representatives(table(s, d, "embeddings")), "distance"),
    "medoid_representatives": lambda s, d: rounded(vectors.medoid_representatives(table(s, d, "embeddings")), "total"),
    "probability_representatives": lambda s, d: vectors.representatives(clusters(s, d), "idx", "idx", "cluster", "probability"),
    "cluster_sizes": lambda s, d: periods.cluster_sizes(clusters(s, d)),
    "cluster_stats": lambda s, d: periods.cluster_stats(clusters(s, d)),
    "period_totals": lambda s, d: periods.period_totals(clusters(s, d)),
    "period_distribution": lambda s, d: periods.period_distribution(clusters(s, d)),
    "dominant_cluster": lambda s, d: periods.dominant_clusters(clusters(s, d)),
    "probability_summary": lambda s, d: rounded(periods.probability_summary(clusters(s, d)), "mean", "median"),
    "top_clusters": lambda s, d: periods.top_clusters(clusters(s, d), 4),
    "core_points": lambda s, d: periods.core_points(clusters(s, d), k=4),
    "prob_histogram": lambda s, d: periods.probability_histogram(clusters(s, d)),
    "heatmap": lambda s, d: rounded(periods.heatmap(clusters(s, d), 4), "pct"),
    "cluster_colors": lambda s, d: periods.color_ranks(clusters(s, d)),
    "html_paragraphs": q_html,
    "corpus_union": q_union,
}
