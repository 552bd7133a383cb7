"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chat_format, exact_dedup, line_dedup, packing, quality, secret_scan, sentencepiece_codec, sharding, simhash, token_counts
from textloom.session import materialize, scratch_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches of inserts, one of them offered twice; then every one revised into another group and
    back, deleted and inserted again. The totals come out of seven signed batches and the snapshots they were folded into.
    """
    rollup = token_counts.TokenRollup(spark, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    counts = materialize(token_counts.count_tokens(table(spark, sf_dir, "documents")), "counts")
    moved = counts.withColumns({"source": F.lit("moved"), "n_tokens": F.col("n_tokens") + 1})
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for k in (0, 1, 2, 0):
        rollup.commit(f"load-{k}", token_counts.inserts(counts.where(part == k)))
    rollup.commit("moved", token_counts.revisions(counts, moved))
    rollup.commit("back", token_counts.revisions(moved, counts))
    rollup.commit("deleted", token_counts.deletes(counts))
    rollup.commit("again", token_counts.inserts(counts))
    return rollup.totals()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = line_dedup.mark_lines(docs)
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.split(text, "\n", -1)).cast("bigint")
    rows = marked.select("doc_id", lines.alias("n_lines"), F.when(F.col("lost_keys").isNull(), F.array(text)).otherwise(line_dedup.kept_lines(text, F.col("lost_keys"))).alias("kept"), F.col("lost_keys").isNull().alias("same"))
    return rows.select(
        "doc_id",
        "n_lines",
        F.when(F.col("same"), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
with lines as (
  select doc_id, unnest(generate_series(1, len(parts))) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select doc_id, pos, line, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), hot as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.pos, k.line, h.key is not null and k.doc_id <> h.last as gone from keyed k left join hot h on k.key = h.key
)
select doc_id, count(*) as n_lines, sum(case when gone then 1 else 0 end)::bigint as n_dropped,
  sha256(coalesce(string_agg(case when gone then null else line end, chr(10) order by pos), '')) as kept_sha256
from marked group by doc_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, tau=2)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, a digest of the ids (decimal, comma-joined), and a digest of what they decode to."""
    rows = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], rows.schema)
    nodes = chat_format.materialize(chat_format.linear_nodes(rows.unionByName(extra)), "turns")
    paths = chat_format.choose_paths(chat_format.root_to_leaf_paths(nodes))
    out = chat_format.format_paths(nodes, paths)
    learnt = chat_format.read_loss(F.col("formatted"), F.col("loss"))
    back = out.select("tree", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), learnt.alias("learnt"))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP8_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), coded as (
  select *, length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E')) + length('<turn:></turn>') + 1
    + length(replace(replace(replace(text, '\', '\\'), '<turn:', '<\turn:'), '</turn>', '<\/turn>')) as size
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(size)::bigint as formatted_chars
from coded group by conv_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = quality.fit_references(docs, table(spark, sf_dir, "labels"))
    return quality.assess_documents(docs, references)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_scan.scan_secrets(docs, out_col="spans").select("doc_id", "spans")

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_chat_format": op8_chat_format,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
}
ORACLE: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_chat_format": OP8_SQL}
