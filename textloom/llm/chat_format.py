"""Chat formatting: reply trees, their root-to-leaf paths, and one formatted conversation per chosen path.

Template: a turn is ``<turn:ROLE>TEXT</turn>`` and a newline. Inside texts, a backslash is doubled and then a backslash
is put behind the ``<`` of both control strings; in roles, ``%``, ``<`` and ``>`` are percent-encoded. So neither control
string occurs within a turn, and both steps can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import materialize

OPEN, CLOSE = "<turn:", "</turn>"


def escape_text(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(f"<\\{mark[1:]}"))
    return text


def unescape_text(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(f"<\\{mark[1:]}"), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for raw, coded in (("%", "%25"), ("<", "%3C"), (">", "%3E")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for raw, coded in ((">", "%3E"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of the trees in nodes(tree, node, parent, score), by iterative self-joins.

    Columns: tree, leaf, path (array of nodes from the root), score (sum over the path). A root has a null parent. Each
    node holds a stretch of its path and the node above it; a round joins the table with itself and appends the stretch
    of that upper node, so stretches double and a tree of height h takes log2(h) + 1 rounds. Nodes that can't be
    reached from a root (a parent that isn't there, a ring) belong to no path. (tree, node) must be unique and
    not null. Stretches hold identifiers only, never texts; a node with very many replies is split by the skew join.
    """
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    state = materialize(
        nodes.join(inner, ["tree", "node"], "left").select(
            "tree",
            "node",
            F.col("parent").alias("up"),
            F.array("node").alias("path"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
            F.col("inner").isNull().alias("leaf"),
        ),
        "paths",
    )
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= largest and not state.where("up is not null").isEmpty():
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"), F.col("score").alias("more"))
        longer = state.where("up is not null").join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), F.concat("front", "path").alias("path"), (F.col("score") + F.col("more")).alias("score"), "leaf"
        )
        state = materialize(state.where("up is null").unionByName(longer), "paths")
        reach *= 2
    return state.where("leaf and up is null").select("tree", F.col("node").alias("leaf"), "path", "score")


def choose_paths(paths: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best paths of each tree as rank 1, 2, ...: by score, then the longer one, then by leaf."""
    order = W.partitionBy("tree").orderBy(F.desc("score"), F.desc(F.size("path")), "leaf")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)


def format_paths(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: tree, rank, formatted, loss (array<struct<start, length>>, code points of formatted, start from 0).

    turns(tree, node, role, text); null roles and texts count as empty. The loss covers each assistant turn's text as it
    stands in formatted, without the marks around it.
    """
    steps = paths.select("tree", "rank", F.posexplode("path").alias("at", "node"))
    cells = steps.join(turns.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree",
        "rank",
        "at",
        F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit(">")).alias("head"),
        escape_text(F.coalesce("text", F.lit(""))).alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
    )
    rows = cells.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "learn"))).alias("turns"))

    def step(state: Column, t: Column) -> Column:
        start = state["end"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.struct(start.alias("start"), F.length(t["body"]).alias("length"))
        spans = F.when(t["learn"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"])
        return F.struct((end + len(CLOSE) + 1).alias("end"), spans.alias("loss"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return rows.select(
        "tree",
        "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda s: s["loss"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE + "\n", -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), ">", 1)).alias("role"),
            unescape_text(F.substring(p, F.instr(p, ">") + 1, 1 << 30)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, joined without anything between."""
    return F.array_join(F.transform(loss, lambda s: unescape_text(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def linear_nodes(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as nodes of trees with one branch: each turn replies to the one before.

    Repeated turns are kept: rows are ordered by turn, then role and text, and numbered.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("bigint")
    return rows.select(
        F.col("conv_id").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )
