"""Sharding: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import materialize

#: The ring has CELLS arcs of equal width; keys of one arc move together unless the arc is too heavy.
CELLS = 1 << 14
#: A heavy arc is dealt into this many parts by the row's identifier.
PARTS = 64
#: At most this many arcs are heavy, as each holds more than this part of all rows or bytes.
HEAVY = 1024


def ring_point(name: str) -> int:
    """A fixed place on the ring for a virtual node."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") % CELLS


def clockwise(n_shards: int, virtual_nodes: int) -> list[list[int]]:
    """For each arc, all shards in the order in which their virtual nodes come clockwise from it."""
    nodes = sorted((ring_point(f"shard {s} node {v}"), s) for s in range(n_shards) for v in range(virtual_nodes))
    points = [p for p, _ in nodes]
    walks = [list(dict.fromkeys(s for _, s in nodes[i:] + nodes[:i])) for i in range(len(nodes))]
    return [walks[bisect.bisect_left(points, cell) % len(nodes)] for cell in range(CELLS)]


def place(loads: list[tuple[int, int, int]], n_shards: int, virtual_nodes: int, slack: float) -> dict[tuple[int, int], int]:
    """The bounded-load walk. loads: (arc, part, bytes); part is -1 for whole arcs. Returns the shard of each.

    A part of an arc that no shard can hold is a key with a place of its own on the ring, and walks clockwise from there.

    A shard takes a key only while its load stays within (1 + slack) times the mean; a key that finds its shard full
    goes on clockwise. Large keys come first, so that small ones fill what is left; ties go by place on the ring. A
    key for which no shard has room goes to the least loaded one, so that nothing is lost.
    """
    order, cap = clockwise(n_shards, virtual_nodes), (1 + slack) * sum(x[2] for x in loads) / n_shards
    full, out = [0] * n_shards, {}
    for cell, part, size in sorted(loads, key=lambda x: (-x[2], x[0], x[1])):
        walk = order[cell if part < 0 else ring_point(f"arc {cell} part {part}")]
        shard = next((s for s in walk if full[s] + size <= cap), None)
        if shard is None:
            shard = min(range(n_shards), key=lambda s: (full[s], walk.index(s)))
        full[shard] += size
        out[cell, part] = shard
    return out


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = 64,
    slack: float = 0.001,
) -> DataFrame:
    """Every row gets a shard and a slot, gapless from 0 in its shard; shards hold near-equal bytes.

    A key is a text: its hash is its place on the ring, so equal texts share an arc and a shard. Bytes per arc are
    summed over all rows (CELLS sums, a fixed bound), the bounded-load walk places the arcs, and the placement goes
    back to the rows by a join with a table of at most CELLS + HEAVY * PARTS rows. An arc with over 1/HEAVY of all
    rows or bytes is also counted in PARTS parts by identifier; it stays whole while a shard can hold it, and
    beyond that (a text held by a large part of all rows) its parts are keys of their own. Slots count rows in parts
    of arcs, so no window holds a whole hot text.

    Columns: id_col, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, shard, slot. A null text
    goes with the empty ones. Repeated rows get slots of their own; null ids are allowed. Other columns of docs are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            docs[id_col].alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("key"),
        ).select(
            "id",
            "size",
            "crc",
            F.shiftrightunsigned("key", 50).cast("int").alias("cell"),
            F.pmod(F.xxhash64("id", "crc"), F.lit(PARTS)).cast("int").alias("part"),
        ),
        "sizes",
    )
    sums = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # CELLS rows at most
    total, count = sum(r["bytes"] for r in sums), sum(r["n"] for r in sums)
    heavy = [r["cell"] for r in sums if r["bytes"] * HEAVY > total or r["n"] * HEAVY > count]
    spark = docs.sparkSession
    parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    if heavy:  # at most 2 * HEAVY arcs
        marks = F.broadcast(spark.createDataFrame([(c,) for c in heavy], "cell int"))
        for r in rows.join(marks, "cell", "left_semi").groupBy("cell", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            parts[r["cell"]].append((r["part"], r["bytes"], r["n"]))
    split = {r["cell"] for r in sums if r["cell"] in parts and r["bytes"] * n_shards > (1 + slack) * total}
    loads = [(r["cell"], -1, r["bytes"]) for r in sums if r["cell"] not in split]
    loads += [(c, p, size) for c in split for p, size, _ in parts[c]]
    shards = place(loads, n_shards, virtual_nodes, slack)
    units = [(r["cell"], -1, r["n"], shards[r["cell"], -1]) for r in sums if r["cell"] not in parts]
    units += [(c, p, n, shards[(c, p) if c in split else (c, -1)]) for c, found in parts.items() for p, _, n in found]
    table, filled = [], [0] * n_shards
    for cell, part, n, shard in sorted(units):
        table.append((cell, part, shard, filled[shard]))
        filled[shard] += n
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("cell", "unit", "shard")] + [T.StructField("first", T.LongType())])
    placed = F.broadcast(spark.createDataFrame(table, schema))  # CELLS + 2 * HEAVY * PARTS rows at most
    if heavy:
        whole = F.broadcast(spark.createDataFrame([(c,) for c in heavy], "heavy int"))
        rows = rows.join(whole, rows["cell"] == F.col("heavy"), "left").withColumn("unit", F.when(F.col("heavy").isNull(), F.lit(-1)).otherwise(F.col("part")))
    else:
        rows = rows.withColumn("unit", F.lit(-1))
    inside = Window.partitionBy("cell", "unit").orderBy("id", "crc")
    return rows.join(placed, ["cell", "unit"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("first") + F.row_number().over(inside) - 1).alias("slot"),
    )
