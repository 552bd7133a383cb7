"""All similar pairs of sets of n-grams, compared block by block: what is shuffled and held has a fixed size for each block.

A set is sent as a signature, the parities of its members over some hundred hashed places. Two signatures differ in at
most as many places as the symmetric difference has members, so a matrix product of signatures rules out nearly all pairs
that are far apart and none that is similar. Only documents of which a pair is left are sent as sets, and only then is
the similarity computed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType

from textloom.session import materialize, release

#: Places of a signature: BITS for sets of up to BITS_FOR members, doubled with them up to MAX_BITS.
BITS, BITS_FOR, MAX_BITS = 512, 1024, 8192
#: Documents that are handled at once where texts become sets; tiles of the matrix products; members that one product covers.
SLICE, TILE, WIDE, MEMBERS = 128, 512, 2048, 8192
#: Lengths are ordered in steps of 1/FINE of a natural logarithm.
FINE = 64
#: Roles in a comparison.
FIRST, SECOND, BOTH = 1, 2, 3


def gram_sets(forms: list[str], n: int) -> list[np.ndarray]:
    """The sorted set of character n-grams of each text as 64-bit numbers: up to three code points are packed, more are
    hashed. A shorter text is its own n-gram."""
    points = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        at = points[k : k + len(codes)]
        codes = codes << np.uint64(21) | at if n <= 3 else (codes ^ at + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) ^ (codes >> np.uint64(29))
    out, start = [], 0
    for form in forms:
        end = start + len(form)
        if len(form) < n:
            whole = 0
            for c in form:
                whole = whole << 21 | ord(c)
            own = np.array([whole & 0xFFFFFFFFFFFFFFFF] if form else [], np.uint64)
        else:
            own = np.sort(codes[start : end - n + 1])
            own = own[np.r_[True, own[1:] != own[:-1]]]
        out.append(own)
        start = end
    return out


def bits_for(n: int) -> int:
    bits = BITS
    while n > BITS_FOR * (bits // BITS) and bits < MAX_BITS:
        bits *= 2
    return bits


def signature(codes: np.ndarray) -> bytes:
    """Parities of the members in hashed places; the first half xor the second is the signature of half as many places."""
    bits = bits_for(len(codes))
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def packed(codes: np.ndarray) -> bytes:
    return zlib.compress(np.diff(codes, prepend=np.uint64(0)).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint64), dtype=np.uint64)


def with_sets(base: DataFrame, n: int) -> DataFrame:
    """base(..., form) with n (the size of the set), sig and codes (the set, packed) in place of form."""
    rest = [c for c in base.columns if c != "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = gram_sets(part.column("form").to_pylist(), n)
                own = [pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + own, names=[*rest, "n", "sig", "codes"])

    schema = StructType([base.schema[c] for c in rest]).add("n", IntegerType()).add("sig", BinaryType()).add("codes", BinaryType())
    return base.mapInArrow(run, schema)


def folded(sigs: list[bytes]) -> np.ndarray:
    """All signatures with as many places as the shortest has, as rows of 1 and -1."""
    bits = 8 * min(map(len, sigs), default=BITS // 8)
    out = np.empty((len(sigs), bits // 8), np.uint8)
    for i, sig in enumerate(sigs):
        row = np.frombuffer(sig, np.uint8)
        while 8 * len(row) > bits:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return 1 - 2 * np.unpackbits(out, axis=1).astype(np.float32)


class Group:
    """The rows of a meeting of two blocks (or of one with itself), and what is compared there.

    Without an order, the pairs are those of a FIRST and a SECOND row; with it, the FIRST row has the smaller number.
    """

    def __init__(self, table: pa.Table, threshold: float, ratio: float, ordered: bool):
        table = table.sort_by("no")
        self.no, self.len, self.n, self.own, self.role = (table[c].to_numpy() for c in ("no", "len", "n", "own", "role"))
        self.signs = folded(table["sig"].to_pylist())
        self.threshold, self.ratio, self.ordered = threshold, ratio, ordered
        self.x, self.y = table["x"][0].as_py(), table["y"][0].as_py()
        self.packed = table["codes"].combine_chunks() if "codes" in table.column_names else None

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, second = self.role & FIRST > 0, self.role & SECOND > 0
        yield np.flatnonzero(first & (self.own == self.x)), np.flatnonzero(second & (self.own == self.y))
        if self.x != self.y and (self.ordered or not (first & second).all()):
            yield np.flatnonzero(first & (self.own == self.y)), np.flatnonzero(second & (self.own == self.x))

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers that may be similar, tile by tile."""
        bits, cut = self.signs.shape[1], (1 - self.threshold) / (1 + self.threshold)
        room = (2 * cut * self.n).astype(np.float32)
        for left, right in self.runs():
            for at in range(0, len(left), TILE):
                rows = left[at : at + TILE]
                a = np.hstack([self.signs[rows], room[rows][:, None], np.ones((len(rows), 1), np.float32)])
                for to in range(0, len(right), WIDE):
                    cols = right[to : to + WIDE]
                    b = np.hstack([self.signs[cols], np.ones((len(cols), 1), np.float32), room[cols][:, None]])
                    # bits - 2 * (places that differ) + 2 * cut * (n + m) >= bits: they differ in no more than two similar sets may.
                    i, j = np.divmod(np.flatnonzero(a @ b.T >= bits - 0.01), len(cols))
                    i, j = rows[i], cols[j]
                    ok = np.minimum(self.len[i], self.len[j]) >= np.maximum(self.len[i], self.len[j]) * self.ratio
                    if self.ordered or self.x == self.y:
                        ok &= self.no[i] < self.no[j]
                    if ok.any():
                        yield i[ok], j[ok]

    def sets(self) -> None:
        """Members become places in the list of all members here."""
        sets = [unpacked(p.as_py()) for p in self.packed]
        self.ends = np.cumsum([0] + [len(s) for s in sets])
        codes = np.concatenate(sets)
        names = np.unique(codes)
        self.ids = np.searchsorted(names, codes).astype(np.int32)
        self.size = len(names)

    def dense(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        out = np.zeros((len(rows), high - low), np.float32)
        for i, r in enumerate(rows):
            ids = self.ids[self.ends[r] : self.ends[r + 1]]
            out[i, ids[np.searchsorted(ids, low) : np.searchsorted(ids, high)] - low] = 1
        return out

    def similar(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, similarity) of the similar pairs, tile by tile."""
        self.sets()
        for i, j in self.tiles():
            (rows, a), (cols, b) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            if len(i) * 15e-6 > (len(rows) + len(cols)) * self.size * 1e-9 + len(rows) * len(cols) * self.size * 4e-11:
                common = np.zeros((len(rows), len(cols)), np.float32)
                for low in range(0, self.size, MEMBERS):
                    high = min(low + MEMBERS, self.size)
                    common += self.dense(rows, low, high) @ self.dense(cols, low, high).T
                shared = common[a, b].astype(np.int64)
            else:
                shared = np.array([len(np.intersect1d(self.ids[self.ends[x] : self.ends[x + 1]], self.ids[self.ends[y] : self.ends[y + 1]], assume_unique=True)) for x, y in zip(i, j)], np.int64)
            n, m = self.n[i].astype(np.int64), self.n[j].astype(np.int64)
            similarity = shared / (n + m - shared)
            ok = similarity >= self.threshold
            if ok.any():
                yield i[ok], j[ok], similarity[ok]


def meetings(members: DataFrame, threshold: float, ratio: float, least: int, most: int, lists: int, apart: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Members for each meeting of their block with one that may hold something similar, with own, x and y; and the scratch tables behind it.

    The documents of a period are ordered by the size of their signatures and by length, and dealt into blocks of about
    `most`. A step of length that alone fills blocks is dealt over them by a hash. At least `lists` blocks are made, while
    they have `least` documents. `apart`: blocks meet only if one has a FIRST and the other a SECOND member.
    """
    members = materialize(members.withColumn("fine", F.octet_length("sig").cast("bigint") * 100_000 + F.floor(F.log("len") * FINE)), "members")
    counts = members.groupBy("period", "fine").count()
    block = max(1, min(most, max(least, members.count() // max(1, lists))))
    before = W.partitionBy("period").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)  # some hundred rows a period
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.select("period", "fine", F.floor(F.col("start") / block).alias("first"), F.ceil(F.col("count") / block).alias("chunks"))
    dealt = members.join(starts, ["period", "fine"]).withColumn("own", (F.col("first") + F.pmod(F.xxhash64("no"), F.col("chunks"))).cast("int"))
    dealt = materialize(dealt.select("period", "own", "no", "len", "n", "sig", "role"), "dealt")
    ranges = dealt.groupBy("period", "own").agg(*(f(c).alias(f"{name}_{c}") for c in ("len", "n") for name, f in (("low", F.min), ("high", F.max))), F.bit_or("role").alias("role"))
    ranges = materialize(ranges, "ranges")

    def reach(c: str, share: float) -> Column:
        return (F.col(f"a.high_{c}") >= F.col(f"b.low_{c}") * share) & (F.col(f"b.high_{c}") >= F.col(f"a.low_{c}") * share)

    met = ranges.alias("a").join(ranges.alias("b"), (F.col("a.period") == F.col("b.period")) & (F.col("a.own") <= F.col("b.own")) & reach("len", ratio) & reach("n", threshold))
    if apart:
        a, b = F.col("a.role"), F.col("b.role")
        met = met.where(((a.bitwiseAND(FIRST) > 0) & (b.bitwiseAND(SECOND) > 0)) | ((b.bitwiseAND(FIRST) > 0) & (a.bitwiseAND(SECOND) > 0)))
    met = met.select("a.period", F.col("a.own").alias("x"), F.col("b.own").alias("y"))
    sides = F.array_distinct(F.array("x", "y"))
    return dealt.join(met.select("period", "x", "y", F.explode(sides).alias("own")), ["period", "own"]), [members, dealt, ranges]


def compared(members: DataFrame, numbers: DataFrame, codes: DataFrame, threshold: float, ratio: float, what: str, least: int, most: int, lists: int) -> DataFrame:
    """(a, b, similarity) of members(period, no, len, n, sig, role) that are similar; numbers(no, row) and codes(row, codes) lead to their sets.

    what: "pairs", all pairs, a before b; "hits", of each SECOND that has a similar FIRST before it, one pair at least;
    "best", of each such SECOND the most similar FIRST before it in each meeting, the earliest of several.
    """
    ordered = what != "pairs"
    key = ["period", "x", "y"]
    met, scratch = meetings(members, threshold, ratio, least, most, lists, ordered)

    def find(table: pa.Table) -> pa.Table:
        group = Group(table, threshold, ratio, ordered)
        touched = np.zeros(len(group.no), bool)
        for i, j in group.tiles():
            touched[i] = touched[j] = True
        return table.sort_by("no").filter(pa.array(touched)).select(["period", "x", "y", "own", "no", "len", "n", "sig", "role"])

    touched = materialize(met.groupBy(*key).applyInArrow(find, "period string, x int, y int, own int, no bigint, len int, n int, sig binary, role int"), "touched")

    def verify(table: pa.Table) -> pa.Table:
        group = Group(table, threshold, ratio, ordered)
        found: list[tuple] = []
        best, with_ = np.full(len(group.no), -1.0), np.zeros(len(group.no), np.int64)
        for i, j, s in group.similar():
            a, b = group.no[i], group.no[j]
            if not ordered:
                found.append((np.minimum(a, b), np.maximum(a, b), s))
                continue
            order = np.lexsort((a, -s, j))
            order = order[np.r_[True, j[order][1:] != j[order][:-1]]]
            for r, name, own in zip(j[order], a[order], s[order]):
                if own > best[r] or own == best[r] and name < with_[r]:
                    best[r], with_[r] = own, name
        if ordered:
            hit = best >= 0
            found = [(with_[hit], group.no[hit], best[hit])]
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    sets = touched.join(numbers, "no").join(codes, "row").drop("row")
    out = materialize(sets.groupBy(*key).applyInArrow(verify, "a bigint, b bigint, similarity double"), "similar")
    release(*scratch, touched)
    return out
