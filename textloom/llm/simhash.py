"""SimHash near-duplicates: generalised pigeonhole over groups of correlated bits, with unequal thresholds."""

from __future__ import annotations

import math
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.session import materialize, release

SEED = 42  # fixed value of the contract
#: Buckets up to this size are compared within; larger ones go another way, see the functions.
BUCKET = 100
#: Wide fingerprints: with at most half as many pairs of different components per node a bucket's pairs are joined, else compared in blocks.
CROSS = 16
#: Wide fingerprints: nodes of a block, of a bucket whose pairs aren't joined.
BLOCK = 512
#: Wide fingerprints: counts of shingles are folded into this many signed cells before they are projected.
CELLS = 4096


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, shingle: int):
    """XXH64 of each run of `shingle` words, A-Z in lower case; fewer words: of the whole sequence; none: empty."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority_bits(hashes) -> int:
    """The 64 bits that are set in over half of the hashes."""
    import numpy as np

    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def projection(words: int):
    """Fixed signs that fold CELLS cells into 64 bits a word; a byte each, as a worker's memory counts."""
    import numpy as np

    if words not in _projections:
        bits = np.random.Generator(np.random.PCG64(20_11)).integers(0, 256, CELLS * words * 8, np.uint8)
        signs = np.unpackbits(bits).view(np.int8).reshape(CELLS, words * 64)
        signs *= 2
        signs -= 1
        _projections[words] = signs
    return _projections[words]


_projections: dict = {}


def wide_bits(sets: list, words: int):
    """One row of `words` 64-bit words per set of shingle hashes: the signs of a random projection of it."""
    import numpy as np

    cells = np.zeros((len(sets), CELLS), np.float32)
    for row, hashes in enumerate(sets):
        cells[row] = np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), 1 - 2.0 * (hashes >> np.uint64(63)), CELLS)
    signs = projection(words)
    above = [cells @ signs[:, at : at + 512].astype(np.float32) > 0 for at in range(0, words * 64, 512)]
    return np.packbits(np.hstack(above), axis=1, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int | None = None) -> DataFrame:
    """(doc, fp): fp is a 64-bit integer, or, if `words` is given, an array of so many; null texts count as empty.

    With `words` there are also n_shingles and digest, the number of different shingles and what identifies their set.
    """
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                if words:
                    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                    bits = wide_bits(sets, words)
                    out = pa.ListArray.from_arrays(pa.array(range(0, bits.size + 1, words), pa.int32()), pa.array(bits.reshape(-1)))
                    more = [pa.array(map(len, sets), pa.int32()), pa.array([xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), out, *more], ["doc", "fp", "n_shingles", "digest"])
                else:
                    out = pa.array([majority_bits(shingle_hashes(t, shingle)) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc", "fp"])

    return given_texts(docs, id_col, text_col).mapInArrow(run, "doc bigint, fp " + ("array<bigint>, n_shingles int, digest binary" if words else "bigint"))


def given_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def shingle_sets(given: DataFrame, shingle: int) -> DataFrame:
    """(doc, hashes): the different shingle hashes of given(doc, text)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, shingle)).view("<i8") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["doc", "hashes"])

    return given.mapInArrow(run, "doc bigint, hashes array<bigint>")


# ---------------------------------------------------------------- the plan


def bit_counts(fps: DataFrame) -> tuple[list[list[float]], int]:
    """For each pair of bits, in how many fingerprints both are set (64 x 64 sums over all rows), and the row count."""

    def count(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
        yield pd.DataFrame({"i": np.repeat(np.arange(64), 64), "j": np.tile(np.arange(64), 64), "n": total.reshape(-1)})

    sums = fps.select("fp").mapInPandas(count, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    out = [[0.0] * 64 for _ in range(64)]
    for r in sums:
        out[r["i"]][r["j"]] = r["n"]
    return out, fps.count()


def correlation(both: list[list[float]], n: int) -> list[list[float]]:
    p = [both[i][i] / max(n, 1) for i in range(64)]
    spread = [math.sqrt(max(x * (1 - x), 1e-9)) for x in p]
    return [[abs(both[i][j] / max(n, 1) - p[i] * p[j]) / (spread[i] * spread[j]) for j in range(64)] for i in range(64)]


def group_bits(corr: list[list[float]], m: int, width: int | None = None) -> list[list[int]]:
    """m groups, of `width` bits or of near-equal size. A group starts with the lowest bit left and takes the bit that correlates most with it."""
    left, groups = list(range(64)), []
    for g in range(m):
        size = width or len(left) // (m - g)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b][x] for x in group), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def within(group: list[int], p: list[float], t: int) -> float:
    """Chance that two random fingerprints differ in at most t bits of the group, bits taken as independent."""
    chance = [1.0]
    for b in group:
        d = 2 * p[b] * (1 - p[b])
        chance = [(chance[k] if k < len(chance) else 0) * (1 - d) + (chance[k - 1] * d if k else 0) for k in range(len(chance) + 1)]
    return sum(chance[: t + 1])


def allocate(groups: list[list[int]], p: list[float], n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum tau - m + 1, from -1 (group unused), of the least estimated cost: probes plus candidates.

    By dynamic programming over the groups and the sum so far. If two fingerprints differ in at most tau bits, at
    least one group holds at most its threshold of them, whatever the thresholds are.
    """
    goal = tau - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, tau + 1):
            probes = sum(math.comb(len(group), k) for k in range(t + 1))
            cost = n * probes + n * n * within(group, p, t) if t >= 0 else 0.0
            for total, (so_far, chosen) in best.items():
                if total + t not in step or so_far + cost < step[total + t][0]:
                    step[total + t] = (so_far + cost, [*chosen, t])
        best = step
    return best[goal]


def plan(fps: DataFrame, tau: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the groups in use, of the least estimated cost over all numbers of groups up to tau + 2."""
    both, n = bit_counts(fps)
    corr, p = correlation(both, n), [both[i][i] / max(n, 1) for i in range(64)]
    options = []
    for m in range(1, tau + 3):
        groups = group_bits(corr, m)
        cost, thresholds = allocate(groups, p, n, tau)
        options.append((cost, m, [(sum(1 << b for b in g), t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options)[2]


# ---------------------------------------------------------------- links of 64-bit fingerprints


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [signed(sum(c)) for k in range(t + 1) for c in combinations(bits, k)]


def keyed(fps: DataFrame, groups: list[tuple[int, int]], probing: bool) -> DataFrame:
    """(part, key, fp): each fingerprint under its bits of each group, or, probing, under all within the threshold."""
    def cell(i: int, mask: int, t: int) -> Column:
        base = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        around = F.lit(flips(mask, t if probing else 0)).cast("array<bigint>")
        return F.transform(around, lambda x: F.struct(F.lit(i).alias("part"), base.bitwiseXOR(x).alias("key")))

    cells = [cell(i, mask, t) for i, (mask, t) in enumerate(groups)]
    return fps.select(F.explode(F.concat(*cells)).alias("cell"), "fp").select("cell.part", "cell.key", "fp")


def near(a: Column, b: Column, tau: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= tau


def hamming_links(fps: DataFrame, tau: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that join exactly the distinct 64-bit fingerprints that links of at most tau bits join.

    Probes meet the index in buckets of one group's bits; what differs in at most tau bits is an edge. A bucket with
    over `bucket` fingerprints (a large group of near copies) isn't compared pair by pair where tau <= 2: all
    fingerprints in it or probing it go under themselves and their 64 neighbours of one bit. Two fingerprints differ
    in at most two bits if and only if they meet there, and at most 65 fingerprints meet in one place, so this needs
    65 rows for each of them and loses nothing. For larger tau every bucket is compared.
    """
    groups = plan(fps, tau)
    index = materialize(keyed(fps, groups, False), "index")
    probe = index if all(t == 0 for _, t in groups) else keyed(fps, groups, True)
    stars = None
    if tau <= 2:
        heavy = materialize(index.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"), "heavy")
        if not heavy.isEmpty():
            hot = materialize(probe.join(heavy, ["part", "key"], "left_semi").select("fp").distinct(), "hot")
            around = F.lit([0, *(signed(1 << b) for b in range(64))]).cast("array<bigint>")
            spots = hot.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
            meet = spots.groupBy("spot").agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)  # 65 at most
            stars = meet.select(F.get("all", F.lit(0)).alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
            index = index.join(heavy, ["part", "key"], "left_anti")
    right = index.withColumnRenamed("fp", "other")
    pairs = probe.join(right, ["part", "key"]).where((F.col("fp") != F.col("other")) & near(F.col("fp"), F.col("other"), tau))
    out = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return (out.unionByName(stars) if stars is not None else out).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """One row per document: id_col, fp (64-bit SimHash of its shingles) and component_id, the smallest linked id.

    Documents whose fingerprints differ in at most tau bits are linked, and links chain. A text without words, null
    or empty, has fingerprint 0 and is linked like any other. Equal fingerprints are one node, so copies cost nothing
    beyond their fingerprints. Repeated rows have the component of their fingerprint; null ids never are a component's
    id unless it has no other. Other columns of docs are ignored; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    links = materialize(hamming_links(nodes.select("fp"), tau), "links")
    if links.isEmpty():
        place = nodes.select("fp", F.col("least").alias("component_id"))
    else:
        roots = connected_components(links).withColumnRenamed("node", "fp")
        whole = materialize(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
        least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
        least = materialize(least, "least")
        place = whole.select("fp", "root").join(least, "root").select("fp", "component_id")
    place = materialize(place, "places")
    return rows.join(place, "fp").select(F.col("doc").alias(id_col), "fp", "component_id")


# ---------------------------------------------------------------- similarity by wide fingerprints


def differing(similarity: float) -> float:
    """Expected part of bits that differ for two sets of that Jaccard similarity (sets of like size)."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def limit_of(bits: int, similarity: float, errors: float) -> int:
    """How many of that many bits differ at most for a pair of `similarity`, with so many standard errors of slack."""
    d = differing(similarity)
    return int(bits * d + errors * math.sqrt(bits * d * (1 - d)))


#: Wide fingerprints: what a pair of strangers (two more rows in each join over buckets) and a word (its projection) cost, in rows of the index.
PAIR_COST, WORD_COST = 4, 5
#: Wide fingerprints: bits that brief() takes of the last word; the number of shingles has the other 16.
BRIEF = 48


def brief() -> Column:
    """bigint of the columns n_shingles and fp: thousandths of the logarithm of n_shingles, and BRIEF bits of the last word."""
    size = F.floor(F.log(F.greatest("n_shingles", F.lit(1))) * 1000).cast("bigint")  # under 2 ** 15
    return F.shiftleft(size, BRIEF).bitwiseOR(F.element_at("fp", -1).bitwiseAND(F.lit((1 << BRIEF) - 1)))


def may_be_near(a: str, b: str, similarity: float) -> Column:
    """Whether two brief() leave `similarity` possible: numbers of shingles never mislead; the bits do by over four standard errors."""
    sizes = F.abs(F.shiftrightunsigned(F.col(a), BRIEF) - F.shiftrightunsigned(F.col(b), BRIEF)) <= math.ceil(-1000 * math.log(similarity)) + 1
    bits = F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit((1 << BRIEF) - 1)))
    return sizes & (bits <= limit_of(BRIEF, similarity, 4))


def wide_size(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a group, words): what a fingerprint of n rows needs, by the least estimated cost for even bits.

    A group of w bits agrees with chance (1 - differing) ** w, so it takes ln(1 - recall) / ln(1 - that) groups, of which
    64 // w fit a word; an eighth more groups leave allocate_wide() a choice. Each group makes n rows and n * n / 2 ** (w + 1)
    pairs of strangers. So w grows with the logarithm of n: the share of rows that meet strangers stays bounded, and all
    rows together grow by a power of n little above one. With one w for all tables, strangers grow with the square of n
    until the buckets are full.
    """
    options = []
    for w in range(12, 33):
        count = math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** w)
        words = math.ceil(count * 9 / 8 / (64 // w))
        options.append((count * (n + PAIR_COST * n * n / 2 ** (w + 1)) + WORD_COST * n * words, w, words))
    return min(options)[1:]


def wide_bit_counts(rows: DataFrame, words: int) -> tuple[dict[int, list[list[float]]], int]:
    """For each word, in how many fingerprints of all rows each two of its bits are set; and the number of rows.

    What comes to the driver is bounded by the fingerprint: 2,080 sums a word.
    """
    import numpy as np

    upper = np.triu_indices(64)

    def count(batches):
        import pandas as pd

        total, n = np.zeros((words, 64, 64)), 0
        for batch in batches:
            flat = np.stack(batch["fp"].to_list()).astype("<i8")
            for at in range(0, len(flat), 1024):
                bits = np.unpackbits(flat[at : at + 1024].view(np.uint8).reshape(-1, words, 8), axis=2, bitorder="little").astype(np.float32)
                for k in range(words):
                    total[k] += bits[:, k].T @ bits[:, k]
            n += len(flat)
        for k in range(words):
            yield pd.DataFrame({"word": k, "i": upper[0], "j": upper[1], "n": total[k][upper]})
        yield pd.DataFrame({"word": [-1], "i": 0, "j": 0, "n": float(n)})

    sums = rows.select("fp").mapInPandas(count, "word int, i int, j int, n double").groupBy("word", "i", "j").agg(F.sum("n").alias("n")).collect()
    both = {k: [[0.0] * 64 for _ in range(64)] for k in range(words)}
    n = 0
    for r in sums:
        if r["word"] < 0:
            n = int(r["n"])
        else:
            both[r["word"]][r["i"]][r["j"]] = both[r["word"]][r["j"]][r["i"]] = r["n"]
    return both, n


def strangers(group: list[int], both: list[list[float]], n: int, t: int) -> float:
    """Estimated chance that two rows differ in at most t bits of the group, from the counts of pairs of its bits.

    Bits are taken one by one, each given the one before it: for one bit, two rows agree with chance p * p + q * q; for
    two, with the sum of the squares of their four joint shares. So bits that go together don't count twice.
    """
    def alone(i: int) -> float:
        p = both[i][i] / max(n, 1)
        return p * p + (1 - p) * (1 - p)

    def joint(i: int, j: int) -> float:
        x = both[i][j] / max(n, 1)
        p, q = both[i][i] / max(n, 1), both[j][j] / max(n, 1)
        return sum(y * y for y in (x, p - x, q - x, 1 - p - q + x))

    chance = [1.0]
    for at, b in enumerate(group):
        agree = min(1.0, joint(group[at - 1], b) / alone(group[at - 1]) if at else alone(b))
        chance = [(chance[k] if k < len(chance) else 0) * agree + (chance[k - 1] * (1 - agree) if k else 0) for k in range(min(len(chance), t) + 1)]
    return sum(chance[: t + 1])


def alike(size: int, t: int, d: float) -> float:
    """Chance that a pair whose bits differ with chance d differs in at most t of `size` bits."""
    return sum(math.comb(size, k) * d**k * (1 - d) ** (size - k) for k in range(t + 1))


def allocate_wide(groups: list[tuple[int, list[int]]], costs: list[list[float]], d: float, recall: float, steps: int = 1000) -> list[int]:
    """Thresholds from -1 (group unused) of the least cost for which a pair with bits differing by chance d meets with chance `recall`.

    costs[g][t] is the estimated cost of group g at threshold t. The chance to be missed is the product over the groups,
    so its logarithm adds up: dynamic programming over the groups and that sum, in `steps` steps of what is needed.
    """
    unit = -math.log(1 - recall) / steps
    best: list[tuple[float, tuple | None]] = [(0.0, None)] + [(math.inf, None)] * steps
    for g, (_, bits) in enumerate(groups):
        gains = [(t, int(-math.log(1 - alike(len(bits), t, d)) / unit), cost) for t, cost in enumerate(costs[g])]
        step = [(cost, (-1, back)) for cost, back in best]
        for have, (so_far, back) in enumerate(best):
            if so_far < math.inf:
                for t, gain, cost in gains:
                    to = min(steps, have + gain)
                    if so_far + cost < step[to][0]:
                        step[to] = (so_far + cost, (t, back))
        best = step
    # Rounding each gain down may leave the goal a little short: then the furthest sum is taken.
    chosen, back = [], next(b for cost, b in reversed(best) if cost < math.inf)
    while back is not None:
        chosen.append(back[0])
        back = back[1]
    return chosen[::-1]


def wide_plan(rows: DataFrame, width: int, words: int, similarity: float, recall: float) -> list[tuple[int, int, int]]:
    """(word, mask, threshold) of the groups in use, of `width` bits each.

    The bits of each word are grouped by their correlation over all rows, and unequal thresholds are allocated by dynamic
    programming: the cost of a group is its index rows and probes, and the pairs of strangers that strangers() expects.
    """
    both, n = wide_bit_counts(rows, words)
    groups = [(k, bits) for k in range(words) for bits in group_bits(correlation(both[k], n), 64 // width, width)]
    costs = []
    for k, bits in groups:
        keys = [sum(math.comb(len(bits), x) for x in range(t + 1)) for t in (0, 1)]
        # Both sides lie under all keys within the threshold, so pairs meet up to twice that apart.
        costs.append([n * keys[t] + n * n / 2 * strangers(bits, both[k], n, 2 * t) for t in (0, 1)])
    thresholds = allocate_wide(groups, costs, differing(similarity), recall)
    return [(k, sum(1 << b for b in bits), t) for (k, bits), t in zip(groups, thresholds) if t >= 0]


def wide_keys(groups: list[tuple[int, int, int]]) -> Column:
    """array<bigint> of the column fp: hashes of each group's number with its bits and all within its threshold of them."""
    def cell(i: int, word: int, mask: int, t: int) -> Column:
        base = F.get("fp", F.lit(word)).bitwiseAND(F.lit(signed(mask)))
        if not t:
            return F.array(F.xxhash64(F.lit(i), base))
        return F.transform(F.lit(flips(mask, t)).cast("array<bigint>"), lambda x: F.xxhash64(F.lit(i), base.bitwiseXOR(x)))

    return F.concat(*(cell(i, *group) for i, group in enumerate(groups)))


def compared_in_blocks(rows: DataFrame, nodes: DataFrame, similarity: float, limit: int, block: int) -> DataFrame:
    """(a, b, ra, rb): all pairs of rows(spot, node, root, s) of one bucket, of different roots, whose fp differ in at most `limit` bits.

    Pairs whose numbers of shingles rule out the similarity go too. A bucket of s nodes is dealt over ceil(s / block) chunks by a hash of the node, and each two chunks meet in one
    group of at most about two blocks, so no bucket is one task's and no pair that is far apart becomes a row.
    """
    import numpy as np
    import pyarrow as pa

    def bits(column):
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
        signs = np.unpackbits(flat.view(np.uint8).reshape(len(column), -1), axis=1).astype(np.float32)
        signs *= 2
        signs -= 1
        return signs

    def compare(table: pa.Table) -> pa.Table:
        node, root, own = (table[c].to_numpy() for c in ("node", "root", "own"))
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        signs = bits(table["fp"])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        near = (signs.shape[1] - signs[left] @ signs[right].T) / 2 <= limit
        near &= root[left][:, None] != root[right][None, :]
        size = table["n_shingles"].to_numpy().astype(np.float64)
        near &= np.minimum.outer(size[left], size[right]) >= (similarity - 1e-9) * np.maximum.outer(size[left], size[right])
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        if x == y:
            i, j = i[node[i] < node[j]], j[node[i] < node[j]]
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.table({"a": node[i], "b": node[j], "ra": root[i], "rb": root[j]})

    chunks = F.ceil(F.col("s") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("n", chunks)
    spread = dealt.select("spot", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    spread = spread.select("spot", "node", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    met = spread.join(nodes, "node").groupBy("spot", "x", "y")
    return met.applyInArrow(compare, "a bigint, b bigint, ra bigint, rb bigint").distinct()


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    recall: float = 0.995,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """(doc, component_id) for documents linked by a Jaccard similarity of their sets of shingles of `similarity` or more.

    64 bits can't tell 0.8: pairs of that similarity differ in 4 to 14 of them. So the fingerprint is as wide as
    wide_size() asks, and the pigeonhole principle is used with a chance in place of a certainty: wide_plan() groups
    correlated bits and allocates thresholds so that a pair of `similarity` meets in some group with chance `recall`.
    That only finds candidates; of these, the ones whose share of differing bits is within three standard errors of what
    `similarity` gives are verified: a link is made if the exact similarity of the two sets of shingle hashes is
    `similarity` or more. Equal sets are one node. The size of the table chooses the groups and the bits, so how
    candidates are searched, but no verdict on a pair.

    Rows of a bucket carry the number of shingles and 48 bits, so a pair whose numbers rule out the similarity, or whose
    bits do by over four standard errors (chance 0.0001 for a pair at `similarity`), ends within the join that finds it.

    Candidates come in two rounds, so that a group of near copies makes rows in proportion to its size. First, each
    bucket of one group's bits is compared with its smallest node, and what is linked becomes one component. Then a
    bucket that still holds several components has its pairs across components compared; pairs within one would
    change nothing. No bucket is left out: those of over `bucket` nodes, or with over CROSS / 2 such pairs a node, are
    compared in blocks of about `block` nodes, which give only the pairs that are near as rows. Texts under `shingle` words are one shingle; null texts
    count as empty. Rows that repeat an id are each a document of that id: the id may show in several components. Rows with
    null ids are in no component. An empty table gives an empty result.
    """
    known = docs.where(F.col(id_col).isNotNull())
    width, words = wide_size(known.count(), similarity, recall)
    limit = limit_of(words * 64, similarity, 3)
    rows = materialize(fingerprints(known, id_col, text_col, shingle, words), "wide")
    nodes = materialize(rows.groupBy("digest", "n_shingles", "fp").agg(F.min("doc").alias("node")), "nodes")
    members = materialize(rows.select("doc", "digest"), "members")
    release(rows)
    groups = wide_plan(nodes, width, words, similarity, recall)
    index = nodes.select("node", brief().alias("brief"), F.explode(wide_keys(groups)).alias("spot"))
    shared = materialize(index.groupBy("spot").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = materialize(index.join(shared, "spot"), "met")
    release(shared)

    def near(pairs: DataFrame) -> DataFrame:
        left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("n_shingles").alias("na")), "a")
        both = left.join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("n_shingles").alias("nb")), "b")
        apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        alike = F.least("na", "nb") / F.greatest("na", "nb") >= similarity
        return both.where(alike).withColumn("apart", apart).where(F.col("apart") <= limit).drop("fa", "fb", "na", "nb")

    def verified(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
        sets = materialize(shingle_sets(given_texts(known, id_col, text_col).join(used, "doc", "left_semi"), shingle), "sets")
        both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(common / (F.size("ha") + F.size("hb") - common) >= similarity).drop("ha", "hb")

    # Most nodes of a group of near copies are linked by the nearest of their candidates; the rest need the other ones.
    heads = met.groupBy("spot").agg(F.min(F.struct("node", "brief")).alias("head")).select("spot", F.col("head.node").alias("a"), F.col("head.brief").alias("brief_a"))
    stars = met.join(heads, "spot").where((F.col("node") > F.col("a")) & may_be_near("brief", "brief_a", similarity))
    stars = materialize(stars.select("a", F.col("node").alias("b")).distinct(), "stars")
    met_first, stars = stars, materialize(near(stars), "near")
    release(met_first)
    nearest = materialize(stars.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"), "nearest")
    links = materialize(verified(nearest), "links")
    roots = connected_components(links)
    apart = stars.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    more = materialize(verified(materialize(apart, "apart")), "links")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    rooted = met.where("size > 2").join(roots, "node", "left")
    rooted = materialize(rooted.select("spot", "node", "brief", F.coalesce("root", "node").alias("root")), "rooted")
    release(met)
    sizes = rooted.groupBy("spot", "root").agg(F.count("*").alias("c"), F.min("node").alias("first"))
    sizes = sizes.groupBy("spot").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("first").alias("first"))
    sizes = materialize(sizes.where("s * s > same").select("spot", "s", "first", ((F.col("s") <= bucket) & (F.col("s") * F.col("s") - F.col("same") <= F.lit(CROSS) * F.col("s"))).alias("few")), "sizes")
    mixed = materialize(rooted.join(sizes.where("few").select("spot", "first"), "spot").where("node > first").drop("first"), "mixed")
    here = mixed.select("spot", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("brief").alias("brief_a"))
    there = mixed.select("spot", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("brief").alias("brief_b"))
    pairs = here.join(there, "spot").where(F.expr("a < b and ra <> rb") & may_be_near("brief_a", "brief_b", similarity)).select("a", "b", "ra", "rb").distinct()
    joined = materialize(near(materialize(pairs, "pairs")).drop("apart"), "joined")
    full = rooted.drop("brief").join(sizes.where("not few").select("spot", "s"), "spot")
    blocks = materialize(compared_in_blocks(full, nodes.select("node", "fp", "n_shingles"), similarity, limit, block), "blocks")
    release(rooted, mixed)
    crossing = materialize(joined.unionByName(blocks).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), "crossing")
    crossed = materialize(verified(crossing).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "crossed")
    tops = connected_components(crossed).select(F.col("node").alias("root"), F.col("root").alias("top"))
    owned = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    place = materialize(owned.join(tops, "root", "left").select("digest", F.coalesce("top", "root").alias("component_id")), "places")
    return members.join(place, "digest").select("doc", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that aren't the smallest id of their component; all columns stay. Rows with null ids stay.

    Of rows that repeat an id all go if one does: where a smaller id has a near copy of any of them.
    """
    placed = similar_components(docs, id_col, text_col, **options)
    gone = materialize(placed.where("doc <> component_id").select(F.col("doc").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("bigint") == gone["gone"], "left_anti")
