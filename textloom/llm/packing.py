"""Packing documents into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.word_tokens import chunk_tokenizer, default_path

WINDOW = 4096  # fixed value of the contract
END = (2).to_bytes(4, "little")  # fixed value of the contract
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the items with near-equal sums.

    Each item starts as a partial partition with one filled group and k - 1 empty ones. The two partial partitions
    with the largest imbalance (largest minus smallest group) merge again and again: the largest group of one joins
    the smallest of the other, so that opposing imbalances cancel. Groups are kept in falling order of their sums;
    empty groups aren't stored. Ties go by the order of the items.
    """
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # a's groups (falling) meet b's (rising); b's empty groups come first, a's last.
        apart = min(len(a), k - len(b))
        merged = a[:apart] + b[: len(b) - (len(a) - apart)] if len(a) > apart else a + b
        for (s, x), (t, y) in zip(a[apart:], reversed(b[len(b) - (len(a) - apart) :]) if len(a) > apart else ()):
            merged.append((s + t, x + y))
        merged.sort(key=lambda g: -g[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], made, merged))
        made += 1
    groups = [x for _, x in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows_of(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Groups of at most `capacity`, near-equal by differencing; their number rises whenever one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1
    return []


class Packer:
    """Packs one task's documents: cuts, collects about `block` windows of tokens, and packs them by differencing."""

    def __init__(self, task: int, capacity: int = WINDOW, longest: int = 1024, block: int = 128, slack: float = 0.005):
        self.capacity, self.longest = capacity, longest
        self.limit = int(block * capacity * (1 - slack))
        self.sequence = task << 32
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        while at < total:
            full = total - at >= self.capacity
            size = self.capacity if full else min(self.longest, total - at)
            piece = (key, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), total)
            at += size
            if full:
                yield (*piece, self.sequence, 0)
                self.sequence += 1
                continue
            if self.tokens + size > self.limit:
                yield from self.flush()
            self.waiting.append(piece)
            self.tokens += size

    def flush(self) -> Iterator[tuple]:
        for group in windows_of([p[2] for p in self.waiting], self.capacity):
            offset = 0
            for i in sorted(group):
                yield (*self.waiting[i], self.sequence, offset)
                offset += self.waiting[i][2]
            self.sequence += 1
        self.waiting, self.tokens = [], 0


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = WINDOW,
    longest: int = 1024,
    block: int = 128,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens.

    A document's ids are those of the tokenizer file at `path` and then END. While it has `capacity` ids left, it fills
    sequences of its own; the rest is cut into pieces of at most `longest` ids. A task collects pieces worth `block`
    sequences and packs them by multiway differencing into the fewest windows of near-equal size that hold them.
    There is no shuffle: tasks are independent, hold one block at a time, and give the same rows when run again, as
    a sequence's number is the partition's number and a count within it. Padding is about one part in a hundred, but
    for the last block of a task, which has fewer windows.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is one piece that
    holds END. Repeated rows are packed each. Other columns of docs are ignored; no rows give no pieces.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        tokenizer = chunk_tokenizer(path or default_path())
        packer = Packer(TaskContext.get().partitionId(), capacity, longest, block)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            kinds = [key_type] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        rows: list[tuple] = []
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.extend(packer.add(key, tokenizer.encode(text) + END))
                if len(rows) >= 10_000:
                    yield table(rows)
                    rows = []
        rows.extend(packer.flush())
        if rows:
            yield table(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
