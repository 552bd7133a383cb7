"""Embedding of texts by a pluggable encoder, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32  # fixed value


class HashingEncoder:
    """Offline default: signed hashed character trigrams of lower-case words. Any callable from texts to vectors can replace it."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                padded = f" {word} ".encode()
                for i in range(len(padded) - 2):
                    h = zlib.crc32(padded[i : i + 3])
                    out[row, h % self.dim] += 1 if h & 0x80000000 else -1
        return out


def encode_batch(texts: pa.Array, encoder: Callable, normalize: bool = True, batch: int = BATCH) -> pa.Array:
    """The vectors of texts; only `batch` of them at once are Python's, the others stay in Arrow's buffers."""
    import numpy as np

    out = [pa.array([], pa.list_(pa.float32()))]
    for at in range(0, len(texts), batch):
        m = np.asarray(encoder([t or "" for t in texts.slice(at, batch).to_pylist()]), np.float32)
        if normalize:
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        ends = np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(m.reshape(-1), pa.float32())))
    return pa.concat_arrays(out)


def encode_documents(docs: DataFrame, encoder: Callable, text_col: str = "text", normalize: bool = True, batch: int = BATCH) -> DataFrame:
    """docs with embedding (array<float>). The encoder is shipped to the workers, where it may load its model on first use.

    With normalize, rows have length 1; a zero vector stays. A null text is encoded as an empty one.
    """
    run = F.arrow_udf(lambda texts: encode_batch(texts, encoder, normalize, batch), "array<float>")
    return docs.withColumn("embedding", run(F.col(text_col)))
