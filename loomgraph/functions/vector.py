"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import EMBEDDING_DIMENSIONS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    whole = F.transform(a, lambda x: x.cast("double"))
    # The norm is bound as an array's one element: inside the lambda over components it would be computed for each.
    return F.transform(F.array(norm(a)), lambda size: F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(whole))[0]


def clamp(x: Column) -> Column:
    """Into 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def hashed_vectors(texts: list[str], dimensions: int = EMBEDDING_DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed words and word pairs: the offline stand-in for a sentence model."""
    import zlib

    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.lower().split()
        for term in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
            h = zlib.crc32(term.encode())
            out[i, h % dimensions] += 1.0 if h & (1 << 31) else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


Embedder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: Embedder = hashed_vectors, batch: int = 32) -> DataFrame:
    """Add unit vectors of a text column, computed in Arrow batches; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(text).to_pylist()]
            parts = [embedder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = np.concatenate(parts).astype(np.float32) if parts else np.empty((0, 1), dtype=np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
            yield pa.record_batch([*rows.columns, flat], names=[*rows.schema.names, out])

    schema = df.schema
    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{out}` array<float>")
