"""Column functions on arrays of floats, and numpy scoring over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Unclamped, over the shorter length; 0 with a zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def cosine01(a: Column, b: Column) -> Column:
    """From 0 to 1, and 0 of vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))).otherwise(0.0)


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def sign_words(a: Column, dims: int) -> Column:
    """One bit for each dimension, set where the value is positive, in an array of longs."""

    def word(w: int) -> Column:
        bits = [F.when(F.get(a, F.lit(i)) > 0, F.lit(1 << (i - w)) if i - w < 63 else F.lit(-(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(w, min(w + 64, dims))]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return F.array(*(word(w) for w in range(0, dims, 64)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def encode_int8(a: Column, low: list[float], high: list[float]) -> Column:
    """Each value's place between its dimension's bounds, from -128 to 127."""
    lo, span = F.array(*map(F.lit, low)), F.array(*(F.lit(float(h - v) or 1.0) for v, h in zip(low, high, strict=True)))
    scaled = F.zip_with(F.zip_with(a, lo, lambda x, m: x.cast("double") - m), span, lambda d, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / s)))
    return F.transform(scaled, lambda x: (F.round(x * 255) - 128).cast("tinyint"))


def as_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def hashed_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of word counts by hashed place: the default where no embedding model is given."""
    from zlib import crc32

    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = crc32(w.encode())
            out[i, h % dims] += 1 if h >> 31 else -1
    return unit_rows(out)
