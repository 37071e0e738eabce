"""Column functions on arrays of numbers: similarity, length, pooling, a hashing embedder, rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for different lengths, zero vectors and nulls."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; shorter than 1e-12 it stays as it is."""
    size = norm(a)
    return F.when(size < 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def mean_pooled(rows: Column) -> Column:
    """Element-wise mean of an array of equally long arrays; null for an empty one."""
    total = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), F.transform(rows[0], lambda x: x.cast("double")), lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))


def fused_score(*ranks: Column, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the arms that know the row."""
    parts = [F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks]
    return sum(parts[1:], parts[0])


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def hash_embedding(tokens: list[str], dim: int) -> np.ndarray:
    """Signed feature hashing of words and word pairs, 1 + ln(count) each, at length 1."""
    long = [t for t in tokens if len(t) > 1]
    counts: dict[str, int] = {}
    for t in [*long, *(f"{x}_{y}" for x, y in zip(long, long[1:]))]:
        counts[t] = counts.get(t, 0) + 1
    out = np.zeros(dim)
    for t, n in counts.items():
        h = fnv1a(t)
        out[h % dim] += (-1.0 if h >> 31 else 1.0) * (1 + np.log(n))
    size = np.linalg.norm(out)
    return out / size if size > 1e-12 else out


def hash_embedder(dim: int = 64):
    """A column function from token arrays to hash embeddings; a null array gives a null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else hash_embedding(list(t), dim).astype(np.float32))

    return embed
