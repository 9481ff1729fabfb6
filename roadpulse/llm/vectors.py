"""Integer vectors: quantizing, and inner products that never wrap."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

#: scores beyond 64 bits are held at these limits
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(vector, scale):
    """floor(scale * x) of each component as longs (beyond 64 bits: the limit);
    null where the vector is null or holds null or non-finite components."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(numbers, lambda x: F.floor(x * scale).cast("long")))


def _most(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of a row of each, nor any part of its sum, is larger."""
    side = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    return side[0] * side[1] * max(1, a.shape[1])


def _held(exact) -> np.ndarray:
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``: exact, by
    floating point where it can't round, and held at the 64-bit limits."""
    most = _most(a, b)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return _held(a.astype(object) @ b.astype(object).T) if len(a) and len(b) else np.zeros((len(a), len(b)), np.int64)


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, exact and held like ``products``."""
    if _most(a, b) < 1 << 63:
        return np.einsum("ij,ij->i", a, b)
    return _held((a.astype(object) * b.astype(object)).sum(1))
