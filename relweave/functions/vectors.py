"""Vectors as arrays of doubles, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if a length differs or a value is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def square(a: Column) -> Column:
    """Sum of squares; null if a value is null."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def unit(a: Column, length: float = 1.0) -> Column:
    """The vector at that length; a zero vector stays zero. The norm is computed once, not for each element."""
    return let(
        F.sqrt(square(a)),
        lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") * (F.lit(length) / n))).otherwise(F.transform(a, lambda x: x.cast("double"))),
    )


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """Cosine similarity; 0 for a null, zero or other than dim long vector."""
    norms = square(a) * square(b)
    c = F.when(norms > 0, dot(a, b) / F.sqrt(norms))
    known = (F.size(a) == dim) & (F.size(b) == dim) if dim else F.lit(True)
    return F.coalesce(F.when(known, c), F.lit(0.0))


def weighted_unit(vectors: dict[Column | str, float], dim: int) -> Column:
    """Unit vectors scaled by the roots of their weights, end to end: the dot product of two is their weighted similarity.

    A vector that is null or not dim long counts as zero.
    """
    zero = F.array_repeat(F.lit(0.0), dim)
    parts = []
    for c, w in vectors.items():
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(F.when(F.size(c) == dim, unit(c, float(w) ** 0.5)), zero))
    return F.concat(*parts)
