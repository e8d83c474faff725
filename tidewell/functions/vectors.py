"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; a zero vector has similarity 0 with everything."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(v: Column | str) -> Column:
    """The vector scaled to length 1; compute once per row before a join of many pairs."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return scaled[0]  # the array binds the norm, which else every element would compute anew


def mean_vector(vectors: Column | str) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    vectors = F.col(vectors) if isinstance(vectors, str) else vectors
    n = F.size(vectors)
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)
