"""Vector scalars in double precision over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Summed in order of the components; vectors of several lengths give null."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)


def normalise(v: Column) -> Column:
    """The unit vector; one without length is an error."""
    length = norm(v)
    return F.when(length == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(v, lambda x: x / length))


def valid(v: Column, dimension: int) -> Column:
    """Of the dimension, finite, and of norm 1 within a millionth."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & (F.abs(norm(v) - 1) <= 1e-6), F.lit(False))
