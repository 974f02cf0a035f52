"""Column builders over vectors of floats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant that the optimizer folds into the scan."""
    return F.lit([float(x) for x in vector]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double from left to right; 0 where the lengths differ."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_unit(a: Column, within: float = 1e-3) -> Column:
    """The invariant under which the inner product is the cosine."""
    return F.abs(norm(a) - 1) <= within
