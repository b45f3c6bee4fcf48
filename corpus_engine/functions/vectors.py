"""Column expressions over embedding arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a, b) -> Column:
    """The vector store's default distance: sum of squared differences."""
    diff = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return _sum(F.transform(diff, lambda d: d * d))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))

