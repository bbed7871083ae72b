"""Vector columns as expressions; scans of many vectors go through operators.search instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the common length, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(products, lambda p: p.isNotNull()), F.lit(0.0), lambda s, p: s + p)


def l2_normalize(v: Column) -> Column:
    """Divided by its length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(v: Column, digits: int) -> Column:
    """Entries rounded half away from zero.  What rounds to zero keeps its sign, as IEEE has it and DuckDB; Spark's round drops it."""

    def entry(x: Column) -> Column:
        r = F.round(x, digits)
        return F.when(r == 0, x.cast("double") * F.lit(0.0)).otherwise(r)

    return F.transform(v, entry)
