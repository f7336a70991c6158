"""Statistics of groups; nulls are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(v: Column, weight: Column | None = None) -> Column:
    """[A1] Plain or weighted mean; null where nothing is left."""
    if weight is None:
        return F.avg(v)
    w = F.when(v.isNotNull(), weight)
    return F.try_divide(F.sum(v * w), F.sum(w))


def deviation(v: Column, weight: Column | None = None) -> Column:
    """[A2, A3, A4] Population standard deviation; weighted by moments where a weight is given."""
    if weight is None:
        return F.stddev_pop(v.cast("double"))
    m = mean(v, weight)
    return F.sqrt(F.greatest(mean(v * v, weight) - m * m, F.lit(0.0)))
