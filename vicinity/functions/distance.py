"""Distances between whole-number vectors, as expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column, dims: int) -> Column:
    """Sum of squared differences, unrolled over the dimensions."""
    terms = [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))).cast("bigint") for i in range(dims)]
    return reduce(lambda x, y: x + y, [t * t for t in terms])


def squared_l2_any(a: Column, b: Column) -> Column:
    """The same for vectors of any length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y).cast("bigint")).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def box_bound(q: Column, low: Column, high: Column, dims: int) -> Column:
    """Least squared distance from q to any point of the box [low, high]."""
    terms = []
    for i in range(dims):
        x, lo, hi = F.get(q, F.lit(i)), F.get(low, F.lit(i)), F.get(high, F.lit(i))
        terms.append(F.greatest(lo - x, x - hi, F.lit(0)).cast("bigint"))
    return reduce(lambda x, y: x + y, [t * t for t in terms])
