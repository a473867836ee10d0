"""Random vectors for warm-up and soak tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DIMS


def vectors(spark: SparkSession, n: int, *, dims: int = DIMS, top: int = 10_000, seed: int = 0) -> DataFrame:
    """qid, v: n vectors with components from 0 to `top`, the same for a seed in any partitioning."""
    part = lambda i: F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(top + 1)).cast("int")
    return spark.range(n).select(F.col("id").alias("qid"), F.array(*[part(i) for i in range(dims)]).alias("v"))
