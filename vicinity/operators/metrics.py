"""Latency histograms and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 600


def bucket_of(nanos: Column) -> Column:
    """Whole microseconds; the last bucket takes all beyond."""
    return F.least(F.lit(BUCKETS - 1), F.floor(nanos / 1000)).cast("int")


def histogram(rows: DataFrame, nanos: str) -> DataFrame:
    """bucket, n, sum_us (microseconds cut to whole ones)."""
    return rows.groupBy(bucket_of(F.col(nanos)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col(nanos) / 1000)).alias("sum_us"))


def cumulative(hist: DataFrame) -> DataFrame:
    """bucket, le (milliseconds), value: running counts over all BUCKETS buckets."""
    every = hist.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(hist.select("bucket", "n"), "bucket", "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket"))
    return dense.select("bucket", ((F.col("bucket") + 1) / 1000).alias("le"), running.cast("long").alias("value"))


def percentile(hist: DataFrame, p: float) -> DataFrame:
    """Upper end, in milliseconds, of the first bucket at which max(1, floor(count * p)) are reached; 0 without rows."""
    c = cumulative(hist)
    total = c.agg(F.max("value").alias("total"))
    target = F.greatest(F.lit(1), F.floor(F.col("total") * p))
    reached = c.join(F.broadcast(total)).where((F.col("value") >= target) & (F.col("total") > 0))
    return reached.agg(F.coalesce((F.min("bucket") + 1) / 1000, F.lit(0.0)).alias("value_ms"))


def counters(rows: DataFrame, backend: Column, failed: Column) -> DataFrame:
    return rows.groupBy(backend.alias("backend")).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"))


def gauge(rows: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """value: how many are open now, from rows that open one and rows that close one."""
    return rows.agg((F.count_if(opened) - F.count_if(closed)).alias("value"))


def round_robin(connection: Column, backends: int) -> Column:
    return F.pmod(connection, F.lit(backends)).cast("int")


def failover(connection: Column, down: list[int], backends: int) -> Column:
    """The first backend from connection mod backends on that isn't down; null if all are."""
    order = [F.pmod(connection + i, F.lit(backends)).cast("int") for i in range(backends)]
    return F.coalesce(*[F.when(~b.isin(*down) if down else F.lit(True), b) for b in order])
