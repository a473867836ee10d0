"""Evaluation: confusion matrix, nearest-rank percentiles, sweeps over configurations."""

from __future__ import annotations

import math
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..config import SearchConfig
from ..functions.rules import approved, borderline
from . import search


def confusion(rows: DataFrame | GroupedData, predicted: str = "approved", expected: str = "expected_approved") -> DataFrame:
    """tp: rightly denied, tn: rightly approved, fp: wrongly denied, fn: wrongly approved."""
    p, e = F.col(predicted), F.col(expected)
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(n(~p & ~e, "tp"), n(p & e, "tn"), n(~p & e, "fp"), n(p & ~e, "fn"))


def error_rates(matrix: DataFrame) -> DataFrame:
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rate = lambda c: F.try_divide(F.lit(100.0) * F.col(c), total)
    return matrix.select("*", rate("fp").alias("fp_pct"), rate("fn").alias("fn_pct"))


def nearest_rank(rows: DataFrame, value: str, *percents: float) -> DataFrame:
    """percent, value: for each percent the value at place min(n - 1, floor(n * percent / 100 + 0.5)) in ascending order,
    from 0.

    Equal values are counted first, and the counts are dealt to partitions by ranges of the value. The ranges (as many
    rows as partitions) tell in which of them a place lies; only the values of that range are ordered, apart for each
    percent.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    parts = ranged.groupBy("part").agg(F.sum("n").alias("sum"), F.min("x").alias("low"), F.max("x").alias("high"))
    got = sorted(parts.collect(), key=lambda r: r["low"])
    total, before, wanted = sum(r["sum"] for r in got), 0, []
    places = {p: min(total - 1, math.floor(total * (p / 100.0) + 0.5)) for p in percents}
    for r in got:
        wanted += [(float(p), i - before, r["low"], r["high"]) for p, i in places.items() if before <= i < before + r["sum"]]
        before += r["sum"]
    kind = counts.schema["x"].dataType
    schema = StructType([StructField("percent", DoubleType()), StructField("place", LongType()), StructField("low", kind), StructField("high", kind)])
    small = rows.sparkSession.createDataFrame(wanted, schema)  # a row for each percent
    inside = counts.join(F.broadcast(small), (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    upto = F.sum("n").over(Window.partitionBy("percent").orderBy("x"))
    return inside.withColumn("upto", upto).where("upto > place").groupBy("percent").agg(F.min("x").alias("value"))


def latency_summary(rows: DataFrame, nanos: str) -> DataFrame:
    """avg (whole nanoseconds) and max."""
    return rows.agg(F.expr(f"sum({nanos}) div count({nanos})").alias("avg_ns"), F.max(nanos).alias("max_ns"))


def best_configuration(results: DataFrame, p99: str = "p99") -> DataFrame:
    """Among configurations without errors the one with the least p99."""
    w = F.struct(F.col(p99).alias("p99"), "nprobe", "nprobe_border")
    return results.where("fp = 0 AND fn = 0").agg(F.min(w).alias("b")).where("b IS NOT NULL").select("b.nprobe", "b.nprobe_border", "b.p99")


def scanned(queries: DataFrame, centroids, boxes: DataFrame, configs: list[SearchConfig], *, border: bool = False) -> DataFrame:
    """slot, qid, scanned: how many rows each configuration's probes look at, which its latency goes with."""
    each = search.probed(queries, centroids, configs, border).select("slot", "qid", F.explode("clusters").alias("cluster_id"))
    return each.join(boxes.select("cluster_id", "cnt"), "cluster_id").groupBy("slot", "qid").agg(F.sum("cnt").alias("scanned"))


def p99_by_configuration(rows: DataFrame, value: str, configs: list[SearchConfig]) -> DataFrame:
    """nprobe, nprobe_border, p99 of a value by slot."""
    parts = [nearest_rank(rows.where(F.col("slot") == i), value, 99).select(F.lit(c.nprobe).alias("nprobe"), F.lit(c.nprobe_border).alias("nprobe_border"), F.col("value").alias("p99")) for i, c in enumerate(configs)]
    return reduce(DataFrame.unionByName, parts)


def sweep(queries: DataFrame, expected: DataFrame, centroids, postings: DataFrame, boxes: DataFrame, configs: list[SearchConfig], **options) -> DataFrame:
    """A row for each configuration: its confusion matrix, from one search for all of them. expected: qid,
    expected_approved."""
    found = search.search_many(queries, centroids, postings, boxes, configs, **options).groupBy("slot", "qid").agg(F.sum("is_fraud").alias("f"))
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(c.nprobe).alias("nprobe"), F.lit(c.nprobe_border).alias("nprobe_border")) for i, c in enumerate(configs)]))
    every = queries.select("qid", slots.alias("s")).select("qid", "s.*").join(found, ["slot", "qid"], "left")
    judged = every.join(expected, "qid").withColumn("approved", approved(F.coalesce("f", F.lit(0))))
    return confusion(judged.groupBy("slot", "nprobe", "nprobe_border")).drop("slot")


def timed(df: DataFrame) -> tuple[float, int]:
    """Seconds and rows of one run that computes every column."""
    began = time.monotonic()
    n = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    return time.monotonic() - began, n


def dataset_facts(rows: DataFrame, fraud: Column, vector: str = "v") -> DataFrame:
    """Counts and shares of both labels, and how many vectors are borderline; rows without an amount don't count there."""
    n = F.count("*")
    border = borderline(F.col(vector)) & (F.get(vector, F.lit(0)) != 0)
    share = lambda c: F.try_divide(F.lit(100.0) * F.count_if(c), n)
    return rows.agg(
        n.alias("n"), F.count_if(fraud).alias("n_fraud"), F.count_if(~fraud).alias("n_legit"), share(fraud).alias("fraud_pct"),
        share(~fraud).alias("legit_pct"), F.count_if(border).alias("n_borderline"),
    )


def countable(vector: Column) -> Column:
    """Rows that an evaluation takes: amount and instalments aren't both zero."""
    return ~((F.get(vector, F.lit(0)) == 0) & (F.get(vector, F.lit(1)) == 0))
