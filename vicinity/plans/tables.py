"""How the test tables stand for transactions, references and queries, in Spark and in SQL.

embeddings: every row is a reference (fraud if label < 5); rows whose vec_id is divisible by 100 are queries, against
all other rows. events: an event is a transaction of amount `value`, customer `user_id`, category `event_type`, and
latency 1000 * value nanoseconds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import quantise
from ..operators import index, kmeans
from ..sources.readers import table
from ..storage import written

DIMS = 64
SEEDS = 16
#: Category risks of the events.
EVENT_RISK = {"click": 0.15, "view": 0.20, "purchase": 0.75, "error": 0.85, "signup": 0.35}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ref_id"), quantise(F.col("embedding")).alias("v"), (F.col("label") < 5).cast("int").alias("is_fraud"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("ref_id % 100 = 0").select(F.col("ref_id").alias("qid"), "v", "is_fraud")


def seeds(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return kmeans.seeds(points(spark, sf_dir), SEEDS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = seeds(spark, sf_dir)
    return index.boxes(index.assign(points(spark, sf_dir), c), c, DIMS)


def indexed(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(seeds, postings, boxes), assigned once for all uses within a query and kept in the shared folder."""
    c = seeds(spark, sf_dir)
    rows = written(index.assign(points(spark, sf_dir), c), "postings")
    return c, rows, written(index.boxes(rows, c, DIMS), "boxes")


DAY = 86_400_000_000


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what a request brings along: the customer's count of 24 hours, the last time, the average so far.

    Customers are dealt by days, so that one with many events doesn't fall to one task: a day's group has its events and
    those of the day before, and what was earlier comes as totals from a table with a row for each customer and day.
    """
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # sums of whole cents: their order doesn't matter
    cents = F.round(F.col("value") * 100, 0).cast("long")
    rows = e.select("*", micros.alias("_at"), cents.alias("_cents"), F.floor(micros / DAY).alias("_day"))
    days = rows.groupBy("user_id", "_day").agg(F.sum("_cents").alias("_c"), F.count("_cents").alias("_k"), F.count("*").alias("_n"), F.max("ts").alias("_t"))
    earlier = W.partitionBy("user_id").orderBy("_day").rangeBetween(W.unboundedPreceding, -2)
    past = [f.over(earlier).alias(f"_{name}0") for name, f in (("c", F.sum("_c")), ("n", F.sum("_n")), ("t", F.max("_t")))]
    days = days.select(F.col("user_id").alias("_user"), F.col("_day").alias("_slot"), *past)
    both = rows.select("*", F.explode(F.array(F.col("_day"), F.col("_day") + 1)).alias("_slot"))
    both = both.join(days, F.col("user_id").eqNullSafe(F.col("_user")) & (both["_slot"] == days["_slot"])).drop("_user", days["_slot"])
    by = W.partitionBy("user_id", "_slot").orderBy("ts", "event_id")
    day = W.partitionBy("user_id", "_slot").orderBy("_at").rangeBetween(-DAY, 0)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero(F.count("*").over(before)) + zero(F.col("_n0"))
    sum_ = F.when(F.sum("_cents").over(before).isNull() & F.col("_c0").isNull(), F.lit(None)).otherwise(zero(F.sum("_cents").over(before)) + zero(F.col("_c0")))
    out = both.select(
        "*", F.count("*").over(day).alias("tx_24h"), F.coalesce(F.lag("ts").over(by), F.col("_t0")).alias("last_ts"), F.try_divide(sum_, n).alias("_avg"),
    )
    return out.where(F.col("_slot") == F.col("_day")).select(*e.columns, "tx_24h", "last_ts", (F.col("_avg") / 100).alias("avg_before"))


# The same in SQL.
CTE_POINTS = """
points AS (
  SELECT vec_id AS ref_id,
         list_transform(embedding, lambda x: CAST(round(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * 10000.0) AS INT)) AS v,
         CAST(label < 5 AS INT) AS is_fraud
  FROM embeddings
), queries AS (SELECT ref_id AS qid, v, is_fraud FROM points WHERE ref_id % 100 = 0)
"""
DIST = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] - z[2] AS BIGINT) * (z[1] - z[2]))) AS BIGINT)"
CTE_KNN = (
    CTE_POINTS
    + f""", knn AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS rank FROM (
      SELECT q.qid, p.ref_id, p.is_fraud, {DIST.format(a="q.v", b="p.v")} AS dist
      FROM queries q JOIN points p ON q.qid <> p.ref_id))
  WHERE rank <= 5)
"""
)
CTE_CLUSTERS = (
    CTE_POINTS
    + f""", seeds AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INT) AS cluster_id, v AS c FROM points ORDER BY ref_id LIMIT {SEEDS}),
near AS (
  SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY d, cluster_id) AS place FROM (
    SELECT p.ref_id, p.v, p.is_fraud, s.cluster_id, {DIST.format(a="p.v", b="s.c")} AS d FROM points p CROSS JOIN seeds s)),
postings AS (SELECT cluster_id, ref_id, v, is_fraud, d FROM near WHERE place = 1),
dims AS (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM postings),
perdim AS (SELECT cluster_id, i, min(x) AS lo, max(x) AS hi FROM dims GROUP BY ALL),
boxes AS (SELECT cluster_id, list(lo ORDER BY i) AS mn, list(hi ORDER BY i) AS mx FROM perdim GROUP BY ALL),
probed AS (SELECT q.qid, n.cluster_id, n.place FROM queries q JOIN near n ON q.qid = n.ref_id)
"""
)
CTE_HISTORY = """
history AS (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS tx_24h,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER b AS DOUBLE) / count(*) OVER b / 100 AS avg_before
  FROM events
  WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
