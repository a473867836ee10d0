"""The query catalogue: QUERIES maps a name to f(spark, sf_dir), ORACLES to DuckDB SQL with the same columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MAX_KNOWN, NormConfig, SearchConfig
from ..functions import features, rules
from ..functions.features import quantise_f32
from ..operators import evaluate, index, kmeans, knn, metrics, search
from ..sources import readers, sinks
from ..sources.readers import table
from ..storage import shared_path, written
from ..streaming import scoring
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NORM = NormConfig()
INV = NORM.inverse


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL; a comment says why one has none."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def clamp_sql(x: str) -> str:
    return f"greatest(least({x}, CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"


def quant_sql(x: str) -> str:
    return f"CAST(round(greatest(least(CAST({x} AS DOUBLE) * 10000.0, 10000.0), -10000.0)) AS INT)"


def inv_sql(k: float) -> str:
    return f"CAST(CAST(1 AS FLOAT) / CAST({k} AS FLOAT) AS FLOAT)"


_AMOUNT = clamp_sql(f"CAST(value AS FLOAT) * {inv_sql(10000)}")
_RATIO = clamp_sql(f"CAST(CAST(value AS FLOAT) / (CASE WHEN CAST(avg_before AS FLOAT) > 0 THEN CAST(avg_before AS FLOAT) ELSE CAST(1 AS FLOAT) END) AS FLOAT) * {inv_sql(10)}")
_HOUR = f"CAST(extract(hour FROM ts) AS FLOAT) * {inv_sql(23)}"
_DAY = f"CAST(isodow(ts) - 1 AS FLOAT) * {inv_sql(6)}"
_EPOCH = "CAST(floor(epoch({0})) AS BIGINT)"
_MINUTES = (
    "CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE "
    + clamp_sql(f"CAST(CAST({_EPOCH.format('ts')} - {_EPOCH.format('last_ts')} AS FLOAT) / CAST(60 AS FLOAT) AS FLOAT) * {inv_sql(1440)}")
    + " END"
)
_COUNT = clamp_sql(f"CAST(tx_24h AS FLOAT) * {inv_sql(20)}")
_RISK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS FLOAT)" for k, v in t.EVENT_RISK.items()) + " ELSE CAST(0.5 AS FLOAT) END"


# --- scalar functions -------------------------------------------------------------------------------------------------
@query(f"SELECT event_id, {quant_sql(_AMOUNT)} AS amount_q FROM events")
def q_clamp_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", quantise_f32(features.scaled(F.col("value"), INV("max_amount"))).alias("amount_q"))


@query(f"WITH {t.CTE_HISTORY} SELECT event_id, {quant_sql(_RATIO)} AS ratio_q FROM history")
def q_ratio_guard(spark: SparkSession, sf: str) -> DataFrame:
    r = features.ratio(F.col("value"), F.col("avg_before"), INV("amount_vs_avg_ratio"))
    return t.history(spark, sf).select("event_id", quantise_f32(r).alias("ratio_q"))


@query("SELECT o_orderkey, CAST(round(greatest(least(CAST(greatest(least(CAST(o_totalprice AS FLOAT) * " + inv_sql(500000) + ", CAST(1 AS FLOAT)), CAST(0 AS FLOAT)) AS DOUBLE) * 10000.0, 10000.0), -10000.0)) AS INT) AS price_q FROM orders")
def q_quantize_f32(spark: SparkSession, sf: str) -> DataFrame:
    inv = NormConfig({"max": 500000.0}).inverse("max")
    return table(spark, sf, "orders").select("o_orderkey", quantise_f32(features.scaled(F.col("o_totalprice"), inv)).alias("price_q"))


@query(f"WITH {t.CTE_POINTS} SELECT ref_id, array_to_string(v, ',') AS v FROM points")
def q_quantize_vec(spark: SparkSession, sf: str) -> DataFrame:
    return t.points(spark, sf).select("ref_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


@query(f"SELECT event_id, {quant_sql(_HOUR)} AS hour_q, {quant_sql(_DAY)} AS day_q FROM events")
def q_hour_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", quantise_f32(features.hour_of_day(F.col("ts"))).alias("hour_q"), quantise_f32(features.day_of_week(F.col("ts"))).alias("day_q"))


@query(f"SELECT event_id, {_EPOCH.format('ts')} AS epoch_s FROM events")
def q_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("epoch_s"))


@query(f"WITH {t.CTE_HISTORY} SELECT event_id, {quant_sql(_MINUTES)} AS minutes_q FROM history")
def q_minutes_since_last(spark: SparkSession, sf: str) -> DataFrame:
    return t.history(spark, sf).select("event_id", quantise_f32(features.minutes_since(F.col("ts"), F.col("last_ts"), INV("max_minutes"))).alias("minutes_q"))


@query(f"WITH {t.CTE_HISTORY} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {quant_sql(_MINUTES)} = -10000) AS BIGINT) AS n_sentinel FROM history")
def q_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    m = quantise_f32(features.minutes_since(F.col("ts"), F.col("last_ts"), INV("max_minutes")))
    return t.history(spark, sf).agg(F.count("*").alias("n"), F.count_if(m == -10000).alias("n_sentinel"))


@query(f"WITH {t.CTE_HISTORY} SELECT event_id, tx_24h FROM history")
def q_tx_count_24h(spark: SparkSession, sf: str) -> DataFrame:
    return t.history(spark, sf).select("event_id", "tx_24h")


@query(f"WITH {t.CTE_HISTORY} SELECT event_id, avg_before FROM history")
def q_customer_running_avg(spark: SparkSession, sf: str) -> DataFrame:
    return t.history(spark, sf).select("event_id", "avg_before")


@query("""
WITH first AS (SELECT o_custkey, l_suppkey, min(o_orderkey) AS first_order FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT DISTINCT o.o_orderkey, l.l_suppkey, CAST(f.first_order < o.o_orderkey AS INT) AS known
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN first f ON f.o_custkey = o.o_custkey AND f.l_suppkey = l.l_suppkey""")
def q_known_merchant(spark: SparkSession, sf: str) -> DataFrame:
    """A merchant is known if an earlier order of the customer had it; decided by a minimum, without sets."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_suppkey").distinct()
    first = rows.groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderkey").alias("first_order"))
    return rows.join(first, ["o_custkey", "l_suppkey"]).select("o_orderkey", "l_suppkey", (F.col("first_order") < F.col("o_orderkey")).cast("int").alias("known"))


@query("""
WITH km AS (SELECT o_custkey, list(DISTINCT l_suppkey ORDER BY l_suppkey)[1:32] AS known FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT DISTINCT o_orderkey, l_suppkey, CAST(CASE WHEN list_contains(known, l_suppkey) THEN 0 ELSE 10000 END AS INT) AS unknown_q
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN km USING (o_custkey)""")
def q_known_merchant_array(spark: SparkSession, sf: str) -> DataFrame:
    """Membership in an array of at most 32 known merchants, the smallest ids of each customer."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_suppkey").distinct()
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_suppkey"))
    each = rows.select("o_custkey", "l_suppkey").distinct().withColumn("n", first).where(F.col("n") <= MAX_KNOWN)
    known = each.groupBy("o_custkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("known"))
    flag = quantise_f32(features.unknown_merchant(F.col("known"), F.col("l_suppkey")))
    return rows.join(known, "o_custkey").select("o_orderkey", "l_suppkey", flag.alias("unknown_q"))


@query(f"SELECT event_id, {quant_sql(_RISK)} AS risk_q FROM events")
def q_mcc_lookup_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", quantise_f32(features.risk(F.col("event_type"), t.EVENT_RISK)).alias("risk_q"))


@query("SELECT event_id, CAST(coalesce(r, 0.5) AS DOUBLE) AS risk FROM events LEFT JOIN (VALUES ('click', 0.15), ('purchase', 0.75), ('error', 0.85)) m(k, r) ON event_type = k")
def q_mcc_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    small = spark.createDataFrame([("click", 0.15), ("purchase", 0.75), ("error", 0.85)], "event_type string, r double")
    return table(spark, sf, "events").join(F.broadcast(small), "event_type", "left").select("event_id", F.coalesce("r", F.lit(0.5)).alias("risk"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


_VECTOR_SQL = (
    "[" + ", ".join(f"{quant_sql(x)}" for x in (
        _AMOUNT, clamp_sql(f"CAST(1 AS FLOAT) * {inv_sql(12)}"), _RATIO, _HOUR, _DAY, _MINUTES,
        "CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE CAST(0 AS FLOAT) END", "CAST(0 AS FLOAT)", _COUNT,
        "CAST(CAST(event_type <> 'signup' AS INT) AS FLOAT)", "CAST(CAST(event_type = 'purchase' AS INT) AS FLOAT)",
        "CAST(CAST(last_ts IS NULL AS INT) AS FLOAT)", _RISK, clamp_sql(f"CAST(avg_before AS FLOAT) * {inv_sql(10000)}"),
    )) + "]"
).replace(clamp_sql(f"CAST(avg_before AS FLOAT) * {inv_sql(10000)}"), clamp_sql(f"coalesce(CAST(avg_before AS FLOAT), CAST(0 AS FLOAT)) * {inv_sql(10000)}"))
CTE_VECTORS = t.CTE_HISTORY + f", vectors AS (SELECT event_id, ts, value, {_VECTOR_SQL} AS v FROM history)"


def event_vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    columns = {
        "amount": c("value"), "installments": F.lit(1), "avg_amount": c("avg_before"), "at": c("ts"), "last_at": c("last_ts"), "km_from_last": F.lit(0.0),
        "km_from_home": F.lit(0.0), "tx_count_24h": c("tx_24h"), "is_online": c("event_type") != "signup", "card_present": c("event_type") == "purchase",
        "known_merchants": F.when(c("last_ts").isNull(), F.array().cast("array<string>")).otherwise(F.array(c("event_type"))), "merchant_id": c("event_type"),
        "mcc": c("event_type"), "merchant_avg": c("avg_before"),
    }
    v = features.feature_vector(columns, NormConfig(risk=t.EVENT_RISK))
    return t.history(spark, sf).select("event_id", "ts", "value", v.alias("v"))


@query(f"WITH {CTE_VECTORS} SELECT event_id, array_to_string(v, ',') AS v FROM vectors")
def q_feature_vector_14(spark: SparkSession, sf: str) -> DataFrame:
    return event_vectors(spark, sf).select("event_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


# --- predicates -------------------------------------------------------------------------------------------------------
_LEGIT = "(v[1] <= 500 AND v[3] <= 500 AND v[2] <= 2500 AND v[9] <= 2500 AND v[8] <= 500 AND v[13] IN (1500, 2000, 2500, 3000) AND v[12] = 0)"
_FRAUD = "(v[1] >= 5000 AND v[2] >= 4167 AND v[9] >= 3000 AND v[8] >= 1500 AND v[13] IN (7500, 8000, 8500) AND v[12] = 10000)"


@query(f"WITH {CTE_VECTORS} SELECT event_id, {_LEGIT} AS legit, {_FRAUD} AS fraud, NOT {_LEGIT} AND NOT {_FRAUD} AS borderline FROM vectors")
def q_borderline(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return event_vectors(spark, sf).select("event_id", rules.obviously_legit(v).alias("legit"), rules.obviously_fraud(v).alias("fraud"), rules.borderline(v).alias("borderline"))


@query(f"WITH {CTE_VECTORS} SELECT event_id FROM vectors WHERE v[12] = 10000 AND v[13] >= 7500")
def q_edge_case_filter(spark: SparkSession, sf: str) -> DataFrame:
    return event_vectors(spark, sf).where(rules.edge_case(F.col("v"))).select("event_id")


@query(f"WITH {CTE_VECTORS} SELECT event_id FROM vectors WHERE NOT (v[1] = 0 AND v[2] = 0)")
def q_bench_row_filter(spark: SparkSession, sf: str) -> DataFrame:
    return event_vectors(spark, sf).where(evaluate.countable(F.col("v"))).select("event_id")


@query("SELECT CAST(k IS NULL OR k % 10 = 0 AS BOOLEAN) AS rejected, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def q_validity_split(spark: SparkSession, sf: str) -> DataFrame:
    """Events become JSON requests, some without a merchant; both sides of the split are counted."""
    k = F.from_json("props", "k BIGINT")["k"]
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.struct(F.col("value").alias("amount"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("requested_at")).alias("transaction"),
        F.struct(F.when(k % 10 != 0, k.cast("string")).alias("id")).alias("merchant"),
    ))
    good, bad = readers.split_valid(readers.parse_transactions(table(spark, sf, "events").select(body.alias("body"))))
    both = good.select(F.lit(False).alias("rejected")).unionByName(bad.select(F.lit(True).alias("rejected")))
    return both.groupBy("rejected").agg(F.count("*").alias("n"))


# --- exact neighbours -------------------------------------------------------------------------------------------------
@query(f"WITH {t.CTE_POINTS} SELECT q.qid, p.ref_id, {t.DIST.format(a='q.v', b='p.v')} AS dist FROM queries q JOIN points p ON q.qid <> p.ref_id")
def q_l2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the stated queries to every other reference."""
    return knn.distances(t.queries(spark, sf), t.points(spark, sf))


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top_k(t.queries(spark, sf), t.points(spark, sf), 5, other_than_self=True)


@query(f"WITH {t.CTE_KNN} SELECT qid, CAST(rank AS INT) AS rank, ref_id, dist, is_fraud FROM knn")
def q_knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf).select("qid", "rank", "ref_id", "dist", "is_fraud")


@query(f"WITH {t.CTE_KNN} SELECT qid, CAST(sum(is_fraud) AS INT) AS fraud_count FROM knn GROUP BY qid")
def q_knn_score(spark: SparkSession, sf: str) -> DataFrame:
    return knn.fraud_counts(t.queries(spark, sf), _knn(spark, sf))


@query(f"WITH {t.CTE_KNN} SELECT qid, CAST(sum(is_fraud) AS INT) AS fraud_count, CAST(sum(is_fraud) / 5.0 AS DOUBLE) AS fraud_score, sum(is_fraud) < 3 AS approved FROM knn GROUP BY qid")
def q_knn_decision(spark: SparkSession, sf: str) -> DataFrame:
    return search.answer(t.queries(spark, sf), _knn(spark, sf))


@query(f"""WITH {t.CTE_KNN} SELECT qid, CASE WHEN sum(is_fraud) < 3 THEN '{{"approved":true,"fraud_score":' ELSE '{{"approved":false,"fraud_score":' END || CAST(CAST(sum(is_fraud) / 5.0 AS DOUBLE) AS VARCHAR) || '}}' AS body FROM knn GROUP BY qid""")
def q_response_body(spark: SparkSession, sf: str) -> DataFrame:
    return knn.fraud_counts(t.queries(spark, sf), _knn(spark, sf)).select("qid", rules.response(F.col("fraud_count")).alias("body"))


# --- clustering -------------------------------------------------------------------------------------------------------
def _assigned(spark: SparkSession, sf: str, n: int) -> DataFrame:
    near = kmeans.nearest(t.points(spark, sf), t.seeds(spark, sf), n)
    return near.select("ref_id", F.posexplode("clusters").alias("place", "c")).select("ref_id", (F.col("place") + 1).alias("place"), "c.cluster_id", F.col("c.dist").cast("long").alias("dist"))


@query(f"WITH {t.CTE_CLUSTERS} SELECT ref_id, cluster_id, d AS dist FROM near WHERE place = 1")
def q_assign_top1(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, 1).drop("place")


@query(f"WITH {t.CTE_CLUSTERS} SELECT ref_id, CAST(place AS INT) AS place, cluster_id, d AS dist FROM near WHERE place <= 2")
def q_assign_top2(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, 2)


@query(f"WITH {t.CTE_CLUSTERS} SELECT cluster_id, CAST(i - 1 AS INT) AS dim, CAST(sum(x) AS DOUBLE) / count(*) AS mean, CAST(count(*) AS BIGINT) AS n FROM dims GROUP BY cluster_id, i")
def q_kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.step(t.points(spark, sf), t.seeds(spark, sf)).select("cluster_id", "dim", "mean", "n")


@query(f"""WITH {t.CTE_CLUSTERS}, means AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, CAST(sum(x) AS DOUBLE) / count(*) AS m FROM dims GROUP BY ALL) GROUP BY 1),
again AS (SELECT ref_id, arg_min(cluster_id, d) AS c2 FROM (SELECT p.ref_id, m.cluster_id, list_sum(list_transform(list_zip(p.v, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM points p CROSS JOIN means m) GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE cluster_id <> c2) AS BIGINT) AS changed, CAST(count(*) AS BIGINT) AS n FROM postings JOIN again USING (ref_id)""")
def q_kmeans_changed(spark: SparkSession, sf: str) -> DataFrame:
    pts, old = t.points(spark, sf), t.seeds(spark, sf)
    new = old.copy()
    for r in kmeans.step(pts, old).collect():  # k x dims means
        new[r["cluster_id"], r["dim"]] = r["mean"]
    first = kmeans.nearest(pts, old, 1).select("ref_id", F.col("clusters")[0]["cluster_id"].alias("a"))
    second = kmeans.nearest(pts, new, 1).select("ref_id", F.col("clusters")[0]["cluster_id"].alias("b"))
    return first.join(second, "ref_id").agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count("*").alias("n"))


@query(f"WITH {t.CTE_CLUSTERS} SELECT s.cluster_id, CAST(count(p.ref_id) AS BIGINT) AS cnt FROM seeds s LEFT JOIN postings p USING (cluster_id) GROUP BY 1")
def q_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t.boxes(spark, sf).select("cluster_id", "cnt")


@query(f"WITH {t.CTE_CLUSTERS} SELECT cluster_id, array_to_string(mn, ',') AS mn, array_to_string(mx, ',') AS mx FROM boxes")
def q_cluster_bbox(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return t.boxes(spark, sf).where("cnt > 0").select("cluster_id", s("mn"), s("mx"))


_COUNTS = f"WITH {t.CTE_CLUSTERS}, counts AS (SELECT s.cluster_id, CAST(count(p.ref_id) AS BIGINT) AS cnt FROM seeds s LEFT JOIN postings p USING (cluster_id) GROUP BY 1)"


@query(_COUNTS + " SELECT cluster_id, CAST(ceil(cnt / 8.0) AS BIGINT) AS blocks, CAST(coalesce(sum(CAST(ceil(cnt / 8.0) AS BIGINT)) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_block FROM counts")
def q_block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return index.block_offsets(t.boxes(spark, sf))


@query(_COUNTS + " SELECT CAST(b AS INT) AS bucket, CAST(count(c) AS BIGINT) AS n FROM range(20) r(b) LEFT JOIN (SELECT CAST(floor(cnt * 20 / ((SELECT max(cnt) FROM counts) + 1)) AS INT) AS c FROM counts) ON b = c GROUP BY 1")
def q_cluster_hist20(spark: SparkSession, sf: str) -> DataFrame:
    return index.size_histogram(t.boxes(spark, sf))


@query(_COUNTS + " SELECT CAST(min(cnt) AS BIGINT) AS smallest, CAST(max(cnt) AS BIGINT) AS largest, CAST(sum(cnt) AS DOUBLE) / count(*) AS average FROM counts")
def q_cluster_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return t.boxes(spark, sf).agg(F.min("cnt").alias("smallest"), F.max("cnt").alias("largest"), F.avg("cnt").alias("average"))


@query(f"WITH {t.CTE_CLUSTERS} SELECT CAST(sum(d) AS BIGINT) AS mass FROM postings")
def q_seed_distance_mass(spark: SparkSession, sf: str) -> DataFrame:
    """What the next seed of k-means++ is drawn in proportion to, in total."""
    return _assigned(spark, sf, 1).agg(F.sum("dist").alias("mass"))


# --- search in the index ----------------------------------------------------------------------------------------------
PLAIN = SearchConfig(nprobe=4, repair_min=1, repair_max=4)
#: What the fitted index is asked with: 12 of its 16 clusters.
FITTED = SearchConfig(nprobe=12, repair_min=1, repair_max=4)


@query(f"WITH {t.CTE_CLUSTERS} SELECT qid, cluster_id, CAST(place - 1 AS INT) AS place FROM probed WHERE place <= 4")
def q_coarse_probe(spark: SparkSession, sf: str) -> DataFrame:
    return search.probes(t.queries(spark, sf), t.seeds(spark, sf), PLAIN)


_EVENT_SEEDS = f"WITH {CTE_VECTORS}, seeds AS (SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INT) AS cluster_id, v AS c FROM vectors ORDER BY event_id LIMIT 16)"


@query(_EVENT_SEEDS + f""" SELECT event_id, CAST(count(*) AS BIGINT) AS probes, CAST(sum(cluster_id) AS BIGINT) AS ids FROM (
  SELECT event_id, v, cluster_id, row_number() OVER (PARTITION BY event_id ORDER BY {t.DIST.format(a="v", b="c")}, cluster_id) AS place FROM vectors CROSS JOIN seeds)
WHERE place <= CASE WHEN NOT {_LEGIT} AND NOT {_FRAUD} THEN 12 ELSE 1 END GROUP BY 1""")
def q_adaptive_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Borderline transactions look into 12 clusters, others into 1."""
    v = event_vectors(spark, sf).select(F.col("event_id").alias("qid"), "v")
    got = search.probes(v, kmeans.seeds(v, 16, "qid"), SearchConfig(nprobe=1, nprobe_border=12), border=True)
    return got.groupBy(F.col("qid").alias("event_id")).agg(F.count("*").alias("probes"), F.sum("cluster_id").alias("ids"))


_PROBE = (
    t.CTE_CLUSTERS
    + f""", cand AS (
  SELECT b.qid, p.ref_id, p.is_fraud, {t.DIST.format(a="q.v", b="p.v")} AS dist
  FROM probed b JOIN queries q USING (qid) JOIN postings p ON p.cluster_id = b.cluster_id AND p.ref_id <> b.qid WHERE b.place <= 4),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS rank FROM cand) WHERE rank <= 5)"""
)


def _probe(spark: SparkSession, sf: str, config: SearchConfig = PLAIN, repair: bool = False) -> DataFrame:
    c, rows, boxes = t.indexed(spark, sf)
    return search.search(t.queries(spark, sf), c, rows, boxes, config, repair=repair, other_than_self=True)


@query(f"WITH {_PROBE} SELECT qid, CAST(rank AS INT) AS rank, ref_id, dist, is_fraud FROM top")
def q_ivf_probe(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf).select("qid", "rank", "ref_id", "dist", "is_fraud")


_BOUND = "CAST(list_sum(list_transform(list_zip(q.v, b.mn, b.mx), lambda z: CAST(greatest(z[2] - z[1], z[1] - z[3], 0) AS BIGINT) * greatest(z[2] - z[1], z[1] - z[3], 0))) AS BIGINT)"


@query(f"WITH {t.CTE_CLUSTERS} SELECT q.qid, b.cluster_id, {_BOUND} AS bound FROM queries q CROSS JOIN boxes b")
def q_bbox_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the stated queries against every cluster's box (a row for each cluster)."""
    asked = t.queries(spark, sf).select("qid", "v", F.lit(None).cast("double").alias("worst"), F.array().cast("array<int>").alias("probed"))
    return _spread(search.bounds(asked, t.boxes(spark, sf), "qid"))


def _spread(found: DataFrame) -> DataFrame:
    return found.select("qid", F.explode(F.arrays_zip("clusters", "bounds")).alias("x")).select("qid", F.col("x.clusters").alias("cluster_id"), F.col("x.bounds").alias("bound"))


_REPAIR = _PROBE + f""", doubt AS (
  SELECT q.qid, q.v, CASE WHEN count(top.ref_id) >= 5 THEN max(top.dist) ELSE 4611686018427387904 END AS worst
  FROM queries q LEFT JOIN top ON top.qid = q.qid GROUP BY q.qid, q.v HAVING coalesce(sum(top.is_fraud), 0) BETWEEN 1 AND 4),
more AS (SELECT q.qid, b.cluster_id, {_BOUND} AS bound FROM doubt q JOIN boxes b ON {_BOUND} <= q.worst
  WHERE NOT EXISTS (SELECT 1 FROM probed p WHERE p.qid = q.qid AND p.cluster_id = b.cluster_id AND p.place <= 4))"""


@query(f"WITH {_REPAIR} SELECT * FROM more")
def q_repair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    q, (c, rows, boxes) = t.queries(spark, sf), t.indexed(spark, sf)
    asked = search.probed(q, c, [PLAIN])
    top = knn.ranked(search.scan(asked, rows, 5, other_than_self=True), 5, "slot")
    return _spread(search.bounds(search.repair_asked(asked, top, [PLAIN]), boxes, "qid"))


_FIXED = _REPAIR + f""", every AS (
  SELECT qid, ref_id, is_fraud, dist FROM top UNION ALL
  SELECT m.qid, p.ref_id, p.is_fraud, {t.DIST.format(a="q.v", b="p.v")} FROM more m JOIN queries q USING (qid) JOIN postings p ON p.cluster_id = m.cluster_id AND p.ref_id <> m.qid),
fixed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS place FROM every) WHERE place <= 5)"""


@query(f"WITH {_FIXED} SELECT qid, CAST(place AS INT) AS rank, ref_id, dist, is_fraud FROM fixed")
def q_ivf_repair(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf, repair=True).select("qid", "rank", "ref_id", "dist", "is_fraud")


@query(f"WITH {_FIXED} SELECT qid, CAST(sum(is_fraud) AS INT) AS fraud_count, CAST(sum(is_fraud) / 5.0 AS DOUBLE) AS fraud_score, sum(is_fraud) < 3 AS approved FROM fixed GROUP BY 1")
def q_fraud_score(spark: SparkSession, sf: str) -> DataFrame:
    return search.answer(t.queries(spark, sf), _probe(spark, sf, repair=True))


@query(f"WITH {_PROBE}, " + t.CTE_KNN.replace(t.CTE_POINTS, "").lstrip(" ,\n") + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(top.ref_id) AS BIGINT) AS found FROM knn LEFT JOIN top USING (qid, ref_id)")
def q_recall_at_5(spark: SparkSession, sf: str) -> DataFrame:
    got = _probe(spark, sf).select("qid", "ref_id", F.lit(1).alias("hit"))
    return _knn(spark, sf).join(got, ["qid", "ref_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


@query(f"WITH {t.CTE_KNN} SELECT qid, CAST(rank AS INT) AS rank, ref_id, dist, is_fraud FROM knn")
def q_nprobe_full_equals_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Looking into every cluster is the exact search."""
    return _probe(spark, sf, SearchConfig(nprobe=t.SEEDS)).select("qid", "rank", "ref_id", "dist", "is_fraud")


# --- evaluation -------------------------------------------------------------------------------------------------------
_JUDGED = "judged AS (SELECT o_orderkey, o_totalprice < 250000 AS approved, max(CAST(l_returnflag = 'R' AS INT)) = 0 AS expected_approved FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
_MATRIX = """matrix AS (SELECT CAST(count(*) FILTER (WHERE NOT approved AND NOT expected_approved) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE approved AND expected_approved) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE NOT approved AND expected_approved) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE approved AND NOT expected_approved) AS BIGINT) AS fn FROM judged)"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    judged = rows.groupBy("o_orderkey", "o_totalprice").agg((F.max((F.col("l_returnflag") == "R").cast("int")) == 0).alias("expected_approved"))
    return evaluate.confusion(judged.withColumn("approved", F.col("o_totalprice") < 250000))


@query(f"WITH {_JUDGED}, {_MATRIX} SELECT * FROM matrix")
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


@query(f"WITH {_JUDGED}, {_MATRIX} SELECT *, 100.0::DOUBLE * fp / (tp + tn + fp + fn) AS fp_pct, 100.0::DOUBLE * fn / (tp + tn + fp + fn) AS fn_pct FROM matrix")
def q_fp_fn_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_rates(_matrix(spark, sf))


_SWEEP = "WITH " + t.CTE_CLUSTERS + f""", configs(nprobe) AS (VALUES (1), (2), (4), (8)),
cand AS (SELECT c.nprobe, b.qid, p.ref_id, p.is_fraud, {t.DIST.format(a="q.v", b="p.v")} AS dist
  FROM configs c JOIN probed b ON b.place <= c.nprobe JOIN queries q USING (qid) JOIN postings p ON p.cluster_id = b.cluster_id AND p.ref_id <> b.qid),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nprobe, qid ORDER BY dist, ref_id) AS rank FROM cand) WHERE rank <= 5),
judged AS (SELECT c.nprobe, q.qid, coalesce(sum(t.is_fraud), 0) < 3 AS approved, q.is_fraud = 0 AS expected_approved
  FROM configs c CROSS JOIN queries q LEFT JOIN top t ON t.nprobe = c.nprobe AND t.qid = q.qid GROUP BY c.nprobe, q.qid, q.is_fraud),
sweep AS (SELECT nprobe, CAST(count(*) FILTER (WHERE NOT approved AND NOT expected_approved) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE approved AND expected_approved) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE NOT approved AND expected_approved) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE approved AND NOT expected_approved) AS BIGINT) AS fn FROM judged GROUP BY 1)"""
CONFIGS = [SearchConfig(nprobe=n) for n in (1, 2, 4, 8)]


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    q = t.queries(spark, sf)
    expected = q.select("qid", (F.col("is_fraud") == 0).alias("expected_approved"))
    c, rows, boxes = t.indexed(spark, sf)
    return evaluate.sweep(q, expected, c, rows, boxes, CONFIGS, repair=False, other_than_self=True)


@query(_SWEEP + " SELECT nprobe, 0 AS nprobe_border, tp, tn, fp, fn FROM sweep")
def q_config_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf)


_BEST = "WITH " + t.CTE_CLUSTERS + ", " + t.CTE_KNN.replace(t.CTE_POINTS, "").lstrip(" ,\n") + f""", configs(nprobe) AS (VALUES (1), (2), (4), (8), (16)),
cand AS (SELECT c.nprobe, b.qid, p.ref_id, p.is_fraud, {t.DIST.format(a="q.v", b="p.v")} AS dist
  FROM configs c JOIN probed b ON b.place <= c.nprobe JOIN queries q USING (qid) JOIN postings p ON p.cluster_id = b.cluster_id AND p.ref_id <> b.qid),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nprobe, qid ORDER BY dist, ref_id) AS rank FROM cand) WHERE rank <= 5),
exact AS (SELECT qid, coalesce(sum(knn.is_fraud), 0) < 3 AS expected FROM queries q LEFT JOIN knn USING (qid) GROUP BY 1),
wrong AS (SELECT nprobe, count(*) FILTER (WHERE approved <> expected) AS n FROM (
  SELECT c.nprobe, e.expected, coalesce(sum(t.is_fraud), 0) < 3 AS approved
  FROM configs c CROSS JOIN exact e LEFT JOIN top t ON t.nprobe = c.nprobe AND t.qid = e.qid GROUP BY c.nprobe, e.qid, e.expected) GROUP BY 1),
sizes AS (SELECT cluster_id, count(*) AS cnt FROM postings GROUP BY 1),
cost AS (SELECT nprobe, qid, CAST(sum(cnt) AS BIGINT) AS scanned FROM configs c JOIN probed b ON b.place <= c.nprobe JOIN sizes USING (cluster_id) GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY nprobe ORDER BY scanned) - 1 AS i, count(*) OVER (PARTITION BY nprobe) AS n FROM cost),
p99 AS (SELECT nprobe, scanned FROM place WHERE i = least(n - 1, floor(n * 0.99 + 0.5)))
SELECT CAST(nprobe AS INT) AS nprobe, 0 AS nprobe_border, scanned AS p99 FROM p99 JOIN wrong USING (nprobe) WHERE wrong.n = 0 ORDER BY scanned, nprobe LIMIT 1"""
WIDER = [*CONFIGS, SearchConfig(nprobe=t.SEEDS)]


@query(_BEST)
def q_best_config(spark: SparkSession, sf: str) -> DataFrame:
    """Among configurations that decide as the exact search does, the one with the least p99 of rows scanned a query."""
    q, (c, rows, boxes) = t.queries(spark, sf), t.indexed(spark, sf)
    expected = search.answer(q, _knn(spark, sf)).select("qid", F.col("approved").alias("expected_approved"))
    found = evaluate.sweep(q, expected, c, rows, boxes, WIDER, repair=False, other_than_self=True)
    cost = evaluate.scanned(q, c, boxes, WIDER)
    return evaluate.best_configuration(found.join(evaluate.p99_by_configuration(cost, "scanned", WIDER), ["nprobe", "nprobe_border"]))


@query(f"""WITH {CTE_VECTORS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS n_fraud, CAST(count(*) FILTER (WHERE NOT value > 50) AS BIGINT) AS n_legit,
  100.0::DOUBLE * count(*) FILTER (WHERE value > 50) / count(*) AS fraud_pct, 100.0::DOUBLE * count(*) FILTER (WHERE NOT value > 50) / count(*) AS legit_pct,
  CAST(count(*) FILTER (WHERE v[1] <> 0 AND NOT {_LEGIT} AND NOT {_FRAUD}) AS BIGINT) AS n_borderline FROM vectors""")
def q_dataset_facts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.dataset_facts(event_vectors(spark, sf), F.col("value") > 50)


_NANOS = "latency AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 1000) AS BIGINT) AS ns FROM events WHERE value IS NOT NULL)"


def _latency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 1000, 0).cast("long").alias("ns"))


@query(f"WITH {_NANOS}, s AS (SELECT ns, row_number() OVER (ORDER BY ns) - 1 AS i, count(*) OVER () AS n FROM latency) SELECT p.p AS percent, s.ns AS value FROM (VALUES (50), (90), (99)) p(p) JOIN s ON s.i = least(n - 1, floor(n * p.p / 100.0 + 0.5))")
def q_pct_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.nearest_rank(_latency(spark, sf), "ns", 50, 90, 99).select(F.col("percent").cast("int").alias("percent"), "value")


@query(f"WITH {_NANOS} SELECT CAST(sum(ns) // count(ns) AS BIGINT) AS avg_ns, max(ns) AS max_ns FROM latency")
def q_latency_avg_max(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency_summary(_latency(spark, sf), "ns")


_HIST = _NANOS + ", hist AS (SELECT CAST(least(599, floor(ns / 1000)) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(ns // 1000) AS BIGINT) AS sum_us FROM latency GROUP BY 1)"
_LE = _HIST + ", le AS (SELECT CAST(b AS INT) AS bucket, (b + 1) / 1000.0::DOUBLE AS le, CAST(sum(coalesce(n, 0)) OVER (ORDER BY b) AS BIGINT) AS value FROM range(600) r(b) LEFT JOIN hist ON bucket = b)"


@query(f"WITH {_HIST} SELECT * FROM hist")
def q_hist_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(_latency(spark, sf), "ns")


@query(f"WITH {_LE} SELECT * FROM le")
def q_hist_cumulative_le(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative(metrics.histogram(_latency(spark, sf), "ns"))


@query(f"WITH {_LE} SELECT p.p, min(bucket + 1) / 1000.0::DOUBLE AS value_ms FROM (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) p(p) JOIN le ON value >= greatest(1, floor((SELECT max(value) FROM le) * p.p)) GROUP BY 1")
def q_hist_pct(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.histogram(_latency(spark, sf), "ns")
    parts = [metrics.percentile(h, p).select(F.lit(p).alias("p"), "value_ms") for p in (0.5, 0.99)]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {_LE}, total AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum_us) AS BIGINT) AS us FROM hist),
backends AS (SELECT CAST(user_id % 3 AS INT) AS b, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM latency GROUP BY 1),
per AS (SELECT r.b, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM range(3) r(b) LEFT JOIN backends USING (b)),
lines AS (
  SELECT 0 AS place, unnest(['# HELP latency_ms Latency of a request', '# TYPE latency_ms histogram']) AS value
  UNION ALL SELECT 1 + bucket, 'latency_ms_bucket{{le="' || printf('%.3f', le) || '"}} ' || value FROM le
  UNION ALL SELECT 700, unnest(['latency_ms_bucket{{le="+Inf"}} ' || n, 'latency_ms_sum ' || printf('%.6f', us / 1000.0), 'latency_ms_count ' || n]) FROM total
  UNION ALL SELECT 800, unnest(['# HELP requests_total Requests', '# TYPE requests_total counter', 'requests_total ' || n]) FROM total
  UNION ALL SELECT 810, unnest(['# HELP repair_total Requests whose answer was repaired', '# TYPE repair_total counter', 'repair_total ' || sum(errors)]) FROM per GROUP BY ()
  UNION ALL SELECT 820, unnest(['# HELP active_connections Open connections', '# TYPE active_connections gauge', 'active_connections ' || (count(*) FILTER (WHERE event_type = 'signup') - count(*) FILTER (WHERE event_type = 'error'))]) FROM latency
  UNION ALL SELECT 830, unnest(['# HELP connections_total Connections by backend', '# TYPE connections_total counter'])
  UNION ALL SELECT 831, 'connections_total{{backend="' || b || '"}} ' || n FROM per
  UNION ALL SELECT 840, unnest(['# HELP errors_total Failed connections by backend', '# TYPE errors_total counter'])
  UNION ALL SELECT 841, 'errors_total{{backend="' || b || '"}} ' || errors FROM per)
SELECT value FROM lines""")
def q_prometheus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole exposition: a histogram, totals, a gauge (signups open, errors close) and counters of three backends."""
    rows = _latency(spark, sf)
    failed = F.col("event_type") == "error"
    counts = metrics.counters(rows, metrics.round_robin(F.col("user_id"), 3), failed)
    every = spark.range(3).select(F.col("id").cast("int").alias("backend")).join(counts, "backend", "left").fillna(0)
    parts = [
        sinks.exposition("latency_ms", "Latency of a request", metrics.histogram(rows, "ns")),
        sinks.sample_lines("requests_total", "Requests", "counter", rows.agg(F.count("*").alias("value"))),
        sinks.sample_lines("repair_total", "Requests whose answer was repaired", "counter", rows.agg(F.count_if(failed).alias("value"))),
        sinks.sample_lines("active_connections", "Open connections", "gauge", metrics.gauge(rows, F.col("event_type") == "signup", failed)),
        sinks.sample_lines("connections_total", "Connections by backend", "counter", every.select("backend", F.col("requests").alias("value")), "backend"),
        sinks.sample_lines("errors_total", "Failed connections by backend", "counter", every.select("backend", F.col("errors").alias("value")), "backend"),
    ]
    return reduce(DataFrame.unionByName, parts).select("value")


@query(f"WITH {_NANOS} SELECT CAST(user_id % 3 AS INT) AS backend, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM latency GROUP BY 1")
def q_counters_by_backend(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(_latency(spark, sf), metrics.round_robin(F.col("user_id"), 3), F.col("event_type") == "error")


@query("SELECT event_id, CAST(event_id % 2 AS INT) AS backend, CAST(CASE WHEN event_id % 3 = 1 THEN 2 ELSE event_id % 3 END AS INT) AS after_failover FROM events")
def q_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", metrics.round_robin(e, 2).alias("backend"), metrics.failover(e, [1], 3).alias("after_failover"))


_DAILY = """daily AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'click' AND value > 60) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE event_type = 'view' AND value > 60) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE event_type = 'error' AND value > 80) AS BIGINT) AS err, max(value) AS p99 FROM events GROUP BY 1)"""
_E = "(fp + 3 * fn + 5 * err)"
_P99 = "CASE WHEN p99 <= 0 THEN 0.0::DOUBLE WHEN p99 > 2000 THEN -3000.0::DOUBLE ELSE 1000.0::DOUBLE * log10(1000.0::DOUBLE / greatest(p99, 1.0::DOUBLE)) END"
_DET = f"CASE WHEN (fp + fn + err)::DOUBLE / n > 0.15::DOUBLE THEN -3000.0::DOUBLE ELSE 1000.0::DOUBLE * log10(1.0::DOUBLE / greatest({_E}::DOUBLE / n, 0.001::DOUBLE)) - 300.0::DOUBLE * log10(1.0::DOUBLE + {_E}) END"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    def n(kind: str, above: int):
        return F.count_if((F.col("event_type") == kind) & (F.col("value") > above))

    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count("*").alias("n"), n("click", 60).alias("fp"), n("view", 60).alias("fn"), n("error", 80).alias("err"), F.max("value").alias("p99"))


def _errors() -> Column:
    return rules.weighted_errors(F.col("fp"), F.col("fn"), F.col("err"))


def _failed() -> Column:
    return F.col("fp") + F.col("fn") + F.col("err")


@query(f"WITH {_DAILY} SELECT day, {_E} AS e, {_E}::DOUBLE / n AS epsilon, (fp + fn + err)::DOUBLE / n AS failure_rate FROM daily")
def q_weighted_error(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("day", _errors().alias("e"), (_errors() / F.col("n")).alias("epsilon"), (_failed() / F.col("n")).alias("failure_rate"))


@query(f"WITH {_DAILY} SELECT day, round({_P99}, 6) AS p99_score FROM daily")
def q_p99_score(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("day", F.round(rules.p99_score(F.col("p99")), 6).alias("p99_score"))


@query(f"WITH {_DAILY} SELECT day, round({_DET}, 6) AS detection_score FROM daily")
def q_detection_score(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("day", F.round(rules.detection_score(_errors(), _failed(), F.col("n")), 6).alias("detection_score"))


@query(f"WITH {_DAILY} SELECT day, round({_P99} + {_DET}, 6) AS final_score FROM daily")
def q_final_score(spark: SparkSession, sf: str) -> DataFrame:
    both = rules.p99_score(F.col("p99")) + rules.detection_score(_errors(), _failed(), F.col("n"))
    return _daily(spark, sf).select("day", F.round(both, 6).alias("final_score"))


# --- windows over time, streams, whole programs -----------------------------------------------------------------------
@query("""SELECT s AS start, CAST(count(*) AS BIGINT) AS n, count(*) / 3600.0::DOUBLE AS per_second
FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTES, ts) - i * INTERVAL 10 MINUTES for i in range(6)]) AS s FROM events WHERE ts IS NOT NULL) GROUP BY 1""")
def q_rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.windowed_rate(table(spark, sf, "events"), "ts", "1 hour", "10 minutes")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS ratio FROM events WHERE ts IS NOT NULL GROUP BY 1")
def q_repair_rate(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.windowed_ratio(table(spark, sf, "events").where("ts IS NOT NULL"), "ts", F.col("event_type") == "error", "1 day")


_QUANTILE = """, cumulated AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS upto, CAST(sum(n) OVER (PARTITION BY start) AS DOUBLE) AS total FROM windowed WINDOW w AS (PARTITION BY start ORDER BY bucket)),
asked AS (SELECT *, q * total AS rank FROM cumulated, (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) qs(q)),
hit AS (SELECT start, q, min(bucket) AS bucket FROM asked WHERE upto >= rank GROUP BY ALL)
SELECT start, q, round(CASE WHEN bucket = 599 THEN 0.599 ELSE bucket / 1000.0::DOUBLE + 0.001::DOUBLE * (rank - (upto - n)) / n END, 9) AS value_ms FROM hit JOIN asked USING (start, q, bucket)"""
_WINDOWED = f"WITH {_NANOS}, windowed AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(least(599, floor(ns / 1000)) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM latency WHERE ts IS NOT NULL GROUP BY ALL)"


@query(_WINDOWED + _QUANTILE)
def q_quantile_window(spark: SparkSession, sf: str) -> DataFrame:
    found = scoring.windowed_quantiles(_latency(spark, sf).where("ts IS NOT NULL"), "ts", "ns", "1 day", qs=(0.5, 0.99))
    return found.select("start", "q", F.round("value_ms", 9).alias("value_ms"))


@query(_WINDOWED + _QUANTILE)
def q_stream_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream with a watermark: a last event a year later closes every window before it."""
    rows = _latency(spark, sf).where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "ns")
    folder, out = shared_path(spark, "latencies"), shared_path(spark, "quantiles")
    late = rows.agg((F.max("ts") + F.expr("INTERVAL 1 YEAR")).alias("ts"), F.lit(0).cast("long").alias("ns"))
    rows.write.parquet(f"{folder}/a")
    late.write.parquet(f"{folder}/b")
    end = late.first()["ts"]
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/*")
    found = scoring.windowed_quantiles(stream, "ts", "ns", "1 day", late="1 day", qs=(0.5, 0.99))
    running = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    kept = spark.read.schema(found.schema).parquet(out).where(F.col("start") < F.lit(end) - F.expr("INTERVAL 2 DAYS"))
    return kept.select(F.col("start").cast("timestamp_ntz").alias("start"), "q", F.round("value_ms", 9).alias("value_ms"))


@query(f"WITH {_NANOS} SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(least(599, floor(ns / 1000)) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM latency WHERE ts IS NOT NULL GROUP BY ALL")
def q_windowed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.windowed_histogram(_latency(spark, sf).where("ts IS NOT NULL"), "ts", "ns", "1 day")


@query()  # fitted from random starts; tests compare its steps with plain ones
def q_kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    c, n = kmeans.fit(t.points(spark, sf), 16)
    return spark.createDataFrame([(i, n, x.tolist()) for i, x in enumerate(c)], "cluster_id int, iterations int, centroid array<double>")


_BALANCED = "WITH RECURSIVE " + t.CTE_CLUSTERS + """, cap AS (SELECT greatest(3 * (count(*) // 16) + 1, count(*) // 16 + 10) AS most FROM points),
firsts AS (SELECT a.ref_id, a.cluster_id AS c1, b.cluster_id AS c2 FROM near a JOIN near b ON b.ref_id = a.ref_id AND b.place = 2 WHERE a.place = 1),
sizes AS (SELECT s.cluster_id, count(p.ref_id) AS size FROM seeds s LEFT JOIN postings p USING (cluster_id) GROUP BY 1),
leaving AS (SELECT row_number() OVER (ORDER BY ref_id) AS i, c1, c2 FROM firsts JOIN sizes ON cluster_id = c1, cap WHERE size > most),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, list(size ORDER BY cluster_id) AS counts FROM sizes
  UNION ALL
  SELECT l.i, CASE WHEN counts[c1 + 1] > most AND counts[c2 + 1] < most
    THEN list_transform(range(0, len(counts)), lambda c: counts[c + 1] - CAST(c = c1 AS INT) + CAST(c = c2 AS INT)) ELSE counts END
  FROM walk JOIN leaving l ON l.i = walk.i + 1, cap),
last AS (SELECT arg_max(counts, i) AS counts FROM walk)
SELECT * FROM (SELECT CAST(generate_subscripts(counts, 1) - 1 AS INT) AS cluster_id, CAST(unnest(counts) AS BIGINT) AS cnt FROM last) WHERE cnt > 0"""


@query(_BALANCED)
def q_balance(spark: SparkSession, sf: str) -> DataFrame:
    return index.assign(t.points(spark, sf), t.seeds(spark, sf), balance=True).groupBy("cluster_id").agg(F.count("*").alias("cnt"))


_EXACT = f"WITH {t.CTE_KNN} SELECT qid, CAST(sum(is_fraud) AS INT) AS fraud_count, CAST(sum(is_fraud) / 5.0 AS DOUBLE) AS fraud_score, sum(is_fraud) < 3 AS approved FROM knn GROUP BY qid"
#: Every answer counts as ambiguous and is repaired, which makes it exact.
REPAIR_ALL = SearchConfig(nprobe=2, repair_min=0, repair_max=5)


def _fitted(spark: SparkSession, sf: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Builds an index with fitted centroids, writes it and reads it back."""
    path = shared_path(spark, "index")
    index.build(t.points(spark, sf), path, 16, iterations=20)
    _, boxes, postings = readers.index(spark, path)
    return np.array([r["qc"] for r in boxes.orderBy("cluster_id").collect()], float), postings, boxes


@query(_EXACT)
def q_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """An index that was built, written and read back answers as the exact search does."""
    q = t.queries(spark, sf)
    return search.answer(q, search.search(q, *_fitted(spark, sf), REPAIR_ALL, other_than_self=True))


@query()  # the centroids are fitted from random starts
def q_fitted_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the exact search that the fitted index finds with FITTED, ambiguous answers repaired."""
    q = t.queries(spark, sf)
    got = search.search(q, *_fitted(spark, sf), FITTED, other_than_self=True).select("qid", "ref_id", F.lit(1).alias("hit"))
    return _knn(spark, sf).join(got, ["qid", "ref_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


@query(f"WITH {t.CTE_KNN} SELECT qid, CAST(sum(is_fraud) AS INT) AS fraud_count, true AS repaired FROM knn GROUP BY qid")
def q_repair_stepwise(spark: SparkSession, sf: str) -> DataFrame:
    """The low-latency rule where nothing ends it but the bound: exact counts."""
    q = t.queries(spark, sf)
    return search.search_stepwise(q, *t.indexed(spark, sf), REPAIR_ALL, other_than_self=True)


@query()  # all events against all events are too many pairs for SQL; tests compare a small stream with all pairs
def q_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive as JSON requests and are scored in micro-batches against an index of event vectors."""
    k = F.from_json("props", "k BIGINT")["k"]
    body = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.col("value").alias("amount"), F.lit(1).alias("installments"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("requested_at")).alias("transaction"),
        F.struct(F.lit(50.0).alias("avg_amount"), (k % 20).alias("tx_count_24h"), F.array(F.lit("click"), F.lit("view")).alias("known_merchants")).alias("customer"),
        F.struct(F.col("event_type").alias("id"), F.lit("5411").alias("mcc"), F.lit(60.0).alias("avg_amount")).alias("merchant"),
        F.struct((F.col("event_type") != "signup").alias("is_online"), F.lit(False).alias("card_present"), k.cast("double").alias("km_from_home")).alias("terminal"),
    )
    folder, out = shared_path(spark, "requests"), shared_path(spark, "scores")
    table(spark, sf, "events").select(body.alias("b")).select("b.*").write.json(folder)
    refs = written(event_vectors(spark, sf).select(F.col("event_id").alias("ref_id"), "v", (F.col("value") > 50).cast("int").alias("is_fraud")), "refs")
    c, at = kmeans.seeds(refs, 64), shared_path(spark, "index")
    postings = written(index.assign(refs, c), "postings")
    sinks.write_index(at, {"k": len(c), "dims": 14}, index.boxes(postings, c, 14), postings)
    _, boxes, postings = readers.index(spark, at)
    work = lambda df: scoring.score(df, c, postings, boxes, SearchConfig(nprobe=1))
    stream = scoring.start(scoring.read_requests(spark, folder), work, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), shared_path(spark, "stream"))
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return spark.read.schema("id string, fraud_count int, fraud_score double, approved boolean, body string").parquet(f"{out}/batch=*")
