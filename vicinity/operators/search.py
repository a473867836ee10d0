"""Search in the clustered index: probing, repair of ambiguous answers, and the answer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.rules import approved, borderline, fraud_score
from ..storage import written
from . import kmeans
from .knn import fraud_counts, ranked
from .vectors import ASKED, WAVE_BYTES, Best, chunks, halved, matrix, prepared

FAR = (1 << 31) - 1
#: Boxes are sent to every task; an index has one for each cluster, and k is its parameter.
BOX_BYTES = 256 << 20
_FOUND = "slot int, qid bigint, ref_id bigint, is_fraud int, dist bigint"


def probes(queries: DataFrame, centroids: np.ndarray, config: SearchConfig, *, border: bool = False) -> DataFrame:
    """qid, cluster_id, place: the nearest clusters that each query looks into."""
    return probed(queries, centroids, [config], border).select("qid", F.posexplode("clusters").alias("place", "cluster_id")).select("qid", "cluster_id", "place")


def probed(queries: DataFrame, centroids: np.ndarray, configs: list[SearchConfig], border: bool = False) -> DataFrame:
    """slot (place of the configuration), qid, v, clusters: what each query looks into, nearest first."""
    for c in configs:
        c.check(len(centroids))
    most = max(max(c.nprobe, c.nprobe_border if border else 0) for c in configs)
    near = kmeans.nearest(queries, centroids, most, key="qid", keep=("v",))
    limits = [F.when(borderline(F.col("v")), F.lit(c.nprobe_border)).otherwise(F.lit(c.nprobe)) if border and c.nprobe_border > 0 else F.lit(c.nprobe) for c in configs]
    slots = F.posexplode(F.array(*limits)).alias("slot", "_n")
    return near.select(slots, "qid", "v", F.col("clusters.cluster_id").alias("_c")).select("slot", "qid", "v", F.slice("_c", 1, F.col("_n")).alias("clusters"))


def scan(asked: DataFrame, postings: DataFrame, k: int, *, other_than_self: bool = False) -> DataFrame:
    """slot, qid, ref_id, is_fraud, dist of at most k for each task and row of asked (slot, qid, v, clusters).

    Rows of asked go to the tasks in waves of about WAVE_BYTES, whatever their number; a task works through its postings
    in chunks, the part of each cluster against the rows that look into it, cell by cell, so that only cells are compared
    that may hold something near enough.
    """
    spark = postings.sparkSession
    size = asked.agg(F.sum(F.size("v") * 8 + F.size("clusters") * 12 + 32)).first()[0] or 0
    n = max(1, -(-size // WAVE_BYTES))
    rows = postings.select("cluster_id", F.col("ref_id").cast("long"), "is_fraud", "v")
    parts = []
    for w in range(n):
        got = asked.where(F.pmod(F.xxhash64("slot", "qid"), F.lit(n)) == w).select("slot", "qid", "v", "clusters").toArrow().combine_chunks()  # bounded: a wave
        if not got.num_rows:
            continue
        got = got.to_batches()[0]
        q = matrix(got, 2)
        order, _ = halved(q, ASKED)  # neighbours stand together
        got, q = got.take(pa.array(order)), q[order]
        into, counts = got.column(3).flatten().to_numpy(), pc.list_value_length(got.column(3)).to_numpy()
        row = np.repeat(np.arange(len(q)), counts)
        order = np.argsort(into, kind="stable")
        sent = spark.sparkContext.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy(), q, into[order], row[order]))

        def look(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            slot, qid, q, into, row = sent.value
            best = Best(len(qid), k)
            asked, own = prepared(q)
            for b in chunks(it, 3):
                if not b.num_rows:
                    continue
                b = b.to_batches()[0]
                cluster, ref, y, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), matrix(b, 3)
                for c in np.unique(cluster):
                    who = row[np.searchsorted(into, c) : np.searchsorted(into, c, "right")]
                    if len(who):
                        here = np.flatnonzero(cluster == c)
                        best.meet_all(who, q, asked, own, v[here], ref[here], y[here], qid if other_than_self else None)
            i, r, y, d = best.found()
            cols = [pa.array(slot[i]), pa.array(qid[i]), pa.array(r), pa.array(y.astype(np.int32)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(cols, names=["slot", "qid", "ref_id", "is_fraud", "dist"])

        parts.append(rows.mapInArrow(look, _FOUND))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FOUND)


def bounds(asked: DataFrame, boxes: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, clusters and bounds: the clusters with points that may hold something at most as far as `worst`
    (null: anything), but for those in `probed`, with the least squared distance of their boxes. asked: v, worst, probed
    and the kept columns. A bound equal to `worst` stays, since a tie is decided by the smaller id."""
    spark = asked.sparkSession
    got = boxes.where("cnt > 0").select("cluster_id", "mn", "mx").collect()
    ids = np.array([r["cluster_id"] for r in got], np.int64)
    mn, mx = (np.array([r[c] for r in got], np.float64).reshape(len(got), -1) for c in ("mn", "mx"))
    if mn.nbytes + mx.nbytes > BOX_BYTES:
        raise ValueError("the index has too many clusters for its boxes to be sent to every task")
    sent = spark.sparkContext.broadcast((ids, mn, mx))
    rows = asked.select(*keep, "worst", "probed", "v")
    schema = rows.select(*keep, F.expr("CAST(NULL AS ARRAY<INT>)").alias("clusters"), F.expr("CAST(NULL AS ARRAY<BIGINT>)").alias("bounds")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mn, mx = sent.value
        step = max(1, (1 << 21) // max(1, mn.size))
        for whole in it:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                q = matrix(b, b.num_columns - 1)
                worst = b.column(len(keep)).to_numpy(zero_copy_only=False).astype(np.float64)
                worst[np.isnan(worst)] = np.inf
                low = np.zeros((len(q), len(ids)))
                if len(ids):
                    gap = np.maximum(np.maximum(mn[None] - q[:, None], q[:, None] - mx[None]), 0)
                    low = (gap * gap).sum(axis=2)
                good = low <= worst[:, None]
                for i, done in enumerate(b.column(len(keep) + 1).to_pylist()):
                    good[i] &= ~np.isin(ids, done)
                r, c = np.nonzero(good)
                ends = pa.array(np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[c].astype(np.int32), low[r, c].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *lists], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def repair_asked(asked: DataFrame, top: DataFrame, configs: list[SearchConfig]) -> DataFrame:
    """slot, qid, v, worst and probed of the rows of asked whose count of frauds is ambiguous for their configuration."""
    per = top.groupBy("slot", "qid").agg(F.sum("is_fraud").alias("_f"), F.max("dist").alias("_far"), F.count("*").alias("_n"))
    at = lambda name: F.element_at(F.array(*[F.lit(getattr(c, name)) for c in configs]), F.col("slot") + 1)
    both = asked.join(per, ["slot", "qid"], "left")
    doubt = both.where(F.coalesce("_f", F.lit(0)).between(at("repair_min"), at("repair_max")))
    return doubt.select("slot", "qid", "v", F.when(F.col("_n") >= at("k"), F.col("_far").cast("double")).alias("worst"), F.col("clusters").alias("probed"))


def search_many(
    queries: DataFrame, centroids: np.ndarray, postings: DataFrame, boxes: DataFrame, configs: list[SearchConfig], *,
    border: bool = False, repair: bool = True, other_than_self: bool = False,
) -> DataFrame:
    """slot, qid, ref_id, is_fraud, dist, rank for each configuration, by its place: k nearest of the probed clusters;
    ambiguous queries get their exact answer. All configurations share each pass over the postings; what is found by
    the first pass is kept in the shared folder."""
    k = max(c.k for c in configs)
    asked = probed(queries, centroids, configs, border)
    if repair:
        asked = written(asked, "probes")
    top = ranked(scan(asked, postings, k, other_than_self=other_than_self), k, "slot")
    if not repair:
        return top
    top = written(top, "nearest")
    more = bounds(repair_asked(asked, top, configs), boxes, "slot", "qid", "v").where(F.size("clusters") > 0).select("slot", "qid", "v", "clusters")
    fixed = scan(written(more, "repairs"), postings, k, other_than_self=other_than_self)
    return ranked(top.drop("rank").unionByName(fixed), k, "slot")


def search(queries: DataFrame, centroids: np.ndarray, postings: DataFrame, boxes: DataFrame, config: SearchConfig, **options) -> DataFrame:
    """qid, ref_id, is_fraud, dist, rank by search_many() with one configuration."""
    return search_many(queries, centroids, postings, boxes, [config], **options).drop("slot")


def answer(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """qid, fraud_count, fraud_score, approved."""
    counts = fraud_counts(queries, neighbours)
    return counts.select("qid", "fraud_count", fraud_score(F.col("fraud_count")).alias("fraud_score"), approved(F.col("fraud_count")).alias("approved"))


def search_stepwise(queries: DataFrame, centroids: np.ndarray, postings: DataFrame, boxes: DataFrame, config: SearchConfig, *, border: bool = False, cap: int = 1024, other_than_self: bool = False) -> DataFrame:
    """qid, fraud_count, repaired: the low-latency rule, query by query: candidates of a repair are capped in the order
    of their ids, sorted by bound, and scanned until the bound or the count decides. For an index that one worker can
    hold: it is sent whole, and refused beyond 1 GB."""
    spark = queries.sparkSession
    config.check(len(centroids))
    size = postings.agg(F.sum(F.size("v") * 4 + 12)).first()[0] or 0
    if size > 1 << 30:
        raise ValueError("the index is too large for the stepwise search; use search()")
    rows = postings.orderBy("cluster_id", "dist_centroid", "ref_id").select("cluster_id", "ref_id", "v", "is_fraud").collect()
    v, y = np.array([r["v"] for r in rows], np.int64), np.array([r["is_fraud"] for r in rows], np.int64)
    refs = np.array([r["ref_id"] for r in rows], np.int64)
    cuts = np.searchsorted([r["cluster_id"] for r in rows], np.arange(len(centroids) + 1))
    b = sorted(boxes.collect(), key=lambda r: r["cluster_id"])
    sent = spark.sparkContext.broadcast((centroids, v, y, refs, cuts, np.array([r["mn"] for r in b], np.int64), np.array([r["mx"] for r in b], np.int64)))
    asked = queries.select("qid", "v", (borderline(F.col("v")) if border else F.lit(False)).alias("b"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, v, y, refs, cuts, mn, mx = sent.value
        filled = cuts[1:] > cuts[:-1]
        for batch in it:
            out = []
            for qid, q, edge in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q = np.array(q, np.int64)
                n = config.nprobe_border if edge and config.nprobe_border > 0 else config.nprobe
                near = np.argsort(((centroids - q) ** 2).sum(1), kind="stable")[:n]
                best: list[tuple[int, int]] = []

                def look(c: int) -> None:
                    d = ((v[cuts[c] : cuts[c + 1]] - q) ** 2).sum(1)  # noqa: B023
                    order = np.argsort(d, kind="stable")
                    if other_than_self:
                        order = order[refs[cuts[c] + order] != qid]  # noqa: B023
                    for i in order[: config.k]:
                        best.append((int(d[i]), int(y[cuts[c] + i])))  # noqa: B023
                    best.sort(key=lambda x: x[0])  # noqa: B023
                    del best[config.k :]  # noqa: B023

                for c in near:
                    look(c)
                count = sum(l for _, l in best)
                repaired = config.repair_min <= count <= config.repair_max
                if repaired:
                    worst = best[-1][0] if len(best) == config.k else FAR
                    gap = np.maximum(0, np.maximum(mn - q, q - mx))
                    bound = (gap * gap).sum(1)
                    mask = filled & (bound < worst)
                    mask[near] = False
                    todo = np.flatnonzero(mask)[:cap]
                    for c in todo[np.argsort(bound[todo], kind="stable")]:
                        if len(best) == config.k and bound[c] >= best[-1][0]:
                            break
                        look(c)
                        count = sum(l for _, l in best)
                        if not config.repair_min <= count <= config.repair_max:
                            break
                out.append((qid, count, repaired))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.bool_())], names=["qid", "fraud_count", "repaired"])

    return asked.mapInArrow(run, "qid bigint, fraud_count int, repaired boolean")
