"""Exact nearest neighbours: every query against every reference, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import Best, blocks, matrix, partial, prepared, squared, waves

_NAMES = ("qid", "ref_id", "is_fraud", "dist")


def top_k(queries: DataFrame, refs: DataFrame, k: int = 5, *, key: str = "qid", other_than_self: bool = False) -> DataFrame:
    """qid, ref_id, is_fraud, dist, rank: the k nearest references (ref_id, v, is_fraud) of each query, ties to the
    smaller ref_id. Each task scans its references once for each wave of queries and keeps k for each query; what the
    tasks kept meets in one window by query."""
    spark = refs.sparkSession
    rows = refs.select(F.col("ref_id").cast("long"), "is_fraud", "v")
    parts = []
    for ids, q in waves(queries, "v", key):
        sent = spark.sparkContext.broadcast((ids, q))

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, every = Best(len(ids), k), np.arange(len(ids))
            asked, own = prepared(q)
            for b in blocks(it):
                if len(ids) and b.num_rows:
                    ref, y, v = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), matrix(b, 2)
                    order = np.argsort(ref, kind="stable")
                    ref = ref[order]
                    d = partial(asked, v[order])
                    if other_than_self:
                        d[ids[:, None] == ref[None, :]] = np.inf
                    best.meet(every, d, own, ref, y[order])
            i, r, y, d = best.found()
            cols = [pa.array(ids[i]), pa.array(r), pa.array(y.astype(np.int32)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

        parts.append(rows.mapInArrow(scan, "qid bigint, ref_id bigint, is_fraud int, dist bigint"))
    return ranked(reduce(DataFrame.unionByName, parts), k)


def distances(queries: DataFrame, refs: DataFrame, *, key: str = "qid") -> DataFrame:
    """qid, ref_id, dist: a stated set of queries against every other reference, in blocks."""
    rows = refs.select(F.col("ref_id").cast("long"), "v")
    parts = []
    for ids, q in waves(queries, "v", key):
        sent = refs.sparkSession.sparkContext.broadcast((ids, q))

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for whole in blocks(it):
                for at in range(0, whole.num_rows if len(ids) else 0, max(1, (1 << 20) // max(1, len(ids)))):
                    b = whole.slice(at, max(1, (1 << 20) // len(ids)))
                    ref, d = b.column(0).to_numpy(), squared(q, matrix(b, 1))
                    i, j = np.nonzero(ids[:, None] != ref[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ref[j]), pa.array(d[i, j].astype(np.int64))], names=["qid", "ref_id", "dist"])

        parts.append(rows.mapInArrow(scan, "qid bigint, ref_id bigint, dist bigint"))
    return reduce(DataFrame.unionByName, parts)


def ranked(candidates: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by, "qid").orderBy("dist", "ref_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fraud_counts(queries: DataFrame, neighbours: DataFrame, key: str = "qid") -> DataFrame:
    """qid and fraud_count; neighbours that are missing count as legitimate."""
    counts = neighbours.groupBy("qid").agg(F.sum("is_fraud").cast("int").alias("fraud_count"))
    return queries.select(F.col(key).alias("qid")).join(counts, "qid", "left").select("qid", F.coalesce("fraud_count", F.lit(0)).alias("fraud_count"))
