"""Clustering: nearest centroids, one Lloyd step, and a full fit on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import blocks, matrix, squared


def seeds(points: DataFrame, k: int, key: str = "ref_id") -> np.ndarray:
    """The vectors of the k smallest ids: a start that every engine can reproduce."""
    return np.array([r["v"] for r in points.select(key, "v").orderBy(key).limit(k).collect()], np.float64)


def least(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the n least of each row, ties to the smaller column. Overwrites d where n is small."""
    if n > 4:
        order = np.argsort(d, axis=1, kind="stable")[:, :n]
        return order, np.take_along_axis(d, order, 1)
    order, near, every = np.zeros((len(d), n), np.int64), np.zeros((len(d), n)), np.arange(len(d))
    for i in range(n):
        order[:, i] = d.argmin(axis=1)
        near[:, i] = d[every, order[:, i]]
        d[every, order[:, i]] = np.inf
    return order, near


def nearest(points: DataFrame, centroids: np.ndarray, n: int, *, key: str = "ref_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, and clusters: the n nearest as (cluster_id, dist), ties to the smaller id.

    The centroids are sent to every task: k x dims numbers, k being a parameter.
    """
    sent = points.sparkSession.sparkContext.broadcast(centroids)
    n = min(n, len(centroids))
    rows = points.select(key, *keep, *(() if "v" in keep else ("v",)))
    at = rows.columns.index("v")
    inner = pa.struct([("cluster_id", pa.int32()), ("dist", pa.float64())])
    schema = rows.select(key, *keep).withColumn("clusters", F.expr("CAST(NULL AS ARRAY<STRUCT<cluster_id: INT, dist: DOUBLE>>)")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in blocks(it):
            if not b.num_rows:
                continue
            d = squared(matrix(b, at), c)
            order, near = least(d, n)
            flat = pa.StructArray.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(near.ravel())], fields=list(inner))
            ends = pa.array(np.arange(0, n * b.num_rows + 1, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(keep)], pa.ListArray.from_arrays(ends, flat)], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def step(points: DataFrame, centroids: np.ndarray, key: str = "ref_id") -> DataFrame:
    """cluster_id, dim, mean, n: the next centroids; partial sums are combined before the shuffle."""
    joined = nearest(points.withColumn("_v", F.col("v")), centroids, 1, key=key, keep=("_v",))
    rows = joined.select(F.col("clusters")[0]["cluster_id"].alias("cluster_id"), F.posexplode("_v").alias("dim", "x"))
    return rows.groupBy("cluster_id", "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def plus_plus(sample: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Starting centroids, each drawn with chances in proportion to the squared distance to those there are."""
    rng = np.random.default_rng(seed)
    out = [sample[rng.integers(len(sample))]]
    d = squared(sample, out[0][None])[:, 0]
    while len(out) < k:
        mass = np.maximum(d, 0)
        i = rng.integers(len(sample)) if mass.sum() <= 0 else rng.choice(len(sample), p=mass / mass.sum())
        out.append(sample[i])
        d = np.minimum(d, squared(sample, sample[i][None])[:, 0])
    return np.array(out)


def lloyd(sample: np.ndarray, centroids: np.ndarray, iterations: int, seed: int = 0xC0FFEE) -> tuple[np.ndarray, int]:
    """Iterates until no assignment changes; an empty cluster gets a random point of the sample."""
    rng = np.random.default_rng(seed)
    c, old = centroids.copy(), np.full(len(sample), -1)
    for n in range(1, iterations + 1):
        new = np.concatenate([squared(sample[i : i + 8192], c).argmin(1) for i in range(0, len(sample), 8192)])
        if (new == old).all():
            return c, n
        old = new
        counts = np.bincount(new, minlength=len(c))
        sums = np.stack([np.bincount(new, sample[:, j], len(c)) for j in range(sample.shape[1])], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], sample[rng.integers(len(sample), size=len(c))])
    return c, iterations


def fit(points: DataFrame, k: int, *, sample_rows: int = 200_000, iterations: int = 50, seed: int = 42) -> tuple[np.ndarray, int]:
    """Centroids from a sample with replacement of about sample_rows points: the bound of what the driver holds."""
    total = points.count()
    rows = points.select("v")
    if total > sample_rows:
        rows = rows.sample(True, sample_rows / total, seed)
    sample = np.array([r["v"] for r in rows.collect()], np.float64)
    if not len(sample):
        return np.zeros((0, 0)), 0
    return lloyd(sample, plus_plus(sample, min(k, len(sample)), seed), iterations)
