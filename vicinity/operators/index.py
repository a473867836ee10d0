"""The clustered index: assignment, balancing, boxes, statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import edge_case
from ..sources import sinks
from ..storage import written
from . import kmeans

BLOCK_ROWS = 8


def assign(refs: DataFrame, centroids: np.ndarray, *, balance: bool = False) -> DataFrame:
    """Postings: cluster_id, ref_id, v, is_fraud, dist_centroid."""
    near = kmeans.nearest(refs, centroids, 2 if balance else 1, keep=("v", "is_fraud"))
    near = near.withColumn("pick", F.lit(0)) if not balance else balanced(near, len(centroids))
    c = F.get("clusters", F.col("pick"))
    return near.select(
        c["cluster_id"].alias("cluster_id"), F.col("ref_id").cast("long"), "v", "is_fraud", F.sqrt(F.greatest(c["dist"], F.lit(0.0))).alias("dist_centroid")
    )


def capacity(n: int, k: int) -> int:
    avg = n // k
    return max(3 * avg + 1, avg + 10)


def balanced(near: DataFrame, k: int) -> DataFrame:
    """Adds pick: 1 for points that leave a cluster that is over its capacity for their second nearest, else 0.

    The outcome is that of going through the points in the order of ref_id and moving each whose cluster is over its
    capacity at that time while its second one is under it. Clusters over capacity only lose points and the others only
    gain some, so this is the greedy matching of leaving points with free places, and it is found in rounds: a point
    moves if its places among all undecided points of its two clusters are within what both have left, and stays if
    either has nothing left. Only points that want to leave take part; a cluster may stay over capacity.
    """
    spark = near.sparkSession
    most = capacity(near.count(), k)
    first = near.select("ref_id", F.col("clusters")[0]["cluster_id"].alias("c1"), F.get("clusters", F.lit(1))["cluster_id"].alias("c2"))
    sizes = written(first.groupBy("c1").agg(F.count("*").alias("size")), "sizes")  # one row for each cluster
    surplus = sizes.where(F.col("size") > most).select("c1", (F.col("size") - most).alias("out"))
    every = spark.range(k).select(F.col("id").cast("int").alias("c2")).join(sizes.withColumnRenamed("c1", "c2"), "c2", "left")
    room = every.select("c2", (F.lit(most) - F.coalesce("size", F.lit(0))).alias("into")).where("into > 0")
    undecided, moved = written(first.where("c2 IS NOT NULL").join(surplus.select("c1"), "c1", "left_semi"), "undecided"), []
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ref_id"))
    while True:
        open_ = undecided.join(surplus, "c1").join(room, "c2")
        turn = (by("c1") <= F.col("out")) & (by("c2") <= F.col("into"))
        state = written(open_.select("ref_id", "c1", "c2", turn.alias("goes")), "undecided")
        goes = state.where("goes")
        if not goes.limit(1).count():
            break
        moved.append(goes.select("ref_id"))
        taken = lambda c: goes.groupBy(c).agg(F.count("*").alias("n"))  # noqa: B023, E731
        surplus = written(surplus.join(taken("c1"), "c1", "left").select("c1", (F.col("out") - F.coalesce("n", F.lit(0))).alias("out")).where("out > 0"), "surplus")
        room = written(room.join(taken("c2"), "c2", "left").select("c2", (F.col("into") - F.coalesce("n", F.lit(0))).alias("into")).where("into > 0"), "room")
        undecided = state.where("NOT goes").drop("goes")
    if not moved:
        return near.withColumn("pick", F.lit(0))
    picked = reduce(DataFrame.unionByName, moved).withColumn("pick", F.lit(1))
    return near.join(picked, "ref_id", "left").withColumn("pick", F.coalesce("pick", F.lit(0)))


def boxes(postings: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """cluster_id, qc, mn, mx, cnt for every cluster; those without points have zeros."""
    spark = postings.sparkSession
    low = F.array(*[F.min(F.get("v", F.lit(i))) for i in range(dims)])
    high = F.array(*[F.max(F.get("v", F.lit(i))) for i in range(dims)])
    found = postings.groupBy("cluster_id").agg(low.alias("mn"), high.alias("mx"), F.count("*").alias("cnt"))
    rounded = np.where(centroids < 0, -np.floor(-centroids + 0.5), np.floor(centroids + 0.5)).astype(int)
    every = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(rounded)], "cluster_id int, qc array<int>")
    zeros = F.array_repeat(F.lit(0), dims)
    return every.join(found, "cluster_id", "left").select(
        "cluster_id", "qc", F.coalesce("mn", zeros).alias("mn"), F.coalesce("mx", zeros).alias("mx"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")
    )


def build(refs: DataFrame, path: str, k: int = 4096, *, sample_rows: int = 200_000, iterations: int = 1000, balance: bool = True) -> dict:
    """Fits, assigns and writes an index folder; returns its meta data."""
    centroids, used = kmeans.fit(refs, k, sample_rows=sample_rows, iterations=iterations)
    postings = assign(refs, centroids, balance=balance)
    dims = int(centroids.shape[1])
    meta = {"n": refs.count(), "k": len(centroids), "dims": dims, "block_size": BLOCK_ROWS, "train_sample": sample_rows, "train_iters": used, "train_max_iters": iterations}
    sinks.write_index(path, meta, boxes(postings, centroids, dims), postings)
    return meta


def build_with_edge_cases(refs: DataFrame, path: str, edge_path: str, k: int = 4096, edge_k: int = 256, **options) -> tuple[dict, dict]:
    """A second index holds only the edge cases."""
    return build(refs, path, k, **options), build(refs.where(edge_case(F.col("v"))), edge_path, edge_k, **options)


def block_offsets(centroids: DataFrame) -> DataFrame:
    """cluster_id, blocks, first_block: exclusive running sum over the clusters (k rows)."""
    blocks = F.ceil(F.col("cnt") / BLOCK_ROWS).cast("long")
    w = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return centroids.select("cluster_id", blocks.alias("blocks")).withColumn("first_block", F.coalesce(F.sum("blocks").over(w), F.lit(0)).cast("long"))


def size_histogram(centroids: DataFrame, buckets: int = 20) -> DataFrame:
    """bucket, n: sizes in equal buckets up to the largest, empty ones included."""
    top = centroids.agg(F.max("cnt").alias("top"))
    by = centroids.join(F.broadcast(top)).groupBy(F.floor(F.col("cnt") * buckets / (F.col("top") + 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = centroids.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
