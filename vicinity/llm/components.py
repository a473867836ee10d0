"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Neighbours beyond which a node is a hub; of E edges, no more than 2E / max(HUB, E / 1000) nodes are.
HUB = 10_000


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) -> (a, root): every node but the roots once, root the smallest node of its component.

    Each round joins the edges with the smallest neighbour of their nodes and is written to the shared folder; the
    number of edges never grows, and the rounds end when they no longer change (a logarithmic number in practice). The
    rows of a hub are many, but its smallest neighbour is one row: hubs, at most 2,000, are joined by sending these
    rows to all tasks, so that no task gets all edges of one node.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "neighbours")
        many = max(HUB, (last[0] if last else near.agg(F.sum("n")).first()[0] or 0) // 1000)
        low, up = near.select("a", F.least("a", "m").alias("m"), "n"), both.where("b > a")
        if near.where(F.col("n") > many).limit(1).count():
            hubs = F.broadcast(low.where(F.col("n") > many).select("a", "m"))
            large = up.join(hubs, "a").unionByName(up.join(hubs, "a", "left_anti").join(low.where(F.col("n") <= many).select("a", "m"), "a"))
        else:
            large = up.join(low.select("a", "m"), "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"))
        # those below a that don't reach its smallest neighbour yet are in `large` as (a, m) from a's own side
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = written(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return e.select("a", F.col("b").alias("root"))
        last = tuple(state)
