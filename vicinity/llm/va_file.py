"""Exact top-k by inner product with a vector-approximation file.

Components are integers. For each position the range over all vectors is cut into CELLS equal cells; the file of cells
holds a byte for each component, and the exact vectors stand in a file of their own. A search first scans the cells
alone: they bound every inner product, and only rows whose upper bound reaches the kth best lower bound, over the whole
file, stay candidates. Exact vectors are then read for candidates only, in the order of their upper bounds, FIRST for
each query and four times as many in each further round, until the kth result beats every bound that is left; so the
answer is exact.

Of equal vectors, the k + 1 smallest ids stand in the file, which no other row of theirs can enter a result before; a
vector that is very common costs no more than any other. Queries are sent to the scanning tasks in waves of at most
WAVE_BYTES, whatever their number.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate, nor do
rows without an id; vectors of different lengths don't meet; ties go to the smaller id; rows that repeat an id are
candidates each, except against queries of that id, and a repeated query is answered once for each vector it has; an
empty table gives no rows. Scores saturate at 64 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 64
WAVE_BYTES = 32 << 20
BLOCK = 4096
#: Exact vectors that a query reads at first.
FIRST = 32
_TOP = 2.0**63


def integers(vectors: DataFrame, scale: float, vector: str, key: str) -> DataFrame:
    """id and v (floor(scale * x) of each component) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in column `at`."""
    col = batch.column(at)
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def edges_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length: the lower ends of the cells of each position, and one end beyond the last."""

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for batch in it:
            for _, m in _matrices(batch, 0):
                lo, hi = m.min(axis=0), m.max(axis=0)
                old = best.get(m.shape[1], [lo, hi])
                best[m.shape[1]] = [np.minimum(lo, old[0]), np.maximum(hi, old[1])]
        table = [(d, p, int(lo[p]), int(hi[p])) for d, (lo, hi) in best.items() for p in range(d)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in table], kinds[k]) for k in range(4)], names=["d", "p", "lo", "hi"])

    got = rows.select("v").mapInArrow(ranges, "d int, p int, lo bigint, hi bigint").groupBy("d", "p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    by: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in got:
        by[r["d"]][r["p"]] = (r["lo"], r["hi"])
    out = {}
    for d, x in by.items():
        span = [(x[p][0], x[p][1] - x[p][0] + 1) for p in range(d)]
        out[d] = np.array([[lo + -(-c * width // CELLS) for c in range(CELLS + 1)] for lo, width in span], object)
    return out


def stored(rows: DataFrame, k: int) -> DataFrame:
    """The file of exact vectors: row (a number), id, v. Of equal vectors the k + 1 smallest ids, k rows of each."""
    by_id = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("_i", by_id).where(F.col("_i") <= k + 1)
    again = F.row_number().over(Window.partitionBy("v", "id").orderBy(F.lit(0)))
    kept = kept.withColumn("_j", again).where(F.col("_j") <= k)
    return written(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def build(vectors: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """The file of cells: row, id, cells (a byte for each component)."""
    ends = {d: e.astype(np.float64) for d, e in edges.items()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cells: list[bytes] = [b""] * batch.num_rows
            for at, m in _matrices(batch, 2):
                for k, raw in zip(at, cells_of(m, ends[m.shape[1]]), strict=True):
                    cells[k] = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["row", "id", "cells"])

    return written(vectors.mapInArrow(run, "row bigint, id bigint, cells binary"), "va-file")


def cells_of(m: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.empty(m.shape, np.uint8)
    for p in range(m.shape[1]):
        c[:, p] = np.clip(np.searchsorted(ends[p][1:], m[:, p], "right"), 0, CELLS - 1)
    return c


def _exact(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row as 64-bit integers, saturated."""
    top = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, m.shape[1])
    if top < 2.0**62:
        return np.einsum("ij,ij->i", m, q)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(1 << 63)), (1 << 63) - 1) for x, y in zip(m, q, strict=True)], np.int64)


class Scan:
    """Bounds of the inner products of queries with rows of cells, and the rows that may be among the k best."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, edges: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.low = edges[:, :-1].astype(np.float64)
        self.high = np.maximum(edges[:, 1:] - 1, edges[:, :-1]).astype(np.float64)
        self.plus, self.minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        self.best = np.full((len(ids), k), -np.inf)  # lower bounds
        self.found: list[tuple[np.ndarray, ...]] = []  # query, row, id, lower, upper

    def floor(self) -> np.ndarray:
        """The kth lower bound so far, less what rounding may have added."""
        return _lowered(self.best.min(axis=1))

    def block(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
        at = np.arange(cells.shape[1])
        lo, hi = self.low[at, cells], self.high[at, cells]
        upper = self.plus @ hi.T + self.minus @ lo.T
        lower = self.plus @ lo.T + self.minus @ hi.T
        if max(np.abs(upper).max(initial=0), np.abs(lower).max(initial=0)) >= _TOP:  # scores saturate, so bounds do
            upper, lower = np.clip(upper, -_TOP, _TOP), np.clip(lower, -_TOP, _TOP)
        own = self.ids[:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        k = min(self.k, lower.shape[1])
        top = np.partition(lower, -k, axis=1)[:, -k:]
        self.best = np.partition(np.hstack([self.best, top]), -self.k, axis=1)[:, -self.k :]
        i, j = np.nonzero((upper >= self.floor()[:, None]) & ~own)
        self.found.append((i, rows[j], ids[j], lower[i, j], upper[i, j]))
        if sum(len(f[0]) for f in self.found) > 1_000_000:
            self.found = [self.candidates()]

    def candidates(self) -> tuple[np.ndarray, ...]:
        """query, row, id, lower, upper of what the bounds of all blocks leave."""
        if not self.found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64))
        all_ = tuple(np.concatenate(x) for x in zip(*self.found, strict=True))
        good = all_[4] >= self.floor()[all_[0]]
        return tuple(x[good] for x in all_)


def _lowered(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x, where=np.isfinite(x), out=np.zeros_like(x)) * 1e-9 - 1


def _waves(queries: DataFrame) -> Iterator[list]:
    """Rows (id, v) of the queries, each list a hash part of about WAVE_BYTES at most."""
    size = queries.agg(F.sum(F.size("v") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    waves = max(1, -(-size // WAVE_BYTES))
    for w in range(waves):
        yield queries.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).select("id", "v").collect()


_CANDIDATE = "d int, n int, query_id bigint, row bigint, vec_id bigint, lower double, upper double"


def candidates(file: DataFrame, sent, k: int) -> DataFrame:
    """d and n (length and number of the query), query_id, row, vec_id, upper and place (by descending bound) of the rows
    that may be among the k best of their query, by the cells alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {d: Scan(*x, k) for d, x in sent.value.items()}
        for whole in it:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                size = pc.binary_length(batch.column(2)).to_numpy()
                for d in np.unique(size):
                    if int(d) in scans:
                        which = np.flatnonzero(size == d)
                        raw = batch.column(2).take(pa.array(which)).to_pylist()
                        scans[int(d)].block(rows[which], ids[which], np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), int(d)))
        for d, scan in scans.items():
            i, row, id_, lower, upper = scan.candidates()
            cols = [np.full(len(i), d, np.int32), i.astype(np.int32), scan.ids[i], row, id_, lower, upper]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "n", "query_id", "row", "vec_id", "lower", "upper"])

    found = written(file.mapInArrow(run, _CANDIDATE), "bounds")
    # each task's k best lower bounds are among its candidates, so the kth of all is the kth over the file
    kth = F.row_number().over(Window.partitionBy("d", "n").orderBy(F.desc("lower"), "row"))
    floor = found.withColumn("_k", kth).where(F.col("_k") == k).select("d", "n", F.col("lower").alias("floor"))
    good = found.join(floor, ["d", "n"], "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor") - F.abs("floor") * 1e-9 - 1))
    place = F.row_number().over(Window.partitionBy("d", "n").orderBy(F.desc("upper"), "row"))
    return written(good.select("d", "n", "query_id", "row", "vec_id", "upper", place.alias("place")), "candidates")


def scored(asked: DataFrame, vectors: DataFrame, sent) -> DataFrame:
    """asked (d, n, query_id, row, vec_id) with the exact scores."""
    rows = asked.select("d", "n", "query_id", "row", "vec_id").join(vectors.select("row", "v"), "row").select("d", "n", "query_id", "vec_id", "v")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = {d: x[1] for d, x in sent.value.items()}
        for batch in it:
            n, score = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for at, m in _matrices(batch, 4):
                score[at] = _exact(m, q[m.shape[1]][n[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], names=["d", "n", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "d int, n int, query_id bigint, vec_id bigint, score bigint")


def search(file: DataFrame, vectors: DataFrame, edges: dict[int, np.ndarray], queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank from 1, vec_id, score. queries: id and v."""
    spark = file.sparkSession
    parts = []
    best = Window.partitionBy("d", "n").orderBy(F.desc("score"), F.asc("vec_id"))
    for part in _waves(queries):
        by: dict[int, list] = defaultdict(list)
        for r in part:
            by[len(r["v"])].append(r)
        if not by:
            continue
        sent = spark.sparkContext.broadcast({d: (np.array([r["id"] for r in x], np.int64), np.array([r["v"] for r in x], np.int64).reshape(len(x), d), edges[d]) for d, x in by.items()})
        todo, top, done, more = candidates(file, sent, k), None, 0, FIRST
        while True:
            exact = scored(todo.where((F.col("place") > done) & (F.col("place") <= more)), vectors, sent)
            top = exact if top is None else top.unionByName(exact)
            top = written(top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "results")
            # a query goes on while a bound that is left may reach its kth score
            full = top.groupBy("d", "n").agg(F.count("*").alias("_n"), F.min("score").cast("double").alias("_kth"))
            left = todo.where(F.col("place") > more).join(full, ["d", "n"], "left")
            open_ = left.where((F.coalesce("_n", F.lit(0)) < k) | (F.col("upper") >= F.col("_kth") - F.abs("_kth") * 1e-9 - 1)).drop("_n", "_kth")
            if not open_.limit(1).count():
                break
            todo, done, more = written(open_, "open"), more, more * 4
        parts.append(top)
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, [p.withColumn("rank", F.row_number().over(best)) for p in parts])
    return found.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest other rows of each query row. is_query: a condition on `id`."""
    rows = integers(vectors, scale, vector, key)
    edges = edges_of(rows)
    kept = stored(rows, k)
    return search(build(kept, edges), kept, edges, rows.where(is_query), k)
