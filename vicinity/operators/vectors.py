"""Blocks of vectors in Arrow batches, and queries that are sent to scans in waves of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of queries that a wave sends to every task.
WAVE_BYTES = 32 << 20
BLOCK = 4096
#: Bytes of vectors that a task holds to put them in cells; queries and vectors of a cell.
CHUNK_BYTES = 16 << 20
ASKED, CELL = 64, 256
#: Cells of references that are compared at once at most.
GROUP = 32


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """rows x dims of a list column whose lists have one length."""
    col = batch.column(column)
    return col.flatten().to_numpy().astype(np.float64).reshape(len(col), -1)


def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def chunks(it: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Batches put together until their vectors come to CHUNK_BYTES."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += len(b.column(column).flatten()) * 8
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; exact for whole numbers whose results stay below 2^53."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def prepared(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries for partial(), their own squares)."""
    return np.hstack([-2 * q, np.ones((len(q), 1))]), (q * q).sum(1)


def partial(asked: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances less the queries' own squares, in one product; asked: from prepared()."""
    return asked @ np.hstack([v, (v * v).sum(1)[:, None]]).T


def halved(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in cells of at most `size`, made by halving the widest side of the box again and again."""
    order, starts, todo = np.arange(len(v)), [], [(0, len(v))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        part = v[order[a:b]]
        side, middle = np.ptp(part, axis=0).argmax(), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], middle)]
        todo += [(a + middle, b), (a, a + middle)]
    return order, np.array(starts)


def gaps(low: np.ndarray, high: np.ndarray, others_low: np.ndarray, others_high: np.ndarray) -> np.ndarray:
    """Least squared distances between boxes of one kind and boxes of another."""
    out = np.zeros((len(low), len(others_low)))
    for i in range(low.shape[1]):
        gap = np.maximum(others_low[:, i][None] - high[:, i][:, None], low[:, i][:, None] - others_high[:, i][None])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


class Best:
    """The k nearest that each query of a set has met: dist, ref and y, ascending by (dist, ref)."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.dist = np.full((n, k), np.inf)
        self.ref = np.full((n, k), np.iinfo(np.int64).max)
        self.y = np.zeros((n, k), np.int64)

    def meet(self, rows: np.ndarray, part: np.ndarray, own: np.ndarray, ref: np.ndarray, y: np.ndarray) -> None:
        """part: the rows' distances to references that ascend by ref, less `own` of each row, as partial() gives them;
        infinite ones don't count."""
        k = self.k
        near = part <= (self.dist[rows, -1] - own)[:, None]
        count = near.sum(axis=1)
        many = np.flatnonzero(count > 4 * k)
        if len(many):  # the k nearest of the block are enough, of those that tie at its kth distance the first k
            t = part[many]
            kth = np.partition(t, k - 1, axis=1)[:, k - 1 : k]
            tie = t == kth
            near[many] &= (t < kth) | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k))
        r, c = np.nonzero(near)
        if not len(r):
            return
        some = np.unique(r)
        row = np.concatenate([np.repeat(some, k), r])
        dist = np.concatenate([self.dist[rows[some]].ravel(), part[r, c] + own[r]])
        refs = np.concatenate([self.ref[rows[some]].ravel(), ref[c]])
        labels = np.concatenate([self.y[rows[some]].ravel(), y[c]])
        order = np.lexsort((refs, dist, row))
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        order = order[np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) < k]
        self.dist[rows[some]], self.ref[rows[some]], self.y[rows[some]] = (x[order].reshape(-1, k) for x in (dist, refs, labels))

    def meet_all(self, rows: np.ndarray, q: np.ndarray, asked: np.ndarray, own: np.ndarray, v: np.ndarray, ref: np.ndarray, y: np.ndarray, ids: np.ndarray | None = None) -> int:
        """The rows of the queries q (asked, own: from prepared()) meet all of v; ids: the queries' ids, where a
        reference of that id doesn't count. Returns the number of pairs that were compared.

        Both sides lie in cells; those of queries are runs of `rows`, which should be near each other.
        """
        order, starts = halved(v, CELL)
        ends = np.append(starts[1:], len(v))
        for a, b in zip(starts, ends, strict=True):
            order[a:b] = order[a:b][np.argsort(ref[order[a:b]], kind="stable")]
        return self.meet_cells(rows, q, asked, own, v[order], ref[order], y[order], starts, ids)

    def meet_cells(self, rows: np.ndarray, q: np.ndarray, asked: np.ndarray, own: np.ndarray, v: np.ndarray, ref: np.ndarray, y: np.ndarray, starts: np.ndarray, ids: np.ndarray | None = None) -> int:
        """meet_all() for references that lie in cells already, which begin at `starts` and ascend by ref inside.

        A cell of references that is farther off than the kth of each query of a cell can't change them; one as far still
        can by a smaller id. The nearest cell comes first, then groups of twice as many each time of those still near enough.
        """
        ends = np.append(starts[1:], len(v))
        right = np.hstack([v, (v * v).sum(1)[:, None]]).T
        low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        step, pairs = ASKED * max(1, (1 << 21) // len(starts)), 0
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            cuts = np.arange(0, len(some), ASKED)
            far = gaps(np.minimum.reduceat(q[some], cuts), np.maximum.reduceat(q[some], cuts), low, high)
            worst = np.maximum.reduceat(self.dist[some, -1], cuts)
            for i in np.flatnonzero(far.min(axis=1) <= worst):
                part = some[cuts[i] : cuts[i] + ASKED]
                left = asked[part]
                close = np.flatnonzero(far[i] <= worst[i])
                close, size = close[np.argsort(far[i, close], kind="stable")], 1
                while len(close):
                    group, close = close[:size], close[size:]
                    at_ = np.concatenate([np.arange(starts[c], ends[c]) for c in group]) if len(group) > 1 else slice(starts[group[0]], ends[group[0]])
                    if len(group) > 1:
                        at_ = at_[np.argsort(ref[at_], kind="stable")]
                    d = left @ right[:, at_]
                    if ids is not None:
                        d[ids[part][:, None] == ref[at_][None, :]] = np.inf
                    self.meet(part, d, own[part], ref[at_], y[at_])
                    pairs += d.size
                    close, size = close[far[i, close] <= self.dist[part, -1].max()], min(2 * size, GROUP)
        return pairs

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, ref, y, dist) of all that was met."""
        at = np.nonzero(np.isfinite(self.dist))
        return at[0], self.ref[at], self.y[at], self.dist[at].astype(np.int64)


def waves(queries: DataFrame, vector: str, key: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of hash parts of the queries, each of about WAVE_BYTES at most, so that sending one to every task
    is bounded whatever the number of queries. At least one wave."""
    rows = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    size = rows.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    n = max(1, -(-size // WAVE_BYTES))
    for w in range(n):
        got = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == w).collect()
        yield np.array([r["id"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64).reshape(len(got), len(got[0]["v"]) if got else 0)
