"""Topics of texts: clusters of their words, for mixing.

A text's profile counts its lower-case words by a hash into WIDTH places; square roots of the counts are weighed by how
rare a place is and scaled to length 1. Topics are the centres of spherical k-means over the profiles of all rows, which
are kept in the shared folder for its passes; every text gets the topic whose centre is nearest, whole texts being counted.

Defined cases: a null text, or one without words, has topic "none"; ties go to the smaller number; without texts that
have words there is no model and every topic is "none".
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, strings, written

WIDTH = 512
NONE = "none"


def profiles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts: texts x WIDTH, number of words of each)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    place = np.fromiter((zlib.crc32(w) % WIDTH if w else -1 for w in words), np.int64, len(words))[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    row, place = row[place >= 0], place[place >= 0]  # empty strings stand at the ends of texts
    counts = np.bincount(row * WIDTH + place, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)
    return counts, np.bincount(row, minlength=len(texts))


def scaled(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * rarity
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def whole(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of length 1 or less in whole numbers, as doubles: their sums and products are exact in any order."""
    return np.rint(x * (1 << bits))


def stored(counts: np.ndarray) -> list[pa.Array]:
    """The places that occur in each row and their counts, as bytes."""
    row, place = np.nonzero(counts)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))])
    parts = (place.astype("<u2"), counts[row, place].astype("<u4"))
    return [pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())]) for x in parts]


def loaded(batch: pa.RecordBatch) -> np.ndarray:
    """The counts that stored() has put into the first two columns."""
    places, numbers = (b"".join(batch.column(i).to_pylist()) for i in range(2))
    size = pc.binary_length(batch.column(0)).to_numpy() // 2
    counts = np.zeros((batch.num_rows, WIDTH))
    counts[np.repeat(np.arange(batch.num_rows), size), np.frombuffer(places, "<u2")] = np.frombuffer(numbers, "<u4")
    return counts


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in it:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield part, loaded(part)


def _rarity(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, rarity of each place) over all rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, has = 0, np.zeros(WIDTH, np.int64)
        for _, counts in _parts(it):
            n, has = n + len(counts), has + (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(has, n))], names=["place", "n"])

    got = {r["place"]: r["n"] for r in rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    n = got.get(WIDTH, 0)
    return n, np.log((1 + n) / (1 + np.array([got.get(i, 0) for i in range(WIDTH)]))) + 0.05


def _start(rows: DataFrame, rarity: np.ndarray, c: np.ndarray | None, seed: int) -> np.ndarray | None:
    """One row of all, drawn with chances in proportion to how far it is from the centres c: each row's key is an
    exponential time of that rate, from a hash, and the earliest wins. None where no row is off the centres."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.inf, 0, None)
        for b, counts in _parts(it):
            x = whole(scaled(counts, rarity), 16)
            far = np.ones(len(x)) if c is None else np.maximum(0, 1 - (x @ whole(c, 24).T).max(axis=1) / 2.0**40) ** 2
            far[far < 1e-9] = 0  # on a centre, but for rounding
            key = b.column(2).to_numpy().view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
                key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
            time = np.full(len(x), np.inf)
            np.divide(-np.log((key.astype(np.float64) + 1) / 2.0**64), far, out=time, where=far > 0)
            i = np.lexsort((key, time))[0]
            if (time[i], int(key[i])) < best[:2]:
                best = (time[i], int(key[i]), x[i])
        if best[2] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([str(best[1]).zfill(20)]), pa.array([best[2].astype("<i4").tobytes()], pa.binary())], names=["time", "key", "x"])

    got = rows.mapInArrow(run, "time double, key string, x binary").orderBy("time", "key").limit(1).collect()
    return np.frombuffer(got[0]["x"], "<i4") / 2.0**16 if got else None


def _sums(rows: DataFrame, rarity: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows nearest to each centre, their sums) over all rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(c), WIDTH + 1))
        target = whole(c, 24).T
        for _, counts in _parts(it):
            x = whole(scaled(counts, rarity), 16)
            to = (x @ target).argmax(axis=1)
            sums += (to[None] == np.arange(len(c))[:, None]).astype(float) @ np.hstack([x, np.ones((len(x), 1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel().astype(np.int64))], names=["place", "n"])

    out = np.zeros(len(c) * (WIDTH + 1))
    for r in rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    out = out.reshape(len(c), WIDTH + 1)
    return out[:, -1], out[:, :-1]


def centres(rows: DataFrame, n: int, rarity: np.ndarray, k: int, *, rounds: int = 25, seed: int = 6, least: float = 0.02) -> np.ndarray:
    """Spherical k-means over all n rows, a pass over them for each starting point and round; starting points are drawn
    far from each other. Clusters with less than a share `least` of the rows are odd texts rather than topics: they go,
    the smallest first. What comes out doesn't depend on how the rows are dealt to tasks, since sums are exact."""
    c = np.zeros((0, WIDTH))
    while len(c) < min(k, n):
        new = _start(rows, rarity, c if len(c) else None, seed + len(c))
        if new is None:
            break
        c = np.vstack([c, new])
    for _ in range(rounds):
        size, sums = _sums(rows, rarity, c)
        if size.min() < least * n:
            c = np.delete(c, size.argmin(), axis=0)
            continue
        new = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return c


def fit(docs: DataFrame, k: int, *, text: str = "text", key: str = "doc_id", sample_rows: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(rarity of each place, centres) from every row whose text has words. Nothing is sampled: sample_rows, which once
    bounded the rows, changes nothing and is there for callers that still name it."""
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(3)).alias("_k"), F.col(text).alias("text")).where("text IS NOT NULL")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, n = profiles(part.column(1))
                yield pa.RecordBatch.from_arrays([*stored(counts), part.column(0)], names=["places", "counts", "_k"]).filter(pa.array(n > 0))

    got = written(rows.mapInArrow(run, "places binary, counts binary, _k bigint"), "profiles")
    n, rarity = _rarity(got)
    return (rarity, centres(got, n, rarity, k)) if n else None


def describe(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, *, text: str = "text") -> DataFrame:
    """docs with n_tokens (words) and topic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # k + 1 rows of WIDTH numbers
    schema = docs.withColumn("n_tokens", F.lit(0).cast("long")).withColumn("topic", F.lit("")).schema
    place = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("topics")
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                counts, n = profiles(batch.column(place))
                names = np.full(len(n), NONE, object)
                if sent.value is not None:
                    rarity, c = sent.value
                    best = (scaled(counts, rarity) @ c.T).argmax(axis=1)
                    names[n > 0] = [f"t{b}" for b in best[n > 0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(names.tolist(), pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
