"""Removal of repeated byte strings: every byte covered by a string of LENGTH bytes that also starts earlier.

Windows of LENGTH bytes are first dealt by content. A window belongs to the smallest hash among its strings of GRAM
bytes, so equal windows always meet; neighbouring windows with one smallest hash form a run, and a run is known by that
hash and by a hash of all its bytes. Runs with equal bytes are settled by these two alone: all but the first are
repeats. (Tasks do so for their own texts before anything is sent, so a passage costs at most one run for each task.)
Runs that share the smallest hash but differ, or that repeat themselves, are settled by their bytes: their windows are
put in suffix order by linear grouping (suffix_array), equal windows then stand together, and all but the first are
repeats. Windows whose first and last GRAM bytes have no equal in the group are left out before, and of stretches with
equal bytes one is ordered for all. A group of more than
GROUP runs is dealt anew by the hash of each window, SPREAD ways for each GROUP; a task sends the first of equal windows alone, the others being
repeats of it already, so the group of one window has a row for each task that met it.

Order is doc_id, then the text's hash, then position. Defined cases: a null or empty text has no bytes; texts shorter
than LENGTH lose nothing; rows with the same doc_id and text are one document and don't remove each other; null doc_ids
come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .suffix_array import suffix_array

LENGTH = 100
GRAM = 32
GROUP, SPREAD = 4000, 64
#: Windows that a task holds to find equal ones among them.
HELD = 20_000
#: Bytes of text that a task cuts up at a time.
CHUNK = 16 << 20
_WIDTH = LENGTH - GRAM + 1
_NULL = -(1 << 63)
_rng = np.random.default_rng(100)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) * 2 + 1 for x in _rng.integers(0, 1 << 62, 2)]
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers.clear()
        for b in (*_BASE, *(pow(b, -1, 1 << 64) for b in _BASE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def hashes(b: np.ndarray, which: int) -> np.ndarray:
    """Running sums from which the hash of any stretch follows: (sum[j] - sum[i]) * inverse power i."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[which][b] * powers(len(b) + 1)[which][: len(b)], out=out[1:])
    return out


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every stretch of `width` values."""
    step = 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return f(x[:-rest], x[rest:]) if rest else x


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(smallest hash, hash of all bytes, first window, last window, repeats itself) of each run of a text."""
    n = len(b)
    if n < LENGTH:
        return None
    p = powers(n + 1)
    one = hashes(b, 0)
    h = mixed((one[GRAM:] - one[:-GRAM]) * p[2][: n - GRAM + 1])
    low = sliding(h, _WIDTH, np.minimum)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    two = hashes(b, 1)
    whole = mixed((two[last + LENGTH] - two[first]) * p[3][first]) ^ (last - first).astype(np.uint64)
    # A smallest hash that stands at two near places: windows of one run may be equal.
    pad = np.zeros(_WIDTH - 1, np.uint64)
    at = np.flatnonzero(h == sliding(np.concatenate([pad, low, pad]), _WIDTH, np.maximum))
    twice = at[1:][(h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= _WIDTH)]
    own = np.isin(low[first], h[twice]) if len(twice) else np.zeros(len(first), bool)
    return low[first], whole, first, last, own


def _first_of(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts a class, equals the first of its class in every part of its place) for rows sorted by keys, place."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = np.all([x[order] == x[head] for x in place], axis=0)
    return order, new, same


def joined(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for i in np.lexsort((end, start)):
        a, b = int(start[i]), int(end[i])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_ROW = "shard int, data binary, doc_id bigint, th bigint, first bigint, last bigint, fp bigint, parts int"
_NAMES = ["shard", "data", "doc_id", "th", "first", "last", "fp", "parts"]
_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_RUN = np.dtype([("fp", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("first", "<u4"), ("last", "<u4"), ("own", "?")])


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _settle(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first runs of their classes, runs that repeat an earlier one)."""
    order, new, same = _first_of([r["fp"], r["whole"]], [r["doc"], r["th"], r["first"]])
    return r[order[new]], r[order[~same]]


def cut(docs: DataFrame, shards: int) -> DataFrame:
    """Runs by shard, in pieces (shard, data), and spans that are settled already (doc_id, th, first, last)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, again = _settle(np.concatenate(held))
            shard = (first["fp"] >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            first, shard = first[order], shard[order]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            data = [x.tobytes() for x in np.split(first, cuts[1:])]
            for at in range(0, len(cuts), 256):
                yield _rows(shard=shard[cuts][at : at + 256].astype(np.int32), data=data[at : at + 256])
            yield from _spans(again, shards)

        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for doc, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    b = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else np.zeros(0, np.uint8)
                    size += len(b)
                    if (found := runs(b)) is not None:
                        r = np.empty(len(found[0]), _RUN)
                        for name, x in zip(("fp", "whole", "first", "last", "own"), found, strict=True):
                            r[name] = x
                        r["doc"], r["th"] = _NULL if doc is None else doc, th
                        held.append(r)
                    if size >= CHUNK and held:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "th", F.col("text").cast("binary").alias("text")).mapInArrow(run, _ROW)


def _spans(r: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs that are repeats as spans of bytes, touching ones of a text as one."""
    if not len(r):
        return
    r = r[np.lexsort((r["first"], r["th"], r["doc"]))]
    start, end = r["first"].astype(np.int64), r["last"].astype(np.int64) + LENGTH
    new = np.ones(len(r), bool)
    new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["th"][1:] != r["th"][:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    yield _rows(shard=(at % shards).astype(np.int32), doc_id=r["doc"][at], th=r["th"][at], first=start[at], last=np.maximum.reduceat(end, at))


def settle(dealt: DataFrame, shards: int, group: int) -> DataFrame:
    """Spans (fp null), and the runs whose bytes are needed (fp, parts, first and last window)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            first, again = _settle(np.concatenate(held))
            yield from _spans(again, shards)
            _, place, size = np.unique(first["fp"], return_inverse=True, return_counts=True)
            size = size[place]
            need = (size > 1) | first["own"]
            r, parts = first[need], -(-size[need] // group)
            for at in range(0, len(r), 50_000):
                x = r[at : at + 50_000]
                yield _rows(doc_id=x["doc"], th=x["th"], first=x["first"].astype(np.int64), last=x["last"].astype(np.int64), fp=x["fp"].view(np.int64), parts=parts[at : at + 50_000].astype(np.int32))

        for batch in it:
            done = batch.filter(pc.is_null(batch.column(1)))
            if done.num_rows:
                yield done
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if raw.is_valid:
                    if s != key and held:
                        yield from close()
                        held = []
                    key = s
                    held.append(np.frombuffer(raw.as_buffer(), _RUN))
        if held:
            yield from close()

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _ROW)


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """fp, part, doc_id, th, first, bytes of the runs that are asked for; windows one by one where a group has parts. Rows
    without bytes are windows that are known to repeat an earlier one."""
    lists = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("fp", "parts", "first", "last")).alias("asked"))
    both = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "th", F.col("text").cast("binary").alias("text")).join(lists, ["doc_id", "th"])
    names, kinds = ["fp", "part", "doc_id", "th", "first", "bytes"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

        def one_by_one(fp: int, parts: int, doc: int, th: int, first: int, last: int, text: bytes) -> Iterator[tuple]:
            for s in range(first, last + 1):
                key, place = (fp, parts, text[s : s + LENGTH]), (doc, th, s)
                old = least.setdefault(key, place)
                if old != place:
                    least[key], later = min(old, place), max(old, place)
                    yield (hash(later), -1, *later, None)

        def sent() -> pa.RecordBatch:
            out = [(fp, int.from_bytes(hashlib.blake2b(w, digest_size=6).digest()) % (SPREAD * parts), *place, w) for (fp, parts, w), place in least.items()]
            least.clear()
            return batch_of(out)

        for whole in it:
            for at in range(0, whole.num_rows, 200):
                out: list[tuple] = []
                for row in whole.slice(at, 200).to_pylist():
                    doc, th, text = row["doc_id"], row["th"], row["text"]
                    for fp, parts, first, last in {(x["fp"], x["parts"], x["first"], x["last"]) for x in row["asked"]}:
                        if parts == 1:
                            out.append((fp, 0, doc, th, first, text[first : last + LENGTH]))
                        else:
                            out += one_by_one(fp, parts, doc, th, first, last, text)
                yield batch_of(out)
                if len(least) >= HELD:
                    yield sent()
        yield sent()

    return both.mapInArrow(run, "fp bigint, part int, doc_id bigint, th bigint, first bigint, bytes binary").dropDuplicates(["fp", "part", "doc_id", "th", "first"])


def _again(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What has an equal in `ends`."""
    _, place, count = np.unique(ends, return_inverse=True, return_counts=True)
    good = count[place] > 1
    return at[good], ends[good]


def _breaks(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where a window doesn't follow the one before it in the same string."""
    return np.flatnonzero((np.diff(at) > 1) | (np.diff(np.searchsorted(begin, at, "right")) > 0)) + 1


def repeated(strings: list[tuple[tuple[int, int], int, bytes]]) -> list[tuple[tuple[int, int], int]]:
    """The windows (document, position) of the strings (document, position, bytes) that repeat an earlier one."""
    raw = b"".join(x[2] for x in strings)
    n = np.array([len(x[2]) for x in strings])
    begin = np.cumsum(n) - n
    flat = np.frombuffer(raw, np.uint8)
    # a window can only have an equal if its first and its last GRAM bytes have
    one = hashes(flat, 0)
    h = mixed((one[GRAM:] - one[:-GRAM]) * powers(len(flat) + 1)[2][: len(flat) - GRAM + 1])
    at = np.concatenate([np.arange(b, b + k - LENGTH + 1) for b, k in zip(begin, n, strict=True)])
    ends = h[at] * _MIX[1] ^ h[at + LENGTH - GRAM]
    at, ends = _again(at, ends)
    if len(at) < 2:
        return []
    out: list[tuple[tuple[int, int], int]] = []
    # of equal stretches, all but the first are repeats of it window by window
    first: dict[bytes, tuple[tuple[tuple[int, int], int], np.ndarray]] = {}

    def place_of(o: int) -> tuple[tuple[int, int], int]:
        k = int(np.searchsorted(begin, o, "right")) - 1
        return strings[k][0], strings[k][1] + o - int(begin[k])

    stretches = np.split(np.arange(len(at)), _breaks(at, begin))
    for part in stretches:
        a, b = int(at[part[0]]), int(at[part[-1]]) + LENGTH
        mine = (place_of(a), part)
        old = first.setdefault(raw[a:b], mine)
        if old is not mine:
            (doc, s), _ = later = max(old, mine, key=lambda x: x[0])
            first[raw[a:b]] = old if later is mine else mine
            out += [(doc, s + k) for k in range(len(part))]
    if len(first) < len(stretches):
        kept = np.sort(np.concatenate([part for _, part in first.values()]))
        at, ends = _again(at[kept], ends[kept])
        if len(at) < 2:
            return out
    # what is left, stretch by stretch, with a symbol of its own between stretches
    symbols: list[int] = []
    origin: list[int] = []
    for part in np.split(at, _breaks(at, begin)):
        a, b = int(part[0]), int(part[-1]) + LENGTH
        symbols += [x + 1 for x in raw[a:b]]
        origin += range(a, b)
        symbols.append(0)
        origin.append(-1)
    candidate = set(at.tolist())
    key, held = None, []

    def close() -> None:
        places = [place_of(o) for o in held]
        least = min(places)
        out.extend(p for p in places if p != least)

    for i in suffix_array(symbols):
        o = origin[i]
        if o in candidate:
            w = raw[o : o + LENGTH]
            if w != key:
                if len(held) > 1:
                    close()
                key, held = w, []
            held.append(o)
    if len(held) > 1:
        close()
    return out


def compare(found: DataFrame, partitions: int) -> DataFrame:
    """Spans (doc_id, th, first, last) of repeated windows among the contexts of each group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close(out: list[tuple]) -> None:
            by: dict[tuple[int, int], list[int]] = {}
            for doc, s in repeated(held):
                by.setdefault(doc, []).append(s)
            for doc, starts in by.items():
                x = np.array(starts)
                out += [(*doc, a, b) for a, b in joined(x, x + LENGTH)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=["doc_id", "th", "first", "last"])

        for batch in it:
            out: list[tuple] = []
            for fp, part, doc, th, first, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if raw is None:
                    out.append((doc, th, first, first + LENGTH))
                    continue
                if (fp, part) != key:
                    if held:
                        close(out)
                    key, held = (fp, part), []
                held.append(((doc, th), first, raw))
            yield batch_of(out)
        out = []
        if held:
            close(out)
        yield batch_of(out)

    return found.repartition(partitions, "fp", "part").sortWithinPartitions("fp", "part").mapInArrow(run, "doc_id bigint, th bigint, first bigint, last bigint")


def remove(docs: DataFrame, *, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left) of every row."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    settled = written(settle(cut(rows, n), n, group).drop("shard", "data"), "runs")
    asked = settled.where("fp IS NOT NULL")
    more = written(compare(contexts(rows, asked), n), "repeated-windows")
    spans = settled.where("fp IS NULL").select("doc_id", "th", "first", "last").unionByName(more)
    lists = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    both = rows.withColumn("_k", F.coalesce("doc_id", F.lit(_NULL))).join(lists.withColumnRenamed("doc_id", "_k"), ["_k", "th"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for whole in it:
            for at in range(0, whole.num_rows, 200):
                out = []
                for row in whole.slice(at, 200).to_pylist():
                    raw, spans = row["text"] or b"", row["spans"] or []
                    gone = joined(*(np.array([s[k] for s in spans], np.int64) for k in ("first", "last")))
                    kept, last = [], 0
                    for a, b in gone:
                        kept.append(raw[last:a])
                        last = b
                    left = b"".join([*kept, raw[last:]])
                    out.append((row["doc_id"], len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    return both.mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
