"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, each followed by a space, and an end byte that no text holds. A byte is coded bit
by bit, high bit first; each bit has a context tree over the DEPTH bytes before it, whatever they are (before a text's
start stands the end byte), whose nodes hold Krichevsky-Trofimov estimates. Weighting mixes the estimates of all depths:
a node's probability is half its own estimate's and half the product of its children's, and the weights that training
leaves are used for prediction. `score` is the log10 probability of all of the text's bytes, and sums to 1 over all
sequences of words.

A context is a node of its own if it occurs at least `least` times in training; the other contexts below a node share one
leaf. Nothing else bounds the tree, which grows with the corpus, and no task holds it: contexts are dealt to shards by the
two bytes next to the coded one, and only the levels above, at most 2^16 nodes, go through the driver.

Texts are worked on in batches. A first pass sends each batch's distinct words and its distinct grams (a byte and the
DEPTH before it, from all texts, counted in training) as arrays to their shards, sorted and deflated. Word shards answer
with counts; gram shards first sum up what the levels above them need, then build their part of the tree and answer with
a probability for each gram of each batch. Last, answers meet the batches' texts, which are kept as word numbers.

Defined cases: a null or empty text is the end alone; a null doc_id is never held out; repeated rows are scored and
counted each; without training texts every bit has probability 1/2; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, strings, written

DEPTH = 6
LEAST = 4
#: Levels of the tree above the shards.
TOP = 2
#: Text of a batch, bytes that are looked at at once, and distinct grams that are held before they are merged.
BATCH_BYTES, BLOCK, HELD = 12 << 20, 2 << 20, 1_000_000
#: Stands for the end of a text; no word holds it.
END = "\n"
_END = 0xFF


# --- texts as bytes ---------------------------------------------------------------------------------------------------
def spelled(words: pa.Array, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts; where each starts, and the whole length). places: each text's words and its end as
    numbers among the words, of which the last is the end; n: how many each text has."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    flat = np.insert(np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], 0x20)
    begin = offsets[:-1] - offsets[0] + np.arange(len(raw))
    size = np.diff(offsets) + 1
    flat[begin[-1]], size[-1] = _END, 1  # the end is one byte of its own
    parts = []
    for at in range(0, len(places), 1 << 18):
        part = places[at : at + (1 << 18)]
        each = size[part]
        stop = np.cumsum(each)
        parts.append(flat[np.arange(stop[-1]) + np.repeat(begin[part] - stop + each, each)])
    starts = np.concatenate([[0], np.cumsum(size[places])])[np.concatenate([[0], np.cumsum(n)])]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), starts


def grams(raw: np.ndarray, starts: np.ndarray, begin: int, end: int) -> np.ndarray:
    """For each byte of raw[begin:end] a key: the DEPTH bytes before it, the nearest highest, then the byte itself."""
    before = np.full(end - begin + DEPTH, _END, np.uint8)
    skip = max(0, DEPTH - begin)
    before[skip:] = raw[begin - DEPTH + skip : end]
    one = before.astype(np.uint16)
    two = one[1:] << 8 | one[:-1]  # [i]: bytes i + 1, i
    four = two[2:].astype(np.uint32) << 16 | two[:-2]  # [i]: bytes i + 3 ... i
    n = end - begin
    keys = (four[2 : 2 + n].astype(np.int64) << 24) | (two[:n].astype(np.int64) << 8) | raw[begin:end]
    first = starts[np.searchsorted(starts, begin - DEPTH) : np.searchsorted(starts, end)]
    for j in range(DEPTH - 1):  # j bytes into a text, only the bytes of that text and its start are known
        at = first + j - begin
        # a position beyond the text's end gets the mask of a later text's start anyway
        keys[at[(at >= 0) & (at < n)]] |= (1 << 8 * (DEPTH - j)) - 1 & ~0xFF
    return keys


# --- the tree ---------------------------------------------------------------------------------------------------------
def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    if not _SMALL.any():
        x, y = np.divmod(np.arange(_SMALL.size, dtype=np.float64), len(_SMALL))
        _SMALL[:] = _kt(x, y).reshape(_SMALL.shape)
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    out, small = np.empty(len(a)), (a < len(_SMALL)) & (b < len(_SMALL))
    out[small] = _SMALL[a[small].astype(np.int64), b[small].astype(np.int64)]
    out[~small] = _kt(a[~small], b[~small])
    return out


#: Values for small counts.
_SMALL = np.zeros((256, 256))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving x above 8."""
    x = np.asarray(x, np.float64)
    small = x < 8
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = small & (y < 8)
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


class Tree:
    """levels[d]: sorted keys (context of d bytes << 8 | bits so far with a leading 1), the chance of a one where that
    context is the deepest node, and where a deeper node is there that never saw these bits."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels
        contexts = [u[(u & 255) == 1] >> 8 for u, _, _ in levels]
        self.context = np.concatenate([*contexts, np.zeros(0, np.int64)])
        self.depth = np.repeat(np.arange(len(contexts)), [len(c) for c in contexts])
        shift = 8 * (DEPTH - self.depth)
        low, high = self.context << shift, (self.context + 1) << shift
        self.bounds = np.unique(np.concatenate([low, high, [0]]))
        #: The deepest node from each bound to the next.
        self.node = np.full(len(self.bounds), -1, np.int64)
        a, b = np.searchsorted(self.bounds, low), np.searchsorted(self.bounds, high)
        for d in range(len(contexts)):
            k = np.flatnonzero(self.depth == d)
            n = b[k] - a[k]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[k], n)
            self.node[at] = np.repeat(k, n)
        self.known = np.zeros(0, np.int64)
        self.value = np.zeros(0)

    def _evaluate(self, context: np.ndarray, depth: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 probability of bytes whose deepest nodes are these (depth -1: there is none)."""
        out = np.zeros(len(byte))
        for bit in range(8):
            u = 1 << bit | byte >> (8 - bit)
            p, open_ = np.full(len(byte), 0.5), np.arange(len(byte))
            for d in range(len(self.levels) - 1, -1, -1):
                keys, deepest, deeper = self.levels[d]
                k = open_[depth[open_] >= d]
                if not len(k) or not len(keys):
                    continue
                want = context[k] >> 8 * (depth[k] - d) << 8 | u[k]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[k[hit]] = np.where(depth[k[hit]] == d, deepest[at[hit]], deeper[at[hit]])
                done = np.zeros(len(byte), bool)
                done[k[hit]] = True
                open_ = open_[~done[open_]]
            out += np.log10(np.where((byte >> (7 - bit)) & 1, p, 1 - p))
        return out

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte; what was worked out before isn't worked out again."""
        order = np.argsort(keys)
        keys = keys[order]
        node = self.node[np.searchsorted(self.bounds, keys >> 8, "right") - 1]
        pair = node << 8 | keys & 255  # negative without a node
        u = np.unique(pair)
        new = np.setdiff1d(u, self.known, assume_unique=True)
        if len(new):
            if len(self.known) > 600_000:
                self.known, self.value, new = np.zeros(0, np.int64), np.zeros(0), u
            at = new >> 8
            none = at < 0
            value = self._evaluate(np.where(none, 0, self.context[at]) if len(self.context) else np.zeros(len(at), np.int64), np.where(none, -1, self.depth[at]) if len(self.depth) else np.full(len(at), -1), new & 255)
            known = np.concatenate([self.known, new])
            by = np.argsort(known)
            self.known, self.value = known[by], np.concatenate([self.value, value])[by]
        out = np.empty(len(keys))
        out[order] = self.value[np.searchsorted(self.known, pair)]
        return out

def nodes_of(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | bits so far, zeros, ones) of sorted keys (context << 8 | byte) with their numbers."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for bit in range(8 if len(keys) else 0):
        u = keys >> 8 << 8 | 1 << bit | (keys & 255) >> (8 - bit)  # sorted, as the keys are
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        ones = np.add.reduceat(np.where(keys >> (7 - bit) & 1, n, 0), first).astype(np.float64)
        found.append((u[first], np.add.reduceat(n, first) - ones, ones))
    u, zeros, ones = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(u)
    return u[order], zeros[order], ones[order]


def above(keys: np.ndarray) -> np.ndarray:
    """Keys with the farthest byte of their context left out."""
    return keys >> 16 << 8 | keys & 255


class Below:
    """What the children of nodes say to them, by parent: sorted keys, sums of log weighted probabilities, zeros, ones."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.keys, back = np.unique(keys, return_inverse=True)
        self.logs, self.zeros, self.ones = (np.bincount(back, x, len(self.keys)).astype(np.float64) for x in (logs, zeros, ones))


def weighed(nodes: tuple, below: Below | None) -> tuple[np.ndarray, np.ndarray, Below]:
    """(weight of each node's own estimate, chance of a one in the leaf its other contexts share, what parents hear)."""
    u, a, b = nodes
    own = weighted = log_kt(a, b)
    rest_a, rest_b, weight = a.copy(), b.copy(), np.ones(len(u))
    if below is not None:
        under = np.zeros(len(u))
        at = np.searchsorted(u, below.keys)
        under[at], rest_a[at], rest_b[at] = below.logs, a[at] - below.zeros, b[at] - below.ones
        under = under + log_kt(rest_a, rest_b)
        weighted = np.logaddexp(own, under) - math.log(2)
        weight = 1 / (1 + np.exp(np.clip(under - own, -700, 700)))
    return weight, (rest_b + 0.5) / (rest_a + rest_b + 1), Below(above(u), weighted, a, b)


def levels_of(nodes: list[tuple], weights: list[tuple], upper: tuple | None) -> tuple[list[tuple], tuple]:
    """(levels of a tree, from the top; what the lowest of them leaves to those below: keys, sum, share)."""
    levels = []
    for (u, a, b), (weight, rest) in zip(nodes, weights, strict=True):
        # what the nodes above have added, and the share that is left for this one and those below
        sum_, left = np.zeros(len(u)), np.ones(len(u))
        if upper is not None:
            parent = np.searchsorted(upper[0], above(u))
            sum_, left = upper[1][parent], upper[2][parent]
        sum_ = sum_ + left * weight * (b + 0.5) / (a + b + 1)
        left = left * (1 - weight)
        levels.append((u, sum_ + left * rest, sum_ + left * 0.5))
        upper = (u, sum_, left)
    return levels, upper


def frequent(keys: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys whose contexts occur at least `least` times."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 8 != keys[:-1] >> 8])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(keys))
    good = np.repeat(np.add.reduceat(n, first) >= least, size) if len(keys) else np.zeros(0, bool)
    return keys[good], n[good]


def shortened(keys: np.ndarray, n: np.ndarray, to: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, keys, numbers) from DEPTH down to `to` bytes of context."""
    for d in range(DEPTH, to - 1, -1):
        if d < DEPTH:
            keys, n = _merged([(above(keys), n)])
        yield d, keys, n


def part_of(keys: np.ndarray, n: np.ndarray, least: int) -> tuple[list[tuple], list[tuple]]:
    """(nodes, weights) of the levels from TOP on of the part of the tree below some contexts. keys, n: the grams of
    training under these contexts."""
    nodes, weights, below = [], [], None
    for _, k, m in shortened(keys, n, TOP):
        nodes.append(nodes_of(*frequent(k, m, least)))
        *weight, below = weighed(nodes[-1], below)
        weights.append(tuple(weight))
    return nodes[::-1], weights[::-1]


def heard(keys: np.ndarray, n: np.ndarray, least: int) -> tuple[Below, np.ndarray, np.ndarray]:
    """(what the levels above a part of the tree hear from it; its grams with TOP - 1 bytes of context, their numbers)."""
    below = None
    for d, k, m in shortened(keys, n, TOP - 1):
        if d >= TOP:
            below = weighed(nodes_of(*frequent(k, m, least)), below)[2]
    return below, k, m


def top_of(counts: tuple[np.ndarray, np.ndarray], below: Below, least: int) -> tuple[list[tuple], tuple]:
    """levels_of() the levels above the shards. counts: keys of one byte of context, and their numbers."""
    keys, n = counts
    nodes, weights = [], []
    for d in range(TOP - 1, -1, -1):
        if d < TOP - 1:
            keys, n = _merged([(above(keys), n)])
        nodes.append(nodes_of(*frequent(keys, n, least)))
        *weight, below = weighed(nodes[-1], below)
        weights.append(tuple(weight))
    return levels_of(nodes[::-1], weights[::-1], None)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their numbers."""
    keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the TOP bytes nearest to the coded one."""
    return ((keys >> 8 * (DEPTH - TOP + 1)) * 0x9E3779B1 & 0xFFFFFFFF) * shards >> 32


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    step = np.diff(keys, prepend=np.int64(0))
    return zlib.compress(_planes(step) + _planes(n), 1)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, the lowest first: the high planes of small numbers deflate to next to nothing."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 8, -1)
    step, n = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes)
    return np.cumsum(step), n


# --- passes -----------------------------------------------------------------------------------------------------------
def packed(places: np.ndarray) -> bytes:
    """Byte planes, the lowest first, deflated: the high planes of small numbers take next to nothing."""
    return zlib.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words with the end; for each text its words and the end as places among them; their number)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    coded = split.flatten().dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy()
    n = np.diff(split.offsets.to_numpy())
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # at the ends of texts that start or end in white space
    words = pa.concat_arrays([words, pa.array([END], words.type)])
    if empty >= 0:
        good = places != empty
        n = np.add.reduceat(np.append(good, False), np.cumsum(n) - n, dtype=np.int64) * (n > 0)
        places = places[good]
    return words, np.insert(places, np.cumsum(n), len(words) - 1), n + 1


def distinct_grams(raw: np.ndarray, starts: np.ndarray, train: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct grams of a stream, how often each stands in a text for which train is true)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = done = 0
    for begin in range(0, len(raw), BLOCK):
        end = min(len(raw), begin + BLOCK)
        keys = grams(raw, starts, begin, end) << 1
        if train is not None:
            first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end) - 1
            lengths = np.diff(np.clip(starts[first : last + 2], begin, end))
            keys |= np.repeat(train[first : last + 1].astype(np.int64), lengths)
        keys.sort()
        one = keys & 1
        keys >>= 1
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        held.append((keys[first], np.add.reduceat(one, first)))
        size += len(first)
        if size > max(HELD, 2 * done):
            held = [_merged(held)]
            done = size = len(held[0][0])
    return _merged(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(stable order by shard, (shard, from, to) in that order)."""
    order = np.argsort(shard, kind="stable")
    which, first = np.unique(shard[order], return_index=True)
    ends = np.append(first[1:], len(shard))[: len(first)]
    return order, list(zip(which.tolist(), first.tolist(), ends.tolist(), strict=True))


_FIRST = "batch bigint, shard int, words binary, counts binary, grams binary, doc_id array<bigint>, held array<boolean>, tokens array<int>, places binary"


def first_pass(docs: DataFrame, text: str, key: str, held_out: Column, shards: int) -> DataFrame:
    """Rows of words (with counts in training) and of grams by batch and shard, and one of texts for each batch."""
    names = [x.split(" ")[0] for x in _FIRST.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]

    def rows(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept.clear()
            train = ~pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)
            words, places, n = numbered(batch.column(2))
            raw, starts = spelled(words, places, n)
            keys, count = distinct_grams(raw, starts, train)
            del raw
            order, parts = by_shard(_shard(keys, shards))
            keys, count = keys[order], count[order]
            sent = [_packed(keys[a:b], count[a:b]) for _, a, b in parts]
            yield rows(batch=[number] * len(parts), shard=[p[0] for p in parts], grams=sent)
            del keys, count, sent
            seen = np.bincount(places[np.repeat(train, n)], minlength=len(words))
            raw_words = words.slice(0, len(words) - 1).cast(pa.large_binary()).to_pylist()
            order, parts = by_shard(np.fromiter((zlib.crc32(w) % shards for w in raw_words), np.int64, len(raw_words)))
            lists = [zlib.compress(b"\n".join([raw_words[k] for k in order[a:b].tolist()]), 1) for _, a, b in parts]
            sums = [zlib.compress(_planes(seen[order[a:b]]), 1) for _, a, b in parts]
            yield rows(batch=[number] * len(parts), shard=[p[0] for p in parts], words=lists, counts=sums)
            # words are numbered in the order in which shards answer, the end last
            new = np.empty(len(words), np.int64)
            new[order], new[-1] = np.arange(len(order)), len(order)
            yield rows(batch=[number], doc_id=[batch.column(0).to_pylist()], held=[~train], tokens=[n.astype(np.int32)], places=[packed(new[places])])
            del words, places, order, lists, sums, new, raw_words
            released()

        size = 0
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                kept.append(whole.slice(at, 500))
                size += pc.sum(pc.binary_length(kept[-1].column(2))).as_py() or 0
                if size >= BATCH_BYTES:
                    yield from flush()
                    number, size = number + 1, 0
        if kept:
            yield from flush()

    given = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text).alias("text"))
    return written(given.mapInArrow(run, _FIRST), "first-pass")


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of sorted batches, shard by shard, blobs still deflated."""
    key, held = None, []
    for batch in it:
        for row in batch.to_pylist():
            if row["shard"] != key:
                if held:
                    yield held
                key, held = row["shard"], []
            held.append(row)
    if held:
        yield held


def count_words(rows: DataFrame, shards: int) -> DataFrame:
    """batch, shard, words, counts (in all of training); and for each shard a row without batch: total, distinct."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "shard", "words", "counts", "total", "distinct"]
        for held in _by_shard(it):
            place: dict[bytes, int] = {}
            sums = np.zeros(1 << 10, np.int64)
            for r in held:
                words = zlib.decompress(r["words"]).split(b"\n")
                at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                if len(place) > len(sums):
                    sums = np.concatenate([sums, np.zeros(2 * len(place), np.int64)])
                sums[at] += _numbers(r["counts"])  # a batch names each word once
                r["at"] = zlib.compress(at.astype("<u4").tobytes(), 1)
            del place
            out = [(r["batch"], r["shard"], r["words"], zlib.compress(_planes(sums[np.frombuffer(zlib.decompress(r["at"]), "<u4")]), 1), None, None) for r in held]
            out.append((None, held[0]["shard"], None, None, int(sums.sum()), int((sums > 0).sum())))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "batch")
    return written(dealt.mapInArrow(run, "batch bigint, shard int, words binary, counts binary, total bigint, distinct bigint"), "word-counts")


def train(grams_: DataFrame, shards: int, least: int) -> tuple[DataFrame, tuple]:
    """(the grams of training by shard; the tree above the shards). grams_: batch, shard, grams."""
    spark = grams_.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "grams", "kind", "key", "x", "a", "b"]

        def table(kind: int, key: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            n = len(key)
            cols = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.full(n, kind, np.int32)), pa.array(key, pa.int64()), *[pa.array(c, pa.float64()) for c in (x, a, b)]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for shard, keys, n in _merged_shards(it):
            if not len(keys):
                continue
            none = [pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_packed(keys, n)], pa.binary()), *none], names=names)
            below, k, m = heard(keys, n, least)
            del keys, n
            yield table(0, below.keys, below.logs, below.zeros, below.ones)
            zero = np.zeros(len(k))
            yield table(1, k, m.astype(np.float64), zero, zero)
            released()

    dealt = grams_.select("shard", "grams").repartition(shards, "shard").sortWithinPartitions("shard")
    found = written(dealt.mapInArrow(run, "shard int, grams binary, kind int, key bigint, x double, a double, b double"), "shard-grams")
    # contexts of one byte, at most 2^8 with 2^8 bits or bytes each
    sums = found.where("kind IS NOT NULL").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in "xab"]).toPandas().sort_values("key")
    part = lambda kind, c, t: sums.loc[sums["kind"] == kind, c].to_numpy(t)
    below = Below(part(0, "key", np.int64), *(part(0, c, np.float64) for c in "xab"))
    top = top_of((part(1, "key", np.int64), part(1, "x", np.float64)), below, least)
    return found.where("grams IS NOT NULL").select("shard", "grams"), top


def _merged_shards(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sorted grams that training has, their numbers) of rows sorted by shard."""
    key, held, size, done = None, [], 0, 0

    def result() -> tuple[int, np.ndarray, np.ndarray]:
        keys, n = _merged(held)
        return key, keys[n > 0], n[n > 0]

    for batch in it:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != key:
                if held:
                    yield result()
                key, held, size, done = shard, [], 0, 0
            held.append(_unpacked(raw.as_buffer()))
            size += len(held[-1][0])
            if size > max(HELD, 2 * done):
                held = [_merged(held)]
                done = size = len(held[0][0])
    if held:
        yield result()


def rate(grams_: DataFrame, trained: DataFrame, top: tuple, shards: int, least: int) -> DataFrame:
    """batch, shard, values: log10 probabilities of the batch's grams in their order, as float32."""
    sent = grams_.sparkSession.sparkContext.broadcast(top)  # levels above the shards: at most 2^16 nodes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper_levels, upper = sent.value
        key, tree = None, None
        kinds, names = [pa.int64(), pa.int32(), pa.binary()], ["batch", "shard", "values"]
        for whole in it:
            for at in range(0, whole.num_rows, 16):
                batch, out = whole.slice(at, 16), []
                for number, shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    keys, n = _unpacked(raw.as_buffer())
                    if shard != key:  # a shard's own grams come first, if training has any of them
                        tree, key = None, shard
                        released()
                        tree = Tree([*upper_levels, *levels_of(*part_of(*((keys, n) if number is None else (keys[:0], n[:0])), least), upper)[0]])
                    if number is not None:
                        out.append((number, shard, tree.score(keys).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    both = trained.select(F.lit(None).cast("long").alias("batch"), "shard", "grams").unionByName(grams_.select("batch", "shard", "grams"))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("batch").asc_nulls_first())
    return dealt.mapInArrow(run, "batch bigint, shard int, values binary")


def score(docs: DataFrame, held_out: Column, *, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    held_out: a boolean Column of docs; rows for which it is true are scored but not learned from. base_score is the
    add-one unigram model of the words and the end, for which all words that training lacks are one event. score is the
    tree's log10 probability of the text's bytes and their end; bits_per_byte its code length for each byte.
    """
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = first_pass(docs, text, key, held_out, shards)
    grams_ = first.where("grams IS NOT NULL").select("batch", "shard", "grams")
    texts = first.where("places IS NOT NULL").select("batch", "doc_id", "held", "tokens", "places")
    counted = count_words(first.where("words IS NOT NULL").select("batch", "shard", "words", "counts"), shards)
    facts = counted.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    ends = texts.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n, v = (facts["n"] or 0) + ends, (facts["v"] or 0) + (ends > 0)
    trained, top = train(grams_, shards, least)
    values = rate(grams_, trained, top, shards, least)
    none = lambda c: F.lit(None).cast("binary").alias(c)
    answers = counted.where("batch IS NOT NULL").select("batch", "shard", "words", "counts", none("values")).unionByName(values.select("batch", "shard", none("words"), none("counts"), "values"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        said = sorted(right.to_pylist(), key=lambda r: r["shard"])
        of_words = [r for r in said if r["words"] is not None]
        words = [w for r in of_words for w in zlib.decompress(r["words"]).split(b"\n")]
        count = np.concatenate([*[_numbers(r["counts"]) for r in of_words], [ends]])
        places, tokens = unpacked(row["places"]), np.array(row["tokens"], np.int64)
        begin = np.cumsum(tokens) - tokens
        known, base = (np.add.reduceat(x[places], begin) for x in ((count > 0).astype(np.float64), np.log10((count + 1) / (n + v + 1))))
        raw, starts = spelled(pa.array([*words, END.encode()], pa.large_binary()), places, tokens)
        del words, places
        keys, _ = distinct_grams(raw, starts)
        value = np.empty(len(keys))
        order, _ = by_shard(_shard(keys, shards))
        value[order] = np.frombuffer(b"".join([r["values"] for r in said if r["values"] is not None]), "<f4")
        total = np.zeros(len(tokens))
        for at in range(0, len(raw), BLOCK):
            end = min(len(raw), at + BLOCK)
            a, b = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end) - 1
            mine = grams(raw, starts, at, end)
            turn = np.argsort(mine)
            each = np.empty(len(mine))
            each[turn] = value[np.searchsorted(keys, mine[turn])]
            total[a : b + 1] += np.add.reduceat(each, np.maximum(starts[a : b + 1], at) - at)
        bits = -total * math.log2(10) / np.diff(starts)
        del raw, keys, value, said, of_words
        released()
        cols = [row["doc_id"], row["held"], tokens, known.astype(np.int64), np.full(len(tokens), n), base, total, bits]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(add, schema)
