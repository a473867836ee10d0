"""Near duplicates by SimHash, linked through BK-trees.

A fingerprint bit is set if more than half of the hashes of the text's shingles have it. Fingerprints are dealt to
shards, each with a BK-tree that keys children by their integer distance to the parent; a search follows only edges
within the radius. Trees aren't broadcast whole, since they grow with the corpus: each meets the fingerprints of its
shard alone. Shards of more than SHARD fingerprints are dealt anew as pairs of parts, so no task holds an unbounded
group and no link is lost.

components(): fingerprints link where at most `radius` bits differ. Shards are bands of the bits: two fingerprints that
differ in at most r bits agree on one of r + 1 bands, so every link falls into some shard. A subtree that already is
one component with the fingerprint that is searched isn't entered, so that groups of near copies don't cost the square
of their size.

near_duplicates(): texts link where their sets of shingles have a Jaccard similarity. Their fingerprints then differ in
many bits (at 0.8 in some 77 of 512, give or take 8), which no band of bits survives; so shards are MinHash bands of the
sets, whose recall doesn't depend on the number of texts, the radius is three deviations above the mean, and each tree
proposes the shortest edges that join its shard: one for each text at most. A proposed edge is a link if the two sets,
compared in full, have the similarity. What can be missed is a text whose only similar partner of a shard is farther by
fingerprint than some dissimilar one, in every shard that the two share; tests hold that below 1 %.

Defined cases: a null or empty text has fingerprint zero, which links like any other (in near_duplicates(), empty texts
are copies of each other); copies share a fingerprint and so are linked without pairs of them; null doc_ids take part
but never name a component unless all of it is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, resident, words_of, written
from .components import stars
from .shingle_sets import alike, number_of, shards_of, shingle_set

SHARD = 20_000
#: Rows of 8 bytes that may be sent to every task.
SENT = 1_000_000
_LANES = np.random.default_rng(64).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int, bits: int) -> bytes:
    """`bits` / 8 bytes, the first eight (high byte first) from the hashes themselves."""
    words = words_of(lower_ascii(text)) if text else []
    if not words:
        return bytes(bits // 8)
    if len(words) < shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return bits_of(np.array([digest(g, 42) for g in grams], np.uint64), bits)


def bits_of(h: np.ndarray, bits: int) -> bytes:
    """The fingerprint of hashes: a bit is set if more than half of them have it."""
    out = []
    for lane in range(bits // 64):
        x = h
        if lane:  # further bits: the hash mixed with another odd number for each lane
            x = (h ^ (h >> np.uint64(31))) * _LANES[lane]
            x = (x ^ (x >> np.uint64(29))) * _LANES[-lane]
            x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 15):
            part = x[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(x)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int, bits: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [fingerprint(x, shingle, bits).hex() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def link(values: list[int], radius: int) -> list[int]:
    """For each value the place of its component's first, by one BK-tree that grows as it is searched."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    children: list[dict[int, int]] = [{} for _ in values]
    one = list(range(len(values)))  # a member if the whole subtree is one component, else -1
    for i in range(1, len(values)):
        x, stack = values[i], [0]
        while stack:
            v = stack.pop()
            if one[v] >= 0 and root(one[v]) == root(i):
                continue
            d = (values[v] ^ x).bit_count()
            if d <= radius:
                a, b = root(v), root(i)
                parent[max(a, b)] = min(a, b)
            for e, c in children[v].items():
                if -radius <= e - d <= radius:
                    stack.append(c)
        v = 0
        while True:
            if one[v] >= 0 and root(one[v]) != root(i):
                one[v] = -1
            d = (values[v] ^ x).bit_count()
            if d not in children[v]:
                children[v][d] = i
                break
            v = children[v][d]
    return [root(i) for i in range(len(values))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words, for each of a against each of b."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)


class Tree:
    """A BK-tree over rows of 64-bit words. A node holds one row and its children by their distance to it; the last
    LEAF rows or fewer of a branch stay together. Searches take many rows at once down the same edges."""

    LEAF, AT_ONCE = 64, 4096

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.item: list[int] = []
        self.leaf: list[np.ndarray] = []
        self.children: list[dict[int, int]] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, d = todo.pop()
            k = len(self.item)
            if parent >= 0:
                self.children[parent][d] = k
            self.item.append(int(rows[0]))
            self.members.append(rows)
            self.children.append({})
            rest = rows[1:]
            if len(rest) <= self.LEAF:
                self.leaf.append(rest)
                continue
            self.leaf.append(rest[:0])
            far = _distances(x[rows[:1]], x[rest])[0]
            order = np.argsort(far, kind="stable")
            values, first = np.unique(far[order], return_index=True)
            todo += [(g, k, int(v)) for v, g in zip(values, np.split(rest[order], first[1:]), strict=True)]

    def nearest_other(self, label: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest one of another label within the radius, and its distance (radius + 1 for none)."""
        best, who = np.full(len(self.x), radius + 1), np.full(len(self.x), -1)
        one = [int(label[m[0]]) if (label[m] == label[m[0]]).all() else -1 for m in self.members]
        todo = [(0, ask[at : at + self.AT_ONCE]) for at in range(0, len(ask), self.AT_ONCE)]
        while todo:
            k, q = todo.pop()
            if one[k] >= 0:
                q = q[label[q] != one[k]]
            if not len(q):
                continue
            rows = np.concatenate([[self.item[k]], self.leaf[k]])
            d = _distances(self.x[q], self.x[rows])
            far = np.where(label[q][:, None] == label[rows][None, :], radius + 1, d)
            at = far.argmin(axis=1)
            least = far[np.arange(len(q)), at]
            better = least < best[q]
            best[q[better]], who[q[better]] = least[better], rows[at[better]]
            for e, child in self.children[k].items():
                todo.append((child, q[np.abs(d[:, 0] - e) < best[q]]))
        return who, best


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The shortest edges of at most `radius` bits that join what such edges join, of distinct rows of words."""
    n, out = len(x), []
    label = np.arange(n)
    if n <= 48:
        d = _distances(x, x)
        a, b = np.nonzero(np.triu(d <= radius, 1))
        for k in np.argsort(d[a, b], kind="stable"):
            i, j = int(a[k]), int(b[k])
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
        return out
    tree, ask = Tree(x), np.arange(n)
    while len(ask):
        who, d = tree.nearest_other(label, ask, radius)
        ask = ask[who[ask] >= 0]
        # each component's shortest edge; components without one are done
        order = ask[np.lexsort((np.maximum(ask, who[ask]), np.minimum(ask, who[ask]), d[ask]))]
        _, first = np.unique(label[order], return_index=True)
        parent = {int(v): int(v) for v in np.unique(label)}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in order[np.sort(first)]:
            a, b = root(int(label[i])), root(int(label[who[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(int(i), int(who[i])), max(int(i), int(who[i]))))
        values, back = np.unique(label, return_inverse=True)
        label = np.array([root(int(v)) for v in values])[back]
        # of components that found an edge, every member is asked again
        ask = np.flatnonzero(np.isin(label, label[ask]))
    return out


def radius_of(similarity: float, bits: int, deviations: float = 3.0) -> int:
    """How many bits differ between the fingerprints of two sets of one size and that similarity, with some to spare."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def small(numbers: DataFrame) -> DataFrame:
    """A table of one number a row, to be sent to all tasks while it has at most SENT rows, by a count; else joined as
    any other."""
    kept = written(numbers, "numbers")
    return F.broadcast(kept) if kept.count() <= SENT else kept


def sharded(dealt: DataFrame, shard: int) -> DataFrame:
    """shard, pair and fingerprint of (shard, fingerprint), dealt to partitions and sorted: all of a shard together, or
    of one above `shard` fingerprints its parts, each pair of them together."""
    spark = dealt.sparkSession
    large = written(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard), "large-shards")
    n_large = large.count()
    if not n_large:
        dealt = dealt.select("shard", F.lit("0").alias("pair"), "fingerprint")
    else:
        # One row for each large shard: sent to all tasks while that is a few MB, else joined by shuffling.
        large = large.select("shard", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("parts"))
        dealt = dealt.join(F.broadcast(large) if n_large <= 100_000 else large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
        pairs = F.when(F.col("parts") == 1, F.array(F.lit("0"))).otherwise(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("mine")),
                lambda o: F.concat_ws("-", F.least(o, F.col("mine")).cast("string"), F.greatest(o, F.col("mine")).cast("string")),
            )
        )
        dealt = dealt.withColumn("mine", mine).select("shard", F.explode(pairs).alias("pair"), "fingerprint")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "shard", "pair").sortWithinPartitions("shard", "pair", "fingerprint")


def groups(it: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The fingerprints of each (shard, pair) of sharded() rows."""
    key, held = None, []
    for batch in it:
        for s, p, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (s, p) != key:
                if len(held) > 1:
                    yield held
                key, held = (s, p), []
            held.append(x)
    if len(held) > 1:
        yield held


def components(prints: DataFrame, radius: int, bits: int, *, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach) for every row of fingerprints()."""
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprints")
    cuts = [round(k * bits / (radius + 1)) for k in range(radius + 2)]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = [bytes.fromhex(x) for x in batch.column(0).to_pylist()]
            values = [int.from_bytes(x) for x in raw]
            prints_ = pa.array(raw, pa.binary())
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                keys = [k << 48 | v >> (bits - b) & ((1 << (b - a)) - 1) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), prints_], names=["shard", "fingerprint"])

    dealt = sharded(distinct.select("fingerprint").mapInArrow(deal, "shard bigint, fingerprint binary"), shard)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(it):
            found = [(i, r) for i, r in enumerate(link([int.from_bytes(x) for x in held], radius)) if r != i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[x[k]].hex() for x in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    edges = dealt.mapInArrow(search, "a string, b string")
    roots = stars(edges)
    named = distinct.join(roots, F.col("fingerprint") == F.col("a"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fingerprint", "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, bits: int = 512, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """doc_id, print (equal for rows with equal sets of shingles, which are one text), component_id (the smallest doc_id
    that links reach) and first (whether the row's text is its component's first, by doc_id and print) for every row.

    Fingerprints count each distinct shingle once.
    """
    radius, width = radius_of(similarity, bits), bits // 8

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("near duplicates")
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
                prints_ = [number_of(x).to_bytes(8, "big", signed=True) for x in found]
                both = [bits_of(x, bits) + n if len(x) else bytes(width) + n for x, n in zip(found, prints_, strict=True)]
                cols = [pa.array(map(number_of, found), pa.int64()), pa.array(both, pa.binary()), pa.array(map(shards_of, found), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "print", "fingerprint", "shards"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = written(rows.mapInArrow(sign, "doc_id bigint, print bigint, fingerprint binary, shards array<bigint>"), "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    # A shard of one text has no edge. Sums are taken before anything is sent, so copies cost a row for each task.
    dealt = prints.select(F.explode("shards").alias("shard"), "print")
    ends = dealt.groupBy("shard").agg(F.min("print").alias("a"), F.max("print").alias("b"), F.count("*").alias("n")).where("a <> b")
    ends = written(ends, "shared-shards")
    two = ends.where("n = 2").select("shard", F.explode(F.array("a", "b")).alias("print"))
    more = small(ends.where("n > 2").select("shard"))
    members = written(two.unionByName(dealt.join(more, "shard", "left_semi").distinct()), "shard-members")
    wanted = small(members.select("print").distinct())
    named = written(prints.select("print", "fingerprint").join(wanted, "print", "left_semi").dropDuplicates(["print"]), "named")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list[bytes], list] = ([], [])
        for held in groups(it):
            if held != last[0]:  # shards with the same texts often follow each other
                x = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), width + 8)
                names = np.ascontiguousarray(x[:, width:]).view(">i8").ravel()
                words = np.ascontiguousarray(x[:, :width]).view(np.uint64)
                u, first, back = np.unique(words, axis=0, return_index=True, return_inverse=True) if len(held) > 2 else (words, np.arange(2), np.arange(2))
                back = back.ravel()
                found = [(first[i], first[j]) for i, j in forest(u, radius)] + [(first[k], i) for i, k in enumerate(back) if first[k] != i]
                last = (held, [(int(names[i]), int(names[j])) for i, j in found])
            if last[1]:
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in last[1]], pa.int64()) for f in (min, max)], names=["a", "b"])

    trees = sharded(members.join(named, "print").select("shard", "fingerprint"), shard)
    pairs = written(trees.mapInArrow(search, "a bigint, b bigint").distinct(), "pairs")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                found = [shingle_set(x, shingle) for x in whole.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(number_of, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["print", "hashes"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct(), "asked")
    # one row of each text that is compared, by a doc_id that has it; rows without one are looked through
    ids = written(prints.join(small(asked), "print", "left_semi").groupBy("print").agg(F.min("doc_id").alias("doc_id")), "compared")
    some = rows.join(small(ids.where("doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_semi")
    if ids.where("doc_id IS NULL").limit(1).count():
        some = some.unionByName(rows.where("doc_id IS NULL"))
    sets = some.select("text").mapInArrow(measure, "print bigint, hashes binary").join(small(asked), "print", "left_semi")
    sets = written(sets.dropDuplicates(["print"]), "shingle-sets")
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    roots = stars(both.mapInArrow(compare, "a bigint, b bigint"))
    named = distinct.join(roots, F.col("print") == F.col("a"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    # a text's least doc_id and print, the least of its component first; null doc_ids last
    order = F.struct(F.col("first").isNull(), "first", "print")
    least = named.groupBy("root").agg(F.min(order).alias("m"))
    labels = named.join(least, "root").select("print", F.col("m.first").alias("component_id"), (F.col("m.print") == F.col("print")).alias("_first"))
    first = F.col("_first") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return prints.select("doc_id", "print").join(labels, "print").select("doc_id", "print", "component_id", first.alias("first"))


def numbered(docs: DataFrame, *, shingle: int = 5, text: str = "text") -> DataFrame:
    """docs with `print`, as near_duplicates() gives it."""
    schema = docs.withColumn("print", F.lit(0).cast("long")).schema

    place = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [number_of(shingle_set(x, shingle)) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
