"""Near duplicates: shards, trees and exact sets of shingles against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("vicinity.llm")
from vicinity.llm import shingle_sets, simhash_dedup  # noqa: E402


def components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs, shingle=5, similarity=0.8).collect()}


def pair(rng, n, same):
    """Texts of n shingles each, `same` of them shared."""
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    one = [word() for _ in range(n + 4)]
    return [" ".join(one), " ".join(one[: same + 4] + [word() for _ in range(n - same)])]


def test_pairs_at_the_bound(spark):
    rng = random.Random(3)
    near = [x for _ in range(100) for x in pair(rng, 180, 160)]  # similarity 160 / 200
    nearer = [x for _ in range(100) for x in pair(rng, 185, 170)]  # 0.85
    far = [x for _ in range(100) for x in pair(rng, 180, 159)]  # 159 / 201
    got = components(spark, near + nearer + far)
    linked = [sum(got[i] == got[i + 1] for i in range(at, at + 200, 2)) for at in (0, 200, 400)]
    assert linked[0] >= 99 and linked[1] == 100 and linked[2] == 0, linked
    assert shingle_sets.recall(0.8) > 0.999


def joined(n, edges):
    label = list(range(n))
    for a, b in edges:
        old, new = label[a], label[b]
        label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("n", [2, 40, 700])
def test_forest_joins_what_the_radius_joins(n):
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 1 << 63, (max(1, n // 12), 8), np.uint64)
    x = seeds[rng.integers(0, len(seeds), n)]
    for row in x:
        for bit in rng.integers(0, 512, rng.integers(0, 90)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    x = np.unique(x, axis=0)
    d = simhash_dedup._distances(x, x)
    for radius in (0, 40, 102):
        got = simhash_dedup.forest(x, radius)
        pairs = sorted((int(d[a, b]), a, b) for a in range(len(x)) for b in range(a) if d[a, b] <= radius)
        assert all(d[a, b] <= radius for a, b in got)
        mine, plain = joined(len(x), got), joined(len(x), [p[1:] for p in pairs])
        assert len(set(zip(mine, plain, strict=True))) == len(set(mine)) == len(set(plain)) == len(x) - len(got)
        # shortest edges: as long in sum as those of the plain greedy choice
        least, label = 0, list(range(len(x)))
        for far, a, b in pairs:
            if label[a] != label[b]:
                least, old = least + far, label[a]
                label = [label[b] if v == old else v for v in label]
        assert sum(int(d[a, b]) for a, b in got) == least


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choices("klmnopqrst", k=9))
    return " ".join(words)


@pytest.mark.parametrize("shard", [20_000, 7])
def test_groups_against_all_pairs(spark, shard):
    """Groups of copies with a few words changed, many of them near the bound; 0.99 of the texts in their right group."""
    rng = random.Random(11)
    texts = []
    for size in (1, 2, 3, 9, 30, 90):
        base = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(rng.randint(60, 220))]
        texts += [" ".join(base)] + [varied(rng, base, rng.randint(1, 4)) for _ in range(size)]
    sets = [shingle_sets.shingle_set(x, 5) for x in texts]
    good = [(i, j) for i in range(len(texts)) for j in range(i) if shingle_sets.alike(sets[i], sets[j], 0.8)]
    want = joined(len(texts), good)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs, shard=shard).collect()}
    for i in range(len(texts)):  # nothing is joined that isn't
        assert want[i] == want[got[i]]
    kept, plain = len(set(got.values())), len(set(want))
    assert kept - plain <= 0.01 * len(texts), (kept, plain)


def test_repeats_in_a_text_count_once(spark):
    rng = random.Random(9)
    one, two = pair(rng, 40, 0)
    line = " ".join(f"w{k}" for k in range(10))
    got = components(spark, [f"{one} {' '.join([line] * 60)}", f"{two} {' '.join([line] * 60)}", one, f"{one} {' '.join(one.split()[:6] * 60)}"])
    assert got[0] != got[1] and got[2] == got[3]
