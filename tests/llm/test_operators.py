"""Each corpus operator against a plain version on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import (
    byte_bpe,
    components,
    context_tree,
    language_id,
    mixing,
    pii,
    quality_rules,
    repeats,
    simhash_dedup,
    suffix_array,
    token_store,
    topics,
    va_file,
)
from vicinity.llm.common import words_of

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, spans int"
LONG = "the quick brown fox " * 3000
PASSAGE = "It was a bright cold day in April, and the clocks were striking thirteen; nobody looked up from the long grey street outside the hall."


def table():
    rng = random.Random(3)
    syllables = ["th", "er", "ing", "on", "ti", "re", "and", "st", "ou", "wh"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(60, 160))) for i in range(24)]
    near = text(150)
    rows += [(30, near), (31, near), (32, near + " end"), (33, near.replace("th", "TH", 1))]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "x"), (44, "one two"), (45, LONG), (46, "12 34 !!"), (47, "Ünïcode ſtraße 中文 🙂\x1c a b")]
    rows += [(50, text(20) + "\n" + PASSAGE + "\n" + text(20)), (51, text(30) + " " + PASSAGE + " " + text(9)), (52, PASSAGE * 3)]
    rows += [(60, "mail a.b@c.example.com or john [at] example [dot] com, +1 (212) 555-0100, 10.0.0.1, 4111 1111 1111 1111")]
    rows += [(60, "a second row of the same number"), (31, near), (None, "no number " * 30), (None, None)]
    return [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 7 else None, len(t or ""), "clash", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return sorted(rows, key=repr)


# --- 1
def test_context_tree(docs, empty):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = context_tree.score(docs, held).collect()
    words = [(i, [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t or "")] + ["\n"]) for i, t, *_ in table()]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in words if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, is_held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words]
    assert pairs((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == pairs(want)
    assert all(r["score"] < 0 and math.isfinite(r["bits_per_byte"]) for r in got)
    assert context_tree.score(empty, held).count() == 0


def plain_ctw(texts, least):
    """A function from a text to its probability, bit by bit the ratio of two weighted probabilities of whole trees."""
    end, depth = b"\xff", context_tree.DEPTH
    of = lambda t: "".join(w + " " for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))).encode() + end

    def events(raw):
        padded = end * depth + raw
        return [(padded[k : k + depth], padded[k + depth]) for k in range(len(raw))]

    seen = [e for t in texts for e in events(of(t))]
    often = Counter(c[depth - d :] for c, _ in seen for d in range(depth + 1))
    nodes = {c for c, n in often.items() if n >= least}
    bits = {}
    for c, x in seen:
        for k in range(8):
            bits.setdefault((1 << k) | x >> (8 - k), []).append((c, x >> (7 - k) & 1))

    kt = lambda rows: context_tree.log_kt(np.array([float(sum(not x for _, x in rows))]), np.array([float(sum(x for _, x in rows))]))[0]

    def weighted(rows, d):
        """Log weighted probability of the node that all rows share at depth d."""
        if d == depth:
            return kt(rows)
        children, rest = {}, []
        for c, x in rows:
            if c[depth - d - 1 :] in nodes:
                children.setdefault(c[depth - d - 1 :], []).append((c, x))
            else:
                rest.append((c, x))
        return np.logaddexp(kt(rows), sum(weighted(r, d + 1) for r in children.values()) + kt(rest)) - math.log(2)

    def score(text):
        total = 0.0
        for c, x in events(of(text)):
            for k in range(8):
                rows = bits.get((1 << k) | x >> (8 - k), [])
                if b"" in nodes:
                    total += weighted([*rows, (c, x >> (7 - k) & 1)], 0) - weighted(rows, 0)
                else:
                    total += math.log(0.5)
        return total / math.log(10)

    return score


@pytest.mark.parametrize("least", [1, 3, 100_000])
def test_context_tree_is_plain_weighting(spark, least):
    rows = [(1, "abba ab"), (2, None), (3, ""), (4, "ABBA abab\tba b"), (5, "cab bac"), (5, "x"), (6, "bab\xe9 abba"), (None, "abba ab")]
    out = [(7, "abba bab"), (8, "\u4e2d q"), (9, None)]
    docs = spark.createDataFrame([(i, t, False) for i, t in rows] + [(i, t, True) for i, t in out], "doc_id bigint, text string, out boolean")
    got = context_tree.score(docs.repartition(3), F.col("out"), least=least).collect()
    plain = plain_ctw([t for _, t in rows], least)
    want = [(i, plain(t)) for i, t in rows + out]
    assert len(got) == len(want)
    assert all(a == b and abs(x - y) < 1e-4 for (a, x), (b, y) in zip(pairs((r["doc_id"], r["score"]) for r in got), pairs(want), strict=True))


def test_context_tree_without_training(spark):
    docs = spark.createDataFrame([(1, "ab c", True), (2, None, True)], "doc_id bigint, text string, out boolean")
    got = {r["doc_id"]: r for r in context_tree.score(docs, F.col("out")).collect()}
    assert abs(got[1]["score"] - 6 * 8 * math.log10(0.5)) < 1e-4 and abs(got[2]["score"] - 8 * math.log10(0.5)) < 1e-4
    assert got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and got[1]["bits_per_byte"] == pytest.approx(8, abs=1e-4)


def test_context_tree_in_many_batches(spark, monkeypatch):
    """Small blocks, one partition or many: the same grams and the same scores."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["ab", "ra", "ca", "dab", "ra\xe9"], k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, t, i % 5 == 4) for i, t in enumerate(texts)] + [(100, texts[4], False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, out boolean")
    one = {r["doc_id"]: tuple(r) for r in context_tree.score(docs.coalesce(1), F.col("out")).collect()}
    monkeypatch.setattr(context_tree, "BLOCK", 37)
    monkeypatch.setattr(context_tree, "HELD", 50)
    import pyarrow as pa

    words, places, n = context_tree.numbered(pa.array(texts))
    raw, starts = context_tree.spelled(words, places, n)
    train = np.array([i % 5 != 4 for i in range(40)])
    keys, count = context_tree.distinct_grams(raw, starts, train)
    monkeypatch.undo()
    whole, all_ = context_tree.distinct_grams(raw, starts, train)
    assert (keys == whole).all() and (count == all_).all() and count.sum() == sum(int(starts[i + 1] - starts[i]) for i in range(40) if train[i])
    many = {r["doc_id"]: tuple(r) for r in context_tree.score(docs.repartition(13), F.col("out")).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k][2:], many[k][2:], atol=1e-4) for k in one)


def test_slices_of_columns():
    """What operators read from a slice of a column is what they read from its rows alone."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [None if k % 11 == 0 else " ".join(rng.choice(["Aa", "b.", "C", "dé", "e\nf"]) for _ in range(rng.randint(0, 9))) for k in range(300)]
    column, e = pa.array(texts, pa.string()), token_store.Encoder(WORDS)
    for a, n in ((0, 300), (7, 20), (100, 100), (250, 50), (299, 1)):
        part, alone = column.slice(a, n), pa.array(texts[a : a + n], pa.string())
        counts, words = topics.profiles(part)
        assert (counts == topics.profiles(alone)[0]).all() and words.tolist() == [len(words_of(t or "")) for t in texts[a : a + n]]
        raw, starts = context_tree.spelled(*context_tree.numbered(part))
        assert raw.tobytes() == context_tree.spelled(*context_tree.numbered(alone))[0].tobytes() and len(starts) == n + 1
        ids, per = e.encode_column(part, 2)
        want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[a : a + n]]
        assert ids.tolist() == [i for x in want for i in x] and per.tolist() == [len(x) for x in want]


def test_topics_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"{'ABCD'[i % 4]}{k}" for k in range(50)], k=60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    models = [topics.fit(x, 4, sample_rows=900) for x in (df.coalesce(1), df.repartition(5), df.repartition(3))]
    assert all(np.allclose(models[0][0], m[0]) and np.allclose(models[0][1], m[1]) for m in models[1:])


def test_topics_are_learned_from_every_row(spark):
    """A model is that of all rows, whatever bound is named: how rare places are, and centres that are means of theirs."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"{'ABC'[i % 3]}{k}" for k in range(40)], k=50)) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rarity, c = topics.fit(df, 3, sample_rows=60)
    counts = np.array(topics.profiles(pa.array(texts))[0], float)
    assert np.allclose(rarity, np.log(601 / (1 + (counts > 0).sum(axis=0))) + 0.05)
    x = topics.scaled(counts, rarity)
    sums = np.array([x[(x @ c.T).argmax(axis=1) == i].sum(axis=0) for i in range(len(c))])
    assert len(c) == 3 and np.allclose(c, sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True)), atol=1e-4)


def test_texts_as_bytes():
    import pyarrow as pa

    texts = ["abba ab", None, "", " ABBA\tb ", "b", "a b \xe9 abba"]
    words, places, n = context_tree.numbered(pa.array(texts))
    raw, starts = context_tree.spelled(words, places, n)
    want = ["".join(w + " " for w in words_of((t or "").lower())).encode() + b"\xff" for t in texts]
    assert raw.tobytes() == b"".join(want) and starts.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    keys = context_tree.grams(raw, starts, 0, len(raw))
    for k, key in enumerate(keys.tolist()):
        text = int(np.searchsorted(starts, k, "right")) - 1
        before = (b"\xff" * 6 + want[text])[k - int(starts[text]) :][:6]
        assert key == int.from_bytes(before[::-1], "big") << 8 | int(raw[k])
    for a, b in ((0, 3), (3, 11), (9, len(raw))):
        assert (context_tree.grams(raw, starts, a, b) == keys[a:b]).all()


def test_probabilities_sum_to_one():
    import pyarrow as pa

    raw, starts = context_tree.spelled(*context_tree.numbered(pa.array(["abba ab", "abba" * 9, "b", "a b \xe9 abba"])))
    keys, n = context_tree.distinct_grams(raw, starts, np.ones(4, bool))
    nodes, weights = context_tree.part_of(keys, n, 2)
    below, k, m = context_tree.heard(keys, n, 2)
    levels, upper = context_tree.top_of((k, m), below, 2)
    tree = context_tree.Tree([*levels, *context_tree.levels_of(nodes, weights, upper)[0]])
    for near in (b"ab", b" ", b"zz", b"abba a", b"\xff"):
        key = int.from_bytes((b"\xff" * 6 + near)[-6:][::-1], "big") << 8
        assert abs((10 ** tree.score(np.arange(256) | key)).sum() - 1) < 1e-9


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6])
    assert np.abs(context_tree._log_gamma(x) - [math.lgamma(v) for v in x]).max() < 1e-8


# --- 2
def plain_print(text, k):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash_dedup.components(simhash_dedup.fingerprints(docs, 3, 64), 3, 64, shard=3).collect()
    rows = [(i, plain_print(t, 3)) for i, t, *_ in table()]
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    want = [(i, f"{h:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, h) in enumerate(rows)]
    assert pairs((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == pairs(want)
    assert simhash_dedup.components(simhash_dedup.fingerprints(empty, 3, 64), 3, 64).count() == 0


def test_tree_finds_all_links():
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(40)})
    got = simhash_dedup.link(values, 3)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == [find(i) for i in range(len(values))]


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got[30] == got[31] == got[32] == got[33] == 30 and got[1] == 1 and got[45] == 45


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = components.stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["a"]: r["root"] for r in got} == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# --- 3
def plain_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4000, 2])
def test_repeats(spark, docs, empty, group):
    rows = [(i, t) for i, t, *_ in table() if i is not None]
    rows = sorted({i: t for i, t in reversed(rows)}.items())  # one row for each number
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r)[:5] for r in repeats.remove(df, group=group).collect()]
    assert pairs(got) == pairs(plain_repeats(rows))
    if group == 4000:
        assert repeats.remove(empty).count() == 0
        assert repeats.remove(docs).count() == docs.count()  # rows without a number or with a repeated one stay


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 40))]
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array.suffix_array([5] * 3000) == list(range(2999, -1, -1))


# --- 4
def test_token_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, WORDS, end=2, vocabulary=49_408)
    got = token_store.read(spark, path).collect()
    t = Tokenizer.from_file(WORDS)
    rows = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in table()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = Counter(), 0
    for i, ids in order:
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in order]
    token_store.write(empty, f"{path}0", WORDS, end=2, vocabulary=49_408)
    assert token_store.read(spark, f"{path}0").count() == 0


def test_blocks_decode_segment_by_segment():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 300_000), 5000).astype(np.int64)
    t = token_store.Table.scaled({int(i): int(n) for i, n in zip(*np.unique(ids, return_counts=True), strict=True)}, 5001)
    assert int(t.freq.sum()) == 1 << token_store.PROB_BITS
    raw = token_store.encode_block(t, [1, None], [100_000, 200_000], ids)
    b = token_store.Block(raw, token_store.Table.from_bytes(t.to_bytes()))
    assert (b.segment(1) == ids[token_store.SEGMENT : 2 * token_store.SEGMENT]).all() and (b.tokens() == ids).all() and b.doc_ids == [1, None]
    for place in (50, len(raw) - 1):
        with pytest.raises(ValueError):
            token_store.Block(raw[:place] + bytes([raw[place] ^ 1]) + raw[place + 1 :], t)
    some = [None, -(1 << 63), None, 0, (1 << 63) - 1]
    assert token_store.Block(token_store.encode_block(t, some, [1] * 5, ids[:5]), t).doc_ids == some
    one = token_store.Table.scaled({7: 3}, 10)
    assert token_store.Block(token_store.encode_block(one, [1], [3], np.array([7, 7, 7])), one).tokens().tolist() == [7, 7, 7]


def test_piecewise_words():
    e = token_store.Encoder(WORDS)
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'LL", "é", "É", "ß", "中文", "🙂", "1", "%", "\x1c", "\x85", "<|endoftext|>", "²", "½", "Σ", "é", "İ", "\xad", "_", "\xa0"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(e.encode_batch([s], 2)[0], np.uint16).tolist() == [*e.tokenizer.encode(s, add_special_tokens=False).ids, 2]


# --- 5
def test_byte_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = byte_bpe.Codec(BPE)
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "中文", "🙂", "1", "%", "\x1c", "\x85", " the", "ing", "<|endoftext|>", "\r\n", "ⅷ", "\x00"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        ids = c.encode(s)
        assert ids == enc.encode_ordinary(s) and c.decode(np.array(ids, np.int32)) == s.encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in table()]
    got = byte_bpe.encode(docs, BPE, ids=True).collect()
    assert pairs(tuple(r)[:4] for r in got) == pairs(want) and all(len(r["token_ids"]) == r["n_tokens"] for r in got)
    assert byte_bpe.encode(empty, BPE).count() == 0


# --- 6
def test_mixing(spark, docs, empty, monkeypatch):
    goal = {"source": {"a": 0.5, "b": 0.5, "gone": 3.0}, "lang": {"x": 0.8, "y": 0.2}, "topic": {"t": 1.0}}
    rows = [(i, "w " * (1 + i % 5), "a" if i % 4 else "b", "x" if i % 3 else "y") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    for cells in (mixing.CELLS, 0):  # on the driver, and as grouped sums
        monkeypatch.setattr(mixing, "CELLS", cells)
        got = mixing.weigh(df, topic=F.lit("t"), targets=goal, rounds=20).toPandas()
        mass = got["n_tokens"] * got["weight"]
        for axis, want in (("mix_source", {"a": 0.5, "b": 0.5}), ("mix_lang", {"x": 0.8, "y": 0.2})):
            share = mass.groupby(got[axis]).sum() / mass.sum()
            assert all(abs(share[k] - v) < 1e-3 for k, v in want.items())
        kept = got[got["kept"]]
        share = kept.groupby("mix_lang")["n_tokens"].sum() / kept["n_tokens"].sum()
        assert abs(share["x"] - 0.8) < 0.05 and got["rate"].max() == 1.0
    monkeypatch.undo()
    assert mixing.weigh(docs).count() == docs.count() and mixing.weigh(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.weigh(df, topic=F.lit("t"), targets={"lang": {"x": -1.0}})


@pytest.mark.parametrize("cells", [mixing.CELLS, 0])
def test_mixing_to_some_targets(spark, monkeypatch, cells):
    """Named values, null among them, get their shares; the others share the rest by tempered shares of their own."""
    monkeypatch.setattr(mixing, "CELLS", cells)
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None, ["x", "y", "z", None][i % 4] if i % 3 else "x") for i in range(3000)] + [(9000, None, "s0", "x"), (9001, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = mixing.weigh(df, topic=F.lit("t"), targets={"source": {None: 0.3, "s0": 0.2}, "lang": {"y": 0.5, "gone": 0.1}}, rounds=60).toPandas()
    assert len(got) == len(rows)
    mass = got["n_tokens"] * got["weight"]
    source = (mass.groupby(got["mix_source"].fillna("-")).sum() / mass.sum()).to_dict()
    lang = (mass.groupby(got["mix_lang"].fillna("-")).sum() / mass.sum()).to_dict()
    assert abs(source["-"] - 0.3) < 1e-4 and abs(source["s0"] - 0.2) < 1e-4
    own = {k: sum(len((t or "").split()) for _, t, s, _ in rows if s == k) ** 0.7 for k in ("s1", "s2", "s3", "s4")}
    assert all(abs(source[k] - 0.5 * v / sum(own.values())) < 1e-4 for k, v in own.items())
    own = {k: sum(len((t or "").split()) for *_, t, _, s in rows if s == k) ** 0.7 for k in ("x", "z", None)}
    assert abs(lang["y"] - 0.5 / 0.9) < 1e-4 and all(abs(lang[k or "-"] - 0.4 / 0.9 * v / sum(own.values())) < 1e-4 for k, v in own.items())


def test_mixing_samples_by_rate(spark):
    """Every row is kept or not by its own key; the shares of what is kept come near the targets."""
    rows = [(i, "a b c", f"s{i % 3}", "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    goal = {"source": {"s0": 0.6, "s1": 0.3, "s2": 0.1}}
    one = {r["doc_id"]: (r["kept"], r["rate"]) for r in mixing.weigh(df, topic=F.lit("t"), targets=goal).collect()}
    two = {r["doc_id"]: (r["kept"], r["rate"]) for r in mixing.weigh(df.repartition(5), topic=F.lit("t"), targets=goal).collect()}
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    kept = Counter(i % 3 for i, (k, _) in one.items() if k)
    n = sum(kept.values())
    assert kept[0] == 2000 and all(abs(kept[k] / n - v) < 0.03 for k, v in ((0, 0.6), (1, 0.3), (2, 0.1)))
    half = mixing.weigh(df, topic=F.lit("t"), targets=goal, budget=0.5).where("kept").count()
    assert abs(half / n - 0.5) < 0.05


def test_bounded_weights(spark, monkeypatch):
    """Targets that contradict each other: weights stay bounded, in both ways of fitting alike."""
    rows = [(i, "a b c d", "s", ["x", "x", "x", "y"][i % 4]) for i in range(800)] + [(5000 + i, "a b", "s", "y") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    topic = F.when((F.col("lang") == "x") | (F.col("doc_id") >= 5000), "one").otherwise("two")
    goal = {"lang": {"x": 0.3, "y": 0.7}, "topic": {"one": 0.7, "two": 0.3}}
    found = []
    for cells in (mixing.CELLS, 0):
        monkeypatch.setattr(mixing, "CELLS", cells)
        got = mixing.weigh(df, topic=topic, targets=goal, most=4.0, rounds=12).toPandas()
        found.append({(a, b): round(w, 4) for a, b, w in zip(got["mix_lang"], got["mix_topic"], got["weight"], strict=True)})
        assert got["kept"].mean() > 0.2
    assert found[0] == found[1] and len(found[0]) == 3
    free = mixing.weigh(df, topic=topic, targets=goal).toPandas()
    assert free["weight"].max() > 20 > 8 > max(found[0].values())


def test_topics_find_groups_of_words(spark):
    rng = random.Random(6)
    pools = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    common = [f"the{k}" for k in range(10)]
    rows = [(i, " ".join(rng.choices(pools[i % 4] + common * 4, k=80))) for i in range(400)] + [(900, None), (901, " \n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = topics.fit(df, 4, sample_rows=200)
    got = {r["doc_id"]: (r["topic"], r["n_tokens"]) for r in topics.describe(df, model).collect()}
    assert got[900] == got[901] == ("none", 0) and all(got[i][1] == 80 for i in range(400))
    best = [Counter(got[i][0] for i in range(g, 400, 4)).most_common(1)[0] for g in range(4)]
    assert len({b[0] for b in best}) == 4 and sum(b[1] for b in best) >= 390
    assert topics.fit(df.where("doc_id >= 900"), 4) is None
    assert {r["topic"] for r in topics.describe(df.where("doc_id < 3"), None).collect()} == {"none"}


# --- 7
def test_language(spark, docs, empty):
    rng = random.Random(5)
    kinds = {"aa": ["the", "ing", "and", "tion"], "bb": ["der", "sch", "ung", "ich"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(30)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df.where("doc_id % 4 <> 2"), PIECES)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    some = {r["text"]: r["lang_pred"] for r in language_id.predict(docs, model, keep=("text",)).collect()}
    for t in (None, "", " \t\n", "12 34 !!"):
        assert some[t] == "und"
    assert language_id.fit(empty, PIECES) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_forward_is_the_sum_over_segmentations():
    pieces = ["^", "^a", "a", "b", "ab", "ba"]
    m = language_id.Model(["x", "y"], pieces, np.log(np.array([[0.1, 0.2], [0.2, 0.1], [0.2, 0.2], [0.1, 0.2], [0.3, 0.1], [0.1, 0.2]])))

    def total(s, k):
        if not s:
            return 1.0
        out = sum(m.probs[i, k] * total(s[len(p) :], k) for i, p in enumerate(pieces) if s.startswith(p))
        return out + (language_id.CHARACTER * total(s[1:], k) if s[0] not in pieces else 0.0)

    for w in ("a", "abba", "bab", "azb"):
        assert np.allclose(np.exp(m.score(w)), [total("^" + w, k) for k in (0, 1)])


# --- 8
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    luhn = lambda d: sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    rng = random.Random(8)
    parts = ["a", "B.c", "@", ".", "com", "-", "_", "x@y.org", "1", "25", "255", "256", "0001", " ", "+", "(", ")", "4111 1111 1111 1111", "192.168.0.1", "+44 20 7946 0958", "é"]
    for _ in range(6000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.find(t) == plain_pii(t)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john [at] example [dot] com now", "email:5:32"),
        ("john dot smith at mail dot example dot com", "email:0:42"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email:0:16"),
        ("jоhn@exаmple.com", "email:0:16"),
        ("call plus four nine one two three four five six seven eight nine ok", "phone:5:64"),
        ("ip one nine two dot one six eight dot one dot one.", "ip:3:49"),
        ("four one one one one one one one one one one one one one one one", "card:0:64"),
        ("١٩٢.١٦٨.١.١", "ip:0:11"),
        ("look at the dot here, one two buckle my shoe", ""),
        ("a@b.com", "email:0:7"),
    ],
)
def test_disguises(text, want):
    assert pii.listed(pii.all_spans(text)[1]) == want


def test_pii_table(docs, empty):
    got = pii.scan(docs, keep=("doc_id", "text")).collect()
    for r in got:
        assert r["base_spans"] == pii.listed(plain_pii(r["text"] or ""))
        assert set(r["base_spans"].split(",")) <= set(r["spans"].split(",")) | {""}
    row = next(r for r in got if r["text"] and r["text"].startswith("mail"))
    assert row["redacted"] == "mail <EMAIL> or <EMAIL>, <PHONE>, <IP>, <CARD>" and row["n_email"] == 1
    assert pii.scan(empty).count() == 0


# --- 9
@pytest.mark.parametrize("scale", [256.0, 2.0**40])
def test_va_file(spark, scale):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 0.3, (300, 16)).round(2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [None] * 16), (302, [math.nan] * 16), (303, [math.inf] * 16), (350, [0.1] * 8), (351, [0.2] * 8), (7, v[7].tolist()), (None, v[1].tolist()), (400, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in va_file.top_k(df, F.col("id") % 50 == 0, scale=scale).collect())
    good = [(i, [math.floor(x * scale) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in good if i != q and len(b) == len(a))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert va_file.top_k(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_va_file_reads_few_vectors():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 40, (4000, 32))).astype(np.int64)
    lo, width = v.min(0), v.max(0) - v.min(0) + 1
    edges = np.array([[a + -(-c * w // va_file.CELLS) for c in range(va_file.CELLS + 1)] for a, w in zip(lo.tolist(), width.tolist(), strict=True)], object)
    cells = va_file.cells_of(v, edges.astype(float))
    s = va_file.Scan(np.arange(20), v[:20], edges, 5)
    for at in range(0, 4000, 500):
        s.block(np.arange(at, at + 500), np.arange(at, at + 500), cells[at : at + 500])
    i, row, id_, lower, upper = s.candidates()
    assert len(i) < 20 * 400
    exact = (v[:20] @ v.T)[i, row]
    assert (lower <= exact).all() and (exact <= upper).all() and (row == id_).all()
    for q in range(20):
        best = sorted((-int(v[q] @ v[j]), j) for j in range(4000) if j != q)[:5]
        assert {j for _, j in best} <= set(row[i == q].tolist())


def test_va_file_common_vectors(spark, monkeypatch):
    """A vector that most rows have, ids that repeat, ties, and many rounds of reading."""
    rng = np.random.default_rng(12)
    v = rng.normal(0, 0.2, (200, 8)).round(3).tolist()
    rows = [(i, v[0] if i % 3 else v[i % 200]) for i in range(400)] + [(5, v[0])] * 9 + [(50, v[0])] * 8 + [(100, v[3]), (7, v[3])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    good = [(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for first in (1, 32):
        monkeypatch.setattr(va_file, "FIRST", first)
        got = [tuple(r) for r in va_file.top_k(df, F.col("id") % 50 == 0).collect()]
        assert sorted(got) == sorted(want)
    rows = va_file.integers(df, 256.0, "embedding", "vec_id")
    assert va_file.stored(rows, 5).where(F.col("v") == F.array(*[F.lit(int(x)).cast("bigint") for x in good[1][1]])).count() <= 5 * 6


# --- 10
def plain_counts(t):
    w = words_of(t or "")
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs):
    got = quality_rules.text_statistics(docs).collect()
    assert pairs(tuple(r)[:6] for r in got) == pairs((i, *plain_counts(t)) for i, t, *_ in table())
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "\n", "#", "\t", "d e f ", "\x1c", "é "], k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert pairs(tuple(r)[:6] for r in quality_rules.text_statistics(df).collect()) == pairs((i, *plain_counts(t)) for i, t in enumerate(texts))


def test_rules(spark, docs, empty):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" + ("##" if i % 4 == 0 else "") for _ in range(80))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 600, 2)] + [(1, None, 0), (None, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    out, rules = quality_rules.judge(df, labels)
    assert rules.rules and all(len(r.conditions) <= 3 and str(r) for r in rules.rules)
    assert sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in out.collect()) >= 0.97 * 600
    for nothing in (labels.where("false"), labels.where("quality = 1")):
        kept, none = quality_rules.judge(docs, nothing)
        assert not none.rules and all(r["kept"] == (not r["base_failed"]) for r in kept.collect())
    assert quality_rules.judge(empty, labels)[0].count() == 0
