"""The registered queries of the corpus operators as they are, over the smallest tables: against SQL, libraries or plain versions."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

entries = pytest.importorskip("vicinity.llm.entries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = entries.QUERIES[name](spark, SF), duck.sql(entries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, values: sorted((tuple(v[columns.index(c)] for c in sorted(columns)) for v in values), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_op1(spark, texts):
    import math

    got = {r["doc_id"]: r for r in entries.op1_context_tree(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*words(low(t)), "\n"] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert got.keys() == texts.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r["score"] < 0


def test_op2(spark, texts):
    import xxhash

    got = {r["doc_id"]: r for r in entries.op2_simhash(spark, SF).collect()}
    prints = {}
    for i, t in texts.items():
        w = words(low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, {}
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entries.op4_token_store(spark, SF).collect()} == want


def test_op5(spark, texts):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = e.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in entries.op5_byte_bpe(spark, SF).collect()} == want


def test_op6(spark, duck, texts):
    got = entries.op6_mixing(spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(texts) and (got["n_tokens"] == [len(words(texts[i])) for i in got["doc_id"]]).all()
    mass = got["n_tokens"] * got["weight"]
    lang = mass.groupby(got["lang"].fillna("-")).sum() / mass.sum()
    own = got.groupby(got["lang"].fillna("-"))["n_tokens"].sum() / got["n_tokens"].sum()
    assert all(abs(lang[k] - v) < 0.5 * abs(own[k] - v) + 0.01 for k, v in entries.TARGETS["lang"].items())
    # no weight is above the bound by more than what its scale to a mean of 1 makes of it
    assert got["weight"].max() <= 1.5 * entries.MOST and got["rate"].mean() > 0.1
    assert got["rate"].between(0, 1).all() and got.loc[got["rate"] == 1, "kept"].all()
    assert abs(got["kept"].sum() - got["rate"].sum()) < 4 * (got["rate"] * (1 - got["rate"])).sum() ** 0.5 + 1


def test_op7(spark, duck, texts):
    got = {r["doc_id"]: r for r in entries.op7_language_id(spark, SF).collect()}
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i]))
    unseen = [i for i, r in got.items() if r["held_out"] and lang[i] and r["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == lang[i] for i in unseen) >= 0.9 * len(unseen)


def test_op8(spark, texts):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    for r in entries.op8_pii(spark, SF).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, good in rules for m in re.finditer(p, texts[r["doc_id"]]) if good(m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k + ":") for x in spans) for k, *_ in rules]
        found = [x for x in r["spans"].split(",") if x]
        assert set(spans) <= set(found)
        kinds = [k for k, *_ in rules]
        assert found == sorted(found, key=lambda x: (kinds.index(x.split(":")[0]), int(x.split(":")[1])))


def test_op10(spark, texts):
    got = entries.op10_quality_rules(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in got)
    again = {r["doc_id"]: r["kept"] for r in entries.op10_quality_rules(spark, SF).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in got}


def test_pipeline(spark, texts):
    """Every stage's rows come from the one before; the last one's ids decode to texts without base personal data."""
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids and docs.columns == list(corpus_pipeline.COLUMNS), name
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == ids
    run = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["ids_sha256"]) for r in run} == {(r["doc_id"], r["ids_sha256"]) for r in last}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in last)
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", t) for t in text.values())
