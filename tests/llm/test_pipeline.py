"""The pipeline's stages one by one on a small table, and the guard around the optional parts."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def table():
    rng = random.Random(11)
    kinds = {"en": ["th", "ing", "and", "er"], "de": ["sch", "ung", "der", "ich"]}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, 120), k, f"s{i % 3}") for i in range(60) for k in [("en", "de")[i % 2]]]
    copy = text("en", 200)
    rows += [(100, copy, "en", "s0"), (101, copy, "en", "s1"), (102, copy + " more", "en", "s0")]
    rows += [(110, None, None, "s0"), (111, "", "en", None), (112, "12 34", "de", "s0"), (113, text("de", 90) + " x@y.org", None, None), (None, text("en", 80), "en", "s1")]
    return [(i, t, lang, s, len(t or ""), "z") for i, t, lang, s in rows]


def test_stages(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    language, near, private, mixture, encode = (f for _, f in corpus_pipeline.STAGES)
    one = language(spark, docs, "").cache()
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in one.collect()} == {r[0] for r in table()} - {110, 111, 112}
    two = near(spark, one, "").cache()
    assert {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in two.collect()} == {101, 102}
    three = private(spark, two, "").cache()
    texts = {r["doc_id"]: r for r in three.collect()}
    assert texts[113]["text"].endswith(" <EMAIL>") and texts[113]["n_chars"] == len(texts[113]["text"])
    four = mixture(spark, three, "").cache()
    assert four.columns == list(corpus_pipeline.COLUMNS) and 0 < four.count() <= three.count()
    assert not {str(r["doc_id"]) for r in four.collect()} - {str(r["doc_id"]) for r in three.collect()}
    five = encode(spark, four, "").collect()
    assert len(five) == four.count() and all(r["n_tokens"] == len(r["token_ids"]) for r in five)


def test_the_mixture_learns_from_every_row(spark, monkeypatch):
    """The topics by which mix_sources weighs are those of all rows, also where there are more than 4,000."""
    import numpy as np
    import pyarrow as pa

    from vicinity.llm import topics

    texts = [f"{'ab'[i % 2]}{i % 7} {'ab'[i % 2]}{i % 11} w{i % 97}" for i in range(5000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t), "z") for i, t in enumerate(texts)], SCHEMA)
    models, describe = [], topics.describe
    monkeypatch.setattr(topics, "describe", lambda df, model, **k: (models.append(model), describe(df, model, **k))[1])
    assert 0 < corpus_pipeline.mix_sources(spark, docs, "").count() <= 5000
    counts, _ = topics.profiles(pa.array(texts))
    assert np.allclose(models[0][0], np.log(5001 / (1 + (counts > 0).sum(axis=0))) + 0.05)


@pytest.mark.parametrize("held", [None, 3])
def test_the_language_model_learns_from_every_row(spark, monkeypatch, held):
    """Words that one text of 2,500 has are learned as well, also where tasks hand on few words at a time."""
    import numpy as np

    from vicinity.llm import language_id

    pieces = ["^", *"abcdefgh", "ab", "ba", "fg"]
    monkeypatch.setattr(language_id, "pieces_of", lambda _: pieces)
    if held:
        monkeypatch.setattr(language_id, "HELD", held)
        monkeypatch.setattr(language_id, "PART", held)
    texts = [("abba cab" if i % 2 else "fgh gh", "xy"[i % 2]) for i in range(2500)] + [("ed abba", "y"), ("dd fgh", "x")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t), "z") for i, (t, k) in enumerate(texts)] + [(9000, "hhh", None, "s", 3, "z"), (9001, None, "x", "s", 0, "z")], SCHEMA)
    models, predict = [], language_id.predict
    monkeypatch.setattr(language_id, "predict", lambda df, model, **k: (models.append(model), predict(df, model, **k))[1])
    corpus_pipeline.identify_language(spark, docs, "")
    want = np.full((len(pieces), 2), -np.log(len(pieces)))
    for _ in range(2):
        m, total = language_id.Model(["x", "y"], pieces, want), np.full((2, len(pieces)), language_id.SMOOTH)
        for t, k in texts:
            for w in t.split():
                m.expected(w, "xy".index(k), 1, total["xy".index(k)])
        want = np.log(total.T / total.sum(axis=1))
    assert models[0].languages == ["x", "y"] and np.allclose(models[0].logs, want)


def test_rows_that_share_a_number(spark):
    """Equal rows are one; another text of the same number is judged as any other."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, a), (1, b), (2, b + " end"), (3, c), (4, a + " x"), (4, c + " y"), (None, a), (None, a), (5, None), (6, ""), (6, None), (0, c + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "z") for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, a), (1, b), (0, c + " z"), (None, a), (None, a), (5, None)], key=repr)


def test_run_over_a_folder(spark, tmp_path):
    """The whole pipeline, its parts in the shared folder gone but for the last table that it reads."""
    from vicinity import storage

    spark.createDataFrame(table(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    before = len(storage._paths)
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = got.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r[0] for r in table()} - {101, 102, 110, 111, 112}
    assert [p.split("/")[-1].split("-")[1] for p in storage._paths[before:] if "stage-" in p] == ["mixture"]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "")
    assert docs.count() == 0


def test_entry_works_without_these_parts(tmp_path):
    code = "import __spark_entry__ as e; print(any(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries(), len(e.queries()) > 40)"
    (tmp_path / "vicinity").mkdir()
    for p in (ROOT / "vicinity").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "vicinity" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert got.stdout.split() == ["False", "False", "True"], got.stderr
