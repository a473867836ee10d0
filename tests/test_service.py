"""Configuration, command line, machine facts, streams and reports around the search."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scoring import points, request

from vicinity import build, host, schema, storage
from vicinity.config import BalancerConfig, SearchConfig, ServiceConfig
from vicinity.functions import generate
from vicinity.operators import evaluate, index, kmeans, knn, metrics, search
from vicinity.sources import readers, sinks
from vicinity.streaming import scoring
from vicinity.streaming.progress import Progress


def test_service_configuration():
    env = {"API_CTRL": "c", "API_REFERENCES": "r", "API_NORMALIZATION": "n", "API_MCC_RISK": "m"}
    got = ServiceConfig.from_env(env | {"API_NPROBE_BORDER": "12", "API_EPOLL_TIMEOUT_MS": "250", "API_METRICS_PORT": "9100"})
    assert got.search == SearchConfig(nprobe_border=12) and got.trigger == "250 milliseconds" and got.metrics_port == 9100
    assert ServiceConfig.from_env(env).search == SearchConfig()
    with pytest.raises(ValueError, match="API_MCC_RISK"):
        ServiceConfig.from_env(env | {"API_MCC_RISK": ""})
    assert BalancerConfig.from_env({"LB_BACKENDS": "a,,b"}) == BalancerConfig(("a", "b"))
    for bad in ({}, {"LB_BACKENDS": ","}):
        with pytest.raises(ValueError):
            BalancerConfig.from_env(bad)


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [{"vector": [*rng.random(11).round(4).tolist(), 1, float(rng.choice([0.2, 0.8])), 0.5], "label": "fraud" if i % 3 else "legit"} for i in range(120)]
    path = tmp_path / "r.json.gz"
    with gzip.open(path, "wt") as f:
        json.dump(rows, f)
    got = build.main([str(path), str(tmp_path / "i"), "6", "100", "5", str(tmp_path / "e"), "3"], spark)
    risky = sum(r["vector"][12] == 0.8 for r in rows)
    assert got[str(tmp_path / "i")]["n"] == 120 and got[str(tmp_path / "e")]["n"] == risky
    meta, boxes, postings = readers.index(spark, str(tmp_path / "e"))
    assert meta["k"] == 3 and postings.count() == risky and boxes.count() == 3
    lines = tmp_path / "lines"
    lines.mkdir()
    for k in range(3):
        (lines / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::3]))
    assert readers.references(spark, str(lines), lines=True).count() == 120
    a = build.arguments(["x", "y"])
    assert (a.k, a.sample, a.iterations, a.edge_index, a.edge_k) == (4096, 200_000, 1000, None, 256)


def test_machine_facts(tmp_path):
    (tmp_path / "proc/self").mkdir(parents=True)
    (tmp_path / "proc/cpuinfo").write_text("processor : 0\nmodel name\t: Chip 9\ncpu cores : 2\nprocessor : 1\nmodel name\t: Chip 9\n")
    (tmp_path / "proc/self/status").write_text("Name:\tx\nCpus_allowed_list:\t0-1\n")
    got = host.machine(str(tmp_path))
    assert (got["model"], got["cores"], got["logical"], got["cpuset"], got["l2"]) == ("Chip 9", 2, 2, "0-1", None)
    (tmp_path / "cpu.stat").write_text("usage_usec 2500000\nuser_usec 2000000\nsystem_usec 500000\nthrottled_usec 1\n")
    (tmp_path / "cpu.max").write_text("45000 100000\n")
    group = host.control_group(str(tmp_path))
    assert group["cpu_total_s"] == 2.5 and group["cpu_limit_cores"] == 0.45 and group["memory_bytes"] is None
    (tmp_path / "cpu.max").write_text("max 100000\n")
    assert host.control_group(str(tmp_path))["cpu_limit_cores"] is None
    assert host.machine()["logical"]


def test_progress_lines():
    lines, now = [], [0.0]
    p = Progress(100, lines.append, lambda: now[0])
    for k in range(4):
        now[0] += 1
        p.add(30, 5.0 + k)
    assert lines == ["requests=120 per_second=30 | batch p99=7.000ms"]
    p.add(70, 1.0)
    assert len(lines) == 1


def test_generated_vectors(spark):
    a = {r["qid"]: r["v"] for r in generate.vectors(spark, 300, seed=3).collect()}
    b = {r["qid"]: r["v"] for r in generate.vectors(spark, 300, seed=3).repartition(7).collect()}
    assert a == b and all(len(v) == 14 and 0 <= min(v) and max(v) <= 10_000 for v in a.values())
    assert abs(np.mean([x for v in a.values() for x in v]) - 5000) < 300


def test_evaluation_stats(spark, tmp_path):
    stats = {"total": 2, "fraud_count": 1, "legit_count": 1, "fraud_rate": 50.0, "legit_rate": 50.0, "edge_case_count": 0, "edge_case_rate": 0.0}
    (tmp_path / "e.json").write_text(json.dumps({"entries": [], "stats": stats}))
    assert readers.evaluation_stats(spark, str(tmp_path / "e.json")).first().asDict() == stats
    (tmp_path / "n.json").write_text(json.dumps({"entries": []}))
    assert readers.evaluation_stats(spark, str(tmp_path / "n.json")).count() == 0


def test_routes(spark):
    rows = [("POST", json.dumps(request(id="a"))), ("PUT", json.dumps(request(id="b"))), ("GET", ""), (None, "x")]
    scored, others = scoring.route(spark.createDataFrame(rows, "method string, body string"))
    assert {r["id"] for r in scored.collect()} == {"a", "b"}
    assert [r["body"] for r in others.collect()] == ["OK", "OK"]


def test_verdict(spark):
    row = {"n_fraud": 40, "n_legit": 60, "p99_ms": 0.15, "fp": 0, "fn": 0, "tp": 40, "tn": 60, "err": 0}
    got = json.loads(sinks.verdict(spark.createDataFrame([row])).first()["body"])
    assert got["scoring"]["final_score"] == 6000 and got["p99"] == "0.15ms" and got["scoring"]["failure_rate"] == "0.0%"
    bad = row | {"p99_ms": 2500.0, "fp": 30, "tn": 30}
    got = json.loads(sinks.verdict(spark.createDataFrame([bad])).first()["body"])["scoring"]
    assert got["p99_score"] == {"value": -3000.0, "cut_triggered": True} and got["final_score"] == -6000
    assert got["detection_score"] == {"value": -3000.0, "rate_component": None, "absolute_penalty": None, "cut_triggered": True}
    some = json.loads(sinks.verdict(spark.createDataFrame([row | {"fn": 2, "tp": 38}])).first()["body"])["scoring"]
    assert some["weighted_errors_E"] == 6 and some["detection_score"]["value"] == round(1000 * math.log10(1 / 0.06) - 300 * math.log10(7), 2)


def test_exposition(spark):
    rows = spark.createDataFrame([(1500,), (1700,), (900_000,)], "ns bigint")
    got = [r["value"] for r in sinks.exposition("x_ms", "about x", metrics.histogram(rows, "ns")).orderBy("part", "place").collect()]
    assert got[:4] == ["# HELP x_ms about x", "# TYPE x_ms histogram", 'x_ms_bucket{le="0.001"} 0', 'x_ms_bucket{le="0.002"} 2']
    assert got[-4:] == ['x_ms_bucket{le="0.600"} 3', 'x_ms_bucket{le="+Inf"} 3', "x_ms_sum 0.902000", "x_ms_count 3"]
    lines = sinks.sample_lines("c", "about", "counter", spark.createDataFrame([(1, 7), (0, 5)], "backend int, value int"), "backend")
    assert [r["value"] for r in lines.orderBy("part", "place").collect()][2:] == ['c{backend="0"} 5', 'c{backend="1"} 7']
    empty = sinks.exposition("y", "", metrics.histogram(rows.where("false"), "ns")).orderBy("part", "place").collect()
    assert empty[-1]["value"] == "y_count 0" and len(empty) == 605


def test_windowed_quantiles(spark):
    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") % 100).alias("ts"), (F.col("id") * 100).alias("ns"))
    got = {(r["start"].second, r["q"]): r["value_ms"] for r in scoring.windowed_quantiles(rows, "ts", "ns", "60 seconds", qs=(0.5, 1.0)).collect() if r["start"].minute == 0}
    # ten in each bucket whose last digit is below 6: the 300th of 600 ends bucket 45, the last one bucket 95
    assert abs(got[0, 0.5] - 0.046) < 1e-9 and abs(got[0, 1.0] - 0.096) < 1e-9
    over = spark.createDataFrame([(0, 10**9)], "s int, ns bigint").select(F.timestamp_seconds("s").alias("ts"), "ns")
    assert scoring.windowed_quantiles(over, "ts", "ns", "1 minute", qs=(0.5,)).first()["value_ms"] == 0.599
    ratio = scoring.windowed_ratio(rows, "ts", F.col("ns") % 200 == 0, "60 seconds").collect()
    assert all(r["ratio"] == 0.5 for r in ratio)


def test_stream_ratio_and_rate(spark, tmp_path):
    rows = spark.range(600).select(F.timestamp_seconds(F.col("id") % 100).alias("ts"), "id")
    rows.write.parquet(str(tmp_path / "in/a"))
    spark.sql("SELECT timestamp_seconds(100000) AS ts, 0L AS id").write.parquet(str(tmp_path / "in/b"))
    for name, f in (("rate", lambda d: scoring.windowed_rate(d, "ts", "20 seconds", "10 seconds", late="1 second")), ("ratio", lambda d: scoring.windowed_ratio(d, "ts", F.col("id") % 3 == 0, "20 seconds", "10 seconds", late="1 second"))):
        found = f(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*")))
        q = found.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).where(F.col("start") < F.timestamp_seconds(F.lit(5000)))
        batch = f(rows)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_polling_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(request(id="r")))
    refs, _ = points(spark, 100)
    c = kmeans.seeds(refs, 4)
    posts = index.assign(refs, c)
    boxes = index.boxes(posts, c, 14)
    got, before = [], list(storage._paths)
    work = lambda df: scoring.score(df, c, posts, boxes, SearchConfig(nprobe=1))
    q = scoring.start(scoring.read_requests(spark, str(tmp_path / "in")), work, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), every="100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in got] == ["r"] and storage._paths == before


def test_stream_against_all_pairs(spark, tmp_path):
    """Scores of a stream of requests whose every answer is repaired are those of all pairs of vectors."""
    bodies = [request(id=f"r{i}", transaction={"amount": float(53 * i % 9000), "installments": i % 12}, terminal={"km_from_home": 7.0 * i}) for i in range(40)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, bodies[k::2])))
    refs, v = points(spark, 250, seed=9)
    y = np.array([r["is_fraud"] for r in refs.orderBy("ref_id").collect()])
    c = kmeans.seeds(refs, 10)
    posts = index.assign(refs, c)
    boxes = index.boxes(posts, c, 14)
    work = lambda df: scoring.score(df, c, posts, boxes, SearchConfig(nprobe=1, repair_min=0, repair_max=5))
    got = {}
    q = scoring.start(scoring.read_requests(spark, str(tmp_path / "in"), 1), work, lambda df, n: got.update({r["id"]: r["fraud_count"] for r in df.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    from vicinity.functions import features

    asked = features.vectorise(spark.read.schema(schema.TRANSACTION).json(str(tmp_path / "in"))).select("id", "v").collect()
    assert len(got) == 40
    for r in asked:
        d = ((v - np.array(r["v"])) ** 2).sum(1)
        assert got[r["id"]] == y[np.lexsort((np.arange(len(v)), d))[:5]].sum()


def test_stepwise_is_the_sequential_rule(spark):
    refs, v = points(spark, 300, seed=4)
    y = {r["ref_id"]: r["is_fraud"] for r in refs.collect()}
    q = refs.where("ref_id < 60").select(F.col("ref_id").alias("qid"), "v")
    c = kmeans.seeds(refs, 12)
    posts = index.assign(refs, c)
    boxes = index.boxes(posts, c, 14)
    at = {}
    for r in posts.orderBy("dist_centroid", "ref_id").collect():
        at.setdefault(r["cluster_id"], []).append(r["ref_id"])
    box = {r["cluster_id"]: (np.array(r["mn"]), np.array(r["mx"])) for r in boxes.collect()}
    config = SearchConfig(nprobe=1, repair_min=2, repair_max=3)
    got = {r["qid"]: (r["fraud_count"], r["repaired"]) for r in search.search_stepwise(q, c, posts, boxes, config, other_than_self=True).collect()}
    exact = {r["qid"]: r["fraud_count"] for r in knn.fraud_counts(q, knn.top_k(q, refs, 5, other_than_self=True)).collect()}
    changed = 0
    for i in range(60):
        dist = ((v - v[i]) ** 2).sum(1)
        first = int(((c - v[i]) ** 2).sum(1).argmin())
        best = sorted((int(dist[j]), n, y[j]) for n, j in enumerate(at[first]) if j != i)[:5]
        count = before = sum(b[2] for b in best)
        repaired = 2 <= count <= 3
        if repaired:
            low = {k: int((np.maximum(0, np.maximum(a - v[i], v[i] - b)) ** 2).sum()) for k, (a, b) in box.items() if k != first and k in at}
            worst = best[-1][0] if len(best) == 5 else search.FAR
            for k in sorted((k for k in low if low[k] < worst), key=lambda k: (low[k], k)):
                if len(best) == 5 and low[k] >= best[-1][0]:
                    break
                best = sorted(best + [(int(dist[j]), 1000 + n, y[j]) for n, j in enumerate(at[k]) if j != i], key=lambda b: b[0])[:5]
                count = sum(b[2] for b in best)
                if not 2 <= count <= 3:
                    break
            else:
                assert count == exact[i]
        changed += count != before
        assert got[i] == (count, repaired)
    assert changed
    with pytest.raises(ValueError):
        search.search_stepwise(q, c, posts, boxes, SearchConfig(nprobe=13))


def test_many_configurations_at_once(spark):
    refs, _ = points(spark, 300, seed=6)
    q = refs.where("ref_id < 30").select(F.col("ref_id").alias("qid"), "v", "is_fraud")
    c = kmeans.seeds(refs, 8)
    posts = index.assign(refs, c)
    boxes = index.boxes(posts, c, 14)
    configs = [SearchConfig(nprobe=1, nprobe_border=3, repair_min=2, repair_max=3), SearchConfig(nprobe=2, repair_min=9, repair_max=9), SearchConfig(nprobe=8)]
    many = search.search_many(q, c, posts, boxes, configs, border=True, other_than_self=True).collect()
    for i, config in enumerate(configs):
        one = search.search(q, c, posts, boxes, config, border=True, other_than_self=True).collect()
        assert sorted(tuple(r)[1:] for r in many if r["slot"] == i) == sorted(map(tuple, one))
    expected = q.select("qid", (F.col("is_fraud") == 0).alias("expected_approved"))
    rows = evaluate.sweep(q, expected, c, posts, boxes, configs, border=True, other_than_self=True).collect()
    assert len(rows) == 3 and all(r["tp"] + r["tn"] + r["fp"] + r["fn"] == 30 for r in rows)
    none = q.where("false")
    assert search.search(none, c, posts, boxes, configs[0], border=True).count() == 0
    assert knn.distances(q, refs).count() == 30 * 299


def test_ties_and_common_vectors():
    """Many equal distances, references in any order, many blocks: the k nearest by distance, then id."""
    from vicinity.operators.vectors import Best, partial, prepared

    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (900, 4)).astype(float)
    v[::3] = 1
    q, ids, y = v[:70], rng.permutation(5000)[:900], rng.integers(0, 2, 900)
    asked, own = prepared(q)
    best = Best(70, 5)
    for at in range(0, 900, 130):
        part = np.arange(at, min(900, at + 130))
        part = part[np.argsort(ids[part])]
        for rows in (np.arange(0, 40), np.arange(40, 70)):
            d = partial(asked[rows], v[part])
            d[ids[rows][:, None] == ids[part][None, :]] = np.inf
            best.meet(rows, d, own[rows], ids[part], y[part])
    i, r, labels, d = best.found()
    for k in range(70):
        dist = ((v - q[k]) ** 2).sum(1).astype(int)
        want = sorted((int(dist[j]), int(ids[j]), int(y[j])) for j in range(900) if j != k)[:5]
        mine = i == k
        assert list(zip(d[mine].tolist(), r[mine].tolist(), labels[mine].tolist(), strict=True)) == want


def test_best_configuration(spark):
    rows = [(1, 0, 0, 1, 5), (2, 0, 0, 0, 9), (4, 12, 0, 0, 7), (8, 0, 0, 0, 7)]
    results = spark.createDataFrame(rows, "nprobe int, nprobe_border int, fp int, fn int, p99 int")
    assert tuple(evaluate.best_configuration(results).first()) == (4, 12, 7)
    assert evaluate.best_configuration(results.where("nprobe = 1")).count() == 0


def test_history_of_busy_and_sparse_customers(spark, tmp_path, monkeypatch):
    from vicinity.plans import tables

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 40 * 86_400)), float(rng.integers(0, 10_000)) / 100) for i in range(400)]
    rows += [(1000 + i, 9, 86_400 * i, 1.0) for i in (0, 1, 2, 7, 30)] + [(2000, 9, 0, 2.0)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    monkeypatch.setattr(tables, "table", lambda *a: df)
    got = {r["event_id"]: r for r in tables.history(spark, "").collect()}
    assert len(got) == len(rows)
    for i, u, s, _ in rows:
        mine = sorted((s2, i2, v) for i2, u2, s2, v in rows if u2 == u)
        earlier = [x for x in mine if x[:2] < (s, i)]
        assert got[i]["tx_24h"] == sum(s - 86_400 <= x[0] <= s for x in mine)
        assert (got[i]["last_ts"] is None) == (not earlier)
        if earlier:
            assert abs(got[i]["avg_before"] - sum(round(x[2] * 100) for x in earlier) / len(earlier) / 100) < 1e-9
            assert int(np.datetime64(got[i]["last_ts"], "s").astype(int)) == earlier[-1][0]


def test_storage(spark, tmp_path):
    with storage.scope(spark):
        df = storage.written(spark.range(3).toDF("x"), "three")
        assert df.count() == 3
        path = storage._paths[-1]
    assert path not in storage._paths and not __import__("os").path.exists(path.removeprefix("file:"))
    assert schema.DIMS == 14
