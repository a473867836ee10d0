"""Sinks: index folders, responses, reports and metrics in text form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.metrics import cumulative


def write_index(path: str, meta: dict, centroids: DataFrame, postings: DataFrame) -> None:
    """Postings are ranged and sorted by cluster and distance to its centroid, so that statistics of row groups prune
    by cluster without a folder for each; large clusters span files."""
    spark = centroids.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("cluster_id", "dist_centroid", "ref_id")
    postings.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    line = json.dumps({"magic": "VCX", "version": 1} | meta)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _header(spark: SparkSession, name: str, about: str, kind: str) -> DataFrame:
    lines = [(0, 0, f"# HELP {name} {about}"), (0, 1, f"# TYPE {name} {kind}")]
    return spark.createDataFrame(lines, "part int, place int, value string")


def exposition(name: str, about: str, histogram: DataFrame) -> DataFrame:
    """part, place, value: the lines of a histogram (bucket, n, sum_us) in text form, to be sorted by part and place:
    header, cumulative buckets with `le` in milliseconds, +Inf, sum in milliseconds and count."""
    buckets = cumulative(histogram).select(F.lit(1).alias("part"), F.col("bucket").alias("place"), F.format_string(f'{name}_bucket{{le="%.3f"}} %d', "le", "value").alias("value"))
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("sum_us"), F.lit(0)).alias("us"))
    last = F.array(F.format_string(f'{name}_bucket{{le="+Inf"}} %d', "n"), F.format_string(f"{name}_sum %.6f", F.col("us") / 1000), F.format_string(f"{name}_count %d", "n"))
    tail = total.select(F.lit(2).alias("part"), F.posexplode(last).alias("place", "value"))
    return _header(histogram.sparkSession, name, about, "histogram").unionByName(buckets).unionByName(tail)


def sample_lines(name: str, about: str, kind: str, rows: DataFrame, *labels: str) -> DataFrame:
    """part, place, value: the lines of a counter or gauge (labels and `value`, a row for each line)."""
    named = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    inner = F.concat(F.lit("{"), named, F.lit("}")) if labels else F.lit("")
    place = F.row_number().over(Window.orderBy(*labels)) if labels else F.lit(0)
    lines = rows.select(F.lit(1).alias("part"), place.alias("place"), F.concat(F.lit(name), inner, F.lit(" "), F.col("value").cast("string")).alias("value"))
    return _header(rows.sparkSession, name, about, kind).unionByName(lines)


def verdict(rows: DataFrame) -> DataFrame:
    """body: the verdict of a load test as JSON. rows: n_fraud, n_legit (what was expected), p99_ms, fp, fn, tp, tn, err."""
    c = F.col
    n = c("tp") + c("tn") + c("fp") + c("fn") + c("err")
    errors, failed = rules.weighted_errors(c("fp"), c("fn"), c("err")), c("fp") + c("fn") + c("err")
    rate, epsilon = F.try_divide(failed, n), F.try_divide(errors, n)
    over, slow = rate > 0.15, c("p99_ms") > 2000
    part = lambda x: F.when(~over, F.round(x, 2))
    p99, detection = rules.p99_score(c("p99_ms")), rules.detection_score(errors, failed, n)
    matrix = {"false_positive_detections": "fp", "false_negative_detections": "fn", "true_positive_detections": "tp", "true_negative_detections": "tn", "http_errors": "err"}
    scoring = F.struct(
        F.struct(*[c(v).alias(k) for k, v in matrix.items()]).alias("breakdown"), F.concat(F.round(rate * 100, 2).cast("string"), F.lit("%")).alias("failure_rate"),
        errors.alias("weighted_errors_E"), F.round(epsilon, 6).alias("error_rate_epsilon"), F.struct(F.round(p99, 2).alias("value"), slow.alias("cut_triggered")).alias("p99_score"),
        F.struct(
            F.round(detection, 2).alias("value"), part(1000 * F.log10(1 / F.greatest(epsilon, F.lit(0.001)))).alias("rate_component"),
            part(-300 * F.log10(1 + errors)).alias("absolute_penalty"), over.alias("cut_triggered"),
        ).alias("detection_score"),
        F.round(p99 + detection, 2).alias("final_score"),
    )
    expected = F.struct((c("n_fraud") + c("n_legit")).alias("total"), c("n_fraud").alias("fraud_count"), c("n_legit").alias("legit_count"))
    body = F.struct(expected.alias("expected"), F.format_string("%.2fms", c("p99_ms").cast("double")).alias("p99"), scoring.alias("scoring"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def markdown_report(rows: DataFrame, facts: dict[str, object]) -> str:
    """A report of a configuration sweep (a row for each configuration); the best row is bold."""
    got = sorted(rows.collect(), key=lambda r: (r["nprobe"], r["nprobe_border"]))
    clean = [r for r in got if r["fp"] == 0 and r["fn"] == 0]
    best = min(clean, key=lambda r: r["p99_us"], default=None)
    lines = ["# Evaluation", "", *(f"- {k}: {v}" for k, v in facts.items()), ""]
    names = ["nprobe", "nprobe_border", "avg_us", "p50_us", "p99_us", "max_us", "tp", "tn", "fp", "fn"]
    lines += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in got:
        cells = [f"{r[n]:.2f}" if isinstance(r[n], float) else str(r[n]) for n in names]
        lines.append("| " + " | ".join(f"**{c}**" if r is best else c for c in cells) + " |")
    top = max((r["p99_us"] for r in got), default=0) or 1
    lines += ["", "p99 by configuration", "", "```"]
    lines += [f"{r['nprobe']:>4}/{r['nprobe_border']:<4} {'#' * round(40 * r['p99_us'] / top)} {r['p99_us']:.2f}" for r in got]
    return "\n".join([*lines, "```", ""])
