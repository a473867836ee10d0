"""Streaming: requests are scored in micro-batches; rates and quantiles over time windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schema
from ..config import NormConfig, SearchConfig
from ..functions.features import vectorise
from ..functions.rules import approved, fraud_score, response
from ..operators import dealt, metrics
from ..sources.readers import parse_transactions
from ..storage import scope, written


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines of requests that arrive as files in a folder."""
    return spark.readStream.schema(schema.TRANSACTION).option("maxFilesPerTrigger", files_per_batch).json(path)


def score(requests: DataFrame, centroids: np.ndarray, postings: DataFrame, boxes: DataFrame, config: SearchConfig, norm: NormConfig | None = None) -> DataFrame:
    """id, fraud_count, fraud_score, approved, body for a batch of requests; rejected ones have only an id. Requests of one
    vector are searched for once."""
    read = written(vectorise(requests, norm).select("id", "v"), "requests")
    rows, bad = read.where("v IS NOT NULL"), read.where("v IS NULL")  # rejected ones have none
    got = dealt.fraud_counts(rows.select(F.col("id").alias("qid"), "v"), centroids, postings, boxes, config, border=True)
    n = F.col("fraud_count")
    scored = got.select(F.col("qid").alias("id"), n, fraud_score(n).alias("fraud_score"), approved(n).alias("approved"), response(n).alias("body"))
    return scored.unionByName(bad.select("id"), allowMissingColumns=True)


def route(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of method and body: those to be scored, parsed (any method that starts with P, whatever the path), and the
    responses (body `OK`) of all others."""
    scored = F.coalesce(F.col("method").startswith("P"), F.lit(False))
    return parse_transactions(requests.where(scored)), requests.where(~scored).select("method", F.lit("OK").alias("body"))


def start(requests: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Runs work on each micro-batch: the search ranks within a query, which streams allow only inside a batch.

    every: an interval, such as "1 second", at which new requests are looked for; without it what is there is worked
    through and the stream ends. What work keeps in the shared folder is dropped after the sink has stored the batch.
    """

    def batch(df: DataFrame, n: int) -> None:
        with scope(df.sparkSession):
            sink(work(df), n)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()


def ramp(spark: SparkSession, peak: int = 900, seconds: int = 120) -> DataFrame:
    """timestamp, value: a load that rises from nothing to `peak` rows a second, for soak tests."""
    return spark.readStream.format("rate").option("rowsPerSecond", peak).option("rampUpTime", f"{seconds}s").load()


def windowed_rate(rows: DataFrame, ts: str, length: str, slide: str, late: str | None = None) -> DataFrame:
    """start, n, per_second of sliding windows; with `late`, a watermark for use on streams."""
    src = rows.withWatermark(ts, late) if late else rows
    w = src.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return w.select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def windowed_ratio(rows: DataFrame, ts: str, condition: Column, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, ratio: the rate of rows that meet the condition over the rate of all rows."""
    src = rows.withWatermark(ts, late) if late else rows
    w = src.groupBy(F.window(ts, length, slide).alias("w")).agg((F.count_if(condition) / F.count("*")).alias("ratio"))
    return w.select(F.col("w.start").alias("start"), "ratio")


def windowed_histogram(rows: DataFrame, ts: str, nanos: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, bucket, n: what quantiles over time are made of."""
    return _histogram(rows, ts, nanos, length, slide, late).select(F.col("w.start").alias("start"), "bucket", "n")


def _histogram(rows: DataFrame, ts: str, nanos: str, length: str, slide: str | None, late: str | None) -> DataFrame:
    src = rows.withWatermark(ts, late) if late else rows
    return src.groupBy(F.window(ts, length, slide).alias("w"), metrics.bucket_of(F.col(nanos)).alias("bucket")).agg(F.count("*").alias("n"))


def windowed_quantiles(rows: DataFrame, ts: str, nanos: str, length: str, slide: str | None = None, late: str | None = None, qs: tuple[float, ...] = (0.5, 0.99, 0.999)) -> DataFrame:
    """start, q, value_ms: quantiles of the windows' histograms, linear within a bucket; the last bucket, which has no
    upper end, gives its lower end. With `late` also on streams, in append mode: a window comes out once the watermark
    has passed it. State is a row for each open window and bucket."""
    per = _histogram(rows, ts, nanos, length, slide, late).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])

    def value(q: float) -> Column:
        rank = F.lit(q) * F.col("total")
        start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("value"))
        inside = lambda s, x: x["bucket"] / 1000 + (rank - s["upto"]) / x["n"] / 1000
        here = lambda s, x: F.when(x["bucket"] == metrics.BUCKETS - 1, F.lit((metrics.BUCKETS - 1) / 1000)).otherwise(inside(s, x))
        step = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.when(s["value"].isNull() & (s["upto"] + x["n"] >= rank), here(s, x)).otherwise(s["value"]).alias("value"))
        return F.aggregate("h", start, step, lambda s: s["value"])

    each = F.array(*[F.struct(F.lit(q).alias("q"), value(q).alias("value_ms")) for q in qs])
    return per.withColumn("total", total.cast("double")).select(F.col("w.start").alias("start"), F.explode(each).alias("x")).select("start", "x.q", "x.value_ms")
