"""Sources: labelled references, transactions, evaluation sets, index folders; malformed rows are split off."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.features import quantise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, path: str, dims: int = schema.DIMS, *, lines: bool = False) -> DataFrame:
    """ref_id, v, is_fraud from a JSON array (also .gz), or with `lines` from a file or folder of one object a line,
    which many tasks can read at once. Rows with fewer than `dims` numbers or without a label are skipped, further
    numbers ignored. Ids follow the file's order."""
    raw = spark.read.schema(schema.REFERENCE).option("multiLine", not lines).json(path)
    good = raw.where((F.size("vector") >= dims) & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    return good.select(
        F.monotonically_increasing_id().alias("ref_id"),
        quantise(F.slice("vector", 1, dims)).alias("v"),
        F.col("label").startswith("fraud").cast("int").alias("is_fraud"),
    )


def transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRANSACTION).option("multiLine", True).json(path)


def parse_transactions(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Adds the fields of a JSON request; keys may come in any order and unknown ones are ignored."""
    return bodies.select("*", F.from_json(column, schema.TRANSACTION).alias("_r")).select("*", "_r.*").drop("_r")


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be scored, and those that are rejected: no time or no merchant."""
    ok = F.col("transaction.requested_at").isNotNull() & F.col("merchant.id").isNotNull()
    return requests.where(ok), requests.where(~F.coalesce(ok, F.lit(False)))


def evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Requests with expected_approved, from a file with an `entries` array; incomplete entries are skipped."""
    raw = spark.read.schema(schema.EVALUATION).option("multiLine", True).json(path)
    rows = raw.select(F.explode("entries").alias("e")).where("e.request IS NOT NULL AND e.expected_approved IS NOT NULL")
    return rows.select("e.request.*", "e.expected_approved")


def evaluation_stats(spark: SparkSession, path: str) -> DataFrame:
    """What an evaluation file says about itself: total, counts and rates of frauds, legitimate rows and edge cases."""
    return spark.read.schema(schema.STATS).option("multiLine", True).json(path).where("stats IS NOT NULL").select("stats.*")


def index(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(meta, centroids, postings) of an index folder, after checking what it says about itself."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("magic") != "VCX" or meta.get("version") != 1:
        raise ValueError(f"not an index of this version: {meta}")
    centroids = spark.read.schema(schema.CENTROIDS).parquet(f"{path}/centroids")
    if centroids.count() != meta["k"] or centroids.where(F.size("qc") != meta["dims"]).count():
        raise ValueError("the centroids don't match the index")
    return meta, centroids, spark.read.schema(schema.POSTINGS).parquet(f"{path}/postings")
