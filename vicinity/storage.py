"""Intermediate tables in the folder that all machines of a session share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has handed out and not dropped, in order.
_paths: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines of the session share.

    The cluster names it in spark.checkpoint.dir. Only a local master, where there is one machine, may do without: a
    temporary folder is then made and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='vicinity-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost no rework."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes what was written to these paths, wherever the shared folder lies."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _paths:
            _paths.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drops what is written inside, once it isn't read any more: results must have been stored or collected by then."""
    n = len(_paths)
    try:
        yield
    finally:
        drop(spark, *_paths[n:])
