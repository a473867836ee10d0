"""Builds index folders: python -m vicinity.build REFERENCES INDEX [k] [sample] [iterations] [EDGE_INDEX] [edge k] [--lines]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions.rules import edge_case
from .operators import index
from .sources import readers


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m vicinity.build", description="Builds an index of labelled references.")
    p.add_argument("references", help="JSON array of vectors and labels, plain or .gz")
    p.add_argument("index", help="folder to write")
    p.add_argument("k", nargs="?", type=int, default=4096, help="clusters")
    p.add_argument("sample", nargs="?", type=int, default=200_000, help="rows that clusters are fitted on")
    p.add_argument("iterations", nargs="?", type=int, default=1000, help="at most so many rounds")
    p.add_argument("edge_index", nargs="?", help="folder for an index of the edge cases alone")
    p.add_argument("edge_k", nargs="?", type=int, default=256, help="its clusters")
    p.add_argument("--lines", action="store_true", help="the references are JSON lines, which many tasks can read at once")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Builds what is asked for and returns the meta data by folder."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    refs = readers.references(spark, a.references, lines=a.lines)
    options = {"sample_rows": a.sample, "iterations": a.iterations}
    out = {a.index: index.build(refs, a.index, a.k, **options)}
    if a.edge_index:
        out[a.edge_index] = index.build(refs.where(edge_case(refs["v"])), a.edge_index, a.edge_k, **options)
    return out


if __name__ == "__main__":
    print(json.dumps(main(), indent=2))
