"""A corpus pipeline: language, near duplicates, personal data, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written to the shared folder
before the next one reads it. All but the last return the columns of documents.

Defined cases: a null or empty text, or one without a letter, is rejected by the first stage; rows without a doc_id are
never taken for duplicates; rows that share a doc_id are told apart by their texts, and equal ones are one; an empty
table goes through as an empty table; columns other than those of documents are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinity.llm import byte_bpe, language_id, mixing, pii, simhash_dedup
from vicinity.llm.common import drop, scope, shared_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language that was learned, from every labelled text; the others carry the predicted language."""
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), sample_rows=None)
    found = language_id.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    good = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5))
    return good.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles are alike to 0.8, the one with the smallest doc_id stays.

    Rows are judged by their texts: of rows that share a doc_id, each whose text is its group's first stays, one row of
    it; rows without a doc_id all stay.
    """
    rows = docs.select(*COLUMNS)
    groups = written(simhash_dedup.near_duplicates(rows.where("doc_id IS NOT NULL"), shingle=5, similarity=0.8), "groups")
    first = groups.where("first").select("doc_id", "print")
    shared = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    shared = written(shared, "shared-ids")
    kept = rows.join(first.select("doc_id").join(shared, "doc_id", "left_anti"), "doc_id", "left_semi")
    if shared.limit(1).count():
        several = simhash_dedup.numbered(rows.join(shared, "doc_id", "left_semi"), shingle=5).join(first.distinct(), ["doc_id", "print"], "left_semi")
        turn = F.row_number().over(Window.partitionBy("doc_id", "print").orderBy("text", *[c for c in COLUMNS if c not in ("doc_id", "text")]))
        kept = kept.unionByName(several.withColumn("_turn", turn).where("_turn = 1").select(*COLUMNS))
    return kept.select(*COLUMNS).unionByName(rows.where("doc_id IS NULL"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, disguised or not, by its kind in angle brackets; every row stays, a null text as null."""
    found = pii.scan(docs.select(*COLUMNS), keep=COLUMNS)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rakes tokens to tempered shares of sources, languages and topics, and samples; no weight is above 2."""
    return mixing.weigh(docs, temper=0.9, most=2.0, carry=COLUMNS).where("kept").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to; a null text has no ids."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixture", mix_sources),
    ("token_ids", encode_tokens),
]
#: No stage but the last could be put in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage keeps in the shared folder is dropped when the next table
    has been written, and that table when the one after it has."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
