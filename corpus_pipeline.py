"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All
but the last return the columns of documents, so a stage can be left out or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm import bpe, common, decontaminate, langid, minhash, secrets
from gradeloom.session import expose_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text of a learned language; lang is set to the language found where it is null.

    A filter is learned from the labelled documents. ``und`` and texts of which less than a tenth
    is known n-grams go; without any labelled document only texts without a letter do.
    """
    expose_package(spark)
    model = langid.train(langid.training_rows(docs))
    return langid.keep_known(docs.select(COLUMNS), model, label="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; of its rows the first by text."""
    expose_package(spark)
    found = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.select(COLUMNS).join(found, "doc_id", "left_anti")
    # rows of one id follow each other here already; those without an id are told apart by their texts' digest
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce(F.sha2("text", 256), F.lit("null")))).orderBy("text", "lang", "source", "n_chars")
    return left.withColumn("place", F.row_number().over(same)).where("place = 1").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    expose_package(spark)
    return decontaminate.clean(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew. Endpoints and logins stay."""
    clean = secrets.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256 of every document, and round_trip: whether the ids decode to its text."""
    expose_package(spark)
    return bpe.encode(docs, keep=("lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256", "round_trip"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, lang, source, n_tokens, ids, decoded_sha256, round_trip."""
    docs = common.table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return common.shared_table(STAGES[-1][1](spark, docs, sf_dir), "tokens")
