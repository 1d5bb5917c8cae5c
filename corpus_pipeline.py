"""Document pipeline: quality, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs.

In every stage null and empty texts, very long ones, repeated rows and nulls in other
columns are rows like any others: null and empty texts have no words and go with the first
stage; exact repeats are one row after the second; no stage cuts a text.  Columns beside
those of documents are not carried.  An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import decontamination, near, quality, secrets, sentencepieces
from vigilake.llm.common import read_table, stage_folder
from vigilake.sources import folders

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word Jaccard similarity 0.8 or more: the smallest doc_id.

    Candidates come from SimHash bits through the Gray-order index; shingle sets decide.
    """
    return near.drop_near_duplicates(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a marker and n_chars counted again where that changed the text."""
    found = secrets.redact_secrets(secrets.scan_secrets(docs.select(*COLUMNS)))
    changed = F.size("secret_spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the checks of the encoding and without the text."""
    coded = sentencepieces.encode_pieces(docs.select(*COLUMNS), keep_text=False)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "n_differing", "decodes")


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark passages", drop_benchmark),
    ("secrets", redact_secrets),
    ("token ids", encode_pieces),
]

#: Components and label models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it, and removed once that one is written."""
    docs, folder = read_table(spark, sf_dir, "documents"), stage_folder(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            folders.remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
