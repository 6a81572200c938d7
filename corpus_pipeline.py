"""Documents to training tokens: quality, exact and near duplicates, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the pipeline writes it as Parquet and
gives what it reads back to the next stage. All but the last return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns have the results that the operators
define: a null or empty text is scored like an empty line, equal texts leave one row, rows with a null id have no
near duplicates, repeated rows are drawn alike, a text without words has no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import bpe, exact_dedup, line_crf, mixing, near_dedup
from tremorframe.llm.common import read_table, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it is trained on the labelled ones of them."""
    return line_crf.keep_good(docs, line_crf.train(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs, near_dedup.near_duplicates(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their source's target share asks, in a random order."""
    return mixing.mix(docs).drop("_copy", "_order")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: token ids, and a digest of what they decode to."""
    rank_file, pattern = bpe.public_vocabulary()
    decoded = bpe.decode(bpe.encode(docs, rank_file, pattern), rank_file)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the classifier nor the merges; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
