"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one winner per digest, the
winners go through a sort-merge anti join with the index, and what is new is appended. The bucketed side of
that join is neither shuffled nor (while a bucket has one file) sorted, so the cost follows the batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import SPACE, read_table, shared_path, text_of
from tremorframe.session import durable

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, n_points BIGINT, group_size BIGINT"


def text_digest(column: str = "text"):
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(column), f"[{SPACE}]", ""), 256))


def open_index(spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 64) -> str:
    """Create the index table at ``path``, or attach the one that is there; returns the table's name.

    ``buckets`` is a property of the stored table: give the same number whenever a path is opened again.
    """
    name = name or f"digest_index_{uuid.uuid4().hex}"
    path = path or shared_path(spark, "digest-index")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_COLUMNS}) USING parquet "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def batch_winners(rows: DataFrame) -> DataFrame:
    """One row per digest: most code points, then smallest id; a null id loses against any other.

    The first aggregate has only fixed-width values and combines on the map side, so a digest that holds a
    third of all rows arrives at its reducer as a few rows per task.
    """
    by_length = rows.groupBy("digest", "n_points").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # ~id orders like -id but has no overflow
    return by_length.groupBy("digest").agg(
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rank"))).alias("best"), F.sum("n").alias("group_size"),
    ).select("digest", F.bitwise_not("best.rank").alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size")


def _property(spark: SparkSession, index: str, name: str) -> str:
    return next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index}").collect() if r.col_name == name)


def append_new(spark: SparkSession, winners: DataFrame, index: str) -> None:
    """Append the winners whose digest the index does not hold yet."""
    buckets = int(_property(spark, index, "Num Buckets"))
    fresh = winners.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
    # the same hash as the buckets: every bucket gets one file per append
    fresh = fresh.repartition(buckets, "digest").select("digest", "keep_id", "n_points", "group_size")
    fresh.write.insertInto(index)


def exact_dedup(docs: DataFrame, index: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after white space is deleted; a null text is empty. Of equal texts of one
    batch the longest (code points), then the smallest id stays; a text that the index already holds stays with
    the row that brought it. ``group_size`` counts the rows of the batch in which the digest was first seen.
    Repeated rows (same id, same text) all count and are all marked like their document; use
    ``keep_first`` to keep one of them. Null ids lose ties. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    index = index or open_index(spark)
    rows = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text_of()).cast("long").alias("n_points"),
        text_digest().alias("digest")))
    append_new(spark, batch_winners(rows), index)
    spark.catalog.refreshTable(index)
    # read without its buckets, the index is shuffled like the rows, and adaptive execution can split a hot digest
    known = spark.read.schema(INDEX_COLUMNS).parquet(_property(spark, index, "Location")).select("digest", "keep_id", "group_size")
    return rows.join(known, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per digest, with their own columns only."""
    names = docs.columns
    keep = decided.filter("kept").select(
        F.col("keep_id").alias("_keep_id"), F.unhex("text_sha256").alias("_keep_digest")).distinct()
    rows = docs.withColumn("_row_digest", text_digest())
    joined = rows.join(
        keep, F.col("_row_digest").eqNullSafe(F.col("_keep_digest")) & F.col("doc_id").eqNullSafe(F.col("_keep_id")), "inner")
    # only repeated rows meet here; the join has already put them into one partition
    return joined.dropDuplicates(["_keep_digest", "_keep_id"]).select(*names)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS kept,
       text_sha256
FROM rows
"""
