"""Prediction lines as partitioned text, their manifest and their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.text import prediction_line, token


def prediction_rows(df: DataFrame, mag_type: str = "Ms") -> DataFrame:
    """Lines with their file kind and line number. Input: mainshock columns, window, pred_mag, pred_hours."""
    kind = F.when(F.col("window").isin("T1", "T2"), "T1-T2").when(F.col("window") == "T3", "T3").otherwise("H168")
    line = prediction_line(F.col("mainshock_time"), F.col("mainshock_lon"), F.col("mainshock_lat"),
                           F.col("mainshock_mag"), F.col("window"), F.col("pred_mag"), F.col("pred_hours"), mag_type)
    return df.select(
        token(F.col("mainshock_time")).alias("token"), kind.alias("file_kind"), "window",
        F.when(F.col("window") == "T2", 1).otherwise(0).alias("line_no"), line.alias("line"))


def write_prediction_files(rows: DataFrame, path: str) -> None:
    """One folder per mainshock and file kind, lines in window order inside it."""
    (rows.repartition("token", "file_kind").sortWithinPartitions("token", "file_kind", "line_no")
     .select("token", "file_kind", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("token", "file_kind").text(path))


def write_single_horizon(rows: DataFrame, path: str) -> None:
    rows.orderBy("token").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def file_names(rows: DataFrame) -> DataFrame:
    """The name each line's file carries when files are laid out flat."""
    return rows.withColumn("file_name", F.concat(F.col("token"), F.lit("-"), F.col("file_kind"), F.lit(".csv")))


def contract_violations(rows: DataFrame) -> DataFrame:
    """Tokens whose files miss a kind or hold the wrong number of lines (T1-T2: 2, T3: 1)."""
    counts = rows.groupBy("token").agg(
        F.count_if(F.col("file_kind") == "T1-T2").alias("t1t2_lines"),
        F.count_if(F.col("file_kind") == "T3").alias("t3_lines"))
    return counts.filter((F.col("t1t2_lines") != 2) | (F.col("t3_lines") != 1))


def manifest(rows: DataFrame, source: str = "source") -> DataFrame:
    """Sequences and lines per source."""
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("predictions"), F.countDistinct("mainshock_id").alias("sequences"))


def submission(df: DataFrame) -> DataFrame:
    return df.select("mainshock_id", F.col("pred_mag").alias("predicted_max_mag"),
                     F.col("pred_time").alias("predicted_time_to_max"))


def write_table(df: DataFrame, path: str, year_from: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by year when a time column is given.

    Range partitioning on (year, time) gives a task few years and spreads a heavy year over several.
    """
    if year_from:
        (df.withColumn("year", F.year(year_from)).repartitionByRange("year", year_from)
         .write.mode(mode).partitionBy("year").parquet(path))
    else:
        df.write.mode(mode).parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    df.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
