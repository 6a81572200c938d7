"""Prediction-line source, truth labels and out-of-fold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.functions.text import hours_between

TRUTH_SCHEMA = "mainshock_id string, window string, main_mag double, true_mag double, true_hours double"


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with file name and line number; files hold one or two lines each."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.csv").select(
        F.col("_metadata.file_name").alias("file_name"), "value")
    return files.select(
        "file_name", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("line_no", "line"))


def parse_prediction_lines(lines: DataFrame) -> DataFrame:
    """Predictions from lines; comments and lines with fewer than seven tokens are dropped.

    The window comes from the file kind and the line number, the id from the file name.
    """
    parts = F.split(F.trim("line"), r"\s+")
    token = F.regexp_extract("file_name", r"^(\d+)-T", 1)
    window = (
        F.when(F.col("file_name").endswith("-T1-T2.csv"), F.when(F.col("line_no") == 0, "T1").otherwise("T2"))
        .when(F.col("file_name").endswith("-T3.csv") & (F.col("line_no") == 0), "T3"))
    parsed = lines.filter(~F.col("line").startswith("#") & (F.size(parts) >= 7)).select(
        token.alias("mainshock_id"), window.alias("window"),
        F.try_element_at(parts, F.lit(4)).try_cast("double").alias("main_mag"),
        F.try_element_at(parts, F.lit(5)).try_cast("double").alias("pred_mag"),
        hours_between(F.element_at(parts, 1), F.element_at(parts, -1)).alias("pred_hours"))
    return parsed.dropna(subset=["window", "pred_mag", "pred_hours"])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path)
    fields = [f.split() for f in TRUTH_SCHEMA.split(", ")]
    return header.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in fields])


def oof_columns(model: str) -> list[str]:
    return [f"{model}_pred_mag", f"{model}_pred_time"]


def read_oof(spark: SparkSession, path: str, model: str) -> DataFrame:
    """One model's out-of-fold table; raises before any job when a column is absent."""
    df = spark.read.parquet(path)
    needed = ["mainshock_id", "target_max_mag", "target_time_to_max_days", *oof_columns(model)]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{model}: missing columns {missing}")
    return df


def merge_oof(tables: dict[str, DataFrame]) -> DataFrame:
    """Inner join of the models' tables, one row per id on each side, rows with nulls dropped."""
    keys = ["mainshock_id", "mainshock_time"]
    if any("mainshock_time" not in t.columns for t in tables.values()):
        keys = ["mainshock_id"]
    merged = None
    for model, table in tables.items():
        if not table.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{model}: more than one row per {keys}")
        if merged is None:
            merged = table.select(*keys, "target_max_mag", "target_time_to_max_days", *oof_columns(model))
        else:
            merged = merged.join(table.select(*keys, *oof_columns(model)), keys)
    return merged.dropna()
