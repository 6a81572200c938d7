"""Small table operators around out-of-fold results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oof_with_truth(features: DataFrame, oof: DataFrame, window: str, prediction: str) -> DataFrame:
    """Out-of-fold rows of one window with their truth; quiet windows and empty predictions drop out."""
    target = f"target_{window}_max_mag"
    rows = oof.filter((F.col("window") == window) & F.col(prediction).isNotNull()).select("mainshock_id", prediction)
    truth = features.filter(F.col(target) > 0).select("mainshock_id", "mainshock_mag", F.col(target).alias("true_mag"))
    return truth.join(rows.withColumnRenamed(prediction, "pred_mag"), "mainshock_id")


def backfill(df: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Add the listed columns that ``df`` lacks and ``features`` has, by left join."""
    wanted = [c for c in columns if c not in df.columns and c in features.columns]
    return df.join(features.select("mainshock_id", *wanted), "mainshock_id", "left") if wanted else df


def earliest_rows(df: DataFrame, time: str, rows: int, tie: str) -> DataFrame:
    """The first rows by time, equal times by ``tie``, for smoke runs (a top-k, not a full sort)."""
    return df.orderBy(time, tie).limit(rows)
