"""Targets per forecast window and labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import AFTERSHOCK_RADIUS_KM, WINDOWS
from tremorframe.functions.windows import in_window, time_bucket
from tremorframe.operators.spatial_join import interval_pairs

KEYS = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"]


def window_targets(pairs: DataFrame) -> DataFrame:
    """``_mag_<window>``, ``_hours_<window>``: largest event per window and mainshock; ties go to the earliest.

    Both aggregates have fixed-width values, so pairs are hashed and combined on the map side, never sorted: first the
    earliest time per magnitude, then the largest magnitude.
    """
    hours = F.col("elapsed_hours")
    window = F.coalesce(*[F.when(in_window(hours, lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(WINDOWS.values())])
    earliest = pairs.select("mainshock_id", window.alias("_w"), "mag", hours.alias("_hours")).filter("_w IS NOT NULL AND mag IS NOT NULL") \
        .groupBy("mainshock_id", "_w", "mag").agg(F.min("_hours").alias("_hours"))
    out = []
    for i, w in enumerate(WINDOWS):
        mag = F.when(F.col("_w") == i, F.col("mag"))
        out += [F.max(mag).alias(f"_mag_{w}"), F.max_by("_hours", mag).alias(f"_hours_{w}")]
    return earliest.groupBy("mainshock_id").agg(*out)


def window_labels(main: DataFrame, events: DataFrame, radius_km: float = AFTERSHOCK_RADIUS_KM) -> DataFrame:
    """Mainshock table with targets; an empty window gives 0.0 at its midpoint and a false flag."""
    longest = max(hi for _, hi in WINDOWS.values())
    pairs = interval_pairs(main.select(*KEYS), events, after_seconds=longest * 3600.0, radius_km=radius_km)
    joined = main.join(window_targets(pairs), "mainshock_id", "left")
    out = [F.col(c) for c in main.columns]
    for w, (lo, hi) in WINDOWS.items():
        out += [
            F.coalesce(f"_mag_{w}", F.lit(0.0)).alias(f"target_{w}_max_mag"),
            F.coalesce(f"_hours_{w}", F.lit((lo + hi) / 2)).alias(f"target_{w}_time_to_max_hours"),
            F.col(f"_mag_{w}").isNotNull().alias(f"has_{w}_aftershock"),
        ]
    return joined.select(*out)


def single_horizon_labels(df: DataFrame) -> DataFrame:
    """Label of the 168 h window from the three windows."""
    options = F.array(*[
        F.struct(
            F.coalesce(F.col(f"target_{w}_max_mag"), F.lit(0.0)).alias("mag"),
            F.coalesce(F.col(f"target_{w}_time_to_max_hours"), F.lit(84.0)).alias("hours"),
        ) for w in WINDOWS
    ])
    best = F.array_max(F.transform(options, lambda o: o["mag"]))
    earliest = F.array_min(F.transform(F.filter(options, lambda o: o["mag"] == best), lambda o: o["hours"]))
    return (
        df.withColumn("target_H168_max_mag", best)
        .withColumn("target_H168_time_to_max_hours", F.when(best > 0, earliest).otherwise(F.lit(84.0)))
        .withColumn("has_H168_aftershock", best > 0)
    )


def long_windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per mainshock and window."""
    rows = F.array(*[
        F.struct(
            F.lit(w).alias("window"),
            F.col(f"target_{w}_max_mag").alias("true_mag"),
            F.col(f"target_{w}_time_to_max_hours").alias("true_hours"),
            F.col(f"has_{w}_aftershock").alias("has_aftershock"),
        ) for w in WINDOWS
    ])
    return df.select(*keep, F.explode(rows).alias("_w")).select(*keep, "_w.*")


def extreme_flag(mag: Column, main_mag: Column, margin: float = 1.2) -> Column:
    return (mag > 0) & (mag >= main_mag - margin)


def risk_flag(mag: Column, main_mag: Column) -> Column:
    """The wider risk label: within two units of the mainshock, or 6.5 and above."""
    return (mag >= main_mag - 2.0) | (mag >= 6.5)


def with_time_buckets(long_df: DataFrame) -> DataFrame:
    return long_df.withColumn("time_bucket", time_bucket(F.col("window"), F.col("true_hours")))


def positive_label(df: DataFrame) -> DataFrame:
    """``label`` for the gate: the flag where it exists, else whether a target exists."""
    if "has_target_aftershock" in df.columns:
        return df.withColumn("label", F.col("has_target_aftershock").cast("int"))
    return df.withColumn("label", F.col("target_max_mag").isNotNull().cast("int"))
