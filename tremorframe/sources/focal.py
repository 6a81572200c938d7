"""Focal-mechanism catalogs: CSV and five-line NDK records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.constants import FOCAL_NUMERIC
from tremorframe.functions.focal import catalog_fault_code
from tremorframe.sources.catalogs import parsed_time, read_csv
from tremorframe.sources.records import RANGE_BYTES, read_records

#: The first line of a record holds a date.
HEAD = r"\d{4}/\d{1,2}/\d{1,2}"

TENSOR = ("mrr", "mtt", "mpp", "mrt", "mrp", "mtp")
# Positions of the fields on the fifth line of a record.
AXES = {"plunge_T": 2, "trend_T": 3, "plunge_B": 5, "trend_B": 6, "plunge_P": 8, "trend_P": 9, "strike1": 11,
        "dip1": 12, "rake1": 13, "strike2": 14, "dip2": 15, "rake2": 16}


def read_focal(spark: SparkSession, path) -> DataFrame:
    raw = read_csv(spark, path)
    numbers = [c for c in ("latitude", "longitude", "depth", "mw", *FOCAL_NUMERIC) if c in raw.columns]
    kept = [c for c in ("fault_type", "event_name") if c in raw.columns]
    return raw.select(
        parsed_time(F.col("time")).alias("time"), *[F.col(c).try_cast("double").alias(c) for c in numbers], *kept
    ).dropna(subset=["time", "latitude", "longitude"])


def parse_ndk(texts: DataFrame) -> DataFrame:
    """Typed rows from NDK text (column ``value``), a record or a whole file per input row.

    A record starts at a line with a date and spans five lines; short or unreadable records
    are dropped.
    """
    lines = F.filter(
        F.split("value", "\r?\n"), lambda l: (F.trim(l) != "") & ~F.trim(l).startswith("#"))
    starts = texts.select(lines.alias("lines")).select("lines", F.posexplode("lines").alias("pos", "head")).filter(
        F.col("head").rlike(HEAD) & (F.col("pos") + 5 <= F.size("lines")))
    record = starts.select(*[
        F.split(F.trim(F.element_at("lines", F.col("pos") + i + 1)), r"\s+").alias(f"l{i}") for i in (0, 1, 3, 4)])

    def at(line: str, position: int) -> Column:
        return F.try_element_at(line, F.lit(position + 1)).try_cast("double")

    whole = F.size("l4") >= 17
    tensor = F.size("l3") >= 12
    power = F.when(tensor, F.pow(F.lit(10.0), at("l3", 0))).otherwise(F.lit(1.0))
    scalar = F.when(whole, at("l4", 10) * power)
    positive = F.when(scalar > 0, scalar)
    eig_t, eig_b = at("l4", 1), at("l4", 4)
    time = F.try_to_timestamp(F.concat_ws(" ", F.element_at("l0", 2), F.try_element_at("l0", F.lit(3))),
                              F.lit("y/M/d H:m:s[.S]"))
    out = record.filter(F.size("l0") >= 6).select(
        time.alias("time"), at("l0", 3).alias("latitude"), at("l0", 4).alias("longitude"), at("l0", 5).alias("depth"),
        (F.lit(2.0 / 3.0) * (F.log10(positive) - 16.1)).alias("mw"), positive.alias("scalar_moment"),
        *[F.when(tensor, at("l3", 1 + 2 * i) * power).alias(c) for i, c in enumerate(TENSOR)],
        F.coalesce(F.try_element_at("l1", F.lit(1)), F.lit("")).alias("event_name"),
        *[F.when(whole, at("l4", i)).alias(c) for c, i in AXES.items()],
        F.when(whole & (F.abs(eig_t) > 1e-30), -eig_b / F.abs(eig_t)).alias("f_clvd"))
    return out.dropna(subset=["time", "latitude", "longitude", "depth"]).withColumn(
        "fault_type", catalog_fault_code(F.col("rake1")))


def read_ndk(spark: SparkSession, path, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of NDK files; a file is read in ranges of bytes, so a large one is spread over tasks."""
    return parse_ndk(read_records(spark, path, HEAD, 5, range_bytes))


def distinct_events(focal: DataFrame) -> DataFrame:
    """One row per (time, place); the smallest name stays, so the result is reproducible."""
    rest = [c for c in focal.columns if c not in ("time", "latitude", "longitude")]
    order = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    best = focal.groupBy("time", "latitude", "longitude").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select("time", "latitude", "longitude", "r.*")
