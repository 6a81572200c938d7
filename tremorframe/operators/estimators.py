"""Grouped seismology estimators over mainshock-event pairs.

Every estimator is built from partial aggregates (counts, sums, moments, small histograms),
so map-side combine shrinks the pairs before the shuffle and no sequence is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import BIN_HOURS
from tremorframe.functions.geo import east_km, north_km
from tremorframe.functions.seismic import bath_deficit, bath_early_max, mag_bin, moment, productivity


def early_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("mainshock_id").agg(
        F.count(F.lit(1)).alias("early_aftershock_count"),
        F.max("mag").alias("early_max_mag"),
        F.avg("mag").alias("early_mean_mag"),
        F.sum(moment(F.col("mag"))).alias("early_energy_sum"),
    )


def bin_aggregates() -> list:
    out = []
    for h in BIN_HOURS:
        inside = (F.col("elapsed_hours") > 0) & (F.col("elapsed_hours") <= h)
        out.append(F.count_if(inside).alias(f"count_{h}h"))
        out.append(F.sum(F.when(inside, moment(F.col("mag"))).otherwise(0.0)).alias(f"energy_{h}h"))
    return out


def time_bins(pairs: DataFrame) -> DataFrame:
    """Cumulative counts and moments per time bin."""
    return pairs.groupBy("mainshock_id").agg(*bin_aggregates())


def sub_windows(df: DataFrame) -> DataFrame:
    """Interval counts, early/late ratios and gradients from the cumulative bins."""
    c12, c24, c72 = (F.col(f"count_{h}h") for h in (12, 24, 72))
    e12, e24, e72 = (F.col(f"energy_{h}h") for h in (12, 24, 72))
    late_c = F.greatest(F.lit(0), c72 - c24)
    late_e = F.greatest(F.lit(0.0), e72 - e24)
    return df.withColumns({
        "count_0_12h": c12,
        "count_12_24h": F.greatest(F.lit(0), c24 - c12),
        "count_24_72h": late_c,
        "energy_0_12h": e12,
        "energy_12_24h": F.greatest(F.lit(0.0), e24 - e12),
        "energy_24_72h": late_e,
        "decay_count_ratio_early_late": c12 / F.greatest(c24 - c12, F.lit(1)),
        "decay_energy_ratio_early_late": e12 / F.greatest(e24 - e12, F.lit(1e-10)),
        "decay_count_gradient": (c12 - late_c) / F.greatest(c72, F.lit(1)),
        "decay_energy_gradient": (e12 - late_e) / F.greatest(e72, F.lit(1e-10)),
    })


def _mag_histogram(pairs: DataFrame, width: float) -> DataFrame:
    """Per sequence and magnitude bin: all events, and those not below the bin centre."""
    binned = pairs.filter(F.col("mag").isNotNull()).withColumn("_bin", mag_bin(F.col("mag"), width))
    full = F.col("mag") >= F.col("_bin")
    return binned.groupBy("mainshock_id", "_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("mag").alias("_s"),
        F.count_if(full).alias("_n_full"),
        F.sum(F.when(full, F.col("mag")).otherwise(0.0)).alias("_s_full"),
    )


def completeness_magnitude(pairs: DataFrame, width: float = 0.1) -> DataFrame:
    """Maximum-curvature Mc: the modal bin, the smallest one on ties."""
    return (
        _mag_histogram(pairs, width).groupBy("mainshock_id")
        .agg(F.min_by("_bin", F.struct(-F.col("_n"), F.col("_bin"))).alias("gr_mc"), F.sum("_n").alias("n_events"))
    )


def gutenberg_richter(pairs: DataFrame, width: float = 0.1, min_events: int = 5,
                      fixed_mc: float | None = None) -> DataFrame:
    """Aki-Utsu b value per sequence.

    The histogram (about a hundred rows per sequence) replaces the events after the first
    shuffle; Mc, the complete count and the complete mean all come from it. Rows whose bin
    is the Mc bin but whose magnitude is below Mc are left out.
    """
    if fixed_mc is None:
        bins = _mag_histogram(pairs, width)
        per_sequence = bins.groupBy("mainshock_id").agg(
            F.min_by("_bin", F.struct(-F.col("_n"), F.col("_bin"))).alias("mc"),
            F.sum("_n").alias("total"),
            F.collect_list(F.struct("_bin", "_n", "_s", "_n_full", "_s_full")).alias("bins"),
        )
        above = F.filter("bins", lambda b: b["_bin"] > F.col("mc"))
        at = F.filter("bins", lambda b: b["_bin"] == F.col("mc"))
        n = F.aggregate(above, F.lit(0).cast("bigint"), lambda a, b: a + b["_n"]) + at[0]["_n_full"]
        ordered = F.array_sort(F.transform(above, lambda b: b["_s"]))
        s = F.aggregate(ordered, at[0]["_s_full"], lambda a, b: a + b)
        base = per_sequence.select("mainshock_id", "mc", "total", n.alias("n"), s.alias("s"))
    else:
        full = F.col("mag") >= fixed_mc
        base = pairs.filter(F.col("mag").isNotNull()).groupBy("mainshock_id").agg(
            F.lit(fixed_mc).alias("mc"), F.count(F.lit(1)).alias("total"),
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("mag")).otherwise(0.0)).alias("s"))
    enough = F.col("total") >= min_events
    spread = F.col("s") / F.col("n") - (F.col("mc") - width / 2)
    usable = enough & (F.col("n") >= min_events) & (spread > 0)
    b = F.when(usable, F.lit(math.log10(math.e)) / spread)
    return base.select(
        "mainshock_id",
        b.alias("gr_b_value"),
        F.when(usable, F.log10(F.col("n").cast("double")) + b * F.col("mc")).alias("gr_a_value"),
        F.when(enough, F.col("mc")).alias("gr_mc"),
        F.when(enough, F.col("n")).otherwise(F.col("total")).alias("gr_n"),
        F.coalesce(usable, F.lit(False)).alias("gr_valid"),
    )


def axis_aggregates() -> list:
    x = east_km(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("longitude"))
    y = north_km(F.col("mainshock_lat"), F.col("latitude"))
    return [F.var_samp(x).alias("_a"), F.var_samp(y).alias("_d"), F.covar_samp(x, y).alias("_b"),
            F.count(F.lit(1)).alias("_n")]


def axis_columns(min_events: int = 3, ratio_epsilon: float = 1e-9) -> list:
    """Axes of the 2 x 2 sample covariance in closed form."""
    a, b, d = F.col("_a"), F.col("_b"), F.col("_d")
    middle, half = (a + d) / 2, (a - d) / 2
    spread = F.sqrt(half * half + b * b)
    valid = F.col("_n") >= min_events
    major = F.sqrt(F.greatest(middle + spread, F.lit(0.0)))
    minor = F.sqrt(F.greatest(middle - spread, F.lit(0.0)))
    azimuth = F.pmod(F.degrees(F.atan2(2 * b, d - a)) / 2 + 180.0, F.lit(180.0))
    return [
        F.when(valid, major).alias("anisotropy_major_axis_km"),
        F.when(valid, minor).alias("anisotropy_minor_axis_km"),
        F.when(valid, major / F.greatest(minor, F.lit(ratio_epsilon))).alias("anisotropy_axis_ratio"),
        F.when(valid, azimuth).alias("anisotropy_azimuth_deg"),
        F.col("_n").alias("anisotropy_n"),
        valid.alias("anisotropy_valid"),
    ]


def anisotropy(pairs: DataFrame, min_events: int = 3, ratio_epsilon: float = 1e-9) -> DataFrame:
    return pairs.groupBy("mainshock_id").agg(*axis_aggregates()).select(
        "mainshock_id", *axis_columns(min_events, ratio_epsilon))


def one_pass_summary(pairs: DataFrame) -> DataFrame:
    """Early statistics, time bins and axes from a single aggregation."""
    stats = [
        F.count(F.lit(1)).alias("early_aftershock_count"), F.max("mag").alias("early_max_mag"),
        F.avg("mag").alias("early_mean_mag"), F.sum(moment(F.col("mag"))).alias("early_energy_sum"),
    ]
    grouped = pairs.groupBy("mainshock_id").agg(*stats, *bin_aggregates(), *axis_aggregates())
    kept = [c for c in grouped.columns if not c.startswith("_")]
    return grouped.select(*kept, *axis_columns())


def bath_features(df: DataFrame) -> DataFrame:
    main, early = F.col("mainshock_mag"), F.col("early_max_mag")
    return df.withColumns({
        "bath_deficit": bath_deficit(main, early),
        "bath_early_max_mag": bath_early_max(early),
        "bath_valid": F.coalesce(early > 0, F.lit(False)),
    })


def productivity_index(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "productivity_index", productivity(F.col("gr_a_value"), F.col("gr_b_value"), F.col("mainshock_mag")))
