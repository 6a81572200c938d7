"""Feature table: assembly, leak-safe window views, derived columns, column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorframe.constants import (
    AFTERSHOCK_RADIUS_KM, BIN_HOURS, META_COLUMNS, OBSERVATION_DAYS, OBSERVATION_PREFIXES, OBSERVED_HOURS,
    STATIC_COLUMNS, STATIC_PREFIXES, WINDOW_FLAGS, WINDOW_TARGETS,
)
from tremorframe.operators import estimators as est
from tremorframe.operators import rates
from tremorframe.operators.spatial_join import live_pairs
from tremorframe.session import durable

# Columns with a numeric type that are never model inputs.
NOT_FEATURES = (
    "mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "nearest_plate_boundary_type",
    "has_target_aftershock", "target_max_mag", "target_time_to_max_days",
)
# Single columns that are model inputs beside the prefixes.
NAMED_FEATURES = tuple(c for c in STATIC_COLUMNS) + ("advanced_early_event_count",)
FEATURE_PREFIXES = STATIC_PREFIXES + OBSERVATION_PREFIXES
# Columns an inference table may carry beside the training columns.
CARRIED = (
    "mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "target_max_mag",
    "target_time_to_max_days", "nearest_plate_boundary_type", "fault_type",
)


def sequence_features(main: DataFrame, events: DataFrame, obs_days: float = OBSERVATION_DAYS,
                      radius_km: float = AFTERSHOCK_RADIUS_KM, with_rates: bool = True) -> DataFrame:
    """One feature row per mainshock from its observed events.

    Every estimator meets the pairs anew (``live_pairs``); what is written is a row per sequence.
    """
    keys = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"]
    with live_pairs(main.select(*keys), events.select("time", "latitude", "longitude", "mag"), after_seconds=obs_days * 86400.0,
                    radius_km=radius_km) as pairs:
        summary, gr = durable(est.one_pass_summary(pairs())), durable(est.gutenberg_richter(pairs()))
        out = main.join(summary, "mainshock_id", "left").join(gr, "mainshock_id", "left")
        if with_rates:
            omori = durable(rates.omori_fit(pairs, obs_days))
            etas = rates.etas_fit(pairs, main, omori, gr, obs_days).drop("etas_amplitude")
            out = out.join(omori, "mainshock_id", "left").join(etas, "mainshock_id", "left")
    zero = {c: 0 for c in out.columns
            if c.startswith(("count_", "energy_", "early_")) or c in ("gr_n", "omori_n", "anisotropy_n", "etas_n")}
    flags = {c: False for c in out.columns if c.endswith("_valid") or c.endswith("_hit")}
    out = est.bath_features(out).fillna({**zero, **flags})
    out = est.productivity_index(est.sub_windows(out))
    return out.withColumn("advanced_early_event_count", F.col("early_aftershock_count"))


def legal_columns(columns: list[str], window: str) -> list[str]:
    """Columns a window may see: static ones, then what its observation period allows."""
    hours = OBSERVED_HOURS[window]
    allowed = {*META_COLUMNS, *WINDOW_TARGETS, *WINDOW_FLAGS, *STATIC_COLUMNS}
    if window == "H168":
        allowed |= {"target_H168_max_mag", "target_H168_time_to_max_hours", "has_H168_aftershock"}
    prefixes = STATIC_PREFIXES + (OBSERVATION_PREFIXES if hours >= 72 else ())
    if 24 <= hours < 72:
        allowed |= {f"{kind}_{h}h" for kind in ("count", "energy") for h in BIN_HOURS if h <= hours}
    return [c for c in columns if c in allowed or c.startswith(prefixes)]


def legal_features(df: DataFrame, window: str) -> DataFrame:
    """Leak-safe view of the feature table for one window."""
    kept = df.select(*legal_columns(df.columns, window))
    hours = OBSERVED_HOURS[window]
    if hours == 0:
        return kept.withColumns({"count_obs_0h": F.lit(0.0), "energy_obs_0h": F.lit(0.0)})

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    tiny = F.lit(1e-10)
    one = F.lit(1.0)
    count, energy = value(f"count_{hours}h"), value(f"energy_{hours}h")
    made = {
        "early_aftershock_count": count, "advanced_early_event_count": count, "early_energy_sum": energy,
        f"count_obs_{hours}h": count, f"energy_obs_{hours}h": energy,
        "energy_per_event": energy / F.greatest(count, one),
        "log_energy_sum": F.log1p(F.greatest(energy, F.lit(0.0))),
    }
    for h in (h for h in BIN_HOURS if h <= hours):
        if f"count_{h}h" in df.columns:
            made[f"count_ratio_{h}h_obs"] = value(f"count_{h}h") / F.greatest(count, one)
            made[f"count_rate_{h}h"] = value(f"count_{h}h") / float(h)
        if f"energy_{h}h" in df.columns:
            made[f"energy_ratio_{h}h_obs"] = value(f"energy_{h}h") / F.greatest(energy, tiny)
            made[f"energy_rate_{h}h"] = value(f"energy_{h}h") / float(h)
    for kind, floor in (("count", one), ("energy", tiny)):
        if {f"{kind}_12h", f"{kind}_24h"} <= set(df.columns):
            first, day = value(f"{kind}_12h"), value(f"{kind}_24h")
            second = F.greatest(day - first, F.lit(0.0))
            made[f"{kind}_0_12h"] = first
            made[f"{kind}_12_24h"] = second
            made[f"decay_{kind}_gradient"] = (first - second) / F.greatest(day, floor)
    if "mainshock_mag" in df.columns:
        per = F.greatest(F.col("mainshock_mag").cast("double"), one)
        made["obs_count_per_main_mag"] = count / per
        made["obs_energy_per_main_mag"] = energy / per
    # Evaluated against the source table, so an overwritten column never feeds another one.
    names = [c for c in kept.columns if c not in made]
    return df.select(*names, *[expr.alias(name) for name, expr in made.items()])


def derived_features(df: DataFrame) -> DataFrame:
    """Interaction columns; each group is added when its inputs exist."""
    have = set(df.columns)
    one, tiny, micro = F.lit(1.0), F.lit(1e-10), F.lit(1e-6)
    made: dict[str, Column] = {}

    def has(*names: str) -> bool:
        return set(names) <= have

    def c(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(0.0)

    def z(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0.0))

    if has("mainshock_mag", "early_max_mag"):
        made["mag_ratio_early_main"] = c("early_max_mag") / F.greatest(c("mainshock_mag"), one)
        made["mag_diff_main_early"] = c("mainshock_mag") - c("early_max_mag")
    if has("early_energy_sum", "early_aftershock_count"):
        made["energy_per_event"] = c("early_energy_sum") / F.greatest(c("early_aftershock_count"), one)
        made["log_energy_sum"] = F.log1p(c("early_energy_sum"))
    if has("count_1h", "count_72h"):
        for h in (1, 6, 24):
            made[f"count_ratio_{h}h_72h"] = c(f"count_{h}h") / F.greatest(c("count_72h"), one)
    if has("energy_1h", "energy_72h"):
        for h in (1, 24):
            made[f"energy_ratio_{h}h_72h"] = c(f"energy_{h}h") / F.greatest(c("energy_72h"), tiny)
    if has("omori_p", "omori_c"):
        made["omori_p_times_c"] = c("omori_p") * c("omori_c")
        made["omori_decay_rate"] = c("omori_p") / F.greatest(c("omori_c"), micro)
    if has("etas_p", "etas_alpha"):
        made["etas_p_alpha_ratio"] = c("etas_p") / F.greatest(c("etas_alpha"), micro)
    if has("anisotropy_major_axis_km", "mainshock_mag"):
        made["aniso_area_proxy"] = c("anisotropy_major_axis_km") * c("anisotropy_minor_axis_km")
        made["aniso_per_mag"] = c("anisotropy_major_axis_km") / F.greatest(c("mainshock_mag"), one)
    if has("plate_boundary_distance_km", "mainshock_mag"):
        made["plate_dist_per_mag"] = c("plate_boundary_distance_km") / F.greatest(c("mainshock_mag"), one)
        made["log_plate_dist"] = F.log1p(c("plate_boundary_distance_km"))
    if has("gr_b_value", "mainshock_mag"):
        made["b_value_times_mag"] = c("gr_b_value") * c("mainshock_mag")
    if has("mainshock_depth"):
        made["log_depth"] = F.log1p(F.greatest(c("mainshock_depth"), F.lit(0.0)))
        made["depth_mag_ratio"] = c("mainshock_depth") / F.greatest(c("mainshock_mag"), one)
    if has("productivity_index", "early_aftershock_count"):
        made["productivity_per_event"] = c("productivity_index") / F.greatest(c("early_aftershock_count"), one)
    for kind, floor in (("count", one), ("energy", tiny)):
        first, day, full = z(f"{kind}_12h"), z(f"{kind}_24h"), z(f"{kind}_72h")
        late = F.greatest(full - day, F.lit(0.0))
        if has(f"{kind}_12h", f"{kind}_24h", f"{kind}_72h"):
            made[f"{kind}_0_12h"] = first
            made[f"{kind}_12_24h"] = F.greatest(day - first, F.lit(0.0))
            made[f"{kind}_24_72h"] = late
        if has(f"{kind}_12h", f"{kind}_72h"):
            made[f"decay_{kind}_ratio_early_late"] = first / F.greatest(late, floor)
            made[f"decay_{kind}_gradient"] = (first - late) / F.greatest(full, floor)
    kept = [name for name in df.columns if name not in made]
    return df.select(*kept, *[expr.alias(name) for name, expr in made.items()])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean model inputs by name and prefix; targets stay out."""
    barred = {*NOT_FEATURES, *WINDOW_TARGETS, *WINDOW_FLAGS}
    numeric = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema.fields
        if f.name not in barred and isinstance(f.dataType, numeric)
        and (f.name in NAMED_FEATURES or f.name.startswith(FEATURE_PREFIXES))
    ]


def model_matrix(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly ``columns`` as doubles; a missing one is NULL, text is coerced."""
    types = dict(df.dtypes)

    def one(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("double").alias(name)
        if types[name] == "boolean":
            return F.col(name).cast("int").cast("double").alias(name)
        if types[name] == "string":
            return F.col(name).try_cast("double").alias(name)
        return F.col(name).cast("double").alias(name)

    return df.select(*keep, *[one(c) for c in columns])


def schema_gap(columns: list[str], training: list[str], max_missing_ratio: float = 0.30,
               strict: bool = False) -> dict[str, list[str]]:
    """Missing and extra columns of an inference table; raises before any job when too many miss."""
    missing = sorted(set(training) - set(columns))
    extra = sorted(set(columns) - set(training) - set(CARRIED))
    ratio = len(missing) / max(len(training), 1)
    if ratio > max_missing_ratio or (strict and missing):
        raise ValueError(f"{len(missing)} of {len(training)} training columns are missing: {missing[:8]}")
    return {"missing": missing, "extra": extra}


def training_rows(df: DataFrame, time: str = "mainshock_time",
                  targets: tuple[str, ...] = ("target_max_mag", "target_time_to_max_days")) -> DataFrame:
    return df.dropna(subset=[time, *targets])


def regression_rows(df: DataFrame) -> DataFrame:
    return training_rows(df.filter(F.col("has_target_aftershock")) if "has_target_aftershock" in df.columns else df)
