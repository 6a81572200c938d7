"""Forecast-window expressions: bounds, buckets, clamps, rule forecasts, targets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorframe.constants import RULE_DROP, RULE_DROP_OTHER, TIME_BUCKETS, WINDOW_BOUNDS


def _pick(window: Column, values: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, window)


def lower_hours(window: Column) -> Column:
    return _pick(window, {w: lo for w, (lo, _) in WINDOW_BOUNDS.items()})


def upper_hours(window: Column) -> Column:
    return _pick(window, {w: hi for w, (_, hi) in WINDOW_BOUNDS.items()})


def midpoint_hours(window: Column) -> Column:
    return (lower_hours(window) + upper_hours(window)) / 2


def in_window(hours: Column, lower: float, upper: float) -> Column:
    return (hours > lower) & (hours <= upper)


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def clamp_mag(mag: Column, main_mag: Column) -> Column:
    safe = F.coalesce(finite(mag), F.lit(0.0))
    return F.least(F.greatest(safe, F.lit(0.0)), main_mag + 0.5)


def clamp_hours(hours: Column, window: Column) -> Column:
    safe = F.coalesce(finite(hours), midpoint_hours(window))
    return F.least(F.greatest(safe, lower_hours(window) + 1e-6), upper_hours(window))


def rule_mag(window: Column, main_mag: Column) -> Column:
    drop = F.coalesce(_pick(window, RULE_DROP), F.lit(RULE_DROP_OTHER))
    return clamp_mag(F.greatest(F.lit(0.0), main_mag - drop), main_mag)


def rule_days(has_aftershocks: Column) -> Column:
    """Fallback time of the 30-day task: one day, or zero for a quiet sequence."""
    return F.when(has_aftershocks, F.lit(1.0)).otherwise(F.lit(0.0))


def bound_30d_mag(mag: Column, main_mag: Column) -> Column:
    return F.least(F.greatest(mag, F.greatest(F.lit(0.0), main_mag - 3.0)), main_mag + 0.5)


def time_bucket(window: Column, hours: Column) -> Column:
    """Bucket number 0-3; values outside the window go to the first or last bucket."""
    edges = F.create_map(*[
        x for name, buckets in TIME_BUCKETS.items()
        for x in (F.lit(name), F.array(*[F.lit(hi) for _, hi in buckets[:3]]))
    ])
    return F.size(F.filter(F.element_at(edges, window), lambda edge: hours > edge))


def bucket_centres(window: Column) -> Column:
    centres = F.create_map(*[
        x for name, buckets in TIME_BUCKETS.items()
        for x in (F.lit(name), F.array(*[F.lit((lo + hi) / 2) for lo, hi in buckets]))
    ])
    return F.element_at(centres, window)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def expected_hours(window: Column, probabilities: Column) -> Column:
    """Probability-weighted bucket centre; a row of zeros gives the mean centre."""
    centres = bucket_centres(window)
    total = _total(probabilities)
    weighted = _total(F.zip_with(probabilities, centres, lambda p, c: p * c))
    return F.when(total > 0, weighted / total).otherwise(_total(centres) / F.size(centres))


def align_probabilities(raw: Column, labels: Column, classes: int = 4) -> Column:
    """Place raw class probabilities by label and normalise; an empty row becomes uniform."""
    by_label = F.map_from_arrays(labels.cast("array<int>"), raw)
    placed = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda k: F.coalesce(F.try_element_at(by_label, k), F.lit(0.0)),
    )
    total = _total(placed)
    return F.when(total > 0, F.transform(placed, lambda p: p / total)).otherwise(
        F.array_repeat(F.lit(1.0 / classes), classes)
    )


def log_target(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def unlog_target(value: Column, cap: float = math.log1p(8760.0)) -> Column:
    """Inverse of log_target. The cap (a year in hours) stops a diverged model from exploding."""
    return F.expm1(F.least(F.greatest(value, F.lit(-cap)), F.lit(cap)))
