"""Magnitude, moment and catalog-statistics expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorframe.constants import GK_OTHER, GK_WINDOWS


def clean(col: Column) -> Column:
    """NaN is the missing value of landed files; Spark aggregates want NULL."""
    return F.when(~F.isnan(col), col)


def moment(mag: Column) -> Column:
    """Seismic moment 10^(1.5 M + 4.8)."""
    return F.pow(F.lit(10.0), 1.5 * mag + 4.8)


def mag_bin(mag: Column, width: float = 0.1) -> Column:
    """Magnitude on its bin centre, half-even at both rounding steps."""
    scale = F.lit(10.0 ** max(0, math.ceil(-math.log10(width))))
    return F.rint(F.rint(mag / F.lit(width)) * F.lit(width) * scale) / scale


def round_even(value: Column, digits: int = 1) -> Column:
    """Scale, round half-even, scale back: the rounding used for corrected magnitudes."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def bath_deficit(main_mag: Column, early_max: Column) -> Column:
    return F.when(early_max > 0, main_mag - early_max).otherwise(main_mag)


def bath_early_max(early_max: Column) -> Column:
    return F.when(early_max > 0, early_max)


def productivity(a_value: Column, b_value: Column, main_mag: Column) -> Column:
    return a_value - b_value * main_mag


def _gk(mag: Column, position: int) -> Column:
    picked = None
    for row in GK_WINDOWS:
        test = (mag >= row[0]) & (mag < row[1])
        picked = F.when(test, F.lit(row[position])) if picked is None else picked.when(test, F.lit(row[position]))
    return picked.otherwise(F.lit(GK_OTHER[position - 2]))


def gk_days(mag: Column) -> Column:
    return _gk(mag, 2)


def gk_km(mag: Column) -> Column:
    return _gk(mag, 3)
