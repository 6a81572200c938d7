"""Prediction-line text: tokens, hour stamps, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorframe.functions.windows import clamp_hours, clamp_mag


def token(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHHmmss")


def hour_stamp(time: Column, hours: Column) -> Column:
    """Start time plus the half-even rounded number of hours, as yyyyMMddHH."""
    whole = F.rint(hours).cast("bigint")
    return F.date_format(F.timestamp_seconds(F.unix_seconds(time) + whole * 3600), "yyyyMMddHH")


def hours_between(token_col: Column, stamp: Column) -> Column:
    """Hours from a token to an hour stamp; NULL when either does not parse."""
    start = F.try_to_timestamp(token_col, F.lit("yyyyMMddHHmmss"))
    end = F.try_to_timestamp(stamp, F.lit("yyyyMMddHH"))
    return (F.unix_seconds(end) - F.unix_seconds(start)) / 3600.0


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value (0.35 is below 0.35, so it prints 0.3).

    The fraction is split into a 52-bit integer and what is left of it, so the distance from
    the halfway point is exact; only a true tie goes to the even digit.
    """
    unit = F.lit(1 << 52).cast("bigint")
    scale = F.lit(10**digits).cast("bigint")
    size = F.abs(value)
    whole = F.floor(size).cast("bigint")
    bits = (size - whole) * F.lit(float(1 << 52))
    held = F.floor(bits).cast("bigint")
    quotient = F.shiftright(held * scale, 52)
    rest = F.pmod(held * scale, unit)
    half = F.lit(1 << 51).cast("bigint")
    odd = F.pmod(quotient, F.lit(2)) == 1
    beyond = (rest - half).cast("double") + (bits - held) * F.lit(float(10**digits))
    up = (beyond > 0) | ((beyond == 0) & odd)
    units = whole * scale + quotient + up.cast("bigint")
    tail = F.lpad(F.pmod(units, scale).cast("string"), digits, "0")
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.floor(units / scale).cast("bigint").cast("string"), F.lit("."), tail)


def prediction_line(time: Column, lon: Column, lat: Column, main_mag: Column, window: Column,
                    mag: Column, hours: Column, mag_type: str = "Ms") -> Column:
    return F.concat_ws(
        " ",
        token(time), fixed(lon, 2), fixed(lat, 2), fixed(main_mag, 1),
        fixed(clamp_mag(mag, main_mag), 1), F.lit(f"({mag_type})"),
        hour_stamp(time, clamp_hours(hours, window)),
    )


def event_key(event_id: Column) -> Column:
    return F.substring(F.md5(event_id), 1, 12)
