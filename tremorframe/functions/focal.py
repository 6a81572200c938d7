"""Fault classes from rake angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Long names and their short codes.
FAULT_CODES = {"Thrust": "TF", "Normal": "NF", "Strike-Slip": "SS", "Unknown": "UNK"}


def fault_type(rake: Column) -> Column:
    """Three classes with limits at 45 and 135 degrees after a wrap to [-180, 180)."""
    wrapped = F.pmod(rake + 180.0, F.lit(360.0)) - 180.0
    return (
        F.when(rake.isNull() | F.isnan(rake), "Unknown")
        .when(wrapped.between(45.0, 135.0), "Thrust")
        .when(wrapped.between(-135.0, -45.0), "Normal")
        .otherwise("Strike-Slip")
    )


def fault_code(fault: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in FAULT_CODES.items() for x in pair])
    return F.coalesce(F.element_at(codes, fault), F.lit("UNK"))


def catalog_fault_code(rake: Column) -> Column:
    """Class stored when a focal catalog is built: limits at 30, 60, 120 and 150 degrees."""
    size = F.abs(rake)
    slip = (size <= 30) | (size >= 120)
    steep = size >= 60
    return (
        F.when(rake.isNull() | F.isnan(rake), "UNK")
        .when(slip, "SS")
        .when((rake > 0) == steep, "TF")
        .otherwise("NF")
    )


def fault_indicators(fault: Column) -> list[Column]:
    """Indicator columns for the long names and for the short codes."""
    long_names = [
        (fault == name).cast("int").alias(f"fault_type_{name.replace('-', '_')}") for name in FAULT_CODES
    ]
    short = [(fault_code(fault) == code).cast("int").alias(f"fault_type_{code}") for code in ("NF", "SS", "TF", "UNK")]
    return long_names + short
