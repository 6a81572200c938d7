"""Plate-boundary GeoJSON as a segment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
)


def plate_type(raw: Column, unknown: str = "UNK", subduction: str = "SUB") -> Column:
    text = F.trim(raw)
    return (F.when(text.isNull() | (text == ""), unknown).when(F.lower(text) == "subduction", subduction)
            .otherwise(F.upper(text)))


def read_boundaries(spark: SparkSession, path: str, type_field: str = "STEP_CLASS",
                    fallback_field: str = "Type") -> DataFrame:
    """segment_id, plate_type and the end points of every polyline segment.

    The fallback field is used when no feature carries the first one.
    """
    features = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(
        F.posexplode("features").alias("feature", "f"))
    props = F.col("f.properties")
    has_first = features.agg(F.max(F.map_contains_key(props, F.lit(type_field))).alias("x")).first()
    if has_first is None or has_first["x"] is None:
        raise ValueError(f"no boundary features in {path}")
    raw = props[type_field] if has_first["x"] else props[fallback_field]
    text = F.col("f.geometry.coordinates")
    line = F.from_json(text, "array<array<double>>")
    lines = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json(text, "array<array<array<double>>>")).otherwise(
        F.array(line))
    parts = features.select("feature", plate_type(raw).alias("plate_type"), F.posexplode(lines).alias("part", "p")).filter(
        F.size("p") >= 2)
    legs = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.struct(i.alias("leg"), F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    out = parts.select("feature", "part", "plate_type", F.explode(legs).alias("s"))
    # 24 bits of features, 16 of parts, 23 of legs: in file order, and no two collide
    number = F.shiftleft(F.col("feature").cast("bigint"), 39) + F.shiftleft(F.col("part").cast("bigint"), 23) + F.col("s.leg")
    return out.select(
        number.alias("segment_id"), "plate_type", F.col("s.a")[0].alias("lon1"), F.col("s.a")[1].alias("lat1"),
        F.col("s.b")[0].alias("lon2"), F.col("s.b")[1].alias("lat2"))
