"""GeoJSON event feeds, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_SCHEMA = (
    "features array<struct<id: string, properties: struct<time: bigint, mag: double, place: string, "
    "type: string, url: string>, geometry: struct<coordinates: array<double>>>>"
)


def feed_events(raw: DataFrame) -> DataFrame:
    """Event rows from feed documents; positions are longitude, latitude, depth."""
    f = raw.select(F.explode("features").alias("f"))
    point = F.col("f.geometry.coordinates")
    return f.select(
        F.col("f.id").alias("id"), F.timestamp_millis("f.properties.time").alias("time"),
        point[1].alias("latitude"), point[0].alias("longitude"), F.coalesce(point[2], F.lit(0.0)).alias("depth"),
        F.col("f.properties.mag").alias("mag"), F.coalesce("f.properties.place", F.lit("")).alias("place"),
    ).dropna(subset=["id", "time", "latitude", "longitude", "mag"])


def read_feed(spark: SparkSession, path) -> DataFrame:
    return feed_events(spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(path))


def stream_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FEED_SCHEMA).option("multiLine", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return feed_events(reader.json(path))
