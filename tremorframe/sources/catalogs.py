"""Event-catalog readers and the normaliser for every landed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column aliases of landed files.
ALIASES = {"Lat": "latitude", "Lon": "longitude", "Mag": "mag", "Depth": "depth"}
NUMBERS = ("latitude", "longitude", "depth", "mag")
# Time formats met in landed files; the last two only after ISO parsing fails.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy/MM/dd HH:mm:ss[.SSSSSS]", "yyyy-M-d H:m:s[.SSSSSS]",
                "yyyy/M/d H:m:s[.SSSSSS]")
CALENDAR = ("Year", "Month", "Day", "Hour", "Minute", "Second")


def parsed_time(text: Column) -> Column:
    """UTC time or NULL; ISO text first, then the listed formats."""
    trimmed = F.trim(text)
    return F.coalesce(trimmed.try_cast("timestamp"), *[F.try_to_timestamp(trimmed, F.lit(f)) for f in TIME_FORMATS])


def event_time(df: DataFrame) -> Column:
    columns = set(df.columns)
    if "time" in columns:
        kind = dict(df.dtypes)["time"]
        return F.col("time").cast("timestamp") if kind.startswith("timestamp") else parsed_time(F.col("time"))
    if {"Date", "Time"} <= columns:
        return parsed_time(F.concat_ws(" ", F.trim(F.col("Date").cast("string")), F.trim(F.col("Time").cast("string"))))
    if set(CALENDAR) <= columns:
        whole = [F.col(c).try_cast("int") for c in CALENDAR[:5]]
        return F.try_make_timestamp(*whole, F.col("Second").try_cast("decimal(8,6)"))
    raise ValueError("events need time, Date and Time, or Year to Second columns")


def normalize_events(raw: DataFrame, need_depth: bool = True, id_style: str = "stamp",
                     extra: list[str] = ()) -> DataFrame:
    """The canonical catalog: id, time, latitude, longitude, depth, mag (+ extras).

    Rows without time, place or magnitude are dropped, and without depth where it is needed.
    A missing id is the time stamp with ``_eq``, or a hash of the row: a row number would
    depend on the partitioning.
    """
    df = raw
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    required = [c for c in NUMBERS if c != "depth" or need_depth]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"events miss columns {missing}")
    types = dict(df.dtypes)

    def number(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("double").alias(name)
        value = F.col(name).try_cast("double") if types[name] == "string" else F.col(name).cast("double")
        return F.when(~F.isnan(value), value).alias(name)

    time = event_time(df)
    if "id" in types:
        id_ = F.col("id").cast("string")
    elif id_style == "stamp":
        id_ = F.concat(F.date_format(time, "yyyyMMddHHmmss"), F.lit("_eq"))
    else:
        id_ = F.concat(F.lit("event_"), F.hex(F.xxhash64(*[F.col(c).cast("string") for c in df.columns])))
    out = df.select(id_.alias("id"), time.alias("time"), *[number(c) for c in NUMBERS], *extra)
    return out.dropna(subset=["time", *required])


def read_csv(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Header CSV as text columns; values are coerced by the normaliser, not by inference."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    return reader.csv(path, pathGlobFilter=glob) if glob else reader.csv(path)


def read_catalog(spark: SparkSession, path) -> DataFrame:
    return normalize_events(read_csv(spark, path), id_style="hash")


def read_sequences(spark: SparkSession, folder: str, glob: str = "*_eq.csv") -> DataFrame:
    """All per-sequence files as one table with ``sequence_id`` from the file name."""
    raw = read_csv(spark, folder, glob).withColumn(
        "sequence_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return normalize_events(raw, extra=["sequence_id"])


def landed_catalog(spark: SparkSession, folder: str, min_mag: float, max_depth: float) -> DataFrame:
    """Yearly extracts of a landed folder as one filtered catalog."""
    events = normalize_events(read_csv(spark, folder), id_style="hash")
    return events.filter((F.col("mag") >= min_mag) & (F.col("depth") <= max_depth))


def write_catalog(events: DataFrame, path: str) -> None:
    """Parquet by year, sorted by time inside a file so that time filters skip row groups.

    Range partitioning on (year, time) splits a heavy year over several tasks and files.
    """
    (events.withColumn("year", F.year("time")).repartitionByRange("year", "time")
     .sortWithinPartitions("year", "time").write.mode("overwrite").partitionBy("year").parquet(path))


def catalog_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Partition and row-group pruned read of a written catalog."""
    first, last = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    years = F.col("year").between(int(start[:4]), int(end[:4]))
    return spark.read.parquet(path).filter(years & (F.col("time") >= first) & (F.col("time") < last)).drop("year")


def union_extracts(*frames: DataFrame) -> DataFrame:
    """Yearly or monthly frames with their own optional columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
