"""Catalog and prediction tables derived from the provided tables.

Every derived value is integer arithmetic on stored columns, so Spark and SQL agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event catalog: magnitude from ``value``, place from ``user_id``, depth from ``event_id``."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("time"),
        (F.lit(-60.0) + F.pmod("user_id", F.lit(240)) * F.lit(0.5)).alias("latitude"),
        (F.lit(-170.0) + F.pmod(F.floor(F.col("user_id") / 240), F.lit(680)) * F.lit(0.5)).alias("longitude"),
        F.pmod("event_id", F.lit(90)).cast("double").alias("depth"),
        ((40 + F.floor(cents / 1150)) / F.lit(10.0)).alias("mag"),
    )


CATALOG_SQL = """
catalog AS (
  SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS us,
         -60.0::DOUBLE + (user_id % 240) * 0.5::DOUBLE AS latitude,
         -170.0::DOUBLE + ((user_id // 240) % 680) * 0.5::DOUBLE AS longitude,
         CAST(event_id % 90 AS DOUBLE) AS depth,
         (40 + CAST(round(value * 100) AS BIGINT) // 1150) / 10.0::DOUBLE AS mag
  FROM events
)"""

MAIN_SQL = """
main AS (
  SELECT id AS mainshock_id, us AS t0, latitude AS lat0, longitude AS lon0, mag AS m0, depth AS d0
  FROM catalog WHERE mag >= 6.0 AND depth <= 70
)"""


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2.0::DOUBLE * 6371.0 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def pairs_sql(hours: float, name: str = "pairs", main: str = "main", radius: float = 100.0) -> str:
    """Mainshock-event pairs in (t0, t0 + hours] within the radius."""
    return f"""
{name} AS (
  SELECT m.*, e.id, e.us, e.latitude, e.longitude, e.depth, e.mag,
         {hav_sql('m.lat0', 'm.lon0', 'e.latitude', 'e.longitude')} AS distance_km,
         (e.us - m.t0) AS elapsed_us, (e.us - m.t0) / 3600000000.0::DOUBLE AS elapsed_hours
  FROM {main} m JOIN catalog e
    ON e.us > m.t0 AND e.us <= m.t0 + {int(hours * 3600)}000000
   AND abs(e.latitude - m.lat0) <= 5
   AND {hav_sql('m.lat0', 'm.lon0', 'e.latitude', 'e.longitude')} <= {radius}
)"""


BASE_SQL = f"{CATALOG_SQL},{MAIN_SQL}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that results can be compared across engines."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def log_moment(df: DataFrame, *columns: str) -> DataFrame:
    """Moments span many decades; they are compared on the log scale."""
    return df.withColumns({c: F.log10(F.col(c) + 1.0) for c in columns})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction row per line item: truth, three models and a risk probability."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    window = F.element_at(F.array(F.lit("T1"), F.lit("T2"), F.lit("T3")), F.pmod("l_linenumber", F.lit(3)) + 1)
    lower = F.element_at(F.array(F.lit(0.0), F.lit(24.0), F.lit(72.0)), F.pmod("l_linenumber", F.lit(3)) + 1)
    width = F.element_at(F.array(F.lit(24.0), F.lit(48.0), F.lit(96.0)), F.pmod("l_linenumber", F.lit(3)) + 1)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", cents.alias("cents"),
        window.alias("window"), lower.alias("lower"), width.alias("width"))
    part, supp, c = F.col("l_partkey"), F.col("l_suppkey"), F.col("cents")
    true_mag = (40 + F.pmod(part, F.lit(31))) / F.lit(10.0)
    true_hours = F.col("lower") + F.col("width") * (F.pmod(c, F.lit(97)) + 1) / F.lit(98.0)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "cents").alias("id"),
        F.col("l_orderkey").alias("group_id"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.col("l_returnflag").alias("plate_type"),
        "window",
        ((60 + F.pmod(c, F.lit(25))) / F.lit(10.0)).alias("main_mag"),
        true_mag.alias("true_mag"),
        (true_mag + (F.pmod(supp, F.lit(21)) - 10) / F.lit(20.0)).alias("mag_a"),
        (true_mag + (F.pmod(c, F.lit(17)) - 8) / F.lit(10.0)).alias("mag_b"),
        ((45 + F.pmod(part, F.lit(20))) / F.lit(10.0)).alias("mag_c"),
        true_hours.alias("true_hours"),
        (true_hours + (F.pmod(supp, F.lit(13)) - 6) * F.lit(1.5)).alias("hours_a"),
        (true_hours + (F.pmod(part, F.lit(19)) - 8) * F.lit(0.75)).alias("hours_b"),
        (F.col("lower") + F.col("width") / 2).alias("hours_c"),
        (F.pmod(c + part, F.lit(1000)) / F.lit(1000.0)).alias("risk"),
    )


PREDICTIONS_SQL = """
li AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         ['T1', 'T2', 'T3'][l_linenumber % 3 + 1] AS window_name,
         [0.0::DOUBLE, 24.0, 72.0][l_linenumber % 3 + 1] AS lo_h,
         [24.0::DOUBLE, 48.0, 96.0][l_linenumber % 3 + 1] AS width
  FROM lineitem
),
li2 AS (
  SELECT *, (40 + l_partkey % 31) / 10.0::DOUBLE AS tm, lo_h + width * (cents % 97 + 1) / 98.0::DOUBLE AS th FROM li
),
preds AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, cents) AS id, l_orderkey AS group_id,
         l_shipdate AS time, l_returnflag AS plate_type, window_name AS "window",
         (60 + cents % 25) / 10.0::DOUBLE AS main_mag, tm AS true_mag,
         tm + (l_suppkey % 21 - 10) / 20.0::DOUBLE AS mag_a,
         tm + (cents % 17 - 8) / 10.0::DOUBLE AS mag_b,
         (45 + l_partkey % 20) / 10.0::DOUBLE AS mag_c,
         th AS true_hours,
         th + (l_suppkey % 13 - 6) * 1.5::DOUBLE AS hours_a,
         th + (l_partkey % 19 - 8) * 0.75::DOUBLE AS hours_b,
         lo_h + width / 2 AS hours_c,
         ((cents + l_partkey) % 1000) / 1000.0::DOUBLE AS risk
  FROM li2
)"""


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a unique id, a time, and 30-day truth with four models."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                                               cents.alias("cents"))
    key, cust, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("cents")
    mag = (40 + F.pmod(cust, F.lit(31))) / F.lit(10.0)
    days = (F.pmod(c, F.lit(2700)) + 1) / F.lit(100.0)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("time"),
        F.col("o_orderpriority").alias("plate_type"),
        ((60 + F.pmod(c, F.lit(25))) / F.lit(10.0)).alias("main_mag"),
        mag.alias("true_mag"), days.alias("true_days"),
        (mag + (F.pmod(key, F.lit(21)) - 10) / F.lit(20.0)).alias("mag_a"),
        (mag + (F.pmod(c, F.lit(17)) - 8) / F.lit(10.0)).alias("mag_b"),
        ((45 + F.pmod(cust, F.lit(20))) / F.lit(10.0)).alias("mag_c"),
        (mag - (F.pmod(key + c, F.lit(11)) - 4) / F.lit(10.0)).alias("mag_d"),
        (days + (F.pmod(key, F.lit(13)) - 6) / F.lit(2.0)).alias("days_a"),
        (days + (F.pmod(cust, F.lit(19)) - 8) / F.lit(4.0)).alias("days_b"),
        F.lit(13.5).alias("days_c"),
    )


DATED_SQL = """
o2 AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
),
o3 AS (
  SELECT *, (40 + o_custkey % 31) / 10.0::DOUBLE AS tm, (cents % 2700 + 1) / 100.0::DOUBLE AS td FROM o2
),
dated AS (
  SELECT o_orderkey AS id, o_orderdate AS time, o_orderpriority AS plate_type,
         (60 + cents % 25) / 10.0::DOUBLE AS main_mag, tm AS true_mag, td AS true_days,
         tm + (o_orderkey % 21 - 10) / 20.0::DOUBLE AS mag_a,
         tm + (cents % 17 - 8) / 10.0::DOUBLE AS mag_b,
         (45 + o_custkey % 20) / 10.0::DOUBLE AS mag_c,
         tm - ((o_orderkey + cents) % 11 - 4) / 10.0::DOUBLE AS mag_d,
         td + (o_orderkey % 13 - 6) / 2.0::DOUBLE AS days_a,
         td + (o_custkey % 19 - 8) / 4.0::DOUBLE AS days_b,
         13.5::DOUBLE AS days_c
  FROM o3
)"""
