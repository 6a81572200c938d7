"""Spatio-temporal interval joins as equi joins on time buckets and cells.

Only the anchor side (mainshocks, focal rows) is replicated to the cells and time
buckets it can reach; every catalog event keeps exactly one key, so the large side is
shuffled once and never multiplied. The exact predicate runs after the key match.
The replicated anchor side outgrows its size estimate, which does not know the copies, so
the join is a sort-merge join and never a static broadcast. Keys above ``hot_cell_rows`` are
counted and salted first, however many there are; what is left is split by adaptive skew
handling.

Pairs grow with the density of a catalog, so they are not stored where several aggregates need them: ``live_pairs``
keeps the events dealt and sorted by key, and each aggregate meets them anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorframe.functions.geo import CellGrid, haversine_km
from tremorframe.session import durable

KEY = ["_bucket", "_band", "_cell"]
#: Events of a key that one task joins.
HOT_CELL_ROWS = 500_000
#: A table of hot keys up to this size is broadcast; a larger one is joined by key.
BROADCAST_KEYS = 10_000
#: Events of a partition from which on live pairs keep them dealt; of fewer, each pass deals them anew and joins small partitions.
DEALT_ROWS = 5_000


def micros(col: Column) -> Column:
    return F.unix_micros(col)


def as_micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def keyed_events(events: DataFrame, grid: CellGrid, bucket_us: int,
                 time: str = "time", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One (time bucket, band, cell) key per event."""
    return (
        events.withColumn("_us", micros(F.col(time)))
        .withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket_us)).cast("bigint"))
        .withColumn("_band", grid.band(F.col(lat)))
        .withColumn("_cell", grid.cell(F.col(lon), grid.ring_size(F.col("_band"))))
    )


def keyed_anchors(anchors: DataFrame, grid: CellGrid, bucket_us: int, before_us: int, after_us: int,
                  time: str, lat: str, lon: str) -> DataFrame:
    """Replicate each anchor to every key that can hold a partner."""
    def bucket(us: Column) -> Column:
        return F.floor(us / F.lit(bucket_us)).cast("bigint")

    return (
        anchors.withColumn("_t0", micros(F.col(time)))
        .withColumn("_bucket", F.explode(F.sequence(
            bucket(F.col("_t0") - F.lit(before_us)), bucket(F.col("_t0") + F.lit(after_us)))))
        .withColumn("_band", F.explode(grid.bands_near(F.col(lat))))
        .withColumn("_ring", grid.ring_size(F.col("_band")))
        .withColumn("_cell", F.explode(grid.cells_near(F.col(lat), F.col(lon), F.col("_band"), F.col("_ring"))))
        .drop("_ring")
    )


def hot_keys(keyed: DataFrame, key: list[str], rows: int) -> DataFrame | None:
    """Keys that hold more than ``rows`` rows, with the parts they are split in; none if there is no such key. One job counts them."""
    hot = durable(
        keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows)
        .select(*key, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("_parts"))
    )
    keys = hot.count()
    if not keys:
        return None
    return F.broadcast(hot) if keys <= BROADCAST_KEYS else hot


def _with_parts(df: DataFrame, hot: DataFrame | None, key: list[str], salt: Callable[[Column], Column]) -> DataFrame:
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return df.join(hot, key, "left").withColumn("_salt", salt(F.coalesce(F.col("_parts"), F.lit(1)))).drop("_parts")


def dealt(df: DataFrame, hot: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of hot keys, each in one part by a hash of the row."""
    return _with_parts(df, hot, key, lambda parts: F.pmod(F.xxhash64(*df.columns), parts).cast("int"))


def repeated(df: DataFrame, hot: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of hot keys, each in every part."""
    return _with_parts(df, hot, key, lambda parts: F.explode(F.sequence(F.lit(0), parts - 1)))


def split_hot_cells(events: DataFrame, anchors: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Salt every key that holds more than ``rows`` events, so that a task meets about ``rows`` of them.

    One job counts the keys; without a hot key both sides only get a constant salt.
    """
    hot = hot_keys(events, KEY, rows)
    return dealt(events, hot, KEY), repeated(anchors, hot, KEY)


def interval_pairs(
    anchors: DataFrame,
    events: DataFrame,
    *,
    after_seconds: float,
    before_seconds: float = 0.0,
    radius_km: float = 100.0,
    closed_start: bool = False,
    anchor_time: str = "mainshock_time",
    anchor_lat: str = "mainshock_lat",
    anchor_lon: str = "mainshock_lon",
    hot_cell_rows: int = HOT_CELL_ROWS,
    earth_radius_km: float = 6371.0,
) -> DataFrame:
    """Events with ``t0 - before < t <= t0 + after`` within ``radius_km`` of each anchor.

    Adds ``distance_km``, ``elapsed_us`` and ``elapsed_hours``. ``closed_start`` includes
    the left end.
    """
    grid = CellGrid(radius_km, earth_radius_km)
    before_us, after_us = as_micros(before_seconds), as_micros(after_seconds)
    bucket_us = max(1, before_us + after_us)
    right = keyed_events(events, grid, bucket_us)
    left = keyed_anchors(anchors, grid, bucket_us, before_us, after_us, anchor_time, anchor_lat, anchor_lon)
    right, left = split_hot_cells(right, left, hot_cell_rows)
    key = [*KEY, "_salt"]
    return _met(left, right, key, grid, before_us, after_us, radius_km, closed_start, anchor_lat, anchor_lon, earth_radius_km)


def _met(left: DataFrame, right: DataFrame, key: list[str], grid: CellGrid, before_us: int, after_us: int, radius_km: float,
         closed_start: bool, anchor_lat: str, anchor_lon: str, earth_radius_km: float) -> DataFrame:
    """Keyed anchors joined with keyed events; the exact predicate."""
    elapsed = F.col("_us") - F.col("_t0")
    start_ok = elapsed >= -before_us if closed_start else elapsed > -before_us
    distance = haversine_km(F.col(anchor_lat), F.col(anchor_lon), F.col("latitude"), F.col("longitude"),
                            earth_radius_km)
    return (
        left.hint("merge").join(right, key)
        .filter(start_ok & (elapsed <= after_us) & (F.abs(F.col("latitude") - F.col(anchor_lat)) <= grid.height))
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= radius_km)
        .withColumn("elapsed_us", elapsed)
        .withColumn("elapsed_hours", elapsed / F.lit(3_600_000_000.0))
        .drop(*key, "_us", "_t0")
    )


@contextmanager
def live_pairs(
    anchors: DataFrame, events: DataFrame, *, after_seconds: float, radius_km: float = 100.0,
    hot_cell_rows: int = HOT_CELL_ROWS, earth_radius_km: float = 6371.0,
) -> Iterator[Callable[..., DataFrame]]:
    """``pairs(state, made)``: the pairs of ``interval_pairs``, with the columns of a state of rows by ``mainshock_id``.

    The state is joined with the anchors before they meet the events, so what is summed by mainshock is combined in the
    task that meets the pairs: no pair is shuffled or written. The events are kept once, from ``DEALT_ROWS`` a
    partition on dealt and sorted by key, until the block ends; a pass shuffles the anchors and its sums. An anchor goes to
    every key it can reach, so wide columns that follow from the state are ``made`` (name: expression) behind that shuffle.
    """
    grid = CellGrid(radius_km, earth_radius_km)
    after_us = as_micros(after_seconds)
    bucket_us = max(1, after_us)
    right = keyed_events(events, grid, bucket_us).drop("time").dropna(subset=["_us", *KEY])
    hot = hot_keys(right, KEY, hot_cell_rows)
    # Without a hot key the salt would be a constant, which the optimizer takes out of the join's key.
    key = KEY if hot is None else [*KEY, "_salt"]
    if hot is not None:
        right = dealt(right, hot, KEY)
    slots = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if right.count() >= slots * DEALT_ROWS:
        right = right.repartition(slots, *key).sortWithinPartitions(*key)
    right = right.persist(StorageLevel.MEMORY_AND_DISK)

    def pairs(state: DataFrame | None = None, made: dict[str, Column] | None = None) -> DataFrame:
        left = anchors if state is None else anchors.join(state, "mainshock_id")
        left = keyed_anchors(left, grid, bucket_us, 0, after_us, "mainshock_time", "mainshock_lat", "mainshock_lon")
        if hot is not None:
            left = repeated(left, hot, KEY)
        if made:
            left = left.repartition(*key).withColumns(made)
        return _met(left, right, key, grid, 0, after_us, radius_km, False, "mainshock_lat", "mainshock_lon", earth_radius_km)

    try:
        yield pairs
    finally:
        right.unpersist()


def drop_near_anchor_time(pairs: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Remove catalog rows within +-``seconds`` of the mainshock time (its own record)."""
    return pairs.filter(F.abs(F.col("elapsed_us")) > as_micros(seconds))


def first_by_time(pairs: DataFrame, limit: int, by: str = "mainshock_id") -> DataFrame:
    """The first ``limit`` events of each sequence.

    The rank filter is applied per input partition before the shuffle (window group limit),
    so a sequence of any size reaches its task with at most ``limit`` rows per partition.
    """
    order = Window.partitionBy(by).orderBy("elapsed_us", "id")
    return pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
