"""Mainshock selection, sequence building and declustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import (
    AFTERSHOCK_RADIUS_KM, EARTH_RADIUS_KM, GK_OTHER, GK_WINDOWS, MAINSHOCK_MAX_DEPTH_KM, MAINSHOCK_MIN_MAG,
    OBSERVATION_DAYS, TARGET_DAYS,
)
from tremorframe.functions.geo import CellGrid, haversine_limit, haversine_term
from tremorframe.functions.seismic import gk_days, gk_km, moment
from tremorframe.operators.spatial_join import (
    HOT_CELL_ROWS, as_micros, dealt, drop_near_anchor_time, hot_keys, interval_pairs, micros, repeated,
)
from tremorframe.session import durable

DAY_S = 86400.0


def mainshocks(events: DataFrame, min_mag: float = MAINSHOCK_MIN_MAG,
               max_depth_km: float = MAINSHOCK_MAX_DEPTH_KM) -> DataFrame:
    return events.filter((F.col("mag") >= min_mag) & (F.col("depth") <= max_depth_km)).select(
        F.col("id").alias("mainshock_id"),
        F.col("time").alias("mainshock_time"),
        F.col("latitude").alias("mainshock_lat"),
        F.col("longitude").alias("mainshock_lon"),
        F.col("mag").alias("mainshock_mag"),
        F.col("depth").alias("mainshock_depth"),
    )


def largest_event(columns: list[str], mag: str = "mag", time: str = "time", id_: str = "id") -> Column:
    """Struct of the largest event; the earliest wins a tie, then the smallest id."""
    return F.min_by(
        F.struct(*columns), F.struct(-F.col(mag), micros(F.col(time)), F.col(id_))
    )


def sequence_mainshock(events: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """The mainshock of each landed sequence."""
    columns = ["id", "time", "latitude", "longitude", "depth", "mag"]
    best = events.groupBy(sequence).agg(largest_event(columns).alias("m"))
    return best.select(
        sequence,
        F.col("m.id").alias("mainshock_id"), F.col("m.time").alias("mainshock_time"),
        F.col("m.latitude").alias("mainshock_lat"), F.col("m.longitude").alias("mainshock_lon"),
        F.col("m.mag").alias("mainshock_mag"), F.col("m.depth").alias("mainshock_depth"),
    )


# --- the greedy rule: a node stays iff no staying node covers it -----------------------------

COVER_KEY = ["_grid", "_bucket", "_band", "_cell"]


class CoverRule:
    """How one node covers a later one: per-node reach, plus an order that has no cycles.

    ``reaches`` lists (test on a node, days, km): nodes are put on one grid per class, so a
    short-range node is never looked up on the cells of a long-range one. Keys of more than
    ``hot_rows`` nodes (``HOT_CELL_ROWS`` if not given) are split: one side is dealt out, the other repeated.
    """

    def __init__(self, reaches: list[tuple[Column | None, float, float]], days: Column, km: Column,
                 smaller_only: bool, hot_rows: int | None = None):
        self.reaches = reaches
        self.days, self.km, self.smaller_only = days, km, smaller_only
        self.hot_rows = hot_rows or HOT_CELL_ROWS

    def _sources(self, nodes: DataFrame, spread: bool) -> DataFrame:
        """Nodes as coverers, one row per key they can cover if ``spread``, else one row at their own place."""
        pieces = []
        for number, (test, days, km) in enumerate(self.reaches):
            own = nodes if test is None else nodes.filter(test)
            piece = own.select(
                F.lit(number).alias("_grid"), F.col("us").alias("s_us"), F.col("latitude").alias("s_lat"),
                F.col("longitude").alias("s_lon"), F.col("mag").alias("s_mag"),
                (self.days * F.lit(DAY_S * 1e6)).cast("bigint").alias("s_reach_us"),
                F.degrees(self.km / EARTH_RADIUS_KM).alias("s_reach_deg"),
                haversine_limit(self.km).alias("s_limit"), F.cos(F.radians("latitude")).alias("s_cos"))
            place = F.col("s_us"), F.col("s_us") + F.col("s_reach_us"), F.col("s_lat"), F.col("s_lon")
            pieces.append(self._spread(piece, CellGrid(km), days, *place) if spread else piece.select(
                "*", *self._own_key(CellGrid(km), days, F.col("s_us"), F.col("s_lat"), F.col("s_lon"))))
        return reduce(DataFrame.unionByName, pieces)

    def _targets(self, nodes: DataFrame, spread: bool) -> DataFrame:
        """Nodes as covered ones: one key per grid, or every key where a coverer can stand if ``spread``."""
        nodes = nodes.withColumn("_cos", F.cos(F.radians("latitude")))
        if spread:
            pieces = []
            for number, (_, days, km) in enumerate(self.reaches):
                piece = nodes.withColumn("_grid", F.lit(number))
                first = F.col("us") - as_micros(days * DAY_S)
                pieces.append(self._spread(piece, CellGrid(km), days, first, F.col("us"), F.col("latitude"), F.col("longitude")))
            return reduce(DataFrame.unionByName, pieces)
        keys = [
            F.struct(F.lit(number).alias("_grid"), *self._own_key(CellGrid(km), days, F.col("us"), F.col("latitude"), F.col("longitude")))
            for number, (_, days, km) in enumerate(self.reaches)]
        return nodes.withColumn("_key", F.explode(F.array(*keys))).select("*", "_key.*").drop("_key")

    @staticmethod
    def _own_key(grid: CellGrid, days: float, us: Column, lat: Column, lon: Column) -> list[Column]:
        band = grid.band(lat)
        return [F.floor(us / as_micros(days * DAY_S)).cast("bigint").alias("_bucket"), band.alias("_band"),
                grid.cell(lon, grid.ring_size(band)).alias("_cell")]

    @staticmethod
    def _spread(piece: DataFrame, grid: CellGrid, days: float, first: Column, last: Column, lat: Column, lon: Column) -> DataFrame:
        width = as_micros(days * DAY_S)
        return (
            piece.withColumn("_bucket", F.explode(F.sequence(F.floor(first / width).cast("bigint"), F.floor(last / width).cast("bigint"))))
            .withColumn("_band", F.explode(grid.bands_near(lat)))
            .withColumn("_ring", grid.ring_size(F.col("_band")))
            .withColumn("_cell", F.explode(grid.cells_near(lat, lon, F.col("_band"), F.col("_ring"))))
            .drop("_ring")
        )

    def hot(self, nodes: DataFrame) -> DataFrame | None:
        """Keys of too many nodes; later rounds hold a part of them."""
        return hot_keys(self._targets(nodes, False), COVER_KEY, self.hot_rows)

    def covered_ids(self, nodes: DataFrame, by: DataFrame, hot: DataFrame | None = None) -> DataFrame:
        """Ids of ``nodes`` covered by some node of ``by``: a semi join, no pair is emitted.

        The side that takes fewer rows for it goes to all keys it can meet, the other keeps to its own place. Both are read
        twice (they are counted first), so give durable ones.
        """
        many = nodes.count() * len(self.reaches) < by.count()
        one, all_parts = (repeated, dealt) if many else (dealt, repeated)
        target = one(self._targets(nodes, many), hot, COVER_KEY).alias("t")
        source = all_parts(self._sources(by, not many), hot, COVER_KEY).alias("s")
        gap = F.col("t.us") - F.col("s.s_us")
        test = (gap > 0) & (gap <= F.col("s.s_reach_us"))
        if self.smaller_only:
            test = test & (F.col("t.mag") < F.col("s.s_mag"))
        # Cheap latitude test first; then the haversine term against its limit, cosines precomputed.
        rise, turn = F.col("t.latitude") - F.col("s.s_lat"), F.col("t.longitude") - F.col("s.s_lon")
        test = test & (F.abs(rise) <= F.col("s.s_reach_deg") * (1 + 1e-9))
        near = haversine_term(rise, turn, F.col("s.s_cos"), F.col("t._cos"))
        test = test & (near <= F.col("s.s_limit"))
        for key in (*COVER_KEY, "_salt"):
            test = test & (F.col(f"t.{key}") == F.col(f"s.{key}"))
        # The replicated side outgrows its size estimate, so a broadcast is ruled out here.
        return target.join(source.hint("merge"), test, "left_semi").select("id").distinct()


def _marked(nodes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``nodes`` with a boolean that says whether the id is among ``ids``."""
    return durable(nodes.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False))))


def greedy_keep(nodes: DataFrame, rule: CoverRule) -> DataFrame:
    """Ids kept by the greedy rule, by rounds of semi and anti joins that follow what changed.

    Nodes that nothing covers are kept. A round drops what the nodes kept last cover; then only nodes that lost
    a coverer by that are looked at again, and those without any other open coverer are kept. A node is a
    coverer of a round's drop once, when it is kept or dropped, and never again. Covering goes strictly forward in
    time (and down in magnitude where asked), so each round settles a node and the kept set is unique. State is
    written to the checkpoint folder each round.
    """
    columns = ["id", "us", "latitude", "longitude", "mag"]
    nodes = durable(nodes.select(*columns))
    hot = rule.hot(nodes)
    first = _marked(nodes, rule.covered_ids(nodes, nodes, hot), "covered")
    fresh, waiting = first.filter("NOT covered").select(*columns), first.filter("covered").select(*columns)
    kept = fresh.select("id")
    while not waiting.isEmpty():
        round_ = _marked(waiting, rule.covered_ids(waiting, fresh, hot), "dropped")
        dropped, rest = round_.filter("dropped").select(*columns), round_.filter("NOT dropped").select(*columns)
        if rest.isEmpty():
            break
        lost = durable(rest.join(rule.covered_ids(rest, dropped, hot), "id", "left_semi"))
        free = lost.join(rule.covered_ids(lost, rest, hot), "id", "left_anti").select("id")
        state = _marked(rest, free, "free")
        fresh, waiting = state.filter("free").select(*columns), state.filter("NOT free").select(*columns)
        kept = kept.unionByName(fresh.select("id"))
    return kept


def decluster(events: DataFrame) -> DataFrame:
    """Gardner-Knopoff declustering: adds ``is_background`` to every event.

    Classes of similar reach share a grid, so an event carries four keys and not thirteen.
    """
    mag = F.col("mag")
    # The class below 2.0 falls through to the largest window, as does anything above the table.
    groups = [(2.0, 4.0), (4.0, 5.0), (5.0, 6.0)]
    reaches = []
    for low, high in groups:
        inside = [row for row in GK_WINDOWS if low <= row[0] < high]
        reaches.append(((mag >= low) & (mag < high), max(r[2] for r in inside), max(r[3] for r in inside)))
    reaches.append(((mag < groups[0][0]) | (mag >= groups[-1][1]), *GK_OTHER))
    rule = CoverRule(reaches, gk_days(mag), gk_km(mag), smaller_only=True)
    nodes = events.select("id", micros(F.col("time")).alias("us"), "latitude", "longitude", "mag")
    kept = greedy_keep(nodes, rule).withColumn("is_background", F.lit(True))
    return events.join(kept, "id", "left").withColumn(
        "is_background", F.coalesce(F.col("is_background"), F.lit(False)))


def _with_any_later_event(main: DataFrame, events: DataFrame, seconds: float) -> DataFrame:
    """Mainshocks with at least one catalog event anywhere in (t0, t0 + seconds].

    The catalog is reduced to first and last time per bucket of that length, so two equi
    lookups decide it.
    """
    width = as_micros(seconds)
    spans = (
        events.select(micros(F.col("time")).alias("us"))
        .groupBy(F.floor(F.col("us") / width).cast("bigint").alias("_bucket"))
        .agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    )
    bucket = F.floor(micros(F.col("mainshock_time")) / width).cast("bigint")
    probe = main.withColumn("_us", micros(F.col("mainshock_time"))).withColumn(
        "_bucket", F.explode(F.array(bucket, bucket + 1)))
    found = (
        probe.join(spans, "_bucket")
        .filter((F.col("_last") > F.col("_us")) & (F.col("_first") <= F.col("_us") + width))
        .select("mainshock_id").distinct()
    )
    return main.join(found, "mainshock_id", "left_semi")


def _eligible(main: DataFrame, events: DataFrame, seconds: float, radius_km: float, min_mag: float) -> DataFrame:
    """Drop foreshocks: mainshocks with a larger event inside the radius and window.

    Only events above the mainshock threshold can be larger, so the join reads those alone.
    """
    larger = (
        interval_pairs(main, events.filter(F.col("mag") > min_mag), after_seconds=seconds, radius_km=radius_km)
        .filter(F.col("mag") > F.col("mainshock_mag"))
        .select("mainshock_id").distinct()
    )
    return main.join(larger, "mainshock_id", "left_anti")


def _claimed_out(main: DataFrame, seconds: float, radius_km: float) -> DataFrame:
    """Apply the claim rule among eligible mainshocks."""
    days = seconds / DAY_S
    rule = CoverRule([(None, days, radius_km)], F.lit(days), F.lit(radius_km), smaller_only=False)
    nodes = main.select(
        F.col("mainshock_id").alias("id"), micros(F.col("mainshock_time")).alias("us"),
        F.col("mainshock_lat").alias("latitude"), F.col("mainshock_lon").alias("longitude"),
        F.col("mainshock_mag").alias("mag"),
    )
    return main.join(greedy_keep(nodes, rule).withColumnRenamed("id", "mainshock_id"), "mainshock_id", "left_semi")


def build_sequences(events: DataFrame, obs_days: float = OBSERVATION_DAYS, target_days: float = TARGET_DAYS,
                    radius_km: float = AFTERSHOCK_RADIUS_KM, min_mag: float = MAINSHOCK_MIN_MAG,
                    max_depth_km: float = MAINSHOCK_MAX_DEPTH_KM) -> DataFrame:
    """One row per mainshock: early statistics and the largest event of the target window.

    The target time counts from the end of observation, in days; a sequence without a target
    has NULL targets.
    """
    seconds = target_days * DAY_S
    main = mainshocks(events, min_mag, max_depth_km)
    main = _with_any_later_event(main, events, seconds)
    main = _claimed_out(_eligible(main, events, seconds, radius_km, min_mag), seconds, radius_km)
    obs_us = as_micros(obs_days * DAY_S)
    early = F.col("elapsed_us") <= obs_us
    late = ~early
    pairs = interval_pairs(main.select("mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"),
                           events, after_seconds=seconds, radius_km=radius_km)
    stats = pairs.groupBy("mainshock_id").agg(
        F.count_if(early).alias("early_aftershock_count"),
        F.max(F.when(early, F.col("mag"))).alias("early_max_mag"),
        F.avg(F.when(early, F.col("mag"))).alias("early_mean_mag"),
        F.sum(F.when(early, moment(F.col("mag"))).otherwise(0.0)).alias("early_energy_sum"),
        F.min(F.when(late, F.struct(
            (-F.col("mag")).alias("neg_mag"), F.col("elapsed_us").alias("us"), F.col("id").alias("id")))
        ).alias("best"),
    )
    days_after = (F.col("best.us") - obs_us) / F.lit(DAY_S * 1e6)
    return main.join(stats, "mainshock_id", "left").select(
        "mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "mainshock_mag", "mainshock_depth",
        F.coalesce("early_aftershock_count", F.lit(0)).cast("bigint").alias("early_aftershock_count"),
        F.coalesce("early_max_mag", F.lit(0.0)).alias("early_max_mag"),
        F.coalesce("early_mean_mag", F.lit(0.0)).alias("early_mean_mag"),
        F.coalesce("early_energy_sum", F.lit(0.0)).alias("early_energy_sum"),
        F.col("best").isNotNull().alias("has_target_aftershock"),
        (-F.col("best.neg_mag")).alias("target_max_mag"),
        days_after.alias("target_time_to_max_days"),
    )


def build_window_samples(events: DataFrame, radius_km: float = AFTERSHOCK_RADIUS_KM,
                         min_mag: float = MAINSHOCK_MIN_MAG,
                         max_depth_km: float = MAINSHOCK_MAX_DEPTH_KM) -> DataFrame:
    """The same rule over 168 h; an isolated mainshock is kept. Adds the window labels."""
    from tremorframe.operators.labels import window_labels

    seconds = 168 * 3600.0
    main = _claimed_out(
        _eligible(mainshocks(events, min_mag, max_depth_km), events, seconds, radius_km, min_mag), seconds, radius_km)
    return window_labels(main, events, radius_km=radius_km)


def holdout_truth(sequence_mains: DataFrame, catalog: DataFrame, obs_days: float = OBSERVATION_DAYS,
                  target_days: float = TARGET_DAYS, radius_km: float = AFTERSHOCK_RADIUS_KM) -> DataFrame:
    """Largest catalog event in (obs, target] days of each held-out mainshock, else 0 / 0."""
    obs_us = as_micros(obs_days * DAY_S)
    pairs = drop_near_anchor_time(
        interval_pairs(sequence_mains.select("mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"),
                       catalog, after_seconds=target_days * DAY_S, radius_km=radius_km))
    best = (
        pairs.filter(F.col("elapsed_us") > obs_us).groupBy("mainshock_id")
        .agg(F.min(F.struct((-F.col("mag")).alias("neg_mag"), F.col("elapsed_us").alias("us"))).alias("best"))
    )
    return sequence_mains.join(best, "mainshock_id", "left").select(
        *sequence_mains.columns,
        F.coalesce(-F.col("best.neg_mag"), F.lit(0.0)).alias("true_max_mag"),
        F.coalesce((F.col("best.us") - obs_us) / F.lit(DAY_S * 1e6), F.lit(0.0)).alias("true_time_to_max_days"),
    )
