"""Joins to reference catalogs: focal mechanisms and plate boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import FOCAL_NUMERIC, PLATE_TYPES
from tremorframe.functions.focal import fault_indicators, fault_type
from tremorframe.functions.geo import mercator_x_m, mercator_y_m, point_segment_m
from tremorframe.operators.spatial_join import interval_pairs

KEYS = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"]


def _best_focal(main: DataFrame, focal: DataFrame, seconds: float, radius_km: float, by_time: bool) -> DataFrame:
    known = [c for c in (*FOCAL_NUMERIC, "fault_type") if c in focal.columns]
    rows = focal.dropna(subset=["time", "latitude", "longitude"]).select("time", "latitude", "longitude", *known)
    pairs = interval_pairs(main.select(*KEYS), rows, before_seconds=seconds, after_seconds=seconds,
                           radius_km=radius_km, closed_start=True)
    gap = F.abs(F.col("elapsed_us"))
    tie = F.unix_micros("time")
    order = F.struct(gap, "distance_km", tie) if by_time else F.struct("distance_km", tie)
    picked = F.struct(gap.alias("gap_us"), "distance_km", *known)
    return pairs.groupBy("mainshock_id").agg(F.min_by(picked, order).alias("_f"))


def _numbers(focal: DataFrame) -> list:
    return [
        (F.col(f"_f.{c}") if c in focal.columns else F.lit(None).cast("double")).alias(c) for c in FOCAL_NUMERIC
    ]


def with_focal_asof(main: DataFrame, focal: DataFrame, tolerance_seconds: float = 60.0,
                    radius_km: float = 50.0) -> DataFrame:
    """Focal row closest in time, then in distance, within the tolerances; else fixed defaults."""
    joined = main.join(_best_focal(main, focal, tolerance_seconds, radius_km, True), "mainshock_id", "left")
    fault = fault_type(F.col("_f.rake1"))
    return joined.select(
        *main.columns, *_numbers(focal), fault.alias("fault_type"), *fault_indicators(fault),
        (F.col("_f.gap_us") / F.lit(1e6)).alias("gcmt_time_diff_seconds"),
        F.col("_f.distance_km").alias("gcmt_distance_km"),
        F.coalesce(F.col("_f.strike1").isNotNull(), F.lit(False)).alias("focal_mechanism_valid"),
    )


def with_focal_nearest(main: DataFrame, focal: DataFrame, window_days: float = 1.0,
                       radius_km: float = 200.0) -> DataFrame:
    """Nearest focal row within a day and the radius, by distance only; uses its stored class."""
    joined = main.join(_best_focal(main, focal, window_days * 86400.0, radius_km, False), "mainshock_id", "left")
    stored = F.col("_f.fault_type") if "fault_type" in focal.columns else F.lit("UNK")
    code = F.when(stored.isin("NF", "SS", "TF"), stored).otherwise("UNK")
    return joined.select(
        *main.columns, *_numbers(focal),
        *[(code == c).cast("int").alias(f"fault_type_{c}") for c in ("NF", "SS", "TF", "UNK")],
        F.coalesce(F.col("_f.strike1").isNotNull(), F.lit(False)).alias("focal_mechanism_valid"),
    )


def nearest_boundary(main: DataFrame, segments: DataFrame, first_cell_km: float = 250.0,
                     levels: int = 5, growth: int = 4) -> DataFrame:
    """Distance to and type of the nearest boundary segment in the Web-Mercator plane.

    Segments are laid on square cells; a point looks at its 3 x 3 cells, which is enough
    when something lies within one cell width. Points still open go on to cells four times
    as wide, and to a single world cell at the end, so every point gets its exact answer
    and points near a boundary never meet the far segments. Resolved points carry no key.
    """
    points = main.filter(F.col("mainshock_lat").isNotNull() & F.col("mainshock_lon").isNotNull()).select(
        "mainshock_id", mercator_x_m(F.col("mainshock_lon")).alias("px"),
        mercator_y_m(F.col("mainshock_lat")).alias("py"))
    lines = segments.select(
        "segment_id", "plate_type",
        mercator_x_m(F.col("lon1")).alias("ax"), mercator_y_m(F.col("lat1")).alias("ay"),
        mercator_x_m(F.col("lon2")).alias("bx"), mercator_y_m(F.col("lat2")).alias("by"))
    blank = F.lit(None).cast("struct<d:double,segment_id:bigint,plate_type:string>")
    state = points.withColumn("best", blank)
    for level in range(levels):
        width = first_cell_km * 1000.0 * growth**level
        last = level == levels - 1
        if last:
            cells_of_line = F.array(F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")))
            cells_of_point = cells_of_line
        else:
            def cell(value):
                return F.floor(value / F.lit(width)).cast("bigint")

            xs = F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx")))
            ys = F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))
            cells_of_line = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(
                x.alias("x"), y.alias("y")))))
            near_x = F.sequence(cell(F.col("px")) - 1, cell(F.col("px")) + 1)
            near_y = F.sequence(cell(F.col("py")) - 1, cell(F.col("py")) + 1)
            cells_of_point = F.flatten(F.transform(near_x, lambda x: F.transform(near_y, lambda y: F.struct(
                x.alias("x"), y.alias("y")))))
        resolved = F.coalesce(F.col("best.d") <= F.lit(width / growth), F.lit(False))
        # A settled point keeps a key of its own that no segment has, so these rows stay spread out.
        alone = F.array(F.struct(F.xxhash64("mainshock_id").alias("x"), F.lit(-(1 << 40)).alias("y")))
        keyed = state.withColumn("_c", F.explode(F.when(resolved, alone).otherwise(cells_of_point)))
        gridded = lines.withColumn("_c", F.explode(cells_of_line))
        met = keyed.join(gridded, "_c", "left")
        candidate = F.when(F.col("segment_id").isNotNull(), F.struct(
            point_segment_m(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"),
            F.col("segment_id").cast("bigint").alias("segment_id"), F.col("plate_type").alias("plate_type")))
        state = met.groupBy("mainshock_id", "px", "py").agg(
            F.min(F.least(candidate, F.col("best"))).alias("best"))
    kind = F.when(F.col("best.plate_type").isin(*PLATE_TYPES), F.col("best.plate_type")).otherwise("UNK")
    answer = state.select("mainshock_id", (F.col("best.d") / 1000.0).alias("plate_boundary_distance_km"),
                          kind.alias("nearest_plate_boundary_type"))
    out = main.join(answer, "mainshock_id", "left").withColumn(
        "nearest_plate_boundary_type", F.coalesce("nearest_plate_boundary_type", F.lit("UNK")))
    return out.withColumns({
        f"plate_type_{t}": (F.col("nearest_plate_boundary_type") == t).cast("int") for t in PLATE_TYPES})
