"""Event-level features and the causal event graph of each sequence.

All events of a sequence take part; a caller who wants a tensor of fixed length passes ``limit``.
Sums over a sequence are grouped (and combined on the map side); position and event before come from
range partitions, so a sequence of any length is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorframe.functions.geo import east_km, north_km
from tremorframe.functions.seismic import moment
from tremorframe.operators.ranking import numbered_with_previous
from tremorframe.operators.spatial_join import dealt, first_by_time, hot_keys, repeated

#: Targets of a sequence that one task of the edge join meets.
EDGE_TARGETS = 20_000


def event_features(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Twelve features per event, of the first ``limit`` events if given. ``pairs`` carries the mainshock columns with its magnitude.

    The local b proxy uses one weight per event that cancels out, so it is a function of the
    magnitude sum alone; it is kept as published and is zero below three events.
    """
    capped = pairs if limit is None else first_by_time(pairs, limit).drop("position")
    days = F.col("elapsed_us") / F.lit(86_400_000_000.0)
    capped = numbered_with_previous(capped.withColumn("dt_days", days), "mainshock_id", [F.col("elapsed_us"), F.col("id")], "dt_days")
    whole = capped.groupBy("mainshock_id").agg(
        F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("_count"), F.sum("mag").alias("_mag_sum"),
        F.sum(moment(F.col("mag"))).alias("_m_sum"))
    x = east_km(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("longitude"))
    y = north_km(F.col("mainshock_lat"), F.col("latitude"))
    base = capped.select("mainshock_id", "mainshock_mag", "id", "row_index", "previous", "distance_km", "depth", "mag", "dt_days",
                         x.alias("rel_x_km"), y.alias("rel_y_km"), moment(F.col("mag")).alias("_m"))
    n = F.col("_count")
    previous = F.coalesce("previous", F.lit(0.0))
    mag_sum = F.col("_mag_sum")
    return base.join(whole, "mainshock_id").select(
        "mainshock_id", "id", (F.col("row_index") - F.col("_first") + 1).alias("position"), "dt_days", F.log1p("dt_days").alias("log_dt_days"),
        "rel_x_km", "rel_y_km", "distance_km", F.coalesce("depth", F.lit(0.0)).alias("depth"), "mag",
        F.atan2("rel_x_km", "rel_y_km").alias("azimuth_rad"),
        (F.col("mag") - F.col("mainshock_mag")).alias("mag_diff"),
        F.when(n >= 2, (F.col("dt_days") - previous) * 24.0).otherwise(0.0).alias("inter_event_interval_hours"),
        F.when(n >= 3, F.lit(1.0 / math.log(10)) / (mag_sum + 1e-12)).otherwise(0.0).alias("local_b_value_proxy"),
        (F.col("_m") / F.greatest(F.col("_m_sum"), F.lit(1e-12))).alias("normalized_energy"),
    )


def graph_edges(features: DataFrame, radius_km: float = 100.0, sigma_km: float = 50.0, mc: float = 2.5,
                alpha: float = math.log1p(math.exp(0.5)), strike_deg: str | None = None,
                targets: int = EDGE_TARGETS) -> DataFrame:
    """Edges from earlier to later events of a sequence with normalised weights.

    Weight = distance kernel x strike factor x magnitude factor; incoming weights of a target
    are divided by their sum. A sequence of more than ``targets`` events is split by its targets. The result has an
    edge for each pair, which is the feature: give features of few events per sequence (``limit``) where that is too much.
    """
    columns = ["mainshock_id", "id", "dt_days", "rel_x_km", "rel_y_km", "mag"]
    extra = [strike_deg] if strike_deg else []
    src = features.select(F.col("mainshock_id"), *[F.col(c).alias(f"s_{c}") for c in columns[1:]])
    dst = features.select(F.col("mainshock_id"), *[F.col(c).alias(f"d_{c}") for c in columns[1:]], *extra)
    dx, dy = F.col("d_rel_x_km") - F.col("s_rel_x_km"), F.col("d_rel_y_km") - F.col("s_rel_y_km")
    squared = dx * dx + dy * dy
    weight = F.exp(-squared / (2 * sigma_km**2)) * F.exp(F.lit(alpha) * (F.col("s_mag") - mc))
    if strike_deg:
        theta = F.atan2(dx, dy) - F.radians(F.col(strike_deg))
        weight = weight * (1.0 + F.cos(2.0 * theta)) * 0.5
    hot = hot_keys(dst, ["mainshock_id"], targets)
    edges = (
        repeated(src, hot, ["mainshock_id"]).hint("merge").join(dealt(dst, hot, ["mainshock_id"]), ["mainshock_id", "_salt"])
        .filter((F.col("s_dt_days") < F.col("d_dt_days")) & (F.sqrt(squared) < radius_km))
        .select("mainshock_id", F.col("s_id").alias("src"), F.col("d_id").alias("dst"), weight.alias("raw_weight"))
    )
    incoming = Window.partitionBy("mainshock_id", "dst")
    total = F.greatest(F.sum("raw_weight").over(incoming), F.lit(1e-8))
    return edges.withColumn("weight", F.col("raw_weight") / total)


def augmented(features: DataFrame, seed: int, drop_rate: float = 0.10, below_max: float = 1.5,
              noise_km: float = 2.0) -> DataFrame:
    """Drop a share of the small events and shift the rest, reproducibly for a seed.

    The draw of an event is an MD5 of its id and the seed, so it does not depend on the
    partitioning. Dropped events keep their row with zeroed values.
    """
    top = features.groupBy("mainshock_id").agg(F.max("mag").alias("_top"))

    def draw(tag: str):
        digits = F.substring(F.md5(F.concat_ws("|", "mainshock_id", "id", F.lit(tag), F.lit(str(seed)))), 1, 8)
        return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))

    def normal(tag: str):
        return F.sqrt(-2.0 * F.log(draw(f"{tag}-r"))) * F.cos(2.0 * math.pi * draw(f"{tag}-a"))

    dropped = (F.col("mag") < F.col("_top") - below_max) & (draw("drop") < drop_rate)
    values = [f.name for f in features.schema.fields
              if f.dataType.typeName() == "double" and f.name not in ("rel_x_km", "rel_y_km")]
    kept = [c for c in features.columns if c not in values and c not in ("rel_x_km", "rel_y_km")]
    moved = [
        F.when(F.col("dropped"), F.lit(0.0)).otherwise(F.col(c) + normal(c) * noise_km).alias(c)
        for c in ("rel_x_km", "rel_y_km")
    ]
    marked = features.join(top, "mainshock_id").withColumn("dropped", dropped)
    return marked.select(
        *kept, "dropped", *moved,
        *[F.when(F.col("dropped"), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in values])
