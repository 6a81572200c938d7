"""Wait for the observation window of each mainshock on a live event stream.

Repeated and late events leave by the stream's watermark, with their ids in the state store. Every micro-batch adds its
events to those that an open window still needs, and the mainshocks whose window the watermark has passed by it meet
their followers once, in an interval join on cells with an aggregation per mainshock. The held events lie in two
folders of the checkpoint, written in turn, so a restart resumes from there and a replayed batch finds what it had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from tremorframe.constants import AFTERSHOCK_RADIUS_KM, MAINSHOCK_MAX_DEPTH_KM, MAINSHOCK_MIN_MAG
from tremorframe.functions.geo import CellGrid, haversine_km
from tremorframe.functions.seismic import moment
from tremorframe.functions.text import event_key
from tremorframe.functions.windows import clamp_mag, unlog_target

# Alert thresholds.
ALERT_MAG = 6.5
ALERT_DAYS = 1.0

WAIT_HOURS = 72.0
HELD = ["id", "time", "latitude", "longitude", "depth", "mag"]


def fresh_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, however often the feed repeats it; later than ``delay`` is dropped."""
    return events.withColumn("key", event_key(F.col("id"))).withWatermark("time", delay).dropDuplicatesWithinWatermark(["id"])


def completed_sequences(events: DataFrame, hours: float = WAIT_HOURS, radius_km: float = AFTERSHOCK_RADIUS_KM,
                        min_mag: float = MAINSHOCK_MIN_MAG, max_depth_km: float = MAINSHOCK_MAX_DEPTH_KM, due: Column | None = None) -> DataFrame:
    """One row per mainshock (of those that are ``due``, if given) with the aftershock statistics of its window.

    The mainshock meets its own record, so a quiet one has a row as well. Works on a batch table, and on a stream
    with a watermark on ``time``, which emits a mainshock when its window has passed.
    """
    grid = CellGrid(radius_km)
    band = grid.band(F.col("latitude"))
    seconds = int(hours * 3600)

    def bucket(time: Column, later: int = 0) -> Column:
        return F.floor((F.unix_micros(time) / 1_000_000 + later) / seconds)

    # A cell is kept by time bucket: a mainshock meets two windows' length of it, not all that is held.
    followers = events.select(
        F.col("time"), F.col("latitude"), F.col("longitude"), F.col("mag"), band.alias("_band"),
        grid.cell(F.col("longitude"), grid.ring_size(band)).alias("_cell"), bucket(F.col("time")).alias("_bucket"))
    anchors = (
        events.filter((F.col("mag") >= min_mag) & (F.col("depth") <= max_depth_km) & (F.lit(True) if due is None else due))
        .select(F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"),
                F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"),
                F.col("mag").alias("mainshock_mag"), F.col("depth").alias("mainshock_depth"))
        .withColumn("_b", F.explode(grid.bands_near(F.col("mainshock_lat"))))
        .withColumn("_c", F.explode(grid.cells_near(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("_b"),
                                                    grid.ring_size(F.col("_b")))))
        .withColumn("_t", F.explode(F.sequence(bucket(F.col("mainshock_time")), bucket(F.col("mainshock_time"), seconds)))))
    # The copies of a mainshock outgrow their size estimate, so a batch join is never a broadcast.
    met = (anchors if events.isStreaming else anchors.hint("merge")).join(
        followers,
        (F.col("_b") == F.col("_band")) & (F.col("_c") == F.col("_cell")) & (F.col("_t") == F.col("_bucket")) & (F.col("time") >= F.col("mainshock_time"))
        & (F.col("time") <= F.col("mainshock_time") + F.expr(f"INTERVAL {seconds} SECONDS")))
    near = met.filter(haversine_km(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("latitude"),
                                   F.col("longitude")) <= radius_km)
    after = F.col("time") > F.col("mainshock_time")
    keys = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "mainshock_mag", "mainshock_depth"]
    return near.groupBy(*keys).agg(
        F.count_if(after).alias("early_aftershock_count"),
        F.coalesce(F.max(F.when(after, F.col("mag"))), F.lit(0.0)).alias("early_max_mag"),
        F.sum(F.when(after, moment(F.col("mag"))).otherwise(0.0)).alias("early_energy_sum"))


def rule_predictor(completed: DataFrame) -> DataFrame:
    """Prediction without a model: M - 1.2, one day when there were aftershocks."""
    return completed.withColumns({
        "pred_mag": F.greatest(F.col("mainshock_mag") - 1.2, F.lit(0.0)),
        "pred_days": F.when(F.col("early_aftershock_count") > 0, 1.0).otherwise(0.0)})


def fitted_predictor(mag_model, time_model, max_days: float = 30.0) -> Callable[[DataFrame], DataFrame]:
    """Predictions of fitted pipelines that add ``mag`` and ``log_days`` to completed windows: the magnitude stays between 0 and half a unit
    above the mainshock, the time inside the target span."""
    def predict(completed: DataFrame) -> DataFrame:
        out = time_model.transform(mag_model.transform(completed))
        return out.withColumns({
            "pred_mag": clamp_mag(F.col("mag"), F.col("mainshock_mag")),
            "pred_days": F.least(F.greatest(unlog_target(F.col("log_days")), F.lit(0.0)), F.lit(max_days))}).drop("mag", "log_days")

    return predict


def alerts(predicted: DataFrame) -> DataFrame:
    """Rows that call for an alert, with the reasons and the severity."""
    strong = F.col("pred_mag") >= ALERT_MAG
    soon = (F.col("pred_days") > 0) & (F.col("pred_days") <= ALERT_DAYS)
    reasons = F.array_compact(F.array(F.when(strong, "strong aftershock"), F.when(soon, "within a day")))
    severity = F.when(strong & (F.col("pred_days") <= ALERT_DAYS), "HIGH").otherwise("MEDIUM")
    return predicted.filter(strong | soon).withColumns({"reasons": reasons, "severity": severity})


def event_table(mainshocks: DataFrame, aftershocks: DataFrame) -> DataFrame:
    """Mainshock and aftershock rows as one table; absent text columns are empty."""
    both = mainshocks.unionByName(aftershocks, allowMissingColumns=True)
    return both.fillna("", subset=[c for c, t in both.dtypes if t == "string"])


def start_monitor(events: DataFrame, results: str, checkpoint: str,
                  predictor: Callable[[DataFrame], DataFrame] = rule_predictor,
                  alert_path: str | None = None, every: str | None = None) -> StreamingQuery:
    """Append predictions (and alerts) of completed windows. Without ``every`` it drains the
    input and stops, which is also the backfill."""
    delay_ms = events.schema["time"].metadata["spark.watermarkDelayMs"]
    held_schema = StructType([StructField(n, events.schema[n].dataType) for n in HELD])
    window = F.expr(f"INTERVAL {int(WAIT_HOURS * 3600)} SECONDS")

    def held(number: int) -> tuple[DataFrame, Column]:
        """The events held after a batch, and the watermark, null without events."""
        kept = events.sparkSession.read.schema(held_schema).parquet(f"{checkpoint}/windows/{number % 2}")
        latest = kept.agg(F.floor(F.unix_micros(F.max("time")) / 1000)).first()[0]
        return kept, F.timestamp_millis(F.lit(None if latest is None else latest - delay_ms).cast("bigint"))

    def handle(batch: DataFrame, number: int) -> None:
        arrived, passed = batch.select(*HELD), F.lit(False)
        if number:
            before, mark = held(number - 1)
            still = F.coalesce(F.col("time") + window > mark, F.lit(True))  # all others are in windows that have passed
            arrived, passed = arrived.unionByName(before.filter(still)), ~still
        arrived.write.mode("overwrite").parquet(f"{checkpoint}/windows/{number % 2}")
        kept, mark = held(number)
        # A folder per batch, overwritten on a replay, keeps the output exactly once.
        rows = predictor(completed_sequences(kept, due=(F.col("time") + window <= mark) & ~passed)).persist()
        rows.write.mode("overwrite").parquet(f"{results}/batch={number}")
        if alert_path:
            alerts(rows).write.mode("overwrite").json(f"{alert_path}/batch={number}")
        rows.unpersist()

    writer = events.select(*HELD).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def status_counts(main: DataFrame, done: DataFrame, latest_time) -> DataFrame:
    """How many mainshocks are predicted, waiting for their window, or missing."""
    wait = F.col("mainshock_time") + F.expr("INTERVAL 72 HOURS")
    marked = main.join(done.select("mainshock_id", F.lit(True).alias("_done")), "mainshock_id", "left")
    status = F.when(F.col("_done"), "predicted").when(wait > latest_time, "waiting").otherwise("missing")
    return marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
