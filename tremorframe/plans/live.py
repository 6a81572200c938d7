"""Queries: the live monitor drained over the whole events table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tremorframe.functions.windows import log_target
from tremorframe.models.training import fit_pipelines
from tremorframe.operators.folds import with_time_rank
from tremorframe.operators.sequences import holdout_truth, mainshocks
from tremorframe.plans.inputs import BASE_SQL, catalog, log_moment, pairs_sql, rounded, table
from tremorframe.plans.landing import geojson
from tremorframe.session import ensure_checkpoint_dir
from tremorframe.sources import feeds
from tremorframe.streaming import monitor


#: Events of a document of the feed, which one task writes and one reads.
FEED_ROWS = 20_000


def _stream(spark, sf):
    """The events table as a stream, mapped to the catalog like the batch view."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(sf, pathGlobFilter="events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return raw.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("time"),
        (F.lit(-60.0) + F.pmod("user_id", F.lit(240)) * F.lit(0.5)).alias("latitude"),
        (F.lit(-170.0) + F.pmod(F.floor(F.col("user_id") / 240), F.lit(680)) * F.lit(0.5)).alias("longitude"),
        F.pmod("event_id", F.lit(90)).cast("double").alias("depth"),
        ((40 + F.floor(cents / 1150)) / F.lit(10.0)).alias("mag"))


def _drained(spark, sf, events=None, predictor=monitor.rule_predictor):
    root = os.path.join(ensure_checkpoint_dir(spark), f"monitor-{uuid.uuid4().hex}")
    events = _stream(spark, sf) if events is None else events
    query = monitor.start_monitor(monitor.fresh_events(events), f"{root}/results", f"{root}/checkpoint",
                                  predictor=predictor, alert_path=f"{root}/alerts")
    query.awaitTermination()
    return root


def _feed(spark, sf, days=3, rows=FEED_ROWS):
    """The catalog as GeoJSON documents, written one span of a few days after the other, and how many documents each span has. Every span but
    the first repeats a fifth of the one before it, so events come again, and late. A document has about ``rows`` events, some may have none."""
    folder = ensure_checkpoint_dir(spark)
    path, texts = f"{folder}/feed-{uuid.uuid4().hex}", f"{folder}/feed-texts-{uuid.uuid4().hex}"
    span = F.floor(F.unix_micros("time") / (days * 86_400_000_000))
    events = catalog(spark, sf).withColumn("span", span)
    again = events.filter(F.pmod(F.col("id").cast("bigint"), F.lit(5)) == 0).withColumn("span", F.col("span") + 1)
    counts = {r["span"]: r["count"] for r in events.groupBy("span").count().collect()}  # one for each few days of the feed
    parts = max(1, *[-(-n // rows) for n in counts.values()])
    documents = geojson(events.unionByName(again).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "span", "part")
    every = events.select("span").distinct().select("span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    documents = every.join(documents, ["span", "part"], "left").withColumn("value", F.coalesce("value", F.lit('{"features":[]}')))
    documents.write.partitionBy("span").parquet(texts)
    held = spark.read.schema("part long, value string, span long").parquet(texts)
    for number in sorted(n for n in counts if n is not None):
        held.filter(F.col("span") == number).drop("span").write.mode("append").partitionBy("part").text(path)
    return path, parts


def _results(spark, sf, events=None, predictor=monitor.rule_predictor):
    return spark.read.option("basePath", f"{(root := _drained(spark, sf, events, predictor))}/results").parquet(f"{root}/results")


def stream_window_complete(spark, sf):
    """Mainshocks whose 72 h have passed on the stream."""
    out = log_moment(_results(spark, sf), "early_energy_sum")
    return rounded(out.select("mainshock_id", "mainshock_mag", "early_aftershock_count", "early_max_mag", "early_energy_sum"))


def stream_feed_windows(spark, sf):
    """The same from a feed of several documents, those of a few days to a micro-batch, with repeated and late events."""
    path, parts = _feed(spark, sf)
    out = log_moment(_results(spark, sf, feeds.stream_feed(spark, path, files_per_batch=parts)), "early_energy_sum")
    return rounded(out.select("mainshock_id", "mainshock_mag", "early_aftershock_count", "early_max_mag", "early_energy_sum"))


MODEL_INPUTS = ["mainshock_mag", "mainshock_depth", "early_aftershock_count", "early_max_mag"]


def stream_model_predictions(spark, sf):
    """Completed windows of the stream predicted by models that were fitted on the batch table; whether they keep their bounds."""
    events = catalog(spark, sf)
    done = monitor.completed_sequences(events)
    truth = holdout_truth(mainshocks(events), events).select("mainshock_id", "true_max_mag", "true_time_to_max_days")
    rows = with_time_rank(done.join(truth, "mainshock_id"), "mainshock_time", "mainshock_id")
    models = fit_pipelines(rows, MODEL_INPUTS, {"mag": ("boosted", F.col("true_max_mag")), "log_days": ("boosted", log_target(F.col("true_time_to_max_days")))}, "row_index")
    out = _results(spark, sf, predictor=monitor.fitted_predictor(models["mag"], models["log_days"]))
    return out.select(
        "mainshock_id", "early_aftershock_count", F.col("pred_mag").between(0.0, F.col("mainshock_mag") + 0.5).alias("mag_in_bounds"),
        F.col("pred_days").between(0.0, 30.0).alias("days_in_bounds"))


def stream_alerts(spark, sf):
    """Alerts of the completed windows."""
    out = monitor.alerts(_results(spark, sf))
    return rounded(out.select("mainshock_id", "pred_mag", "pred_days", "severity", F.array_join("reasons", ",").alias("reasons")))


def stream_status(spark, sf):
    main = mainshocks(catalog(spark, sf))
    latest = catalog(spark, sf).agg(F.max("time")).first()[0]
    return monitor.status_counts(main, _results(spark, sf), F.lit(latest))


QUERIES = {f.__name__: f for f in (
    stream_window_complete, stream_feed_windows, stream_model_predictions, stream_alerts, stream_status)}

DONE = f"""{BASE_SQL}, {pairs_sql(72)},
done AS (SELECT * FROM main WHERE t0 + 73 * 3600000000 < (SELECT max(us) FROM catalog)),
st AS (SELECT mainshock_id, count(*) AS n, max(mag) AS mx, sum(pow(10.0, 1.5 * mag + 4.8)) AS en FROM pairs GROUP BY 1),
res AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(mx, 0.0) AS mx, coalesce(en, 0.0) AS en,
   greatest(m0 - 1.2::DOUBLE, 0.0) AS pm, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS pd FROM done d LEFT JOIN st USING (mainshock_id))"""

ORACLES = {
    "stream_window_complete": f"""WITH {DONE} SELECT mainshock_id, m0 AS mainshock_mag, n AS early_aftershock_count, mx AS early_max_mag,
  round(log10(en + 1.0), 6) AS early_energy_sum FROM res""",
    "stream_model_predictions": f"""WITH {DONE} SELECT mainshock_id, n AS early_aftershock_count, true AS mag_in_bounds, true AS days_in_bounds FROM res""",
    "stream_alerts": f"""WITH {DONE} SELECT mainshock_id, round(pm, 6) AS pred_mag, CAST(pd AS DOUBLE) AS pred_days,
  CASE WHEN pm >= 6.5 AND pd <= 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  concat_ws(',', CASE WHEN pm >= 6.5 THEN 'strong aftershock' END, CASE WHEN pd > 0 THEN 'within a day' END) AS reasons
FROM res WHERE pm >= 6.5 OR pd > 0""",
    "stream_status": f"""WITH {DONE} SELECT CASE WHEN mainshock_id IN (SELECT mainshock_id FROM done) THEN 'predicted'
  WHEN t0 + 72 * 3600000000 > (SELECT max(us) FROM catalog) THEN 'waiting' ELSE 'missing' END AS status, count(*) AS n FROM main GROUP BY 1""",
}
ORACLES["stream_feed_windows"] = ORACLES["stream_window_complete"]  # repeats and late rows change nothing
