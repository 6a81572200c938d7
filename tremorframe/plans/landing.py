"""Queries: what sources and sinks write and read, on files that Spark makes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tremorframe.operators import features as ft
from tremorframe.operators import folds as fd
from tremorframe.operators import imputation as imp
from tremorframe.operators import tables as tb
from tremorframe.plans.inputs import BASE_SQL, DATED_SQL, PREDICTIONS_SQL, catalog, dated_rows, predictions, rounded
from tremorframe.plans.scoring import LINES, line_inputs
from tremorframe.session import ensure_checkpoint_dir
from tremorframe.sinks import predictions as sink
from tremorframe.sinks.named_files import write_named_files
from tremorframe.sources import catalogs, feeds, focal
from tremorframe.sources.predictions import TRUTH_SCHEMA, read_oof, read_prediction_lines, read_truth


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _view(events):
    return events.select("id", F.unix_micros("time").alias("us"), "latitude", "longitude", "depth", "mag")


def _stamp(form):
    return F.date_format("time", form)


def csv_catalog(spark, sf):
    """A header CSV with alias columns and one text time, read back."""
    path = _place(spark, "catalog-csv")
    catalog(spark, sf).select("id", _stamp("yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.col("latitude").alias("Lat"), F.col("longitude").alias("Lon"),
                              F.col("depth").alias("Depth"), F.col("mag").alias("Mag")).write.option("header", True).csv(path)
    return _view(catalogs.read_catalog(spark, path))


def csv_calendar_catalog(spark, sf):
    """The layout with Year to Second columns."""
    path = _place(spark, "calendar-csv")
    parts = {"Year": "yyyy", "Month": "M", "Day": "d", "Hour": "H", "Minute": "m", "Second": "s.SSSSSS"}
    catalog(spark, sf).select("id", *[_stamp(f).alias(c) for c, f in parts.items()], "latitude", "longitude", "depth", "mag") \
        .write.option("header", True).csv(path)
    return _view(catalogs.read_catalog(spark, path))


def csv_sequences(spark, sf):
    """Files named by their sequence (here: the depth), with Date and Time columns and no depth column needed."""
    path = _place(spark, "sequence-csv")
    named = catalog(spark, sf).select("id", _stamp("yyyy/MM/dd").alias("Date"), _stamp("HH:mm:ss.SSSSSS").alias("Time"), "latitude", "longitude", "depth", "mag",
                                      F.concat(F.lit("s"), F.col("depth").cast("int")).alias("_s"))
    named.repartition("_s").write.option("header", True).partitionBy("_s").csv(path)
    raw = catalogs.read_csv(spark, path)
    return catalogs.normalize_events(raw, need_depth=False, extra=["_s"]).select(
        "id", F.unix_micros("time").alias("us"), "latitude", "longitude", "mag", F.col("_s").alias("sequence_id"))


def landed_extracts(spark, sf):
    """Extracts with their own optional columns, united and filtered as a landed folder."""
    events = catalog(spark, sf).withColumn("time", _stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    shallow = events.filter("depth < 30").withColumn("place", F.lit("x"))
    deep = events.filter("depth >= 30").withColumn("magType", F.lit("mw"))
    path = _place(spark, "extract-csv")
    catalogs.union_extracts(shallow, deep).write.option("header", True).csv(path)
    return _view(catalogs.landed_catalog(spark, path, 5.0, 70.0))


def catalog_store(spark, sf):
    """The catalog written by year and read for a span of time."""
    path = _place(spark, "catalog-store")
    catalogs.write_catalog(catalog(spark, sf), path)
    return _view(catalogs.catalog_between(spark, path, "2024-01-05", "2024-01-20"))


def geojson(events, *document):
    """The columns of ``document`` and ``value``: a GeoJSON text for each of their values; times in milliseconds."""
    feature = F.struct(
        F.col("id"), F.struct(F.unix_millis("time").alias("time"), "mag", F.lit("p").alias("place"), F.lit("earthquake").alias("type"), F.lit("").alias("url")).alias("properties"),
        F.struct(F.array("longitude", "latitude", "depth").alias("coordinates")).alias("geometry"))
    return events.groupBy(*document).agg(F.collect_list(feature).alias("features")).select(*document, F.to_json(F.struct("features")).alias("value"))


def feed_catalog(spark, sf):
    """The feed, a file per document, read back as events."""
    path = _place(spark, "feed")
    documents = geojson(catalog(spark, sf).withColumn("document", F.pmod(F.xxhash64("id"), F.lit(64))), "document")
    documents.repartition("document").write.partitionBy("document").text(path)
    return _view(feeds.read_feed(spark, path))


def ndk_catalog(spark, sf):
    """The catalog as five-line focal records, read in ranges of bytes that cut records anywhere."""
    path = _place(spark, "ndk")

    def line(*parts):
        return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    place = [F.format_string("%.2f", c) for c in ("latitude", "longitude", "depth")]
    rake = F.pmod(F.col("id").cast("bigint"), F.lit(360)) - 180
    power = F.floor("mag") + 20
    lines = [
        line("PDEW", _stamp("yyyy/MM/dd HH:mm:ss.S"), *place, "0.0 7.5 PLACE"), line(F.col("id"), "B: 4 4 27 S: 27 33 50"), line("CENTROID: -0.3 0.9"),
        line(power.cast("string"), "1.000 0.1 -0.500 0.1 -0.500 0.1 0.200 0.1 0.100 0.1 0.050 0.1"),
        line("V10 1.581 56 12 -0.537 23 140 -1.044 24 241 1.310 9 29", rake.cast("string"), "133 72 66")]
    catalog(spark, sf).select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    read = focal.read_ndk(spark, path, range_bytes=65_536)
    return rounded(read.select(F.col("event_name").alias("id"), F.unix_micros("time").alias("us"), "latitude", "longitude", "depth", "mw", "rake1"))


def truth_file(spark, sf):
    """Truth rows of every prediction, as a header CSV."""
    path = _place(spark, "truth")
    rows = predictions(spark, sf).select(F.col("id").alias("mainshock_id"), "window", "main_mag", "true_mag", "true_hours")
    rows.write.option("header", True).csv(path)
    names = [f.split()[0] for f in TRUTH_SCHEMA.split(", ")]
    return rounded(read_truth(spark, path).select(*names))


def oof_file(spark, sf):
    """A model's out-of-fold table, written by year of its time, read with its column check; results are appended twice."""
    path, results = _place(spark, "oof"), _place(spark, "results")
    d = dated_rows(spark, sf).select(
        F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"), F.col("true_mag").alias("target_max_mag"),
        F.col("true_days").alias("target_time_to_max_days"), F.col("mag_a").alias("a_pred_mag"), F.col("days_a").alias("a_pred_time"))
    sink.write_table(d, path, "mainshock_time")
    oof = read_oof(spark, path, "a")
    for part in (oof.filter("year < 1996"), oof.filter("year >= 1996")):
        sink.append_results(sink.submission(part.withColumnsRenamed({"a_pred_mag": "pred_mag", "a_pred_time": "pred_time"})), results)
    read = spark.read.parquet(results)
    return rounded(read.filter("recorded_at IS NOT NULL").drop("recorded_at"))


def named_prediction_files(spark, sf):
    """A file per mainshock and kind, written under its own name and read back."""
    path = _place(spark, "package")
    write_named_files(sink.file_names(sink.prediction_rows(line_inputs(spark, sf))), path, ["line_no"])
    return read_prediction_lines(spark, path).select("file_name", "line")


def single_horizon_lines(spark, sf):
    """One line per prediction, in the order of tokens, written and read."""
    path = _place(spark, "horizon")
    p = dated_rows(spark, sf).select(
        "id", F.col("time").alias("mainshock_time"), F.lit(10.5).alias("mainshock_lon"), F.lit(-20.25).alias("mainshock_lat"),
        F.col("main_mag").alias("mainshock_mag"), F.lit("H168").alias("window"), F.col("true_mag").alias("pred_mag"), F.lit(12.0).alias("pred_hours"))
    sink.write_single_horizon(sink.prediction_rows(p), path)
    line = F.split("value", " ")
    return spark.read.text(path).select(F.col("value").alias("line"), F.size(line).cast("long").alias("tokens")).groupBy("tokens").agg(
        F.count("*").alias("lines"))


def earliest_rows(spark, sf):
    """The first hundred events."""
    return _view(tb.earliest_rows(catalog(spark, sf), "time", 100, "id"))


def training_rows(spark, sf):
    """Rows that have all targets; sequences without an aftershock drop out of the regression table."""
    d = _with_holes(spark, sf)
    rows = d.select("id", "time", F.col("mag_a").alias("target_max_mag"), F.col("days_b").alias("target_time_to_max_days"),
                    (F.col("main_mag") >= 7).alias("has_target_aftershock"))
    return ft.regression_rows(rows.withColumnRenamed("time", "mainshock_time")).select("id", "target_max_mag", F.round("target_time_to_max_days", 6).alias("days"))


def schema_gaps(spark, sf):
    """Columns that an inference table misses or has too much, beside how many rows it has."""
    d = dated_rows(spark, sf)
    gap = ft.schema_gap(d.columns, ["main_mag", "mag_a", "mag_b", "mag_c", "mag_d", "days_a", "days_b", "omori_p"])
    n = d.agg(F.count("*").alias("n"))
    return n.select(F.array_join(F.array(*[F.lit(c) for c in gap["missing"]]), ",").alias("missing"),
                    F.array_contains(F.array(*[F.lit(c) for c in gap["extra"]]), "days_c").alias("extra_days_c"), "n")


HOLES = {"mag_a": ("id", 7), "days_b": ("id", 3), "main_mag": (None, 0), "days_a": ("id", 2)}


def _with_holes(spark, sf):
    d = dated_rows(spark, sf)
    return d.withColumns({c: F.when(F.col(by) % n != 0, F.col(c)) for c, (by, n) in HOLES.items() if by})


def fold_preprocessors(spark, sf):
    """Fill values and scales of every fold, from its own training rows."""
    ranked = fd.with_time_rank(_with_holes(spark, sf), "time", "id")
    return rounded(imp.fold_preprocessors(ranked, fd.plan_folds(ranked), list(HOLES), priors={"days_a": 5.0}))


QUERIES = {
    f.__name__: f for f in (
        csv_catalog, csv_calendar_catalog, csv_sequences, landed_extracts, catalog_store, feed_catalog, ndk_catalog, truth_file, oof_file, named_prediction_files, single_horizon_lines,
        earliest_rows, training_rows, schema_gaps, fold_preprocessors,
    )
}

VIEW = "id, us, latitude, longitude, depth, mag"
HOLED = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {by} % {n} <> 0 THEN {c} END AS {c}" for c, (by, n) in HOLES.items() if by) + ") FROM dated"


def _fold_sql() -> str:
    """Training rows of each fold with the gap that leaves enough of them, then quantiles of the filled values."""
    long = " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, {c} AS v FROM train" for c in HOLES)
    return f"""WITH {DATED_SQL}, holed AS ({HOLED}),
ranked AS (SELECT *, row_number() OVER (ORDER BY time, id) - 1 AS i, count(*) OVER () AS total FROM holed),
bounds AS (SELECT f AS fold, total - (6 - f) * (total // 6) AS start FROM (SELECT max(total) AS total FROM ranked), range(1, 6) t(f)),
starts AS (SELECT fold, start, time AS first FROM bounds JOIN ranked ON i = start),
counts AS (SELECT fold, start, first, count(*) FILTER (time <= first - INTERVAL 30 DAY) AS c30, count(*) FILTER (time <= first - INTERVAL 7 DAY) AS c7
  FROM starts JOIN ranked ON i < start GROUP BY ALL),
gaps AS (SELECT fold, start, CASE WHEN c30 >= greatest(10, start * 0.2) THEN first - INTERVAL 30 DAY
  WHEN c7 >= greatest(5, start * 0.1) THEN first - INTERVAL 7 DAY ELSE first + INTERVAL 1000 DAY END AS last FROM counts),
train AS (SELECT fold, {', '.join(HOLES)} FROM gaps JOIN ranked ON i < start AND time <= last),
long AS ({long}),
fills AS (SELECT fold, feature, count(v) AS n, count(*) - count(v) AS nulls, CASE WHEN feature = 'days_a' THEN 5.0::DOUBLE ELSE coalesce(quantile_cont(v, 0.5), 0) END AS fill FROM long GROUP BY fold, feature),
s AS (SELECT feature, fold, n, nulls, fill, quantile_cont(coalesce(v, fill), 0.5) AS centre, quantile_cont(coalesce(v, fill), 0.75) - quantile_cont(coalesce(v, fill), 0.25) AS scale,
  avg(coalesce(v, fill)) AS mean, stddev_pop(coalesce(v, fill)) AS deviation FROM long JOIN fills USING (fold, feature) GROUP BY ALL)
SELECT feature, CAST(fold AS INT) AS fold, n, nulls, round(fill, 6) AS fill, round(centre, 6) AS centre, round(CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) AS scale, round(mean, 6) AS mean,
  round(CASE WHEN deviation = 0 THEN 1 ELSE deviation END, 6) AS deviation FROM s"""


ORACLES = {
    "csv_catalog": f"WITH {BASE_SQL} SELECT {VIEW} FROM catalog",
    "csv_calendar_catalog": f"WITH {BASE_SQL} SELECT {VIEW} FROM catalog",
    "csv_sequences": f"WITH {BASE_SQL} SELECT id, us, latitude, longitude, mag, 's' || CAST(depth AS INT) AS sequence_id FROM catalog",
    "landed_extracts": f"WITH {BASE_SQL} SELECT {VIEW} FROM catalog WHERE mag >= 5 AND depth <= 70",
    "catalog_store": f"WITH {BASE_SQL} SELECT {VIEW} FROM catalog WHERE us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-20')",
    "feed_catalog": f"WITH {BASE_SQL} SELECT id, us // 1000 * 1000 AS us, latitude, longitude, depth, mag FROM catalog",
    "ndk_catalog": f"""WITH {BASE_SQL} SELECT id, us // 100000 * 100000 AS us, latitude, longitude, depth,
  round((2.0::DOUBLE / 3.0) * (log10(1.31::DOUBLE) + floor(mag) + 20 - 16.1::DOUBLE), 6) AS mw, ((CAST(id AS BIGINT) % 360) - 180)::DOUBLE AS rake1 FROM catalog""",
    "truth_file": f"""WITH {PREDICTIONS_SQL}
SELECT id AS mainshock_id, "window", round(main_mag, 6) AS main_mag, round(true_mag, 6) AS true_mag, round(true_hours, 6) AS true_hours FROM preds""",
    "oof_file": f"WITH {DATED_SQL} SELECT id AS mainshock_id, round(mag_a, 6) AS predicted_max_mag, round(days_a, 6) AS predicted_time_to_max FROM dated",
    "named_prediction_files": f"""WITH {LINES}
SELECT token || '-' || file_kind || '.csv' AS file_name, concat_ws(' ', token, lon, lat, mm, pm, '(Ms)', stamp) AS line FROM lines""",
    "single_horizon_lines": "SELECT CAST(7 AS BIGINT) AS tokens, count(*) AS lines FROM orders",
    "earliest_rows": f"WITH {BASE_SQL} SELECT {VIEW} FROM catalog ORDER BY us, id LIMIT 100",
    "training_rows": f"""WITH {DATED_SQL}, holed AS ({HOLED})
SELECT id, mag_a AS target_max_mag, round(days_b, 6) AS days FROM holed WHERE mag_a IS NOT NULL AND days_b IS NOT NULL AND main_mag >= 7""",
    "schema_gaps": "SELECT 'omori_p' AS missing, true AS extra_days_c, count(*) AS n FROM orders",
    "fold_preprocessors": _fold_sql(),
}
