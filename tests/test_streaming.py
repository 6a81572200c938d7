import json
import os
import time

from pyspark.sql import functions as F

from test_sources import feed
from tremorframe.sources import feeds
from tremorframe.streaming import monitor

HOUR = 3600_000


def documents():
    """Five documents in event-time order; the middle ones repeat earlier events."""
    t0 = 946684800000
    rows = [("m1", t0, 140.0, 35.0, 10.0, 7.8), ("a1", t0 + 2 * HOUR, 140.1, 35.1, 5.0, 5.0), ("far", t0 + 3 * HOUR, 20.0, 20.0, 5.0, 6.2),
            ("a2", t0 + 71 * HOUR, 140.0, 35.2, 5.0, 5.6), ("late", t0 + 73 * HOUR, 140.0, 35.0, 5.0, 5.9),
            ("m2", t0 + 100 * HOUR, 179.95, 10.0, 20.0, 6.3), ("a3", t0 + 101 * HOUR, -179.95, 10.0, 20.0, 4.2),
            ("end", t0 + 200 * HOUR, 0.0, 0.0, 5.0, 4.0)]
    return [rows[:3], rows[1:5], rows[4:6], rows[5:7], rows[7:]], rows


def test_stream_equals_batch(spark, tmp_path):
    docs, rows = documents()
    source = tmp_path / "feed"
    source.mkdir()
    for i, part in enumerate(docs):
        path = source / f"{i}.json"
        path.write_text(json.dumps(feed(part)))
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    events = monitor.fresh_events(feeds.stream_feed(spark, str(source), files_per_batch=1))
    query = monitor.start_monitor(events, str(tmp_path / "out"), str(tmp_path / "ck"), alert_path=str(tmp_path / "alerts"))
    query.awaitTermination()
    got = {r.mainshock_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = monitor.completed_sequences(feeds.read_feed(spark, str(source)).dropDuplicates(["id"]))
    want = {r.mainshock_id: r for r in batch.collect()}
    assert set(got) == {"m1", "far", "m2"} == set(want)
    for key, row in want.items():
        assert (got[key].early_aftershock_count, got[key].early_max_mag) == (row.early_aftershock_count, row.early_max_mag)
    assert got["m1"].early_aftershock_count == 2 and got["m2"].early_aftershock_count == 1
    raised = {r.mainshock_id: r for r in spark.read.json(str(tmp_path / "alerts")).collect()}
    assert set(raised) == {"m1", "m2"} and raised["m1"].severity == "HIGH" and raised["m2"].severity == "MEDIUM"


def test_restart_does_not_repeat(spark, tmp_path):
    docs, _ = documents()
    source = tmp_path / "feed"
    source.mkdir()

    def run():
        events = monitor.fresh_events(feeds.stream_feed(spark, str(source)))
        monitor.start_monitor(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    for i, part in enumerate(docs):
        (source / f"{i}.json").write_text(json.dumps(feed(part)))
        if i in (2, 4):
            run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in out.select("mainshock_id").collect()) == ["far", "m1", "m2"]


def test_events_are_held_once_and_only_while_a_window_needs_them(spark, tmp_path):
    """The stream keeps ids alone in its state; a batch's folder has the events of windows that are still open."""
    docs, _ = documents()
    source = tmp_path / "feed"
    source.mkdir()
    for i, part in enumerate(docs):
        path = source / f"{i}.json"
        path.write_text(json.dumps(feed(part)))
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    events = monitor.fresh_events(feeds.stream_feed(spark, str(source), files_per_batch=1))
    query = monitor.start_monitor(events, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    operators = {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]}
    assert operators == {"dedupeWithinWatermark"}
    last = max(p["batchId"] for p in query.recentProgress)
    held = [r.id for r in spark.read.parquet(str(tmp_path / "ck" / "windows" / str(last % 2))).collect()]
    assert "end" in held and "m1" not in held and len(held) == len(set(held))


def test_a_feed_span_is_cut_into_documents(spark, tmp_path):
    """Spans of many events are several documents, empty ones included, and each micro-batch takes whole spans."""
    from tremorframe.plans import live

    sf = str(tmp_path)
    rows = [(i, f"2024-01-{1 + i // 20:02d} {i % 20:02d}:00:00", i % 3, 300.0 if i % 10 == 0 else 5.0) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").selectExpr(
        "event_id", "CAST(t AS timestamp) ts", "user_id", "value").write.parquet(f"{sf}/events.parquet")
    path, parts = live._feed(spark, sf, rows=7)
    spans = {(r.time.toordinal() - 1) // 3 for r in live.catalog(spark, sf).select("time").collect()}
    assert parts > 1 and spark.read.text(path).count() == parts * len(spans)
    out = live._results(spark, sf, feeds.stream_feed(spark, path, files_per_batch=parts))
    want = monitor.completed_sequences(live.catalog(spark, sf), due=F.col("time") + F.expr("INTERVAL 73 HOURS") <= F.lit("2024-01-10 19:00:00").cast("timestamp"))
    columns = ["mainshock_id", "early_aftershock_count", "early_max_mag"]
    assert sorted(out.select(*columns).collect()) == sorted(want.select(*columns).collect()) != []


def test_alert_rules(spark):
    df = spark.createDataFrame([("a", 6.6, 0.5), ("b", 6.6, 3.0), ("c", 5.0, 0.5), ("d", 5.0, 0.0), ("e", 5.0, 2.0), ("f", 6.5, 0.0)],
                               "id string, pred_mag double, pred_days double")
    got = {r.id: (r.severity, len(r.reasons)) for r in monitor.alerts(df).collect()}
    assert got == {"a": ("HIGH", 2), "b": ("MEDIUM", 1), "c": ("MEDIUM", 1), "f": ("HIGH", 1)}


def test_status_counts(spark, make_catalog):
    from tremorframe.operators.sequences import mainshocks

    events = make_catalog([(i, f"2000-01-{d:02d} 00:00:00", 1.0, 1.0, 5.0, 6.5) for i, d in (("p", 1), ("m", 2), ("w", 9))])
    main = mainshocks(events)
    counts = monitor.status_counts(main, main.filter("mainshock_id = 'p'"), F.to_timestamp(F.lit("2000-01-10")))
    assert {r.status: r.n for r in counts.collect()} == {"predicted": 1, "missing": 1, "waiting": 1}


def test_event_table_pads_text(spark):
    a = spark.createDataFrame([("m", 6.5, "place")], "id string, mag double, place string")
    b = spark.createDataFrame([("x", 4.5)], "id string, mag double")
    assert [r.place for r in monitor.event_table(a, b).orderBy("id").collect()] == ["place", ""]
