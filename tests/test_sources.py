import json

import pytest
from pyspark.sql import functions as F

from tremorframe.operators import reference
from tremorframe.sinks import predictions as sink
from tremorframe.sources import boundaries, catalogs, feeds, focal, predictions


def test_three_layouts(spark):
    a = spark.createDataFrame([("2000-01-01T00:00:00.5Z", "1", "2", "5", "10", "k"), ("bad", "1", "2", "5", "10", "k2")],
                              "time string, latitude string, longitude string, mag string, depth string, id string")
    rows = catalogs.normalize_events(a).collect()
    assert len(rows) == 1 and rows[0].id == "k" and rows[0].time.microsecond == 500000
    b = spark.createDataFrame([("2012-03-12", "21:43:35", "99.15", "2.73", "171.4", "4.4"), ("2012-03-12", "21:43:36", "99.15", "2.73", "", "4.4")],
                              "Date string, Time string, Lon string, Lat string, Depth string, Mag string")
    assert [r.id for r in catalogs.normalize_events(b).collect()] == ["20120312214335_eq"]
    assert catalogs.normalize_events(b, need_depth=False).count() == 2
    c = spark.createDataFrame([(2001, 1, 26, 3, 16, 40, 70.23, 23.42, 16.0, 7.6), (2001, 13, 26, 3, 16, 40, 70.23, 23.42, 16.0, 7.6)],
                              "Year int, Month int, Day int, Hour int, Minute int, Second int, Lon double, Lat double, Depth double, Mag double")
    row = catalogs.normalize_events(c).collect()
    assert len(row) == 1 and row[0].id == "20010126031640_eq" and row[0].latitude == 23.42
    with pytest.raises(ValueError):
        catalogs.normalize_events(c.drop("Year"))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([("2000-01-01", 1.0, 2.0, float("nan"), 5.0), ("2000-01-02", 1.0, 2.0, 3.0, float("nan"))],
                               "time string, latitude double, longitude double, depth double, mag double")
    assert catalogs.normalize_events(df, need_depth=False).first().depth is None
    assert catalogs.normalize_events(df).count() == 0


def test_sequence_folder_with_byte_order_mark(spark, fixtures):
    rows = catalogs.read_sequences(spark, f"{fixtures}/sequences")
    assert {r[0] for r in rows.select("sequence_id").distinct().collect()} == {"20201030115127_eq", "20220905045218_eq"}
    assert rows.filter(F.col("mag").isNull()).count() == 0


def test_landed_catalog_round_trip(spark, tmp_path):
    for year in (2001, 2002):
        (tmp_path / f"{year}.csv").write_text(
            "time,latitude,longitude,depth,mag\n" + "".join(f"{year}-0{m}-01T00:00:00Z,1.0,2.0,{10 * m},{4 + m / 2}\n" for m in range(1, 8)))
    events = catalogs.landed_catalog(spark, str(tmp_path), 5.0, 60.0)
    assert events.count() == 10 and events.select("id").distinct().count() == 10
    catalogs.write_catalog(events, str(tmp_path / "out"))
    part = catalogs.catalog_between(spark, str(tmp_path / "out"), "2002-01-01", "2002-05-01")
    assert part.count() == 3
    assert "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


NDK = """PDEW 2024/01/01 07:10:09.5  37.49  137.27  10.0 0.0 7.5 NOTO
C202401010710A B:  4    4  27 S: 27   33  50 M:  0    0   0 CMT: 1 TRIHD:  0.6
CENTROID:     -0.3 0.9  13.76 0.06  -89.08 0.09 162.8 12.5 FREE S-20050322125201
27  1.000 0.1 -0.500 0.1 -0.500 0.1 0.200 0.1 0.100 0.1 0.050 0.1
V10   1.581 56  12  -0.537  23 140  -1.044  24 241   1.310   9 29  142 133 72   66
"""


def test_ndk_records(spark, tmp_path):
    (tmp_path / "jan.ndk").write_text("# comment\n" + NDK + "garbage line\n" + NDK.replace("07:10:09.5", "07:10:75.5") + NDK.replace("2024/01/01", "2024/01/02"))
    (tmp_path / "feb.ndk").write_text("\n".join(NDK.splitlines()[:3]))
    rows = focal.read_ndk(spark, str(tmp_path)).orderBy("time").collect()
    assert [str(r.time)[:10] for r in rows] == ["2024-01-01", "2024-01-02"]
    r = rows[0]
    assert (r.latitude, r.longitude, r.depth, r.strike1, r.dip1, r.rake1, r.rake2) == (37.49, 137.27, 10.0, 9.0, 29.0, 142.0, 66.0)
    assert abs(r.mw - 2 / 3 * (27.1172712957 - 16.1)) < 1e-6
    assert abs(r.f_clvd - 0.537 / 1.581) < 1e-12 and r.mrr == 1e27 and r.event_name == "C202401010710A"
    assert r.fault_type == "SS"
    twice = focal.read_ndk(spark, [str(tmp_path / "jan.ndk")] * 2)
    assert focal.distinct_events(twice).count() == 2


def test_ranges_of_bytes_cut_no_record(spark, tmp_path):
    """Every cut of a file gives the rows of the file read at once."""
    import io
    import re

    from tremorframe.sources.records import range_records

    text = ("# comment\n" + NDK + "garbage line\n\n" + NDK.replace("2024/01/01", "2024/01/02").replace("\n", "\r\n") + "\n".join(NDK.splitlines()[:3])).encode()
    head = re.compile(focal.HEAD)
    whole = list(range_records(io.BytesIO(text), 0, len(text), head, 5))
    assert len(whole) == 2 and whole[0].splitlines() == NDK.splitlines()[:5]
    for cut in range(len(text) + 1):
        assert [r for a, b in ((0, cut), (cut, len(text))) for r in range_records(io.BytesIO(text), a, b, head, 5)] == whole
    (tmp_path / "a.ndk").write_bytes(text * 3)
    (tmp_path / "empty.ndk").write_bytes(b"")
    split = focal.read_ndk(spark, str(tmp_path), range_bytes=200)
    assert split.rdd.getNumPartitions() > 5
    assert sorted(map(str, split.collect())) == sorted(map(str, focal.parse_ndk(spark.read.text(str(tmp_path), wholetext=True)).collect()))
    (tmp_path / "a.ndk").unlink()
    assert focal.read_ndk(spark, str(tmp_path)).count() == 0


def test_boundaries_and_nearest(spark, tmp_path, make_catalog):
    def feature(kind, coords, shape="LineString"):
        return {"type": "Feature", "properties": {"STEP_CLASS": kind}, "geometry": {"type": shape, "coordinates": coords}}

    doc = {"type": "FeatureCollection", "features": [
        feature("subduction", [[140.0, 35.0], [141.0, 36.0], [142.0, 36.0]]), feature(" otf ", [[-70.0, -30.0], [-71.0, -31.0]]),
        feature("", [[[0.0, 0.0], [1.0, 0.0]], [[5.0, 5.0], [6.0, 5.0]]], "MultiLineString")]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    segments = boundaries.read_boundaries(spark, str(tmp_path / "b.json"))
    assert sorted(r[0] for r in segments.select("plate_type").collect()) == ["OTF", "SUB", "SUB", "UNK", "UNK"]
    main = spark.createDataFrame([("on", 35.0, 140.0), ("far", -80.0, 10.0), ("none", None, 1.0), ("mid", -10.0, -120.0)],
                                 "mainshock_id string, mainshock_lat double, mainshock_lon double")
    out = {r.mainshock_id: r for r in reference.nearest_boundary(main, segments).collect()}
    assert out["on"].plate_boundary_distance_km < 1e-6 and out["on"].plate_type_SUB == 1
    assert out["none"].plate_boundary_distance_km is None and out["none"].nearest_plate_boundary_type == "UNK"
    assert out["far"].plate_boundary_distance_km > 9000 and out["mid"].nearest_plate_boundary_type == "OTF"


FOCAL = "time string, latitude double, longitude double, strike1 double, dip1 double, rake1 double, fault_type string"


def test_focal_matches(spark):
    rows = [("2000-01-01 00:00:00", 36.5, 140.0, 10.0, 20.0, 90.0, "TF"), ("2000-01-01 20:00:00", 35.01, 140.0, 30.0, 40.0, -90.0, "NF"),
            ("2000-01-01 00:00:30", 35.1, 140.0, 50.0, 60.0, 0.0, "SS")]
    cat = spark.createDataFrame(rows, FOCAL).withColumn("time", F.to_timestamp("time"))
    main = spark.createDataFrame([("m", "2000-01-01 00:00:00", 35.0, 140.0), ("far", "1990-01-01 00:00:00", 0.0, 0.0)],
                                 "mainshock_id string, mainshock_time string, mainshock_lat double, mainshock_lon double").withColumn(
        "mainshock_time", F.to_timestamp("mainshock_time"))
    near = {r.mainshock_id: r for r in reference.with_focal_nearest(main, cat).collect()}
    assert near["m"].fault_type_NF == 1 and near["m"].strike1 == 30.0
    assert near["far"].fault_type_UNK == 1 and not near["far"].focal_mechanism_valid
    asof = {r.mainshock_id: r for r in reference.with_focal_asof(main, cat).collect()}
    assert asof["m"].strike1 == 50.0 and asof["m"].gcmt_time_diff_seconds == 30.0 and asof["m"].fault_type == "Strike-Slip"
    assert asof["far"].fault_type == "Unknown" and asof["far"].fault_type_UNK == 1


def test_prediction_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", w, m, h) for w, m, h in (("T1", 5.44, 17.5), ("T2", 5.0, 40.0), ("T3", 6.0, 100.0))],
                               "mainshock_id string, window string, pred_mag double, pred_hours double").withColumns({
        "mainshock_time": F.to_timestamp(F.lit("2008-05-12 06:28:04")), "mainshock_lon": F.lit(103.4),
        "mainshock_lat": F.lit(31.0), "mainshock_mag": F.lit(7.95)})
    rows = sink.prediction_rows(df)
    assert sink.contract_violations(rows).count() == 0
    assert sink.contract_violations(rows.filter("window <> 'T3'")).count() == 1
    sink.write_prediction_files(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == 3
    flat = tmp_path / "flat"
    flat.mkdir()
    for kind in ("T1-T2", "T3"):
        lines = [r.line for r in rows.filter(F.col("file_kind") == kind).orderBy("line_no").collect()]
        (flat / f"20080512062804-{kind}.csv").write_text("\n".join(lines) + "\n")
    (flat / "20080512062805-T3.csv").write_text("# comment\n")
    parsed = {r.window: r for r in predictions.parse_prediction_lines(predictions.read_prediction_lines(spark, str(flat))).collect()}
    assert set(parsed) == {"T1", "T2", "T3"} and parsed["T1"].pred_mag == 5.4
    assert abs(parsed["T1"].pred_hours - (18 - 28 / 60 - 4 / 3600)) < 1e-9


def test_named_files(spark, tmp_path):
    """Exact names and order, files of the same name replaced, nothing left by a failed job."""
    from tremorframe.sinks.named_files import write_named_files

    out = tmp_path / "named"
    out.mkdir()
    rows = [(f"{i}.csv", n, f"{i} line {n}") for i in range(20) for n in (1, 0)]
    write_named_files(spark.createDataFrame(rows, "file_name string, n int, line string").repartition(5), str(out), ["n"])
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{i}.csv" for i in range(20))
    assert (out / "7.csv").read_text() == "7 line 0\n7 line 1\n"
    write_named_files(spark.createDataFrame([("7.csv", 0, "new")], "file_name string, n int, line string"), str(out), ["n"])
    assert (out / "7.csv").read_text() == "new\n" and len(list(out.iterdir())) == 20
    with pytest.raises(Exception, match="not a file name"):
        write_named_files(spark.createDataFrame([("8.csv", 0, "new"), ("../9.csv", 0, "x")], "file_name string, n int, line string"), str(out), ["n"])
    assert (out / "8.csv").read_text() == "8 line 0\n8 line 1\n" and len(list(out.iterdir())) == 20


def test_oof_tables(spark, tmp_path):
    cols = "mainshock_id string, mainshock_time timestamp, target_max_mag double, target_time_to_max_days double, {m}_pred_mag double, {m}_pred_time double"
    from datetime import datetime

    a = spark.createDataFrame([("x", datetime(2000, 1, 1), 5.0, 1.0, 5.1, 1.1), ("y", datetime(2000, 1, 2), 5.0, 1.0, None, 1.1)], cols.format(m="a"))
    b = spark.createDataFrame([("x", datetime(2000, 1, 1), 5.0, 1.0, 5.2, 1.2), ("y", datetime(2000, 1, 2), 5.0, 1.0, 5.2, 1.2)], cols.format(m="b"))
    assert [r.mainshock_id for r in predictions.merge_oof({"a": a, "b": b}).collect()] == ["x"]
    with pytest.raises(ValueError):
        predictions.merge_oof({"a": a.union(a), "b": b})
    b.write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError):
        predictions.read_oof(spark, str(tmp_path / "b"), "a")


def feed(rows):
    return {"type": "FeatureCollection", "features": [
        {"id": i, "properties": {"time": t, "mag": m, "place": None, "type": "earthquake", "url": "u"},
         "geometry": {"type": "Point", "coordinates": [lon, lat, d]}} for i, t, lon, lat, d, m in rows]}


def test_feed(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(feed([("a", 946684800000, 140.0, 35.0, 10.0, 6.5), ("b", None, 1.0, 1.0, 1.0, 5.0)])))
    row = feeds.read_feed(spark, str(tmp_path)).collect()
    assert len(row) == 1 and str(row[0].time) == "2000-01-01 00:00:00" and row[0].longitude == 140.0 and row[0].place == ""


def test_small_ranges_share_a_task():
    from tremorframe.sources.records import RANGE_BYTES, RecordReader

    files = [["a", 300 * RANGE_BYTES + 7], ["b", 0], ["c", 10]]
    reader = RecordReader({"files": json.dumps(files), "head": "x", "lines": "1", "rangeBytes": "65536", "slots": "8"})
    tasks = reader.partitions()
    assert 300 <= len(tasks) <= 302 and max(sum(e - s for _, s, e in t.parts) for t in tasks) <= RANGE_BYTES
    for path, size in files:
        parts = sorted((s, e) for t in tasks for p, s, e in t.parts if p == path)
        assert [s for s, _ in parts] + [size] * bool(size) == [0] * bool(size) + [e for _, e in parts]
        assert all(s % 65536 == 0 for s, _ in parts)


def test_records_of_many_ranges_in_one_task(tmp_path):
    from tremorframe.sources.records import RecordReader

    path = tmp_path / "x.ndk"
    path.write_text("".join(f"H{i}\nrest {i}\n" for i in range(500)))
    size = path.stat().st_size
    for width, slots in ((7, 1), (64, 3), (10_000, 5)):
        reader = RecordReader({"files": json.dumps([[f"file:{path}", size]]), "head": "^H", "lines": "2", "rangeBytes": str(width), "slots": str(slots)})
        got = [v for t in reader.partitions() for b in reader.read(t) for v in b.column(0).to_pylist()]
        assert got == [f"H{i}\nrest {i}" for i in range(500)]
