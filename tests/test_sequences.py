import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremorframe.constants import GK_WINDOWS
from tremorframe.operators import labels, sequences
from tremorframe.operators.spatial_join import first_by_time, interval_pairs

SMALL = [
    ("a", "2000-01-01 00:00:00", 35.0, 140.0, 30.0, 6.5),
    ("b", "2000-01-01 06:00:00", 35.01, 140.01, 10.0, 5.0),
    ("c", "2000-01-02 00:00:00", 35.02, 140.02, 15.0, 4.5),
    ("d", "2000-01-05 00:00:00", 35.01, 140.00, 12.0, 5.5),
    ("e", "2010-01-01 00:00:00", -30.0, -70.0, 20.0, 6.8),
    ("f", "2010-01-01 01:00:00", -29.99, -70.01, 10.0, 4.5),
]


def km(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


@pytest.mark.parametrize("hot", [500_000, 40])
def test_interval_pairs_equal_brute_force(random_catalog, hot):
    """Poles, date line and dense places; with and without salting."""
    main = sequences.mainshocks(random_catalog)
    got = {(r[0], r[1]) for r in interval_pairs(main, random_catalog, after_seconds=10 * 86400, radius_km=100.0,
                                                hot_cell_rows=hot).select("mainshock_id", "id").collect()}
    rows = random_catalog.collect()
    want = set()
    for m in rows:
        if m.mag >= 6.0 and m.depth <= 70.0:
            for e in rows:
                if m.time < e.time <= m.time + timedelta(days=10) and km(m.latitude, m.longitude, e.latitude, e.longitude) <= 100.0:
                    want.add((m.id, e.id))
    assert len(want) > 100
    assert got == want


def test_pairs_have_no_duplicates(random_catalog):
    pairs = interval_pairs(sequences.mainshocks(random_catalog), random_catalog, after_seconds=86400 * 30, radius_km=500.0)
    assert pairs.count() == pairs.select("mainshock_id", "id").distinct().count()


def test_first_by_time_caps_before_the_shuffle(random_catalog):
    pairs = interval_pairs(sequences.mainshocks(random_catalog), random_catalog, after_seconds=86400 * 30)
    capped = first_by_time(pairs, 5)
    assert capped.groupBy("mainshock_id").count().agg(F.max("count")).first()[0] == 5
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_small_catalog_sequences(make_catalog):
    rows = {r.mainshock_id: r for r in sequences.build_sequences(make_catalog(SMALL)).collect()}
    assert set(rows) == {"a", "e"}
    assert rows["a"].has_target_aftershock and rows["a"].target_max_mag == 5.5
    assert rows["a"].target_time_to_max_days == 1.0 and rows["a"].early_aftershock_count == 2
    assert not rows["e"].has_target_aftershock and rows["e"].target_max_mag is None
    assert rows["e"].target_time_to_max_days is None and rows["e"].early_max_mag == 4.5


def test_isolated_mainshock_rules(make_catalog):
    """An empty catalog window drops a 30-day sequence but keeps a window sample."""
    events = make_catalog(SMALL[:1])
    assert sequences.build_sequences(events).count() == 0
    assert sequences.build_window_samples(events).count() == 1


def test_foreshock_does_not_claim(make_catalog):
    events = make_catalog([
        ("fore", "2000-01-01 00:00:00", 35.0, 140.0, 10.0, 6.1), ("main", "2000-01-02 00:00:00", 35.0, 140.0, 10.0, 7.0),
        ("claimed", "2000-01-03 00:00:00", 35.0, 140.0, 10.0, 6.2), ("later", "2000-02-02 12:00:00", 35.0, 140.0, 10.0, 6.0),
        ("end", "2000-02-03 00:00:00", 35.0, 140.0, 10.0, 4.0)])
    assert {r[0] for r in sequences.build_sequences(events).select("mainshock_id").collect()} == {"main", "later"}


def greedy_brute(rows, reach, smaller):
    kept = []
    for r in rows:
        covered = any(
            k["us"] < r["us"] <= k["us"] + reach(k)[0] * 86400e6 and (not smaller or r["mag"] < k["mag"])
            and km(k["lat"], k["lon"], r["lat"], r["lon"]) <= reach(k)[1] for k in kept)
        if not covered:
            kept.append(r)
    return {k["id"] for k in kept}


def test_claim_chain(make_catalog):
    """Each event covers the next one only: every second stays."""
    start = datetime(2001, 1, 1)
    rows = [(f"n{i}", (start + timedelta(days=20 * i)).isoformat(sep=" "), 10.0, 20.0, 5.0, 6.5) for i in range(12)]
    rows.append(("last", (start + timedelta(days=245)).isoformat(sep=" "), -10.0, 20.0, 5.0, 4.0))
    got = {r[0] for r in sequences.build_sequences(make_catalog(rows)).select("mainshock_id").collect()}
    assert got == {f"n{i}" for i in range(0, 12, 2)}


@pytest.mark.parametrize("hot", [500_000, 40])
def test_decluster_equals_brute_force(random_catalog, monkeypatch, hot):
    rows = [{"id": r.id, "us": r.time.timestamp() * 1e6, "lat": r.latitude, "lon": r.longitude, "mag": r.mag}
            for r in random_catalog.collect()]

    def reach(k):
        for low, high, days, dist in GK_WINDOWS:
            if low <= k["mag"] < high:
                return days, dist
        return 1000.0, 140.0

    want = greedy_brute(sorted(rows, key=lambda r: -r["mag"]), reach, smaller=True)
    monkeypatch.setattr(sequences, "HOT_CELL_ROWS", hot)
    out = sequences.decluster(random_catalog)
    got = {r[0] for r in out.filter("is_background").select("id").collect()}
    assert out.count() == len(rows)
    assert got == want


def test_rounds_follow_what_changed(random_catalog, monkeypatch):
    """After the first round a node covers others once, as a kept or as a dropped one; only nodes that lost a coverer are looked at again."""
    calls, covered = [], sequences.CoverRule.covered_ids

    def counted(self, nodes, by, hot=None):
        calls.append((nodes.count(), by.count()))
        return covered(self, nodes, by, hot)

    monkeypatch.setattr(sequences.CoverRule, "covered_ids", counted)
    sequences.decluster(random_catalog).count()
    total = random_catalog.count()
    assert calls[0] == (total, total)
    drop, lost, free = calls[1::3], calls[2::3], calls[3::3]
    assert sum(by for _, by in drop + lost) <= total
    assert all(f[0] <= now[0] for now, f in zip(lost, free)) and sum(n for n, _ in free) < sum(n for n, _ in lost)


def test_pick_mainshock_takes_the_earliest_largest(make_catalog):
    events = make_catalog([("x", "2000-01-03 00:00:00", 1.0, 1.0, 5.0, 7.0), ("y", "2000-01-02 00:00:00", 1.0, 1.0, 5.0, 7.0),
                           ("z", "2000-01-01 00:00:00", 1.0, 1.0, 5.0, 6.0)]).withColumn("sequence_id", F.lit("s"))
    assert sequences.sequence_mainshock(events).first()["mainshock_id"] == "y"


def test_holdout_truth_excludes_the_mainshock_record(make_catalog):
    main = make_catalog([("m", "2000-01-01 00:00:00", 1.0, 1.0, 5.0, 7.0)])
    catalog = make_catalog([("m2", "2000-01-01 00:00:03", 1.0, 1.0, 5.0, 7.1), ("t", "2000-01-06 00:00:00", 1.0, 1.0, 5.0, 5.0)])
    row = sequences.holdout_truth(sequences.mainshocks(main), catalog).first()
    assert (row.true_max_mag, row.true_time_to_max_days) == (5.0, 2.0)


def test_window_boundaries(make_catalog):
    t0 = datetime(2008, 5, 12, 6, 28, 4)
    rows = [("m", t0, 7.9)] + [(f"f{i}", t0 + timedelta(seconds=s), mag) for i, (s, mag) in enumerate(
        [(24 * 3600, 5.1), (24 * 3600 + 1, 5.7), (72 * 3600, 5.8), (144 * 3600, 6.0)])]
    events = make_catalog([(i, t.isoformat(sep=" "), 31.0, 103.4, 10.0, m) for i, t, m in rows])
    main = sequences.mainshocks(events).filter("mainshock_id = 'm'")
    row = labels.window_labels(main, events).first()
    assert (row.target_T1_max_mag, row.target_T2_max_mag, row.target_T3_max_mag) == (5.1, 5.8, 6.0)
    assert row.target_T1_time_to_max_hours == 24.0 and row.has_T3_aftershock


def test_empty_windows(make_catalog):
    events = make_catalog(SMALL[:1])
    row = labels.window_labels(sequences.mainshocks(events), events).first()
    assert [row[f"target_{w}_time_to_max_hours"] for w in ("T1", "T2", "T3")] == [12.0, 48.0, 120.0]
    assert not row.has_T1_aftershock and row.target_T2_max_mag == 0.0


def test_single_horizon_labels(spark):
    cols = ", ".join(f"target_{w}_max_mag double, target_{w}_time_to_max_hours double" for w in ("T1", "T2", "T3"))
    data = [(5.0, 10.0, 4.0, 30.0, 0.0, 120.0), (5.0, 20.0, 5.5, 40.0, 5.5, 100.0), (0.0, 12.0, 0.0, 48.0, 0.0, 120.0),
            (None, None, None, None, None, None)]
    got = labels.single_horizon_labels(spark.createDataFrame(data, cols).coalesce(1)).collect()
    assert [(r.target_H168_max_mag, r.target_H168_time_to_max_hours, r.has_H168_aftershock) for r in got] == [
        (5.0, 10.0, True), (5.5, 40.0, True), (0.0, 84.0, False), (0.0, 84.0, False)]
