import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremorframe.operators import estimators, event_features, features, rates, sequences
from tremorframe.operators.spatial_join import interval_pairs
from tremorframe.sources.catalogs import read_sequences


@pytest.fixture(scope="module")
def landed(spark, fixtures):
    """Two landed sequences; each mainshock is joined with the events of its own file."""
    events = read_sequences(spark, f"{fixtures}/sequences").withColumn("id", F.concat_ws("/", "sequence_id", "id", "mag", "latitude"))
    main = sequences.sequence_mainshock(events)
    pairs = interval_pairs(main, events.withColumnRenamed("sequence_id", "own"), after_seconds=72 * 3600).filter(
        "own = sequence_id").cache()
    return main, pairs


# Published values of the two sequences.
GOLDEN = {
    "20201030115127_eq": dict(n=18, mx=5.3, b=1.4639139839435444, mc=4.2, gn=15, major=16.870735491370315,
                              azimuth=94.49449391894294, c1=2, c24=12, e72=11403085860424.037,
                              omori=-23.41451603786362, etas=-23.415486021097212),
    "20220905045218_eq": dict(n=15, mx=4.5, b=1.1329421267041353, mc=3.0, gn=15, major=15.02543705104467,
                              azimuth=156.2588437675297, c1=3, c24=10, e72=545243931910.1222,
                              omori=-16.12249689758877, etas=-16.19141442347385),
}


def keyed(main, df):
    return {r["sequence_id"]: r for r in main.select("sequence_id", "mainshock_id").join(df, "mainshock_id").collect()}


def test_counts_axes_and_b_value(landed):
    main, pairs = landed
    summary, gr = keyed(main, estimators.one_pass_summary(pairs)), keyed(main, estimators.gutenberg_richter(pairs))
    for name, want in GOLDEN.items():
        row = summary[name]
        assert (row.early_aftershock_count, row.early_max_mag, row.count_1h, row.count_24h) == (
            want["n"], want["mx"], want["c1"], want["c24"])
        assert math.isclose(row.energy_72h, want["e72"], rel_tol=1e-9)
        assert math.isclose(row.anisotropy_major_axis_km, want["major"], rel_tol=1e-9)
        assert math.isclose(row.anisotropy_azimuth_deg, want["azimuth"], rel_tol=1e-9)
        assert math.isclose(gr[name].gr_b_value, want["b"], rel_tol=1e-9)
        assert (gr[name].gr_mc, gr[name].gr_n, gr[name].gr_valid) == (want["mc"], want["gn"], True)


def test_omori_and_etas_reach_the_published_likelihood(spark, landed):
    main, pairs = landed
    fit = keyed(main, rates.omori_fit(pairs))
    fixed = main.select("mainshock_id", F.lit(1.0).alias("omori_p"), F.lit(0.05).alias("omori_c"), F.lit(False).alias("omori_valid"))
    etas = keyed(main, rates.etas_fit(pairs, main, fixed, estimators.gutenberg_richter(pairs)))
    for name, want in GOLDEN.items():
        assert fit[name].omori_nll <= want["omori"] + 0.001
        row = etas[name]
        assert row.etas_nll <= want["etas"] + 0.001
        assert row.etas_valid and row.etas_n == want["n"]
        assert 0.0 <= row.etas_branching_ratio <= 1.0


def test_omori_event_count_identity(spark):
    rows = [("m", int(3.6e9 * (0.1 + 1.7 * i ** 1.4))) for i in range(16)]
    pairs = spark.createDataFrame(rows, "mainshock_id string, elapsed_us long")
    row = rates.omori_fit(pairs).first()
    integral = spark.range(1).select(rates.decay_integral(F.lit(row.omori_p), F.lit(row.omori_c), 0.0, 3.0)).first()[0]
    assert math.isclose(row.omori_k * integral, row.omori_n, rel_tol=1e-9)


def test_minimum_events(spark):
    pairs = spark.createDataFrame([("m", 3_600_000_000 * i, 4.0 + i / 10) for i in range(1, 5)],
                                  "mainshock_id string, elapsed_us long, mag double")
    gr = estimators.gutenberg_richter(pairs).first()
    assert not gr.gr_valid and gr.gr_n == 4 and gr.gr_b_value is None
    omori = rates.omori_fit(pairs).first()
    assert not omori.omori_valid and omori.omori_n == 4 and omori.omori_p is None


def test_b_value_matches_formula_off_the_bin_grid(spark):
    rng = random.Random(1)
    mags = [3.0 + rng.expovariate(2.3) for _ in range(300)]
    pairs = spark.createDataFrame([("m", m) for m in mags], "mainshock_id string, mag double")
    row = estimators.gutenberg_richter(pairs).first()
    complete = [m for m in mags if m >= row.gr_mc]
    assert row.gr_n == len(complete)
    assert math.isclose(row.gr_b_value, math.log10(math.e) / (sum(complete) / len(complete) - (row.gr_mc - 0.05)), rel_tol=1e-9)


def test_etas_interior_optimum_explains_the_count(spark, landed):
    rng = random.Random(2)
    times = sorted([rng.uniform(0.01, 3.0) for _ in range(40)] + [0.02 * math.exp(rng.uniform(0, 4)) for _ in range(40)])
    pairs = spark.createDataFrame([("m", f"e{i}", 3.0 + rng.expovariate(2.0), int(t * 8.64e10)) for i, t in enumerate(times) if t <= 3],
                                  "mainshock_id string, id string, mag double, elapsed_us long")
    main = spark.createDataFrame([("m", 6.5)], "mainshock_id string, mainshock_mag double")
    fixed = main.select("mainshock_id", F.lit(1.0).alias("omori_p"), F.lit(0.05).alias("omori_c"), F.lit(True).alias("omori_valid"))
    row = rates.etas_fit(pairs, main, fixed, estimators.gutenberg_richter(pairs)).first()
    assert math.isclose(row.etas_expected_count, row.etas_n, rel_tol=1e-6)


def _etas_problem(spark, times, mags, mag=6.5):
    pairs = spark.createDataFrame([("m", f"e{i}", m, int(t * 8.64e10)) for i, (t, m) in enumerate(zip(times, mags))],
                                  "mainshock_id string, id string, mag double, elapsed_us long")
    main = spark.createDataFrame([("m", mag)], "mainshock_id string, mainshock_mag double")
    fixed = main.select("mainshock_id", F.lit(1.0).alias("omori_p"), F.lit(0.05).alias("omori_c"), F.lit(True).alias("omori_valid"))
    return pairs, main, fixed, estimators.gutenberg_richter(pairs)


def test_etas_uses_every_event(spark):
    pairs, main, fixed, gr = _etas_problem(spark, [(i + 1) * 300 / 86400 for i in range(800)], [4.0 + (i % 20) / 10 for i in range(800)])
    fit = [rates.etas_fit(p, main, fixed, gr).first() for p in (pairs, pairs.repartition(7))]
    assert fit[0].etas_n == 800 and math.isclose(fit[0].etas_mu, fit[1].etas_mu, rel_tol=1e-9)
    assert rates.etas_fit(pairs, main, fixed, gr, max_events=500).first().etas_n == 500


@pytest.mark.parametrize("kind", ["mixed", "early", "late", "crowded"])
def test_etas_is_the_optimum_inside_the_bounds(spark, kind):
    """No step in mu or amplitude improves the likelihood, on the bounds neither."""
    rng = random.Random(4)
    times = {"mixed": [rng.uniform(0, 3) for _ in range(30)] + [0.01 * 10 ** rng.uniform(0, 2) for _ in range(30)],
             "early": [0.001 + rng.uniform(0, 0.01) for _ in range(60)], "late": [3 * rng.random() ** 0.3 for _ in range(60)],
             "crowded": [rng.uniform(0.01, 3) for _ in range(900)]}[kind]
    mags = [3.0 + rng.expovariate(2.0) for _ in times]
    row = rates.etas_fit(*_etas_problem(spark, times, mags)).first()
    gain, integral = math.exp(0.5 * 4.0), math.log(3.05 / 0.05)
    g = [1 / (int(t * 8.64e10) / 8.64e10 + 0.05) for t in times]

    def nll(mu, a):
        return mu * 3 + a * integral - sum(math.log(mu + a * x) for x in g)

    mu, a = row.etas_mu, row.etas_amplitude
    assert 1e-6 * (1 - 1e-9) <= mu <= 10 * (1 + 1e-9) and 1e-6 * gain * (1 - 1e-9) <= a <= 100 * gain * (1 + 1e-9)
    best = nll(mu, a)
    assert math.isclose(best, row.etas_nll, rel_tol=1e-9)
    for scale in (1e-4, 1e-2, 0.3):
        for d, e in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
            new = (min(10, max(1e-6, mu * (1 + scale * d))), min(100 * gain, max(1e-6 * gain, a * (1 + scale * e))))
            assert nll(*new) >= best - 1e-9 * abs(best)


@pytest.fixture(scope="module")
def feature_row(spark):
    cols = {"mainshock_id": "x", "mainshock_time": datetime(2000, 1, 1), "mainshock_mag": 7.0, "mainshock_depth": 10.0,
            "count_1h": 2, "count_24h": 8, "count_72h": 20, "energy_1h": 1.0, "energy_24h": 4.0, "energy_72h": 9.0,
            "early_max_mag": 5.0, "early_aftershock_count": 20, "gr_b_value": 1.0, "omori_p": 1.1,
            "plate_type_SUB": 1, "target_T1_max_mag": 5.0, "target_T1_time_to_max_hours": 3.0}
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_windows_never_see_later_observations(feature_row):
    t1 = features.legal_features(feature_row, "T1")
    assert not {"count_24h", "count_1h", "early_max_mag", "gr_b_value"} & set(t1.columns)
    assert {"mainshock_mag", "plate_type_SUB", "count_obs_0h"} <= set(t1.columns)
    t2 = features.legal_features(feature_row, "T2")
    assert "count_24h" in t2.columns and not {"count_72h", "early_max_mag", "omori_p"} & set(t2.columns)
    assert t2.first()["early_aftershock_count"] == 8.0
    t3 = features.legal_features(feature_row, "T3")
    assert {"count_24h", "count_72h", "early_max_mag", "gr_b_value"} <= set(t3.columns)
    h168 = features.legal_features(feature_row, "H168")
    assert not [c for c in h168.columns if c.startswith(("early_", "gr_", "omori_"))]


def test_feature_columns_exclude_targets(feature_row):
    names = features.feature_columns(features.legal_features(feature_row, "T3"))
    assert not [n for n in names if n.startswith(("target_", "has_")) or n == "mainshock_id"]


def test_schema_gap():
    assert features.schema_gap(["a", "b", "z"], ["a", "b", "c", "d"], 0.5) == {"missing": ["c", "d"], "extra": ["z"]}
    with pytest.raises(ValueError):
        features.schema_gap(["a"], ["a", "b", "c"])
    with pytest.raises(ValueError):
        features.schema_gap(["a", "b", "c"], ["a", "b", "c", "d"], strict=True)


def test_event_features_single_event_and_graph(make_catalog):
    start = datetime(2000, 1, 1)
    events = make_catalog([("m", start.isoformat(sep=" "), 10.0, 10.0, 5.0, 6.5)] + [
        (f"e{i}", (start + timedelta(hours=3 * (i + 1))).isoformat(sep=" "), 10.0 + 0.01 * i, 10.0, 5.0, 4.0 + i / 10) for i in range(4)])
    pairs = interval_pairs(sequences.mainshocks(events), events, after_seconds=72 * 3600)
    made = event_features.event_features(pairs)
    gaps = [r.inter_event_interval_hours for r in made.orderBy("position").collect()]
    assert all(math.isclose(g, 3.0, rel_tol=1e-9) for g in gaps)
    single = event_features.event_features(pairs.filter("id = 'e0'")).first()
    assert single.inter_event_interval_hours == 0.0 and single.local_b_value_proxy == 0.0
    edges = event_features.graph_edges(made)
    assert edges.count() == 6
    assert all(math.isclose(r[0], 1.0, rel_tol=1e-9) for r in edges.groupBy("dst").agg(F.sum("weight")).select("sum(weight)").collect())
    shaken = [event_features.augmented(made.repartition(n), seed=3).orderBy("id").collect() for n in (1, 5)]
    assert shaken[0] == shaken[1]


def test_features_and_edges_of_a_sequence_over_many_partitions(spark, make_catalog):
    """Positions and gaps across range partitions, and edges of a split sequence, equal those of one task."""
    from pyspark.sql import Window

    start = datetime(2000, 1, 1)
    events = make_catalog([(f"e{i:03d}", (start + timedelta(minutes=10 * (i // 2))).isoformat(sep=" "), 10.0 + 0.001 * i, 10.0, 5.0, 6.5 if i == 0 else 4.0)
                           for i in range(300)])
    pairs = interval_pairs(sequences.mainshocks(events), events, after_seconds=72 * 3600)
    made = event_features.event_features(pairs)
    by_time = Window.partitionBy("mainshock_id").orderBy("dt_days", "id")
    wrong = made.withColumns({"_n": F.row_number().over(by_time), "_gap": (F.col("dt_days") - F.coalesce(F.lag("dt_days").over(by_time), F.lit(0.0))) * 24})
    assert made.count() == 298 and wrong.filter("_n <> position OR abs(_gap - inter_event_interval_hours) > 1e-12").isEmpty()
    order = ["src", "dst"]
    whole, split = event_features.graph_edges(made), event_features.graph_edges(made, targets=40)
    assert "_parts" in split._jdf.queryExecution().logical().toString()
    assert [r.asDict() for r in split.orderBy(*order).select("src", "dst", F.round("weight", 12)).collect()] == [
        r.asDict() for r in whole.orderBy(*order).select("src", "dst", F.round("weight", 12)).collect()]
