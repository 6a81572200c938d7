import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.operators import folds, fusion, imputation, metrics, ranking, rules

# Published scores of the 60 window predictions in the fixture.
PUBLISHED = {
    "T1": (0.42000000000000004, 0.5683308895353127, 2.9081805555555555, 4.026999599635312, 0.8, 1.0),
    "T2": (0.2799999999999999, 0.4847679857416328, 8.013902777777778, 10.44730809534414, 0.85, 1.0),
    "T3": (0.395, 0.48114446894877627, 22.429236111111106, 26.199701100850742, 0.75, 0.5),
    "ALL": (0.36499999999999994, 0.5129977257909304, 11.117106481481482, 16.449795439340328, 0.8, 0.8333333333333334),
}


@pytest.fixture(scope="module")
def scores(spark, fixtures):
    schema = "mainshock_id string, window string, true_mag double, pred_mag double, true_hours double, pred_hours double"
    return spark.read.option("header", True).schema(schema).csv(f"{fixtures}/window_scores.csv").cache()


def test_published_window_scores(scores):
    got = {r.window: r for r in metrics.package_scores(scores).collect()}
    assert set(got) == set(PUBLISHED)
    for window, want in PUBLISHED.items():
        r = got[window]
        mine = (r.mag_mae, r.mag_rmse, r.time_mae_h, r.time_rmse_h, r.within_mag_05, r.within_time_24h)
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(mine, want))
    assert got["ALL"]["count"] == sum(got[w]["count"] for w in ("T1", "T2", "T3"))


def test_worst_samples_and_unmatched(scores):
    assert metrics.worst_samples(scores, 3).count() == 9
    assert metrics.unmatched_truth(scores, scores.filter("window <> 'T2'")).count() == 20


def test_exact_quantiles(spark):
    rng = random.Random(4)
    data = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", float(rng.randint(0, 5))) for _ in range(400)] + [("c", 2.5)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for row in ranking.exact_quantiles(df, ["g"], "v", probs).collect():
        want = np.quantile([v for g, v in data if g == row.g], probs)
        assert np.allclose([row[f"q{i}"] for i in range(5)], want)
    whole = ranking.exact_quantiles(df, [], "v", [0.5]).first()
    assert math.isclose(whole.q0, float(np.median([v for _, v in data])))


def test_global_rank_with_one_hot_time(spark):
    """A third of the rows share one time: ranks stay exact and use several partitions."""
    df = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("t"), "id")
    ranked = ranking.global_row_number(df, [F.col("t"), F.col("id")])
    got = [(r.t, r.id) for r in ranked.orderBy("row_index").collect()]
    assert got == sorted(got) and ranked.agg(F.countDistinct("row_index"), F.max("row_index")).first()[:] == (3000, 2999)


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(9)
    data = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(300)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "y int, s double")
    assert math.isclose(metrics.auc(df, [], "y", "s").first()[0], want)
    assert metrics.auc(df.filter("y = 1"), [], "y", "s").first()[0] is None


def test_threshold_search_prefers_the_lower(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.2), (0, 0.07)], "y int, p double")
    rows = {round(r.threshold, 2): r for r in metrics.threshold_search(df, "y", "p").collect()}
    assert len(rows) == 99
    for t, r in rows.items():
        cut = r.threshold
        assert r.tp == sum(y == 1 and p >= cut for y, p in df.collect()) and r.tp + r.fn == 2 and r.fp + r.tn == 2
    assert [t for t, r in rows.items() if r.best] == [0.21]


def test_regression_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    t, p, tt, pt, m = rng.uniform(4, 7, 41), rng.uniform(4, 7, 41), rng.uniform(0, 30, 41), rng.uniform(-2, 30, 41), rng.uniform(6, 8, 41)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(t, p, tt, pt, m)], "t double, p double, tt double, pt double, m double")
    row = metrics.regression_metrics(df, [], "t", "p", "tt", "pt", main_mag="m").first()
    e, c = p - t, np.clip(pt, 0, None) - tt
    assert math.isclose(row.mag_medae, np.median(np.abs(e))) and math.isclose(row.time_medae, np.median(np.abs(c)))
    assert math.isclose(row.mag_energy_ratio_median, np.median(10 ** (1.5 * np.abs(e))))
    assert math.isclose(row.time_asymmetric_rmse, np.sqrt(np.mean(np.where(c > 0, 2, 1) * c**2)))
    assert math.isclose(row.bath_true_delta_std, np.std(np.clip(m - t, 0, None)))
    assert math.isclose(row.time_hit_rate, np.mean(np.abs(c) <= np.maximum(0.2 * tt, 0.5)))


def test_fold_bounds_and_purge(spark):
    assert folds.fold_bounds(11, 3) == [(1, 5, 7), (2, 7, 9), (3, 9, 11)]
    with pytest.raises(ValueError):
        folds.fold_bounds(3, 5)
    df = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("time"))
    ranked = folds.with_time_rank(df, "time", "id")
    plan = folds.plan_folds(ranked, 4)
    assert [f.purge_days for f in plan] == [30.0] * 4
    for f in plan:
        assert f.train(ranked).count() == f.train_rows == f.train_end - 29
        assert f.train(ranked).agg(F.max("time_us")).first()[0] <= f.valid_start_us - 30 * folds.DAY_US
    short = folds.with_time_rank(df.filter("id < 36"), "time", "id")
    assert [f.purge_days for f in folds.plan_folds(short, 2)] == [7.0, 7.0]
    tiny = folds.with_time_rank(df.filter("id < 9"), "time", "id")
    assert [f.purge_days for f in folds.plan_folds(tiny, 2)] == [None, None]


def test_expanding_windows_and_holdout(spark):
    assert folds.expanding_windows(100, 40, 25) == [(1, 40, 65), (2, 65, 90)]
    assert folds.expanding_windows(100, 40, 5) == []
    ranked = folds.with_time_rank(spark.range(7).select("id", F.timestamp_seconds("id").alias("time")), "time", "id")
    train, valid = folds.holdout_split(ranked, 0.1)
    assert (train.count(), valid.count()) == (6, 1)


def test_simplex_grids():
    assert len(fusion.simplex_grid(4, 0.02)) == 23426 and len(fusion.simplex_grid(3, 0.02)) == 1326
    for grid in (fusion.simplex_grid(2), fusion.simplex_grid(3, 0.1), fusion.simplex_grid(4, 0.1), fusion.random_simplex(5)):
        assert all(math.isclose(sum(w), 1.0) and min(w) >= 0 for w in grid)


@pytest.fixture(scope="module")
def three_models(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(5, 1, 120)
    data = [(float(v), float(v + a), float(v + b), float(v + c)) for v, a, b, c in zip(
        y, rng.normal(0, 0.5, 120), rng.normal(0.2, 0.7, 120), rng.normal(-0.4, 1.0, 120))]
    return spark.createDataFrame(data, "y double, a double, b double, c double").repartition(5), np.array(data)


@pytest.mark.parametrize("objective", ["rmse", "late_rmse", "mae", "mae+rmse", "time_mae", "time_mae+rmse"])
def test_grid_scores_against_numpy(three_models, objective):
    df, data = three_models
    grid = fusion.simplex_grid(3, 0.1)
    got = {r.point: r.score for r in fusion.grid_scores(df, ["a", "b", "c"], "y", grid, objective).collect()}
    for i, w in enumerate(grid):
        e = data[:, 1:] @ np.array(w) - data[:, 0]
        side = np.where(e > 0, 2.0, 1.0)
        rmse, mae, late = np.sqrt(np.mean(e**2)), np.mean(np.abs(e)), np.mean(side * np.abs(e))
        want = {"rmse": rmse, "late_rmse": np.sqrt(np.mean(side * e**2)), "mae": mae, "mae+rmse": mae + rmse,
                "time_mae": late, "time_mae+rmse": late + rmse}[objective]
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_weights_sum_to_one_and_fallbacks(spark, three_models):
    df, _ = three_models
    assert math.isclose(sum(fusion.best_weights(fusion.grid_scores(df, ["a", "b"], "y", fusion.simplex_grid(2)), ["a", "b"]).values()), 1.0)
    assert fusion.fit_weights(df.limit(0), "y", ["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert math.isclose(sum(fusion.fit_weights(df, "y", ["a", "b", "c"], method="draws").values()), 1.0)
    assert math.isclose(sum(fusion.fit_weights(df, "y", ["a", "b", "c"], "mae", 0.1).values()), 1.0)
    assert fusion.normalized({"a": 0.0, "b": -1.0}) == {"a": 0.5, "b": 0.5}
    assert fusion.nested_weights({"a": 1.0, "b": 3.0})["time"]["b"] == 0.75
    for r in fusion.stack_nonnegative(df, ["a", "b", "c"], "y").collect():
        assert math.isclose(r.w_0 + r.w_1 + r.w_2, 1.0) and min(r.w_0, r.w_1, r.w_2) >= 0


def test_fused_renormalises_over_available(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "a double, b double").coalesce(1)
    col = fusion.fused({"a": F.col("a"), "b": F.col("b")}, {"a": 0.75, "b": 0.25})
    assert [r[0] for r in df.select(col).collect()] == [1.25, 2.0, 0.0]
    assert [r[0] for r in df.select(fusion.null_mean([F.col("a"), F.col("b")])).collect()] == [1.5, 2.0, None]


def test_calibration_text():
    assert fusion.parse_calibration("T1:-0.1, t2:0.1") == {"T1": -0.1, "T2": 0.1}
    assert fusion.parse_calibration("off") == {}
    with pytest.raises(ValueError):
        fusion.parse_calibration("T9:1")


def test_extreme_adjustment(spark):
    df = spark.createDataFrame([(5.0, 20.0, 0.9, 8.0, "T1"), (5.0, 2.0, 0.9, 8.0, "T1"), (5.0, 20.0, 0.1, 8.0, "T1")],
                               "m double, h double, p double, main double, window string").coalesce(1)
    m, h = fusion.extreme_adjusted(*[F.col(c) for c in ("m", "h", "p", "main", "window")], t1_bonus=0.2)
    got = [(round(r[0], 9), round(r[1], 9)) for r in df.select(m, h).collect()]
    assert got == [(6.1, 18.72), (6.1, 2.0), (5.0, 20.0)]


def test_guarded_bias(spark):
    df = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "w string").coalesce(1)
    got = [r[0] for r in df.select(fusion.guarded_bias(F.col("w"), F.lit(-30.0))).collect()]
    assert np.allclose(got, [-30.0, -9.6, -19.2])


def test_shift_walk_against_brute_force(spark):
    rng = random.Random(12)
    data = []
    for w, (lo, hi) in rules.SHIFT_BOUNDS.items():
        for _ in range(12):
            data.append((w, rng.uniform(lo, hi), rng.uniform(lo, hi), rng.random()))
    df = spark.createDataFrame(data, "window string, true_hours double, pred_hours double, fraction double")
    errors = {(w, s): [round(min(max(p + s, rules.SHIFT_BOUNDS[w][0]), rules.SHIFT_BOUNDS[w][1])) - f - t
                       for w2, t, p, f in data if w2 == w] for w in rules.SHIFT_BOUNDS for s in rules.SHIFTS}
    rms = lambda e: math.sqrt(sum(x * x for x in e) / len(e))
    base = {w: rms(errors[w, 0.0]) for w in rules.SHIFT_BOUNDS}
    best, top = (0.0, 0.0, 0.0), rms(sum((errors[w, 0.0] for w in base), []))
    start = top
    for a in rules.SHIFTS:
        for b in rules.SHIFTS:
            for c in rules.SHIFTS:
                pick = dict(zip(rules.SHIFT_BOUNDS, (a, b, c)))
                total = rms(sum((errors[w, s] for w, s in pick.items()), []))
                if all(rms(errors[w, s]) <= base[w] + 0.01 for w, s in pick.items()) and total <= start + 0.01 and total < top - 0.005:
                    best, top = (a, b, c), total
    row = rules.shift_search(df).first()
    assert (row.shift_T1, row.shift_T2, row.shift_T3) == best and math.isclose(row.rmse, top, rel_tol=1e-9)


def test_floor_rule(spark):
    df = spark.createDataFrame([(4.0, 8.0), (4.0, 7.0), (7.9, 8.0)], "p double, m double").coalesce(1)
    got = [r[0] for r in df.select(rules.floor_rule(F.col("p"), F.col("m"), 7.5, 2.0, 0.5)).collect()]
    assert got == [5.0, 4.0, 7.9]


def test_impute_order(spark):
    df = spark.createDataFrame([(None, None, "SUB"), (None, 1.0, "XX"), (0.7, 3.0, "SUB"), (0.7, 8.0, "UNK")],
                               "gr_b_value double, other double, nearest_plate_boundary_type string").coalesce(1)
    rows = imputation.impute(df, ["gr_b_value", "other", "absent"]).collect()
    assert [r.gr_b_value for r in rows] == [0.8, 1.0, 0.7, 0.7] and rows[0].other == 3.0
    assert [r.gr_b_value_missing for r in rows] == [1, 1, 0, 0] and rows[1].other_missing == 0


def test_preprocessor_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, 7.0), (10.0, 9.0)], "x double, omori_c double")
    fitted = imputation.fit_preprocessor(train, ["x", "omori_c"])
    assert fitted.fills["omori_c"] == 0.05 and fitted.indicators == ["omori_c"]
    assert math.isclose(fitted.centre["x"], 2.5) and math.isclose(fitted.scale["x"], float(np.subtract(*np.quantile([1, 2, 3, 10], [0.75, 0.25]))))
    out = imputation.apply_preprocessor(spark.createDataFrame([(1e308 * 10, None)], "x double, omori_c double"), fitted).first()
    assert out.x == 0.0 and out.omori_c_missing == 1.0
    picked = [imputation.stable_sample(spark.range(100).repartition(n), "id", 10, 5).collect() for n in (1, 6)]
    assert picked[0] == picked[1]


def test_risk_searches_leave_rows_in_place(spark):
    """No sort of the rows by group: a group would lie in one task."""
    from tremorframe.operators import rules as ru

    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "T1").otherwise("T2").alias("window"), (F.col("id") % 10 / 10).alias("risk"), F.lit(1.0).alias("w"),
        (F.col("id") % 7).cast("double").alias("base"), (F.col("id") % 5).cast("double").alias("truth"), F.lit(7.0).alias("main_mag"))
    for found in (ru.risk_mag_search(rows, ["window"], "base", "main_mag", "risk", "truth", "w"),
                  ru.risk_time_search(rows, ["window"], "base", "window", "risk", "truth", "w")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan and found.count() > 0
