import pytest
from pyspark.sql import functions as F

from tremorframe.models import calibration, quantiles, selection, training, tuning
from tremorframe.operators import folds

SMALL = {"boosted": {"rounds": 30, "rate": 0.2, "depth": 3}, "forest": {"rounds": 20, "depth": 5, "node_columns": 1.0}}


@pytest.fixture(scope="module")
def ranked(spark):
    df = spark.range(400).select(
        "id", F.timestamp_seconds(F.col("id") * 86400).alias("time"), (F.col("id") % 17).cast("double").alias("x"),
        (F.rand(3) * 2).alias("z"))
    df = df.withColumns({"mag": 4.0 + F.col("x") / 10, "days": 1.0 + F.col("x"), "label": (F.col("x") > 8).cast("int"), "main": F.lit(6.5)})
    return folds.with_time_rank(df, "time", "id").cache()


def test_oof_rows_and_no_leak(ranked):
    plan = folds.plan_folds(ranked, 2)
    oof = training.oof_regression(ranked, plan, ["x", "z"], "mag", "days", params=SMALL, keep=["id"], late_weight=2.0)
    rows = oof.collect()
    assert len(rows) == 2 * (400 // 3) and {r.fold for r in rows} == {1, 2}
    for kind in ("boosted", "forest"):
        assert sum(abs(r[f"{kind}_pred_mag"] - r.mag) for r in rows) / len(rows) < 0.15
        assert min(r[f"{kind}_pred_time"] for r in rows) >= 0
    # labels of the last block reach no prediction
    later = ranked.withColumn("mag", F.when(F.col("row_index") >= plan[1].train_end, F.lit(99.0)).otherwise(F.col("mag")))
    again = training.oof_regression(later, plan, ["x", "z"], "mag", "days", params=SMALL, keep=["id"], late_weight=2.0).collect()
    assert {r.id: r.boosted_pred_mag for r in again} == {r.id: r.boosted_pred_mag for r in rows}


def test_gate_constant_for_one_class(ranked):
    plan = folds.plan_folds(ranked, 2, folds.PURGE_GATE)
    oof = training.oof_gate(ranked.withColumn("label", F.lit(1)), plan, ["x"], params={"rounds": 2})
    assert oof.filter("probability <> 1.0").count() == 0 and oof.count() > 0


def test_gate_separates(ranked):
    plan = folds.plan_folds(ranked, 2, folds.PURGE_GATE)
    oof = training.oof_gate(ranked, plan, ["x", "z"], keep=["id"], params={"rounds": 20, "depth": 2, "rate": 0.3})
    assert oof.filter("(probability >= 0.5) <> (label = 1)").count() < 10


def test_quantile_forest_is_ordered_and_close(ranked):
    every = F.lit(True)
    out = quantiles.quantile_forest(ranked, ["x"], every, every, "days", "id", params=SMALL["forest"]).join(ranked.select("id", "days"), "id").collect()
    assert len(out) == 400
    assert all(r.q10 <= r.q25 <= r.q50 <= r.q75 <= r.q90 for r in out)
    assert sum(abs(r.q50 - r.days) for r in out) / len(out) < 1.5


def test_calibrator_limits_and_save(spark, ranked, tmp_path, monkeypatch):
    monkeypatch.setattr(calibration, "CALIBRATOR_SIZE", calibration.CALIBRATOR_SIZE.with_({"rounds": 10}))
    rows = ranked.select("id", "row_index", F.lit("T1").alias("window"), "main", F.col("mag").alias("true_mag"),
                         (F.col("mag") - 0.5).alias("pred_mag")).withColumnRenamed("main", "main_mag")
    table, columns = calibration.calibration_table(rows)
    scored = calibration.compare_calibrators(table, table, columns, kinds=("ridge", "isotonic", "boosted")).collect()
    assert len(scored) == 9 and all(r.mae <= r.mae_before + 1e-9 for r in scored)
    limited = spark.range(1).select(calibration.limited(F.lit(0.9), F.lit(8.1), (-0.2, 0.4, 0.5)), calibration.limited(F.lit(0.9), F.lit(7.0), (-0.2, 0.4, 0.5))).first()
    assert tuple(limited) == (0.5, 0.4)
    model = training.fit_pipelines(ranked, ["x", "z"], {"m": ("forest", F.col("mag"))}, "id", SMALL)["m"]
    training.save_model(model, str(tmp_path / "m"))
    again = training.load_model(str(tmp_path / "m")).transform(ranked)
    assert again.filter(F.abs(F.col("m") - F.col("mag")) > 0.5).count() == 0


def test_residual_out_of_fold(ranked):
    rows = ranked.withColumn("residual", F.col("x") / 4)
    oof = calibration.oof_residual(rows, "id", "residual", ["x", "z"], folds=3, params={"rounds": 40, "rate": 0.2}).collect()
    assert len(oof) == 400 and sum(abs(r.residual_pred - r.residual) for r in oof) / 400 < 0.4


def test_selection_and_draws(ranked):
    gains = training.importances(ranked, ["x", "z"], "mag", "id", params=SMALL["boosted"])
    kept = selection.keep_by_gain(gains, 0.85, 1).collect()
    assert kept[0].feature == "x" and len(kept) == 1
    assert tuning.draw_parameters(3) == tuning.draw_parameters(3)


def test_search_prunes_by_the_median(ranked):
    space = {"rounds": (5, 60), "depth": (1, 4), "rate": (0.01, 0.2), "row_share": (1.0,)}
    plan = folds.plan_folds(ranked, 4)
    for kind, target in (("mag", "mag"), ("time", "days")):
        rows = tuning.parameter_search(ranked, plan, ["x", "z"], target, "main", trials=6, space=space, warm_up=2, target_kind=kind).collect()
        assert sorted(r.folds_run for r in rows) == [2, 2, 2, 3, 4, 4]
        best = [r for r in rows if r.best]
        assert len(best) == 1 and best[0].folds_run == 4 and best[0].score == min(r.score for r in rows if r.folds_run == 4)
        assert best[0].rate == 0.2 and best[0].rounds == 60


def test_isotonic_fit_gets_a_row_per_prediction(spark, monkeypatch):
    """However many rows share a prediction, one task's memory holds it once; the fit is that of all rows."""
    from contextlib import contextmanager

    from pyspark.ml.regression import IsotonicRegression

    rows = spark.range(600).select((F.col("id") % 5 / 2.0).alias("pred_mag"), (F.hash("id") % 100 / 300.0 + F.col("id") % 3 / 10.0).alias("residual"))
    seen = []

    @contextmanager
    def counted(df):
        seen.append(df.count())
        yield df

    monkeypatch.setattr(calibration, "held", counted)
    found = calibration.fit_calibrator(rows, "isotonic", ["pred_mag"])(rows.select("pred_mag").distinct()).collect()
    plain = IsotonicRegression(featuresCol="pred_mag", labelCol="residual").fit(rows).transform(rows.select("pred_mag").distinct()).collect()
    assert seen == [5]
    want = {r.pred_mag: r.prediction for r in plain}
    assert len(found) == 5 and all(abs(r.residual_pred - want[r.pred_mag]) < 1e-12 for r in found)


def test_search_weighs_each_prediction_once(ranked, monkeypatch):
    """One score per sweep over the rows of all trials, not one per trial over all predictions; equal to each trial alone."""
    table = ranked.withColumn("main", F.col("mag") + 1.0)
    plan = folds.plan_folds(table)
    space = {"rounds": (3, 5), "depth": (2, 3), "rate": (0.1, 0.3), "row_share": (0.8, 1.0)}
    asked, score = [], tuning.mag_error
    monkeypatch.setattr(tuning, "mag_error", lambda *a: asked.append(1) or score(*a))
    rows = tuning.parameter_search(table, plan, ["x", "z"], "mag", "main", trials=6, space=space, warm_up=len(plan)).collect()
    assert len(asked) == 1 and len(rows) == 6
    r = rows[4]
    size = {"rounds": r.rounds, "depth": r.depth, "rate": r.rate, "row_share": r.row_share}
    oof = training.oof_regression(table, plan, ["x", "z"], "mag", "days", kinds=("boosted",), params={"boosted": size}, keep=["main"])
    want = oof.agg(score(F.col("boosted_pred_mag"), F.col("mag"), F.col("main")).alias("v")).first().v
    assert abs(r.score - want) < 1e-9
