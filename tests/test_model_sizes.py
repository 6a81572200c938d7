"""Full sizes are the defaults; smaller ones reach every fit by params."""

import pytest
from pyspark.sql import functions as F

from tremorframe.models import calibration, training, tuning
from tremorframe.operators import folds
from tremorframe.plans import learning

SMALL = {"boosted": {"rounds": 2, "depth": 2}, "forest": {"rounds": 3, "depth": 2}}


@pytest.fixture(scope="module")
def ranked(spark):
    df = spark.range(60).select("id", F.timestamp_seconds(F.col("id") * 86400 * 9).alias("time"), (F.col("id") % 7).cast("double").alias("x"))
    return folds.with_time_rank(df.withColumns({"mag": F.col("x") + 4.0, "days": F.col("x") + 1.0}), "time", "id").cache()


def test_defaults_are_the_full_sizes():
    assert training.SIZES["boosted"].rounds == training.SIZES["forest"].rounds == 500 and training.SIZES["boosted"].depth == 7
    assert training.GATE_SIZE.rounds == 300 and training.BUCKET_SIZE.rounds == 500
    assert calibration.CALIBRATOR_SIZE.rounds == 100 and calibration.RESIDUAL_SIZE.rounds == 150
    assert min(tuning.SPACE["rounds"]) == 200


def test_params_reach_the_fits(ranked):
    models = tuning.fit_models(ranked, ["x"], "mag", "days", params=SMALL)
    assert [len(m.stages[-1].trees().feature) for m in models["boosted"] + models["forest"]] == [2, 2, 3, 3]
    assert training.importances(ranked, ["x"], "mag", "id", params=SMALL["boosted"]).first().gain > 0
    found = tuning.expanding_evaluation(ranked, [(1, 40, 60)], ["x"], "mag", "days", params=SMALL)
    assert {r.window for r in found.collect()} == {0, 1}


def test_queries_ask_for_all_folds_kinds_and_trials(spark, ranked, monkeypatch):
    asked = {}
    monkeypatch.setattr(learning, "_dated", lambda *a: ranked)
    monkeypatch.setattr(learning.tr, "oof_regression", lambda r, f, *a, kinds=("boosted", "forest"), **b: asked.update(folds=len(f), kinds=kinds))
    monkeypatch.setattr(learning.tuning, "parameter_search", lambda r, f, *a, trials=100, **b: asked.update(folds=len(f), trials=trials))
    for name in ("oof_regression", "oof_late_weighted"):
        learning.QUERIES[name](spark, "")
        assert asked == {"folds": 5, "kinds": ("boosted", "forest")}
    asked.clear()
    learning.param_search(spark, "")
    assert asked == {"folds": 5, "trials": 100}
