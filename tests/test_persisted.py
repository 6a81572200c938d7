"""Saved window pipelines: the same rows after loading, no later observation, gaps filled as in training."""

import json

import pytest
from pyspark.sql import functions as F

from tremorframe.models import persisted, training
from tremorframe.operators import folds

SMALL = {"boosted": {"rounds": 20, "rate": 0.2, "depth": 3}, "forest": {"rounds": 10, "depth": 4},
         "buckets": {"rounds": 5, "depth": 2}, "extreme": {"rounds": 5, "depth": 2}}


@pytest.fixture(scope="module")
def ranked(spark):
    k = F.col("k")
    df = spark.range(240).withColumnRenamed("id", "k").select(
        k.cast("string").alias("mainshock_id"), F.timestamp_seconds(k * 86400).alias("mainshock_time"),
        (6.0 + (k % 15) / 10).alias("mainshock_mag"), F.when(k % 5 != 0, (k % 60).cast("double")).alias("mainshock_depth"),
        (k % 12).cast("double").alias("count_24h"), (k % 31).cast("double").alias("count_72h"),
        F.when(k % 7 != 0, 4.0 + (k % 12) / 10).alias("target_T2_max_mag"),
        F.when(k % 7 != 0, 25.0 + (k % 12) * 3).alias("target_T2_time_to_max_hours"))
    return folds.with_time_rank(df, "mainshock_time", "mainshock_id").cache()


@pytest.fixture(scope="module")
def fitted(ranked, tmp_path_factory):
    model = persisted.fit_window_pipeline(ranked, "T2", params=SMALL)
    path = str(tmp_path_factory.mktemp("heads") / "T2")
    training.save_model(model, path)
    return model, path


def rows(df):
    return {r.mainshock_id: r for r in df.collect()}


def test_a_loaded_pipeline_gives_the_same_rows(ranked, fitted):
    model, path = fitted
    before = rows(model.transform(ranked))
    after = rows(training.load_model(path).transform(ranked.drop("target_T2_max_mag", "target_T2_time_to_max_hours", "row_index", "time_us")))
    assert before == after and len(after) == 240
    assert all(24 < r.hours_boosted <= 72 and 24 < r.hours_forest <= 72 and 24 <= r.hours_bucket <= 72 for r in after.values())
    assert all(abs(sum(r.bucket_probs) - 1) < 1e-9 and 0 <= r.extreme_prob <= 1 for r in after.values())
    truth = {r.mainshock_id: r.target_T2_max_mag for r in ranked.collect() if r.target_T2_max_mag is not None}
    assert sum(abs(after[i].mag_boosted - m) for i, m in truth.items()) / len(truth) < 0.15


def test_later_observations_change_nothing(ranked, fitted):
    _, path = fitted
    later = ranked.withColumns({"count_72h": F.lit(999.0), "target_T2_max_mag": F.lit(9.0)})
    assert rows(training.load_model(path).transform(later)) == rows(training.load_model(path).transform(ranked))


def test_gaps_take_the_values_of_training(spark, ranked, fitted):
    model, path = fitted
    fills = json.loads(model.stages[1].getOrDefault("fills"))
    loaded = training.load_model(path)
    gone = rows(loaded.transform(ranked.drop("mainshock_depth")))
    same = rows(loaded.transform(ranked.withColumn("mainshock_depth", F.lit(fills["mainshock_depth"]))))
    nan = rows(loaded.transform(ranked.withColumn("mainshock_depth", F.lit(float("nan")))))
    assert gone == same == nan
    assert loaded.transform(ranked.limit(0)).count() == 0
