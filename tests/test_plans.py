"""Plan shapes that must hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

from tremorframe.operators import estimators, labels, metrics, sequences
from tremorframe.operators.spatial_join import interval_pairs
from tremorframe.plans import inputs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def pairs(spark):
    events = inputs.catalog(spark, SF)
    return interval_pairs(sequences.mainshocks(events), events, after_seconds=72 * 3600)


def test_interval_join_is_an_equi_join(pairs):
    text = plan(pairs)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # the replicated side has no usable size estimate: no static broadcast
    assert "_bucket" in text and "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_labels_are_hashed_not_sorted(spark, pairs):
    text = plan(labels.window_targets(pairs))
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 4


def test_hot_keys_are_split_without_a_limit(spark):
    events = inputs.catalog(spark, SF)
    main = sequences.mainshocks(events)
    split = interval_pairs(main, events, after_seconds=72 * 3600, hot_cell_rows=1)
    assert "_parts" in plan(split) and "Limit" not in plan(split)
    whole = interval_pairs(main, events, after_seconds=72 * 3600)
    assert "_parts" not in plan(whole)
    assert split.select("mainshock_id", "id").exceptAll(whole.select("mainshock_id", "id")).isEmpty()
    assert split.count() == whole.count()


def test_hot_keys_of_a_focal_catalog_are_split(spark, monkeypatch):
    from tremorframe.operators import reference, spatial_join
    from tremorframe.plans import features

    def nearest():
        return reference.with_focal_nearest(features._main(spark, SF), features.focal_catalog(spark, SF)).orderBy("mainshock_id")

    whole = nearest().collect()
    monkeypatch.setattr(reference, "interval_pairs", lambda *a, **b: spatial_join.interval_pairs(*a, **b, hot_cell_rows=1))
    split = nearest()
    assert "_parts" in plan(split) and split.collect() == whole and any(r.focal_mechanism_valid for r in whole)


def test_scan_reads_only_what_is_needed(pairs):
    text = plan(pairs.groupBy("mainshock_id").count())
    assert "event_type" not in text and "props" not in text


def test_filters_reach_the_scan(spark):
    df = inputs.table(spark, SF, "events").filter(F.col("value") > 100).select("event_id")
    assert "GreaterThan(value,100.0)" in plan(df)


def test_one_shuffle_for_the_summary(pairs):
    """All count, moment and axis aggregates share one exchange after the join."""
    text = pairs.transform(estimators.one_pass_summary)._jdf.queryExecution().executedPlan().toString()
    assert text.count("partial_sum") > 0
    assert text.split("SortMergeJoin")[0].count("Exchange hashpartitioning") == 1


def test_rollup_reads_once(spark):
    df = inputs.predictions(spark, SF).select("window", "true_mag", "true_hours", F.col("mag_a").alias("pred_mag"),
                                              F.col("hours_a").alias("pred_hours"))
    assert plan(metrics.package_scores(df)).count("Scan parquet") == 2  # the tree and its detail line


def test_nearest_boundary_has_no_cross_join(spark):
    from tremorframe.operators.reference import nearest_boundary
    from tremorframe.plans.features import boundary_segments

    main = sequences.mainshocks(inputs.catalog(spark, SF))
    text = plan(nearest_boundary(main, boundary_segments(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pairs_are_neither_stored_nor_shuffled(spark, make_catalog, monkeypatch):
    """What the rate fits and the feature table write is a row per mainshock, however many pairs there are."""
    from tremorframe.operators import features, rates, spatial_join

    rows = [(f"m{i}", f"2020-01-01 0{i}:00:00", 10.0, 20.0, 5.0, 6.5) for i in range(3)]
    rows += [(f"a{i}", f"2020-01-0{2 + i % 2} {i % 24:02d}:{i % 60:02d}:00", 10.0 + i % 7 / 10, 20.0, 5.0, 4.0 + i % 9 / 10) for i in range(90)]
    events = make_catalog(rows)
    main = sequences.mainshocks(events)
    keys = main.select("mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon")
    table = interval_pairs(keys, events, after_seconds=72 * 3600)
    want = sorted(rates.omori_fit(table).collect())
    assert table.count() > 200 and len(want) == 3
    stored = []

    def watched(df):
        out = spatial_join.durable(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(rates, "durable", watched)
    monkeypatch.setattr(features, "durable", watched)
    whole = features.sequence_features(main, events)
    assert max(stored) == 3 and whole.count() == 3
    for hot, dealt in ((500_000, 5_000), (5, 0)):
        monkeypatch.setattr(spatial_join, "DEALT_ROWS", dealt)
        with spatial_join.live_pairs(keys, events, after_seconds=72 * 3600, hot_cell_rows=hot) as pairs:
            assert pairs().select("mainshock_id", "id").exceptAll(table.select("mainshock_id", "id")).isEmpty() and pairs().count() == table.count()
            fit = sorted(rates.omori_fit(pairs).collect())
            for a, b in zip(fit, want):
                assert a.mainshock_id == b.mainshock_id and list(a)[1:6] == pytest.approx(list(b)[1:6], rel=1e-9)
            text = plan(pairs(keys.select("mainshock_id", F.lit(1).alias("x"))).groupBy("mainshock_id").count())
            assert "InMemoryTableScan" in text


def test_wide_columns_of_a_state_are_made_behind_the_shuffle_of_anchors(spark, make_catalog):
    from tremorframe.operators import spatial_join

    rows = [("m1", "2020-01-01 00:00:00", 10.0, 20.0, 10.0, 6.5)]
    rows += [(f"a{i}", f"2020-01-0{2 + i % 2} {i % 24:02d}:{i % 60:02d}:00", 10.0 + i % 7 / 10, 20.0, 5.0, 4.0 + i % 9 / 10) for i in range(30)]
    events = make_catalog(rows)
    keys = sequences.mainshocks(events).select("mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon")
    state = keys.select("mainshock_id", F.lit(2.0).alias("lo"))
    wide = {"wide": F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.exp(F.col("lo")) * i)}
    with spatial_join.live_pairs(keys, events, after_seconds=72 * 3600) as pairs:
        made = pairs(state, wide)
        asked = ["mainshock_id", "id", "lo", "wide"]
        assert sorted(made.select(asked).collect()) == sorted(pairs(state.withColumns(wide)).select(asked).collect())
        text = made.select(asked)._jdf.queryExecution().optimizedPlan().toString()
        shuffle = text.index("RepartitionByExpression")
        assert " AS wide" in text[:shuffle] and " AS wide" not in text[shuffle:]
