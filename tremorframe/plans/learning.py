"""Queries: models on time folds. Row counts grow with the catalog; fitted values have no SQL twin."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorframe.constants import WINDOWS
from tremorframe.functions.windows import lower_hours, upper_hours
from tremorframe.models import calibration as cal
from tremorframe.models import heads, persisted, tuning
from tremorframe.models import quantiles as qf
from tremorframe.models import training as tr
from tremorframe.models.boosting import fit_all, scores_by_key
from tremorframe.models.selection import keep_by_gain
from tremorframe.models.training import load_model, save_model
from tremorframe.operators import features as ft
from tremorframe.operators import folds as fd
from tremorframe.operators import fusion as fu
from tremorframe.operators import imputation as imp
from tremorframe.operators import metrics as mt
from tremorframe.operators import rules as ru
from tremorframe.operators.ranking import global_row_number
from tremorframe.operators.labels import long_windows, single_horizon_labels, window_labels
from tremorframe.operators.sequences import holdout_truth, mainshocks
from tremorframe.plans.inputs import BASE_SQL, PREDICTIONS_SQL, catalog, dated_rows, predictions
from tremorframe.plans.sequences import labels_sql, long_sql
from tremorframe.session import durable, ensure_checkpoint_dir


def _dated(spark, sf):
    df = dated_rows(spark, sf).withColumn("day_of_year", F.dayofyear("time").cast("double"))
    return fd.with_time_rank(df, "time", "id")


DATED_INPUTS = ["main_mag", "mag_a", "mag_c", "days_b", "day_of_year"]


def oof_regression(spark, sf):
    """Out-of-fold predictions of boosted trees and a forest for both targets."""
    ranked = _dated(spark, sf)
    folds = fd.plan_folds(ranked)
    return tr.oof_regression(ranked, folds, DATED_INPUTS, "true_mag", "true_days", keep=["id"])


def oof_late_weighted(spark, sf):
    """The same with the second pass that weighs late predictions."""
    ranked = _dated(spark, sf)
    return tr.oof_regression(ranked, fd.plan_folds(ranked), DATED_INPUTS, "true_mag", "true_days",
                             keep=["id"], late_weight=2.0)


def gate_oof(spark, sf):
    """Gate probabilities out of fold, with the F2 threshold applied."""
    ranked = _dated(spark, sf).withColumn("label", (F.col("true_mag") >= 5.0).cast("int"))
    oof = durable(tr.oof_gate(ranked, fd.plan_folds(ranked, purge=fd.PURGE_GATE), DATED_INPUTS, keep=["id", "mag_a", "days_b"]))
    best = mt.threshold_search(oof, "label", "probability").filter("best").first()["threshold"]
    rows = oof.withColumns({"pred_mag": F.col("mag_a"), "pred_time": F.col("days_b")})
    return fu.gate(rows, best).select("id", "label", "probability", "pred_mag", "pred_time", "gated")


def quantile_forest(spark, sf):
    """Five quantiles of the target time for the newest fifth of the rows."""
    ranked = _dated(spark, sf)
    cut = fd.holdout_start(ranked)
    return qf.quantile_forest(ranked, DATED_INPUTS, F.col("row_index") < cut, F.col("row_index") >= cut, "true_days", "id")


def residual_calibration(spark, sf):
    """Calibrators compared on the newest fifth."""
    rows, columns = cal.calibration_table(
        predictions(spark, sf).select("id", "time", "window", "main_mag", "true_mag", F.col("mag_b").alias("pred_mag")))
    ranked = fd.with_time_rank(rows, "time", "id")
    train, newest = fd.holdout_split(ranked)
    return cal.compare_calibrators(train, newest, columns)


def residual_model(spark, sf):
    """T3 time correction with the out-of-fold residual model."""
    rows = predictions(spark, sf).filter("window = 'T3'").withColumn("residual", F.col("hours_a") - F.col("true_hours"))
    bias = {r["mag_bin"]: r["bias"] for r in mt.bias_by_class(rows, "main_mag", "residual").collect()}
    oof = cal.oof_residual(rows, "id", "residual", ["main_mag", "mag_a", "hours_a", "risk"])
    fixed = ru.residual_corrected(F.col("hours_a"), F.col("main_mag"), bias, bias["ALL"], F.col("residual_pred"))
    return oof.select("id", "true_hours", F.col("hours_a").alias("hours_before"), fixed.alias("hours_after"))


def feature_selection(spark, sf):
    """Features by the gain of a boosted magnitude model until 85 % of it, thirty at least."""
    table = _training_table(spark, sf, with_rates=False)
    return keep_by_gain(tr.importances(table, ft.feature_columns(table), "target_T1_max_mag", "row_index"))


def param_search(spark, sf):
    ranked = _dated(spark, sf)
    return tuning.parameter_search(ranked, fd.plan_folds(ranked), DATED_INPUTS, "true_mag", "main_mag")


def time_param_search(spark, sf):
    """The same search for the time target, by its composite score."""
    ranked = _dated(spark, sf)
    return tuning.parameter_search(ranked, fd.plan_folds(ranked), DATED_INPUTS, "true_days", target_kind="time")


def expanding_evaluation(spark, sf):
    ranked = _dated(spark, sf)
    n = ranked.count()
    windows = fd.expanding_windows(n, n // 2, max(10, n // 4))
    return tuning.expanding_evaluation(ranked, windows, DATED_INPUTS, "true_mag", "true_days")


def _training_table(spark, sf, with_rates=True):
    """Imputed features with window labels, in time order."""
    events = catalog(spark, sf)
    main = mainshocks(events)
    labelled = window_labels(main, events)
    table = ft.derived_features(ft.sequence_features(main, events, with_rates=with_rates))
    names = ft.feature_columns(table)
    full = imp.impute(table, names)
    joined = full.join(labelled.select("mainshock_id", *[c for c in labelled.columns if c.startswith(("target_", "has_"))]),
                       "mainshock_id")
    return fd.with_time_rank(durable(joined), "mainshock_time", "mainshock_id")


def _raw_table(spark, sf):
    """Features with their gaps, and window labels, in time order."""
    events = catalog(spark, sf)
    main = mainshocks(events)
    labelled = window_labels(main, events)
    table = ft.derived_features(ft.sequence_features(main, events))
    joined = table.join(labelled.select("mainshock_id", *[c for c in labelled.columns if c.startswith(("target_", "has_"))]), "mainshock_id")
    return fd.with_time_rank(durable(joined), "mainshock_time", "mainshock_id")


def _window_heads(ranked, windows):
    """Out-of-fold output of every head, both kinds, of each window; each window's table is written once for all folds."""
    folds = fd.plan_folds(ranked)
    out = None
    for window in windows:
        table, columns = heads.window_table(ranked, window)
        part = heads.oof_window(durable(table), window, folds, len(columns))
        out = part if out is None else out.unionByName(part)
    return out


def oof_buckets(spark, sf):
    """Every head of every window out of fold: magnitude, bucket and direct time, extreme risk."""
    oof = _window_heads(_training_table(spark, sf), WINDOWS)
    return oof.select("mainshock_id", "window", "fold", "true_mag", "true_hours", "bucket", "mag_boosted", "mag_forest",
                      "hours_boosted", "hours_forest", "hours_bucket", "extreme_prob")


def decoupled_predictions(spark, sf):
    """Prediction of every window from its heads: fusion, extreme adjustment, guarded bias, clamp."""
    oof = _window_heads(_training_table(spark, sf), WINDOWS).withColumn("main_mag", F.col("mainshock_mag"))
    out = fu.decoupled_prediction(oof, {"boosted": "mag_boosted", "forest": "mag_forest"}, "hours_bucket", "extreme_prob",
                                  {"boosted": 0.5, "forest": 0.5}, mag_bias={"T1": -0.1}, time_bias={"T1": -1.0}, t1_bonus=0.1)
    return out.select("mainshock_id", "window", "main_mag", "true_mag", "true_hours", "pred_mag", "pred_hours")


def single_horizon_predictions(spark, sf):
    """168 h prediction from static features only: no rates are fitted for it."""
    ranked = single_horizon_labels(_training_table(spark, sf, with_rates=False))
    oof = _window_heads(ranked, ("H168",)).withColumn("main_mag", F.col("mainshock_mag"))
    out = fu.single_horizon_prediction(
        oof, {"boosted": "mag_boosted", "forest": "mag_forest"},
        {"bucket": "hours_bucket", "boosted": "hours_boosted", "forest": "hours_forest"}, "extreme_prob",
        {"boosted": 0.5, "forest": 0.5}, {"bucket": 0.6, "boosted": 0.2, "forest": 0.2})
    return out.select("mainshock_id", "main_mag", "true_mag", "true_hours", "pred_mag", "pred_hours")


def window_model_predictions(spark, sf):
    """Weighted window prediction; T3 has no time weight and falls back to the rule."""
    p = predictions(spark, sf)
    w, m = F.col("window"), F.col("main_mag")
    mags = {"a": F.col("mag_a"), "b": F.col("mag_b")}
    hours = {"a": F.col("hours_a"), "b": F.col("hours_b")}
    full = fu.window_prediction(w, m, mags, hours, {"a": 0.6, "b": 0.4}, {"a": 0.5, "b": 0.5})
    none = fu.window_prediction(w, m, mags, hours, {"a": 0.6, "b": 0.4}, {})
    pick = [F.when(w == "T3", n).otherwise(f) for f, n in zip(full, none)]
    out = p.withColumns({"pm": pick[0], "ph": pick[1]})
    return out.groupBy("window").agg(F.round(F.avg("pm"), 6).alias("mag"), F.round(F.avg("ph"), 6).alias("hours"))


def extreme_risk_floor(spark, sf):
    """Risk classifier over hash folds, the best floor per window, and its application."""
    events = catalog(spark, sf)
    main = mainshocks(events)
    rows = long_windows(window_labels(main, events), ["mainshock_id", "mainshock_mag", "mainshock_depth"])
    rows = rows.withColumns({"main_mag": F.col("mainshock_mag"), "pred_mag": F.col("mainshock_mag") - 1.5,
                             "label": (F.col("true_mag") >= F.col("mainshock_mag") - 2.0).cast("int"),
                             "_fold": fd.hash_fold("mainshock_id", 5)})
    rows = durable(global_row_number(rows, [F.col("mainshock_id"), F.col("window")]))
    folds = {f"f{k}": (F.col("_fold") != k, F.col("_fold") == k) for k in range(5)}
    fits = tr.gates(rows, folds, "label", "probability")
    scores = scores_by_key(fit_all(rows, "row_index", ["mainshock_mag", "mainshock_depth"], fits), fits, "row_index")
    oof = durable(rows.join(scores, "row_index"))
    found = ru.extreme_floor_search(oof, ["window"])
    best = found.groupBy("window").agg(F.min_by(F.struct("threshold", "margin"), F.struct("mae", "threshold", "margin")).alias("b"))
    fixed = ru.apply_extreme_floor(F.col("pred_mag"), F.col("main_mag"), F.col("probability"), F.col("b.threshold"), F.col("b.margin"))
    return oof.join(best, "window").select("mainshock_id", "window", "true_mag", "pred_mag", "probability", fixed.alias("floored_mag"))


INFERENCE_INPUTS = ["mainshock_mag", "mainshock_depth", "early_aftershock_count", "early_max_mag", "gr_b_value", "count_24h"]


def _holdout(spark, sf):
    events = catalog(spark, sf)
    truth = holdout_truth(mainshocks(events), events)
    table = imp.impute(ft.sequence_features(mainshocks(events), events, with_rates=False), INFERENCE_INPUTS)
    joined = table.join(truth.select("mainshock_id", "true_max_mag", "true_time_to_max_days"), "mainshock_id")
    return fd.with_time_rank(durable(joined), "mainshock_time", "mainshock_id")


def _searched(ranked):
    """Weights of the two kinds for each target, from out-of-fold predictions of the given rows; equal ones for rows too few to be five folds."""
    if ranked.limit(6).count() < 6:
        return [{"boosted": 0.5, "forest": 0.5}] * 2
    oof = durable(tr.oof_regression(ranked, fd.plan_folds(ranked), INFERENCE_INPUTS, "true_max_mag", "true_time_to_max_days"))
    return [{k: found[f"{k}_pred_{t}"] for k in ("boosted", "forest")} for t, found in (
        ("mag", fu.fit_weights(oof, "true_max_mag", ["boosted_pred_mag", "forest_pred_mag"])),
        ("time", fu.fit_weights(oof, "true_time_to_max_days", ["boosted_pred_time", "forest_pred_time"])))]


def batch_inference(spark, sf):
    """Both final models over all sequences in one transform, fused by weights searched out of fold, with agreement."""
    ranked = _holdout(spark, sf)
    mag_weights, time_weights = _searched(ranked)
    models = tuning.fit_models(ranked, INFERENCE_INPUTS, "true_max_mag", "true_time_to_max_days")
    out = tuning.batch_inference(models, ranked, mag_weights, time_weights)
    return out.select("mainshock_id", "boosted_pred_mag", "forest_pred_mag", "boosted_pred_time", "forest_pred_time", "pred_mag", "pred_time",
                      "mag_std", "mag_range", "time_std", F.lit(mag_weights["boosted"]).alias("mag_weight_boosted"),
                      F.lit(time_weights["boosted"]).alias("time_weight_boosted"))


def holdout_evaluation(spark, sf):
    """Weights searched out of fold on the older part, models fitted on it, the newest fifth scored with the combined objective."""
    train, test = fd.holdout_split(_holdout(spark, sf))
    mag_weights, time_weights = _searched(train)
    models = tuning.fit_models(train, INFERENCE_INPUTS, "true_max_mag", "true_time_to_max_days")
    out = tuning.batch_inference(models, test, mag_weights, time_weights)
    return tuning.holdout_scores(out).withColumns({
        "mag_weight_boosted": F.lit(mag_weights["boosted"]), "time_weight_boosted": F.lit(time_weights["boosted"])})


def _outside(*bad):
    """How many rows break a rule."""
    return F.count_if(~F.coalesce(reduce(lambda a, b: a & b, bad), F.lit(False))).alias("outside")


def oof_regression_checked(spark, sf):
    """Per fold: rows, predictions below zero or missing, and whether both kinds beat the constant mean of the truth."""
    oof = oof_regression(spark, sf)
    mean = Window.partitionBy("fold")
    rows = oof.withColumns({"_m": F.avg("true_mag").over(mean), "_t": F.avg("true_days").over(mean)})
    better = [(mt.rmse(F.col(f"{k}_pred_mag") - F.col("true_mag")) < mt.rmse(F.col("_m") - F.col("true_mag"))) for k in ("boosted", "forest")]
    return rows.groupBy("fold").agg(
        F.count("*").alias("n"), _outside(*[F.col(f"{k}_pred_{t}") >= 0 for k in ("boosted", "forest") for t in ("mag", "time")]),
        (better[0] & better[1]).alias("beats_mean"))


def window_heads_checked(spark, sf):
    """Per window and fold: rows, and how many heads' results or fused predictions leave their bounds or their probabilities one."""
    oof = _window_heads(_training_table(spark, sf), WINDOWS).withColumn("main_mag", F.col("mainshock_mag"))
    out = fu.decoupled_prediction(oof, {"boosted": "mag_boosted", "forest": "mag_forest"}, "hours_bucket", "extreme_prob",
                                  {"boosted": 0.5, "forest": 0.5}, mag_bias={"T1": -0.1}, time_bias={"T1": -1.0}, t1_bonus=0.1)
    low, high = lower_hours(F.col("window")), upper_hours(F.col("window"))
    inside = [F.col(c).between(low, high) for c in ("hours_boosted", "hours_forest", "hours_bucket", "pred_hours")]
    total = F.aggregate("bucket_probs", F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("window", "fold").agg(
        F.count("*").alias("n"), F.round(F.sum("true_mag"), 6).alias("truth"),
        _outside(*inside, F.abs(total - 1) < 1e-9, F.col("extreme_prob").between(0, 1), F.col("pred_mag").between(0.0, F.col("main_mag") + 0.5)))


def persisted_heads(spark, sf):
    """Final heads of every window, saved with their preparation, loaded again and applied to raw features without targets."""
    ranked = _raw_table(spark, sf)
    raw = ranked.drop(*[c for c in ranked.columns if c.startswith(("target_", "has_"))], "row_index", "time_us")
    root = f"{ensure_checkpoint_dir(spark)}/heads-{uuid.uuid4().hex}"
    parts = []
    for window in WINDOWS:
        save_model(persisted.fit_window_pipeline(ranked, window), f"{root}/{window}")
        parts.append(load_model(f"{root}/{window}").transform(raw))
    return reduce(lambda a, b: a.unionByName(b), parts)


def persisted_heads_checked(spark, sf):
    """Per window: rows that the loaded pipelines score, and how many leave the window's bounds, the mean or probabilities of one."""
    out = persisted_heads(spark, sf)
    low, high = lower_hours(F.col("window")), upper_hours(F.col("window"))
    inside = [F.col(c).between(low, high) for c in ("hours_boosted", "hours_forest", "hours_bucket")]
    total = F.aggregate("bucket_probs", F.lit(0.0), lambda a, x: a + x)
    mean = F.abs(F.col("mag_mean") - (F.col("mag_boosted") + F.col("mag_forest")) / 2) < 1e-9
    return out.groupBy("window").agg(F.count("*").alias("n"), _outside(
        *inside, mean, F.abs(total - 1) < 1e-9, F.col("extreme_prob").between(0, 1), F.col("mag_boosted") >= 0, F.col("mag_forest") >= 0))


def head_risk_metrics(spark, sf):
    """Risk of an extreme aftershock per window and fold: AUC, precision and recall of the extreme heads, out of fold."""
    ranked = _training_table(spark, sf)
    folds = fd.plan_folds(ranked)
    parts = []
    for window in WINDOWS:
        table, columns = heads.window_table(ranked, window)
        oof = heads.oof_extreme(durable(table), folds, len(columns))
        parts.append(mt.risk_metrics(oof, ["fold"], "extreme", "extreme_prob").withColumn("window", F.lit(window)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("window", "fold", "positive_rate", "prob_mean", "precision_at_0_5", "recall_at_0_5", "roc_auc")


def batch_inference_checked(spark, sf):
    """Rows of the batch, and how many are not the weighted mean of their models or miss their spread."""
    out = batch_inference(spark, sf)
    fused = [F.abs(F.col(f"pred_{t}") - (F.col(f"{t}_weight_boosted") * F.col(f"boosted_pred_{t}") + (1 - F.col(f"{t}_weight_boosted")) * F.col(f"forest_pred_{t}"))) < 1e-9
             for t in ("mag", "time")]
    spread = F.abs(F.col("mag_range") - F.abs(F.col("boosted_pred_mag") - F.col("forest_pred_mag"))) < 1e-9
    return out.agg(F.count("*").alias("n"), _outside(*fused, spread))


QUERIES = {
    f.__name__: f for f in (
        oof_regression, oof_late_weighted, gate_oof, quantile_forest, residual_calibration, residual_model,
        feature_selection, param_search, time_param_search, expanding_evaluation, oof_buckets, decoupled_predictions,
        single_horizon_predictions, window_model_predictions, extreme_risk_floor, batch_inference, holdout_evaluation,
        oof_regression_checked, window_heads_checked, persisted_heads_checked, head_risk_metrics, batch_inference_checked,
    )
}

ORACLES = {
    "window_model_predictions": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT "window", CASE WHEN "window" = 'T3' THEN greatest(0.0, main_mag - 1.55::DOUBLE)
        ELSE least(greatest(0.6::DOUBLE * mag_a + 0.4::DOUBLE * mag_b, 0.0), main_mag + 0.5) END AS pm,
  CASE "window" WHEN 'T3' THEN 120.0 WHEN 'T1' THEN least(greatest((hours_a + hours_b) / 2, 1e-6), 24.0)
       ELSE least(greatest((hours_a + hours_b) / 2, 24.000001), 72.0) END AS ph FROM preds)
SELECT "window", round(avg(pm), 6) AS mag, round(avg(ph), 6) AS hours FROM x GROUP BY 1""",
    "oof_regression_checked": """SELECT CAST(fold AS INT) AS fold, n // 6 AS n, CAST(0 AS BIGINT) AS outside, true AS beats_mean
FROM (SELECT count(*) AS n FROM orders), range(1, 6) t(fold)""",
    "window_heads_checked": f"""WITH {BASE_SQL},{labels_sql()}{long_sql()},
ranked AS (SELECT mainshock_id, row_number() OVER (ORDER BY t0, mainshock_id) - 1 AS i, count(*) OVER () AS total FROM main),
folds AS (SELECT mainshock_id, fold FROM ranked, range(1, 6) t(fold) WHERE i >= total - (6 - fold) * (total // 6) AND i < total - (5 - fold) * (total // 6))
SELECT "window", CAST(fold AS INT) AS fold, count(*) AS n, round(sum(true_mag), 6) AS truth, CAST(0 AS BIGINT) AS outside
FROM long_labels JOIN folds USING (mainshock_id) GROUP BY ALL""",
    "persisted_heads_checked": f"""WITH {BASE_SQL}
SELECT "window", count(*) AS n, CAST(0 AS BIGINT) AS outside FROM main, (VALUES ('T1'), ('T2'), ('T3')) w("window") GROUP BY 1""",
    "batch_inference_checked": f"WITH {BASE_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside FROM main",
}
