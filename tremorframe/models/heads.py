"""Window models: magnitude, time bucket, direct time and extreme heads on legal features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import WINDOW_BOUNDS
from tremorframe.functions.windows import expected_hours, log_target, time_bucket, unlog_target
from tremorframe.models.boosting import clean, fit_all, scores_by_key
from tremorframe.models.training import buckets, gates, regression
from tremorframe.operators.features import feature_columns, legal_features
from tremorframe.operators.folds import Fold, assign_fold
from tremorframe.operators.fusion import null_mean
from tremorframe.operators.labels import extreme_flag


def head_columns(legal: DataFrame) -> list[str]:
    """Inputs of a window's heads: model features and the observed counts."""
    observed = [c for c in legal.columns if c.startswith(("obs_", "count_obs", "energy_obs"))]
    return list(dict.fromkeys(feature_columns(legal) + observed))


def window_table(ranked: DataFrame, window: str, margin: float = 1.2) -> tuple[DataFrame, list[str]]:
    """Legal feature arrays with the targets of one window."""
    legal = legal_features(ranked, window)
    columns = head_columns(legal)
    mag, hours = f"target_{window}_max_mag", f"target_{window}_time_to_max_hours"
    base = legal.join(ranked.select("mainshock_id", "row_index", "time_us", *(
        [mag, hours] if mag not in legal.columns else [])), "mainshock_id")
    table = base.withColumn("features", clean(columns)).select(
        "mainshock_id", "row_index", "time_us", "mainshock_mag", "features",
        F.col(mag).alias("true_mag"), F.col(hours).alias("true_hours"))
    return table.withColumns({
        "bucket": time_bucket(F.lit(window), F.col("true_hours")),
        "extreme": extreme_flag(F.col("true_mag"), F.col("mainshock_mag"), margin).cast("int"),
    }), columns


def oof_window(table: DataFrame, window: str, folds: list[Fold], width: int, kinds=("boosted", "forest"),
               params: dict[str, dict] | None = None) -> DataFrame:
    """Out-of-fold output of every head of one window: all folds and heads are fitted in one job. ``width`` is the number of features."""
    params = params or {}
    low, high = WINDOW_BOUNDS[window]
    fits = []
    for fold in folds:
        at = fold.trains(), fold.validates()
        for kind in kinds:
            fits.append(regression(f"_mag_{kind}", kind, at[0], F.col("true_mag"), at[1], params.get(kind)))
            fits.append(regression(f"_hours_{kind}", kind, at[0], log_target(F.col("true_hours")), at[1], params.get(kind)))
        fits.append(buckets("bucket_probs", at[0], "bucket", at[1], params.get("buckets")))
    fits += gates(table, {f"f{f.fold}": (f.trains(), f.validates()) for f in folds}, "extreme", "extreme_prob", params.get("extreme"))
    scores = scores_by_key(fit_all(table, "row_index", [f"f{k}" for k in range(width)], fits, features="features"), fits, "row_index")
    mags = {f"mag_{k}": F.greatest(F.col(f"_mag_{k}"), F.lit(0.0)) for k in kinds}
    hours = {f"hours_{k}": F.least(F.greatest(unlog_target(F.col(f"_hours_{k}")), F.lit(low + 1e-6)), F.lit(high)) for k in kinds}
    out = assign_fold(table, folds).join(scores, "row_index").withColumns({**mags, **hours, "window": F.lit(window)})
    return out.withColumns({
        "hours_bucket": expected_hours(F.lit(window), F.col("bucket_probs")),
        "mag_mean": null_mean([F.col(m) for m in mags])}).drop("features", *[f"_mag_{k}" for k in kinds], *[f"_hours_{k}" for k in kinds])


def oof_extreme(table: DataFrame, folds: list[Fold], width: int, params: dict | None = None) -> DataFrame:
    """The extreme head alone, out of fold: ``mainshock_id, fold, extreme, extreme_prob``."""
    fits = gates(table, {f"f{f.fold}": (f.trains(), f.validates()) for f in folds}, "extreme", "extreme_prob", params)
    scores = scores_by_key(fit_all(table, "row_index", [f"f{k}" for k in range(width)], fits, features="features"), fits, "row_index")
    return assign_fold(table, folds).join(scores, "row_index").select("mainshock_id", "fold", "extreme", "extreme_prob")


def oof_bucket_accuracy(oof: DataFrame) -> DataFrame:
    best = F.array_position(F.col("bucket_probs"), F.array_max("bucket_probs")) - 1
    return oof.groupBy("window", "fold").agg(F.avg((best == F.col("bucket")).cast("int")).alias("bucket_accuracy"))
