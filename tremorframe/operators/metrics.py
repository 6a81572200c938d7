"""Scoring: error metrics, report tables, classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorframe.operators.ranking import exact_quantiles, global_running_sum


def rmse(error: Column, weight: Column | None = None) -> Column:
    if weight is None:
        return F.sqrt(F.avg(error * error))
    return F.sqrt(F.sum(weight * error * error) / F.sum(weight))


def late(error: Column, weight: float = 2.0) -> Column:
    """Weight of a time error: heavier when the forecast is after the event."""
    return F.when(error > 0, F.lit(weight)).otherwise(F.lit(1.0))


def regression_metrics(df: DataFrame, groups: list[str], true_mag: str, pred_mag: str, true_time: str,
                       pred_time: str, late_weight: float = 2.0, main_mag: str | None = None) -> DataFrame:
    """All metrics of the 30-day task, per group. Predictions are floored at zero first.

    Sums come from one aggregation; the three medians from one exact distributed quantile.
    """
    pm, pt = F.greatest(F.col(pred_mag), F.lit(0.0)), F.greatest(F.col(pred_time), F.lit(0.0))
    main = [F.col(main_mag).alias("_main")] if main_mag else []
    rows = df.select(*groups, F.col(true_mag).alias("_tm"), F.col(true_time).alias("_tt"), pm.alias("_pm"),
                     pt.alias("_pt"), *main)
    me, te = F.col("_pm") - F.col("_tm"), F.col("_pt") - F.col("_tt")
    weight = F.exp(F.col("_tm") - 4.5)
    log_error = F.log10(F.col("_pt") + 1) - F.log10(F.col("_tt") + 1)
    hit = F.abs(te) <= F.greatest(0.2 * F.col("_tt"), F.lit(0.5))
    ratio = F.pow(F.lit(10.0), 1.5 * F.abs(me))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        rmse(me).alias("mag_rmse"), F.avg(F.abs(me)).alias("mag_mae"),
        rmse(me, weight).alias("mag_weighted_rmse"),
        rmse(te).alias("time_rmse"), F.avg(F.abs(te)).alias("time_mae"), rmse(log_error).alias("time_log_rmse"),
        F.avg(hit.cast("int")).alias("time_hit_rate"),
        F.avg(late(te, late_weight) * F.abs(te)).alias("time_asymmetric_mae"),
        F.sqrt(F.avg(late(te, late_weight) * te * te)).alias("time_asymmetric_rmse"),
        F.avg(ratio).alias("mag_energy_ratio_mean"),
    ]
    if main_mag:
        true_gap = F.greatest(F.col("_main") - F.col("_tm"), F.lit(0.0))
        pred_gap = F.greatest(F.col("_main") - F.col("_pm"), F.lit(0.0))
        aggs += [
            F.avg(true_gap).alias("bath_true_delta_mean"), F.stddev_pop(true_gap).alias("bath_true_delta_std"),
            F.avg(pred_gap).alias("bath_pred_delta_mean"), F.stddev_pop(pred_gap).alias("bath_pred_delta_std"),
            F.avg(F.abs(true_gap - pred_gap)).alias("bath_deviation"),
        ]
    names = {"mag_medae": F.abs(me), "time_medae": F.abs(te), "mag_energy_ratio_median": ratio}
    long_rows = rows.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in names.items()
    ])).alias("_m")).select(*groups, "_m.*")
    medians = exact_quantiles(long_rows, [*groups, "metric"], "value", [0.5])
    wide = medians.groupBy(*groups).agg(*[
        F.max(F.when(F.col("metric") == name, F.col("q0"))).alias(name) for name in names])
    sums = rows.groupBy(*groups).agg(*aggs)
    if groups:
        return sums.join(wide, groups)
    # Two one-row results.
    return sums.withColumn("_one", F.lit(1)).join(wide.withColumn("_one", F.lit(1)), "_one").drop("_one")


def window_metrics(df: DataFrame, groups: list[str], true_mag: str, pred_mag: str, true_hours: str,
                   pred_hours: str, late_weight: float = 2.0, sample_weight: str | None = None) -> DataFrame:
    """Metrics of the window task in hours; a hit is within max(20 %, 3 h)."""
    me, te = F.col(pred_mag) - F.col(true_mag), F.col(pred_hours) - F.col(true_hours)
    w = F.col(sample_weight) if sample_weight else None
    asym = late(te, late_weight) * (w if w is not None else F.lit(1.0))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rmse(me, w).alias("mag_rmse"), F.avg(F.abs(me)).alias("mag_mae"),
        rmse(te, w).alias("time_hour_rmse"), F.avg(F.abs(te)).alias("time_hour_mae"),
        F.sqrt(F.avg(late(te, late_weight) * te * te)).alias("time_hour_asym_rmse"),
        rmse(te, asym).alias("time_hour_asymmetric_rmse"),
        F.avg((F.abs(te) <= F.greatest(0.2 * F.col(true_hours), F.lit(3.0))).cast("int")).alias("time_hour_hit_rate"),
    )


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "mag_error": F.col("pred_mag") - F.col("true_mag"),
        "time_error_h": F.col("pred_hours") - F.col("true_hours"),
        "abs_mag_error": F.abs(F.col("pred_mag") - F.col("true_mag")),
        "abs_time_error_h": F.abs(F.col("pred_hours") - F.col("true_hours")),
    })


def package_scores(df: DataFrame) -> DataFrame:
    """Scores per window and over all of them, from one rollup."""
    rows = with_errors(df)
    am, at = F.col("abs_mag_error"), F.col("abs_time_error_h")
    return rows.rollup("window").agg(
        F.count(F.lit(1)).alias("count"), F.avg(am).alias("mag_mae"), rmse(F.col("mag_error")).alias("mag_rmse"),
        F.avg(at).alias("time_mae_h"), rmse(F.col("time_error_h")).alias("time_rmse_h"),
        F.avg((am <= 0.5).cast("int")).alias("within_mag_05"),
        F.avg((at <= 12.0).cast("int")).alias("within_time_12h"),
        F.avg((at <= 24.0).cast("int")).alias("within_time_24h"),
        F.max(am).alias("max_abs_mag_err"), F.max(at).alias("max_abs_time_h"),
    ).withColumn("window", F.coalesce("window", F.lit("ALL")))


def worst_samples(df: DataFrame, limit: int = 10) -> DataFrame:
    """Largest magnitude errors per window; the rank limit applies before the shuffle."""
    order = Window.partitionBy("window").orderBy(F.desc("abs_mag_error"), "mainshock_id")
    return with_errors(df).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def match_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return truth.join(predictions.select("mainshock_id", "window", "pred_mag", "pred_hours"),
                      ["mainshock_id", "window"])


def unmatched_truth(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return truth.join(predictions, ["mainshock_id", "window"], "left_anti").select("mainshock_id", "window")


def gap_by_earthquake(df: DataFrame) -> DataFrame:
    return with_errors(df).groupBy("mainshock_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_mag_error").alias("mag_mae"), F.max("abs_mag_error").alias("mag_max"),
        F.avg("abs_time_error_h").alias("time_mae_h"), F.max("abs_time_error_h").alias("time_max_h"))


def _mean_errors(df: DataFrame, keys: list[str], late_weight: float) -> DataFrame:
    me, te = F.col("pred_mag") - F.col("true_mag"), F.col("pred_time") - F.col("true_time")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(me)).alias("mag_mae"),
        F.avg(late(te, late_weight) * F.abs(te)).alias("time_asym_mae"))


def error_by_type(df: DataFrame, kind: str, min_rows: int = 5, late_weight: float = 2.0) -> DataFrame:
    return _mean_errors(df, [kind], late_weight).filter(F.col("n") >= min_rows)


def error_by_years(df: DataFrame, time: str, years: int = 5, min_rows: int = 5, late_weight: float = 2.0) -> DataFrame:
    binned = df.withColumn("year_bin", (F.floor(F.year(time) / years) * years).cast("int"))
    return _mean_errors(binned, ["year_bin"], late_weight).filter(F.col("n") >= min_rows)


def mag_class(mag: Column) -> Column:
    """Left-closed report classes."""
    return (F.when(mag < 6.5, "<6.5").when(mag < 7.0, "6.5-7.0").when(mag < 7.5, "7.0-7.5")
            .when(mag < 8.0, "7.5-8.0").when(mag < 10.0, ">=8.0"))


def correction_class(mag: Column) -> Column:
    """Right-closed classes of the residual correction."""
    return (F.when((mag > 5.0) & (mag <= 6.5), "5-6.5").when(mag <= 7.0, F.when(mag > 6.5, "6.5-7"))
            .when(mag <= 7.5, "7-7.5").when(mag <= 8.0, "7.5-8").when(mag <= 10.0, "8+"))


def error_by_mag(df: DataFrame, main_mag: str, late_weight: float = 2.0) -> DataFrame:
    return _mean_errors(df.withColumn("mag_bin", mag_class(F.col(main_mag))), ["mag_bin"], late_weight)


def bias_by_class(df: DataFrame, main_mag: str, residual: str) -> DataFrame:
    """Mean residual per class and overall (class ALL) from one rollup."""
    return (
        df.withColumn("mag_bin", F.coalesce(correction_class(F.col(main_mag)), F.lit("none")))
        .rollup("mag_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(residual).alias("bias"))
        .withColumn("mag_bin", F.coalesce("mag_bin", F.lit("ALL"))))


def long_models(df: DataFrame, keep: list[str], models: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per model with ``pred_mag`` and ``pred_time``."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(m).cast("double").alias("pred_mag"),
                 F.col(t).cast("double").alias("pred_time"))
        for name, (m, t) in models.items()
    ])).alias("_m")).select(*keep, "_m.*")


def model_agreement(long_df: DataFrame, key: str) -> DataFrame:
    """Population spread and range of the models that gave a value."""
    return long_df.groupBy(key).agg(
        F.count("pred_mag").alias("n_models"),
        F.stddev_pop("pred_mag").alias("mag_std"), (F.max("pred_mag") - F.min("pred_mag")).alias("mag_range"),
        F.stddev_pop("pred_time").alias("time_std"), (F.max("pred_time") - F.min("pred_time")).alias("time_range"))


def run_summary(df: DataFrame) -> DataFrame:
    """Batch summary: means, sample deviations, success and error counts."""
    ok = F.col("success")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("pred_mag"))).alias("mag_mean"), F.stddev_samp(F.when(ok, F.col("pred_mag"))).alias("mag_std"),
        F.avg(F.when(ok, F.col("pred_time"))).alias("time_mean"),
        F.stddev_samp(F.when(ok, F.col("pred_time"))).alias("time_std"))


def validity_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and share of valid rows per flag column."""
    long_rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias("valid"))
        for f in flags])).alias("_v")).select("_v.*")
    return long_rows.groupBy("feature").agg(
        F.count_if("valid").alias("valid_count"), F.avg(F.col("valid").cast("int")).alias("valid_rate"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the last bin is closed on both sides."""
    value = F.col(column)
    number = F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)).cast("int"))
    inside = df.filter((value >= low) & (value <= high))
    return inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_by_model(fold_metrics: DataFrame, metrics: list[str]) -> DataFrame:
    return fold_metrics.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])


def unpivot_metrics(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def auc(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Exact area under the curve with average ranks on ties.

    Equal scores are counted first; a distributed running sum gives the negatives below each
    score. NULL when a class is absent.
    """
    if not groups:
        return auc(df.withColumn("_all", F.lit(0)), ["_all"], label, score).drop("_all")
    counted = df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    ranked = global_running_sum(counted, [*[F.col(g) for g in groups], F.col(score)], {"_n": "_below"})
    start = ranked.groupBy(*groups).agg(F.min("_below").alias("_start"))
    pairs = F.sum(F.col("_p") * (F.col("_below") - F.col("_start") + F.col("_n") / 2.0))
    total = F.sum("_p") * F.sum("_n")
    return ranked.join(start, groups).groupBy(*groups).agg(F.when(total > 0, pairs / total).alias("roc_auc"))


def risk_metrics(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= 0.5
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    base = df.filter(F.col(score).isNotNull()).groupBy(*groups).agg(
        F.avg(y.cast("int")).alias("positive_rate"), F.avg(score).alias("prob_mean"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision_at_0_5"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall_at_0_5"))
    return base.join(auc(df, groups, label, score), groups)


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> Column:
    b2 = beta * beta
    bottom = (1 + b2) * tp + b2 * fn + fp
    return F.when(bottom > 0, (1 + b2) * tp / bottom).otherwise(0.0)


def threshold_search(df: DataFrame, label: str, score: str, beta: float = 2.0, step: float = 0.01) -> DataFrame:
    """Confusion counts at every threshold and the F-beta; ``best`` marks the winner.

    A row is reduced to the number of thresholds it passes, so the data becomes at most
    (thresholds + 1) counters before the thresholds are laid over them.
    """
    total = int(round(1.0 / step)) - 1

    def cut(k: Column) -> Column:
        return F.lit(step) + (k - 1) * F.lit(step)

    # The division lands within one step of the exact count; three comparisons settle it.
    base = F.greatest(F.floor(F.col(score) / step).cast("int") - 1, F.lit(0))
    passed = F.least(F.lit(total), base + sum(
        ((cut(base + i) <= F.col(score)).cast("int") for i in (1, 2, 3)), F.lit(0)))
    counters = df.filter(F.col(score).isNotNull()).groupBy(passed.alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    spread = counters.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(total))))
    over = F.col("passed") >= F.col("k")
    confusion = spread.groupBy("k").agg(
        F.sum(F.when(over, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~over, F.col("_n")).otherwise(0)).alias("tn"), F.sum(F.when(~over, F.col("_p")).otherwise(0)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scored = confusion.select(
        cut(F.col("k")).alias("threshold"), "tp", "fp", "tn", "fn",
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        ((tp + tn) / F.greatest(tp + fp + tn + fn, F.lit(1))).alias("accuracy"), fbeta(tp, fp, fn, beta).alias("fbeta"))
    # 99 rows: a single small window picks the lowest threshold among the best.
    first = F.row_number().over(Window.orderBy(F.desc(F.round("fbeta", 12)), "threshold"))
    return scored.withColumn("best", first == 1)
