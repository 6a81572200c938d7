"""Queries: prediction lines, scoring and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorframe.sources.focal import distinct_events
from tremorframe.operators import labels as lab
from tremorframe.operators import metrics as mt
from tremorframe.operators import tables
from tremorframe.operators.sequences import mainshocks
from tremorframe.plans.inputs import (
    BASE_SQL, DATED_SQL, PREDICTIONS_SQL, catalog, dated_rows, predictions, rounded, table,
)
from tremorframe.plans.sequences import labels_sql, long_sql
from tremorframe.sinks import predictions as sink
from tremorframe.sources.predictions import merge_oof, parse_prediction_lines

MODELS_30D = {"a": ("mag_a", "days_a"), "b": ("mag_b", "days_b"), "c": ("mag_c", "days_c")}


def metrics_overall(spark, sf):
    return rounded(mt.regression_metrics(dated_rows(spark, sf), [], "true_mag", "mag_b", "true_days", "days_a",
                                         main_mag="main_mag"))


def model_comparison(spark, sf):
    long_df = mt.long_models(dated_rows(spark, sf), ["true_mag", "true_days"], MODELS_30D)
    return rounded(mt.regression_metrics(long_df, ["model"], "true_mag", "pred_mag", "true_days", "pred_time"))


def window_metrics(spark, sf):
    p = predictions(spark, sf).withColumn("w", F.when(F.col("true_mag") >= F.col("main_mag") - 1.2, 3.0).otherwise(1.0))
    return rounded(mt.window_metrics(p, ["window"], "true_mag", "mag_a", "true_hours", "hours_a", sample_weight="w"))


def _scored(spark, sf):
    return predictions(spark, sf).select(
        F.col("id").alias("mainshock_id"), "group_id", "window", "main_mag", "true_mag", "true_hours",
        F.col("mag_b").alias("pred_mag"), F.col("hours_a").alias("pred_hours"))


def metrics_by_window_rollup(spark, sf):
    return rounded(mt.package_scores(_scored(spark, sf)))


def worst_samples(spark, sf):
    out = mt.worst_samples(_scored(spark, sf))
    return rounded(out.select(F.col("mainshock_id").alias("id"), "window", F.col("rank").cast("bigint").alias("rank"), "abs_mag_error"))


def gap_by_earthquake(spark, sf):
    per = _scored(spark, sf).withColumn("mainshock_id", F.col("group_id").cast("string"))
    return rounded(mt.gap_by_earthquake(per))


def _reported(spark, sf):
    return dated_rows(spark, sf).select("plate_type", "time", "main_mag", "true_mag", F.col("true_days").alias("true_time"),
                                        F.col("mag_a").alias("pred_mag"), F.col("days_b").alias("pred_time"))


def error_by_type(spark, sf):
    return rounded(mt.error_by_type(_reported(spark, sf), "plate_type"))


def error_by_year(spark, sf):
    return rounded(mt.error_by_years(_reported(spark, sf), "time"))


def error_by_mag(spark, sf):
    return rounded(mt.error_by_mag(_reported(spark, sf), "main_mag"))


def residual_by_class(spark, sf):
    df = predictions(spark, sf).withColumn("residual", F.col("hours_a") - F.col("true_hours"))
    return rounded(mt.bias_by_class(df, "main_mag", "residual"))


def model_agreement(spark, sf):
    return rounded(mt.model_agreement(mt.long_models(dated_rows(spark, sf), ["id"], MODELS_30D), "id"))


def batch_summary(spark, sf):
    df = dated_rows(spark, sf).select(F.col("mag_a").alias("pred_mag"), F.col("days_a").alias("pred_time"),
                                      (F.col("plate_type") != "5-LOW").alias("success"))
    return rounded(mt.run_summary(df))


def validity_rates(spark, sf):
    df = dated_rows(spark, sf).select((F.col("mag_a") > 5).alias("a_valid"), (F.col("days_b") > 10).alias("b_valid"))
    return rounded(mt.validity_rates(df, ["a_valid", "b_valid"]))


def plate_counts(spark, sf):
    return mt.category_counts(dated_rows(spark, sf), "plate_type")


def magnitude_histogram(spark, sf):
    out = mt.histogram(catalog(spark, sf), "mag", 3.95, 8.95, 10)
    return out.withColumn("bin", F.col("bin").cast("bigint"))


def fold_metric_means(spark, sf):
    """Metrics per year and model, averaged over years, in long form."""
    long_df = mt.long_models(dated_rows(spark, sf), ["time", "true_mag", "true_days"], MODELS_30D)
    per_fold = long_df.groupBy(F.year("time").alias("fold"), "model").agg(
        mt.rmse(F.col("pred_mag") - F.col("true_mag")).alias("mag_rmse"),
        mt.rmse(F.col("pred_time") - F.col("true_days")).alias("time_rmse"))
    means = mt.mean_by_model(per_fold, ["mag_rmse", "time_rmse"])
    return rounded(mt.unpivot_metrics(means, ["model"], ["mag_rmse", "time_rmse"]))


def auc_rank_sum(spark, sf):
    df = predictions(spark, sf).withColumn("y", (F.col("true_mag") >= F.col("main_mag") - 2.0).cast("int"))
    return rounded(mt.risk_metrics(df, ["window"], "y", "risk"))


def label_auc(spark, sf):
    """Area under the curve of document length as a score of the quality label."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    df = table(spark, sf, "labels").filter("quality is not null").join(docs, "doc_id")
    return rounded(mt.auc(df, [], "quality", "n_chars"))


def f2_threshold(spark, sf):
    df = predictions(spark, sf).withColumn("y", (F.col("true_mag") >= 5.0).cast("int"))
    return rounded(mt.threshold_search(df, "y", "risk"))


def line_inputs(spark, sf):
    events = catalog(spark, sf)
    main = mainshocks(events)
    keep = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "mainshock_mag"]
    long_df = lab.long_windows(lab.window_labels(main, events), keep)
    return long_df.withColumn("pred_mag", F.col("true_mag") * 1.15).withColumn("pred_hours", F.col("true_hours") * 0.9)


def prediction_lines(spark, sf):
    out = sink.prediction_rows(line_inputs(spark, sf))
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))


def parsed_predictions(spark, sf):
    return rounded(parse_prediction_lines(sink.file_names(sink.prediction_rows(line_inputs(spark, sf)))))


def package_check(spark, sf):
    """Violations after every line of a third of the T2 rows is withheld."""
    rows = sink.prediction_rows(line_inputs(spark, sf))
    short = rows.filter((F.col("window") != "T2") | (F.substring("token", 13, 2).cast("int") >= 20))
    return sink.contract_violations(short)


def unmatched_truth(spark, sf):
    truth = line_inputs(spark, sf).select("mainshock_id", "window")
    preds = line_inputs(spark, sf).filter(F.col("true_mag") > 0).select("mainshock_id", "window")
    return mt.unmatched_truth(truth, preds)


def package_manifest(spark, sf):
    df = line_inputs(spark, sf).withColumn("source", F.when(F.col("true_mag") > 0, "model").otherwise("rule"))
    return sink.manifest(df)


def focal_dedupe(spark, sf):
    """Distinct catalog rows per (hour, place): the row with the smallest name stays, with its own columns."""
    df = catalog(spark, sf).select(F.date_trunc("hour", "time").alias("time"), "latitude", "longitude", F.lpad("id", 19, "0").alias("name"), "depth", "mag")
    return distinct_events(df).select(F.unix_micros("time").alias("hour_us"), "latitude", "longitude", F.col("name").cast("bigint").alias("id"), "depth", "mag")


def _model_tables(spark, sf):
    """Two models' out-of-fold tables; model b misses every fifth prediction."""
    d = dated_rows(spark, sf).select(
        F.col("id").cast("string").alias("mainshock_id"), F.col("time").alias("mainshock_time"),
        F.col("true_mag").alias("target_max_mag"), F.col("true_days").alias("target_time_to_max_days"), "id", "mag_a", "mag_b",
        "days_a", "days_b")
    keys = d.columns[:4]
    a = d.select(*keys, F.col("mag_a").alias("a_pred_mag"), F.col("days_a").alias("a_pred_time"))
    b = d.select(*keys, F.when(F.pmod("id", F.lit(5)) != 0, F.col("mag_b")).alias("b_pred_mag"), F.col("days_b").alias("b_pred_time"))
    return a, b


def oof_merge(spark, sf):
    a, b = _model_tables(spark, sf)
    out = merge_oof({"a": a, "b": b})
    return rounded(out.withColumn("mainshock_time", F.unix_micros("mainshock_time")).withColumnRenamed("mainshock_time", "time_us"))


def oof_window_join(spark, sf):
    """Window T2: labels of the mainshocks joined with predictions that every fourth mainshock lacks."""
    events = catalog(spark, sf)
    labelled = lab.window_labels(mainshocks(events), events)
    oof = lab.long_windows(labelled, ["mainshock_id", "mainshock_mag"]).select(
        "mainshock_id", "window", F.when(F.pmod(F.col("mainshock_id").cast("bigint"), F.lit(4)) != 0,
                                         F.col("mainshock_mag") - 1.5).alias("pred"))
    return rounded(tables.oof_with_truth(labelled, oof, "T2", "pred"))


def backfilled(spark, sf):
    """Depth is missing from the prediction rows and comes from the mainshock table."""
    main = mainshocks(catalog(spark, sf))
    rows = line_inputs(spark, sf).select("mainshock_id", "window", "pred_mag")
    return rounded(tables.backfill(rows, main, ["pred_mag", "mainshock_depth", "unknown"]))


QUERIES = {
    f.__name__: f for f in (
        oof_merge, oof_window_join, backfilled, metrics_overall, model_comparison, window_metrics, metrics_by_window_rollup, worst_samples,
        gap_by_earthquake, error_by_type, error_by_year, error_by_mag, residual_by_class, model_agreement,
        batch_summary, validity_rates, plate_counts, magnitude_histogram, fold_metric_means, auc_rank_sum,
        label_auc, f2_threshold, prediction_lines, parsed_predictions, package_check, unmatched_truth,
        package_manifest, focal_dedupe,
    )
}


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


ME = "(greatest(pm, 0.0) - tm)"
TE = "(greatest(pt, 0.0) - tt)"
LW = f"CASE WHEN {TE} > 0 THEN 2.0 ELSE 1.0 END"
REGRESSION = ", ".join([
    "count(*) AS n", r(f"sqrt(avg(pow({ME}, 2)))", "mag_rmse"), r(f"avg(abs({ME}))", "mag_mae"),
    r(f"sqrt(sum(exp(tm - 4.5) * pow({ME}, 2)) / sum(exp(tm - 4.5)))", "mag_weighted_rmse"),
    r(f"sqrt(avg(pow({TE}, 2)))", "time_rmse"), r(f"avg(abs({TE}))", "time_mae"),
    r("sqrt(avg(pow(log10(greatest(pt, 0.0) + 1) - log10(tt + 1), 2)))", "time_log_rmse"),
    r(f"avg(CASE WHEN abs({TE}) <= greatest(0.2::DOUBLE * tt, 0.5) THEN 1.0 ELSE 0.0 END)", "time_hit_rate"),
    r(f"avg({LW} * abs({TE}))", "time_asymmetric_mae"), r(f"sqrt(avg({LW} * pow({TE}, 2)))", "time_asymmetric_rmse"),
    r(f"avg(pow(10.0, 1.5 * abs({ME})))", "mag_energy_ratio_mean"), r(f"median(abs({ME}))", "mag_medae"),
    r(f"median(abs({TE}))", "time_medae"), r(f"median(pow(10.0, 1.5 * abs({ME})))", "mag_energy_ratio_median"),
])
TG, PG = "greatest(main_mag - tm, 0.0)", "greatest(main_mag - greatest(pm, 0.0), 0.0)"
LONG_SQL = "long_models AS (" + " UNION ALL ".join(
    f"SELECT id, time, true_mag AS tm, true_days AS tt, '{m}' AS model, {a} AS pm, {b} AS pt FROM dated"
    for m, (a, b) in MODELS_30D.items()) + ")"
MAE = ", ".join([
    "count(*) AS n", r("avg(abs(mag_a - true_mag))", "mag_mae"),
    r("avg(CASE WHEN days_b - true_days > 0 THEN 2.0 ELSE 1.0 END * abs(days_b - true_days))", "time_asym_mae")])
SCORED = "scored AS (SELECT *, mag_b - true_mag AS me, hours_a - true_hours AS te FROM preds)"
LINES = f"""{BASE_SQL}, {labels_sql()}{long_sql()},
li0 AS (SELECT l.*, m.t0, m.lat0, m.lon0, true_mag * 1.15::DOUBLE AS pm0, true_hours * 0.9::DOUBLE AS ph0,
          CASE "window" WHEN 'T1' THEN 0.0 WHEN 'T2' THEN 24.0 ELSE 72.0 END AS lo,
          CASE "window" WHEN 'T1' THEN 24.0 WHEN 'T2' THEN 72.0 ELSE 168.0 END AS hi
        FROM long_labels l JOIN main m USING (mainshock_id)),
li1 AS (SELECT *, least(greatest(pm0, 0.0), m0 + 0.5) AS pm, least(greatest(ph0, lo + 1e-6), hi) AS ph FROM li0),
lines AS (
  SELECT mainshock_id, strftime(make_timestamp(t0), '%Y%m%d%H%M%S') AS token, CASE WHEN "window" = 'T3' THEN 'T3' ELSE 'T1-T2' END AS file_kind,
         "window", CASE WHEN "window" = 'T2' THEN 1 ELSE 0 END AS line_no, true_mag,
         strftime(make_timestamp((t0 // 1000000 + CAST(round_even(ph, 0) AS BIGINT) * 3600) * 1000000), '%Y%m%d%H') AS stamp,
         printf('%.2f', lon0) AS lon, printf('%.2f', lat0) AS lat, printf('%.1f', m0) AS mm, printf('%.1f', pm) AS pm
  FROM li1)"""

ORACLES = {
    "oof_merge": f"""WITH {DATED_SQL}
SELECT CAST(id AS VARCHAR) AS mainshock_id, epoch_us(time) AS time_us, round(true_mag, 6) AS target_max_mag, round(true_days, 6) AS target_time_to_max_days,
  round(mag_a, 6) AS a_pred_mag, round(days_a, 6) AS a_pred_time, round(mag_b, 6) AS b_pred_mag, round(days_b, 6) AS b_pred_time
FROM dated WHERE id % 5 <> 0""",
    "oof_window_join": f"""WITH {BASE_SQL}, {labels_sql()}
SELECT mainshock_id, m0 AS mainshock_mag, round("target_T2_max_mag", 6) AS true_mag, round(m0 - 1.5, 6) AS pred_mag FROM labels_wide
WHERE "target_T2_max_mag" > 0 AND CAST(mainshock_id AS BIGINT) % 4 <> 0""",
    "backfilled": f"""WITH {LINES}
SELECT li1.mainshock_id, "window", round(pm0, 6) AS pred_mag, d0 AS mainshock_depth FROM li1 JOIN main m USING (mainshock_id)""",
    "metrics_overall": f"""WITH {DATED_SQL},
x AS (SELECT main_mag, true_mag AS tm, mag_b AS pm, true_days AS tt, days_a AS pt FROM dated)
SELECT {REGRESSION}, {r(f'avg({TG})', 'bath_true_delta_mean')}, {r(f'stddev_pop({TG})', 'bath_true_delta_std')},
       {r(f'avg({PG})', 'bath_pred_delta_mean')}, {r(f'stddev_pop({PG})', 'bath_pred_delta_std')},
       {r(f'avg(abs({TG} - {PG}))', 'bath_deviation')} FROM x""",
    "model_comparison": f"WITH {DATED_SQL}, {LONG_SQL} SELECT model, {REGRESSION} FROM long_models GROUP BY model",
    "window_metrics": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT *, mag_a - true_mag AS me, hours_a - true_hours AS te,
             CASE WHEN true_mag >= main_mag - 1.2::DOUBLE THEN 3.0 ELSE 1.0 END AS w FROM preds)
SELECT "window", count(*) AS n, {r('sqrt(sum(w * me * me) / sum(w))', 'mag_rmse')}, {r('avg(abs(me))', 'mag_mae')},
  {r('sqrt(sum(w * te * te) / sum(w))', 'time_hour_rmse')}, {r('avg(abs(te))', 'time_hour_mae')},
  {r('sqrt(avg(CASE WHEN te > 0 THEN 2.0 ELSE 1.0 END * te * te))', 'time_hour_asym_rmse')},
  {r('sqrt(sum(CASE WHEN te > 0 THEN 2.0 ELSE 1.0 END * w * te * te) / sum(CASE WHEN te > 0 THEN 2.0 ELSE 1.0 END * w))', 'time_hour_asymmetric_rmse')},
  {r('avg(CASE WHEN abs(te) <= greatest(0.2::DOUBLE * true_hours, 3.0) THEN 1.0 ELSE 0.0 END)', 'time_hour_hit_rate')}
FROM x GROUP BY "window" """,
    "metrics_by_window_rollup": f"""WITH {PREDICTIONS_SQL}, {SCORED}
SELECT coalesce("window", 'ALL') AS "window", count(*) AS "count", {r('avg(abs(me))', 'mag_mae')}, {r('sqrt(avg(me * me))', 'mag_rmse')},
  {r('avg(abs(te))', 'time_mae_h')}, {r('sqrt(avg(te * te))', 'time_rmse_h')},
  {r('avg(CASE WHEN abs(me) <= 0.5 THEN 1.0 ELSE 0.0 END)', 'within_mag_05')},
  {r('avg(CASE WHEN abs(te) <= 12.0 THEN 1.0 ELSE 0.0 END)', 'within_time_12h')},
  {r('avg(CASE WHEN abs(te) <= 24.0 THEN 1.0 ELSE 0.0 END)', 'within_time_24h')},
  {r('max(abs(me))', 'max_abs_mag_err')}, {r('max(abs(te))', 'max_abs_time_h')}
FROM scored GROUP BY GROUPING SETS (("window"), ())""",
    "worst_samples": f"""WITH {PREDICTIONS_SQL}, {SCORED}
SELECT id, "window", row_number() OVER (PARTITION BY "window" ORDER BY abs(me) DESC, id) AS rank, {r('abs(me)', 'abs_mag_error')}
FROM scored QUALIFY rank <= 10""",
    "gap_by_earthquake": f"""WITH {PREDICTIONS_SQL}, {SCORED}
SELECT CAST(group_id AS VARCHAR) AS mainshock_id, count(*) AS n, {r('avg(abs(me))', 'mag_mae')}, {r('max(abs(me))', 'mag_max')},
       {r('avg(abs(te))', 'time_mae_h')}, {r('max(abs(te))', 'time_max_h')} FROM scored GROUP BY 1""",
    "error_by_type": f"WITH {DATED_SQL} SELECT plate_type, {MAE} FROM dated GROUP BY 1 HAVING count(*) >= 5",
    "error_by_year": f"WITH {DATED_SQL} SELECT CAST(year(time) // 5 * 5 AS INT) AS year_bin, {MAE} FROM dated GROUP BY 1 HAVING count(*) >= 5",
    "error_by_mag": f"""WITH {DATED_SQL} SELECT CASE WHEN main_mag < 6.5 THEN '<6.5' WHEN main_mag < 7.0 THEN '6.5-7.0'
  WHEN main_mag < 7.5 THEN '7.0-7.5' WHEN main_mag < 8.0 THEN '7.5-8.0' ELSE '>=8.0' END AS mag_bin, {MAE} FROM dated GROUP BY 1""",
    "residual_by_class": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT CASE WHEN main_mag <= 6.5 THEN '5-6.5' WHEN main_mag <= 7.0 THEN '6.5-7' WHEN main_mag <= 7.5 THEN '7-7.5'
             WHEN main_mag <= 8.0 THEN '7.5-8' ELSE '8+' END AS b, hours_a - true_hours AS res FROM preds)
SELECT coalesce(b, 'ALL') AS mag_bin, count(*) AS n, {r('avg(res)', 'bias')} FROM x GROUP BY ROLLUP (b)""",
    "model_agreement": f"""WITH {DATED_SQL}, {LONG_SQL}
SELECT id, count(pm) AS n_models, {r('stddev_pop(pm)', 'mag_std')}, {r('max(pm) - min(pm)', 'mag_range')},
       {r('stddev_pop(pt)', 'time_std')}, {r('max(pt) - min(pt)', 'time_range')} FROM long_models GROUP BY id""",
    "batch_summary": f"""WITH {DATED_SQL}
SELECT count(*) AS total, count(*) FILTER (plate_type <> '5-LOW') AS succeeded, count(*) FILTER (plate_type = '5-LOW') AS failed,
  {r("avg(mag_a) FILTER (plate_type <> '5-LOW')", 'mag_mean')}, {r("stddev_samp(mag_a) FILTER (plate_type <> '5-LOW')", 'mag_std')},
  {r("avg(days_a) FILTER (plate_type <> '5-LOW')", 'time_mean')}, {r("stddev_samp(days_a) FILTER (plate_type <> '5-LOW')", 'time_std')} FROM dated""",
    "validity_rates": f"""WITH {DATED_SQL},
v AS (SELECT 'a_valid' AS feature, mag_a > 5 AS ok FROM dated UNION ALL SELECT 'b_valid', days_b > 10 FROM dated)
SELECT feature, count(*) FILTER (ok) AS valid_count, {r('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)', 'valid_rate')} FROM v GROUP BY 1""",
    "plate_counts": "SELECT o_orderpriority AS plate_type, count(*) AS n FROM orders GROUP BY 1",
    "magnitude_histogram": f"""WITH {BASE_SQL} SELECT least(9, CAST(floor((mag - 3.95::DOUBLE) / 0.5) AS BIGINT)) AS bin, count(*) AS n
FROM catalog WHERE mag BETWEEN 3.95 AND 8.95 GROUP BY 1""",
    "fold_metric_means": f"""WITH {DATED_SQL}, {LONG_SQL},
f AS (SELECT year(time) AS fold, model, sqrt(avg(pow(pm - tm, 2))) AS a, sqrt(avg(pow(pt - tt, 2))) AS b FROM long_models GROUP BY 1, 2)
SELECT model, 'mag_rmse' AS metric, {r('avg(a)', 'value')} FROM f GROUP BY model
UNION ALL SELECT model, 'time_rmse', round(avg(b), 6) FROM f GROUP BY model""",
    "auc_rank_sum": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT "window", risk, CAST(true_mag >= main_mag - 2.0::DOUBLE AS INT) AS y FROM preds),
rk AS (SELECT *, rank() OVER (PARTITION BY "window" ORDER BY risk)
              + (count(*) OVER (PARTITION BY "window", risk) - 1) / 2.0 AS ar FROM x)
SELECT "window", {r('avg(y)', 'positive_rate')}, {r('avg(risk)', 'prob_mean')},
  {r('coalesce(sum(y) FILTER (risk >= 0.5) / nullif(count(*) FILTER (risk >= 0.5), 0), 0.0)', 'precision_at_0_5')},
  {r('coalesce(sum(y) FILTER (risk >= 0.5) / nullif(sum(y), 0), 0.0)', 'recall_at_0_5')},
  {r('(sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))', 'roc_auc')}
FROM rk GROUP BY "window" """,
    "label_auc": """WITH x AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM x)
SELECT round((sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM rk""",
    "f2_threshold": f"""WITH {PREDICTIONS_SQL},
cuts AS (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM (SELECT unnest(generate_series(0, 98)) AS i)),
x AS (SELECT risk, true_mag >= 5.0 AS y FROM preds),
c AS (SELECT threshold, count(*) FILTER (y AND risk >= threshold) AS tp, count(*) FILTER (NOT y AND risk >= threshold) AS fp,
             count(*) FILTER (NOT y AND risk < threshold) AS tn, count(*) FILTER (y AND risk < threshold) AS fn FROM x, cuts GROUP BY 1),
s AS (SELECT *, 5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0) AS fb FROM c)
SELECT {r('threshold', 'threshold')}, tp, fp, tn, fn, {r('tp / greatest(tp + fp, 1)', 'precision')}, {r('tp / greatest(tp + fn, 1)', 'recall')},
  {r('(tp + tn) / greatest(tp + fp + tn + fn, 1)', 'accuracy')}, {r('coalesce(fb, 0.0)', 'fbeta')},
  row_number() OVER (ORDER BY round(coalesce(fb, 0.0), 12) DESC, threshold) = 1 AS best FROM s""",
    "prediction_lines": f"""WITH {LINES}
SELECT token, file_kind, "window", CAST(line_no AS BIGINT) AS line_no,
       concat_ws(' ', token, lon, lat, mm, pm, '(Ms)', stamp) AS line FROM lines""",
    "parsed_predictions": f"""WITH {LINES}
SELECT token AS mainshock_id, "window", CAST(mm AS DOUBLE) AS main_mag, CAST(pm AS DOUBLE) AS pred_mag,
  round((epoch_us(strptime(stamp, '%Y%m%d%H')) - epoch_us(strptime(token, '%Y%m%d%H%M%S'))) / 3600000000.0::DOUBLE, 6) AS pred_hours FROM lines""",
    "package_check": f"""WITH {LINES},
k AS (SELECT * FROM lines WHERE "window" <> 'T2' OR CAST(substr(token, 13, 2) AS INT) >= 20)
SELECT token, count(*) FILTER (file_kind = 'T1-T2') AS t1t2_lines, count(*) FILTER (file_kind = 'T3') AS t3_lines
FROM k GROUP BY token HAVING t1t2_lines <> 2 OR t3_lines <> 1""",
    "unmatched_truth": f"""WITH {LINES} SELECT mainshock_id, "window" FROM lines WHERE true_mag <= 0""",
    "package_manifest": f"""WITH {LINES} SELECT CASE WHEN true_mag > 0 THEN 'model' ELSE 'rule' END AS source, count(*) AS predictions,
  count(DISTINCT mainshock_id) AS sequences FROM lines GROUP BY 1""",
    "focal_dedupe": f"""WITH {BASE_SQL}
SELECT us // 3600000000 * 3600000000 AS hour_us, latitude, longitude, CAST(id AS BIGINT) AS id, depth, mag FROM catalog
QUALIFY row_number() OVER (PARTITION BY us // 3600000000, latitude, longitude ORDER BY CAST(id AS BIGINT)) = 1""",
}
