"""Queries: folds, fusion weights, rule and shift searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorframe.operators import folds as fd
from tremorframe.operators import fusion as fu
from tremorframe.operators import metrics as mt
from tremorframe.operators import rules as ru
from tremorframe.plans.inputs import DATED_SQL, PREDICTIONS_SQL, dated_rows, predictions, rounded
from tremorframe.session import durable

MAGS = ["mag_a", "mag_b", "mag_c", "mag_d"]
DAYS = ["days_a", "days_b", "days_c"]


def _ranked(spark, sf):
    return fd.with_time_rank(dated_rows(spark, sf).select("id", "time", "true_days"), "time", "id")


def time_folds(spark, sf):
    ranked = _ranked(spark, sf)
    out = fd.assign_fold(ranked, fd.plan_folds(ranked, 5))
    return out.select("id", "row_index", F.col("fold").cast("bigint").alias("fold"))


def purged_folds(spark, sf):
    ranked = _ranked(spark, sf)
    return fd.fold_table(ranked, fd.plan_folds(ranked, 5))


def purged_folds_gate(spark, sf):
    ranked = _ranked(spark, sf)
    return fd.fold_table(ranked, fd.plan_folds(ranked, 8, fd.PURGE_GATE))


def expanding_windows(spark, sf):
    """Rows and mean truth per expanding window."""
    ranked = _ranked(spark, sf)
    n = ranked.count()
    windows = fd.expanding_windows(n, n // 3, max(10, n // 10))
    bounds = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for w, a, b in windows])
    rows = ranked.withColumn("w", F.explode(bounds)).filter(F.col("row_index") < F.col("w.b"))
    train = F.col("row_index") < F.col("w.a")
    out = rows.groupBy(F.col("w.window").cast("bigint").alias("window")).agg(
        F.count_if(train).alias("train_rows"), F.count_if(~train).alias("valid_rows"),
        F.avg(F.when(~train, F.col("true_days"))).alias("valid_mean_days"))
    return rounded(out)


def holdout_split(spark, sf):
    train, valid = fd.holdout_split(_ranked(spark, sf))
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"),
                                   F.max("time_us").alias("last_us"))
    return part(train, "train").unionByName(part(valid, "valid"))


def gain_cut(spark, sf):
    """Cumulative-gain selection with part sizes as gains."""
    from tremorframe.models.selection import keep_by_gain
    from tremorframe.plans.inputs import table

    gains = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.sum(F.col("p_size").cast("double")).alias("gain"))
    return rounded(keep_by_gain(gains, ratio=0.85, least=5))


def simplex_weights(spark, sf):
    """Best weights of four magnitude models on the 0.02 grid."""
    scores = fu.grid_scores(dated_rows(spark, sf), MAGS, "true_mag", fu.simplex_grid(4, 0.02))
    return rounded(scores.orderBy("score", "point").limit(1).drop("point"))


def simplex_late_weights(spark, sf):
    """Late-weighted scores of three time models over the whole 0.02 grid."""
    scores = fu.grid_scores(dated_rows(spark, sf), DAYS, "true_days", fu.simplex_grid(3, 0.02), "late_rmse")
    return rounded(scores)


def fusion_objectives(spark, sf):
    """Line search of two time models under each of the five objectives."""
    df = dated_rows(spark, sf)
    sums = durable(fu.grid_sums(df, ["days_a", "days_b"], "true_days", fu.simplex_grid(2, 0.02)))
    best = None
    for name in ("rmse", "mae", "mae+rmse", "time_mae", "time_mae+rmse"):
        top = sums.select("point", fu.objective_column(name).alias("score")).orderBy(F.round("score", 10), "point").limit(1)
        top = top.select(F.lit(name).alias("objective"), "point", "score")
        best = top if best is None else best.unionByName(top)
    return rounded(best)


def two_model_weights(spark, sf):
    """Line search with sample weights, per point. The offsets keep errors away from exact zero."""
    df = predictions(spark, sf).withColumns({
        "w": F.when(F.col("true_mag") >= F.col("main_mag") - 1.2, 3.0).otherwise(1.0),
        "hours_a": F.col("hours_a") + 0.013, "hours_b": F.col("hours_b") + 0.007})
    scores = fu.grid_scores(df, ["hours_a", "hours_b"], "true_hours", fu.simplex_grid(2, 0.05), "late_weighted_rmse",
                            weight="w")
    return rounded(scores.select("point", "score"))


def ridge_stacking(spark, sf):
    """Normalised non-negative stacking weights per penalty."""
    return rounded(fu.stack_nonnegative(dated_rows(spark, sf), MAGS, "true_mag"), 5)


WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.2}


def weighted_fusion(spark, sf):
    """Fusion in long form; model b is missing for every seventh row."""
    long_df = mt.long_models(dated_rows(spark, sf), ["id"], {m: (f"mag_{m}", f"days_{m}") for m in WEIGHTS})
    gap = (F.col("model") == "b") & (F.pmod("id", F.lit(7)) == 0)
    long_df = long_df.select("id", "model", F.when(~gap, F.col("pred_mag")).alias("pred"))
    weights = fu.normalize_weight_rows(spark.createDataFrame(
        [("mag", m, 2 * w) for m, w in WEIGHTS.items()], "target string, model string, w double"))
    return rounded(fu.fuse_long(long_df, ["id"], weights.select("model", "w")))


def ensemble_metrics(spark, sf):
    """Fused prediction of both targets, scored; combined = magnitude RMSE + late time RMSE."""
    df = dated_rows(spark, sf)
    mag = fu.fused({m: F.col(f"mag_{m}") for m in WEIGHTS}, WEIGHTS)
    days = fu.fused({m: F.col(f"days_{m}") for m in WEIGHTS}, WEIGHTS)
    out = mt.regression_metrics(df.withColumns({"fm": mag, "fd": days}), [], "true_mag", "fm", "true_days", "fd")
    return rounded(out.select("n", "mag_rmse", "time_asymmetric_rmse", (F.col("mag_rmse") + F.col("time_asymmetric_rmse"))
                              .alias("combined")))


def null_aware_mean(spark, sf):
    df = dated_rows(spark, sf)
    b = F.when(F.pmod("id", F.lit(3)) > 0, F.col("mag_b"))
    return rounded(df.select("id", fu.null_mean([F.col("mag_a"), b]).alias("mag_mean")))


def _sides(spark, sf):
    df = dated_rows(spark, sf)
    long_df = df.select(F.col("id").alias("mainshock_id"), "main_mag", "true_mag", "mag_a", "mag_b", "days_a", "days_b",
                        F.explode(F.array(*[F.lit(w) for w in ("T1", "T2", "T3")])).alias("window"))
    score = long_df.select("mainshock_id", "window", "main_mag", F.col("mag_a").alias("pred_mag"), F.col("days_a").alias("pred_hours"))
    legal = long_df.select("mainshock_id", "window", "main_mag", F.col("mag_b").alias("pred_mag"), (F.col("days_b") * 3).alias("pred_hours"))
    return score, legal


def hybrid_pick(spark, sf):
    return rounded(fu.hybrid_pick(*_sides(spark, sf)))


def post_calibration(spark, sf):
    score, _ = _sides(spark, sf)
    out = fu.calibrate(score, fu.parse_calibration("T1:-0.1,T2:0.1"), fu.parse_calibration("T1:0.5,T3:-2"))
    return rounded(out.select("mainshock_id", "window", "pred_mag", "pred_hours"))


def extreme_postprocessing(spark, sf):
    df = predictions(spark, sf)
    mag, hours = fu.extreme_adjusted(F.col("mag_b"), F.col("hours_a"), F.col("risk"), F.col("main_mag"), F.col("window"),
                                     t1_bonus=0.1)
    return rounded(df.select("id", "window", mag.alias("mag"), hours.alias("hours")))


def _risk_rows(spark, sf):
    return predictions(spark, sf).withColumn(
        "w", F.when(F.col("true_mag") >= F.col("main_mag") - 1.2, 4.0).otherwise(1.0))


def risk_adjust_search(spark, sf):
    return rounded(ru.risk_mag_search(_risk_rows(spark, sf), ["window"], "mag_b", "main_mag", "risk", "true_mag", "w"))


def risk_time_search(spark, sf):
    return rounded(ru.risk_time_search(_risk_rows(spark, sf), ["window"], "hours_a", "window", "risk", "true_hours", "w"))


def risk_adjusted(spark, sf):
    df = predictions(spark, sf)
    mag = ru.apply_risk_mag(F.col("mag_b"), F.col("main_mag"), F.col("risk"), 0.3, 0.8, 0.4)
    hours = ru.apply_risk_hours(F.col("hours_a"), F.col("window"), F.col("risk"), 0.3, 0.2, 0.4)
    return rounded(df.select("id", "window", mag.alias("mag"), hours.alias("hours")))


def _rule_sets(spark, sf):
    rows = predictions(spark, sf).select("id", "window", "plate_type", "main_mag", "true_mag", F.col("mag_c").alias("pred_mag"))
    return rows.filter("plate_type = 'A'"), rows.filter("plate_type <> 'A'")


def floor_rule_search(spark, sf):
    return rounded(ru.floor_rule_search(*_rule_sets(spark, sf), ["window"]))


def floor_rule_choice(spark, sf):
    """The rule each mode would take."""
    found = durable(ru.floor_rule_search(*_rule_sets(spark, sf), ["window"]))
    out = None
    for mode in ("safe", "balanced", "public_max"):
        row = ru.choose_rule(found, ["window"], mode).select(F.lit(mode).alias("mode"), "window", "visible_rmse", "visible_changed")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def floor_rule_applied(spark, sf):
    rows = predictions(spark, sf).withColumn("p", ru.floor_rule(F.col("mag_c"), F.col("main_mag"), 7.5, 2.0, 0.6))
    return rounded(rows.select("id", "window", F.col("p").alias("mag"), (F.col("p") > F.col("mag_c") + 1e-9).alias("raised")))


def oof_first_rule(spark, sf):
    _, oof = _rule_sets(spark, sf)
    return rounded(ru.oof_first_rule(oof, ["window"]).select("window", "oof_high_mae", "oof_rmse", "oof_mae"))


def _shift_rows(spark, sf):
    fraction = F.pmod(F.col("group_id"), F.lit(3600)) / F.lit(3600.0)
    return predictions(spark, sf).select("window", "true_hours", F.col("hours_a").alias("pred_hours"), fraction.alias("fraction"))


def hour_shift_table(spark, sf):
    out = ru.shift_table(_shift_rows(spark, sf))
    return rounded(out.select("window", "shift", "n", F.sqrt(F.col("ss") / F.col("n")).alias("rmse"), (F.col("sa") / F.col("n")).alias("mae")))


def hour_shift_search(spark, sf):
    return rounded(ru.shift_search(_shift_rows(spark, sf)))


def directional_shift(spark, sf):
    return rounded(ru.directional_check(_shift_rows(spark, sf)))


def residual_corrected(spark, sf):
    """T3 times corrected by class and global bias."""
    rows = predictions(spark, sf).filter("window = 'T3'").withColumn("residual", F.col("hours_a") - F.col("true_hours"))
    bias = {r["mag_bin"]: r["bias"] for r in mt.bias_by_class(rows, "main_mag", "residual").collect()}
    fixed = rows.withColumn("h", ru.residual_corrected(F.col("hours_a"), F.col("main_mag"), bias, bias["ALL"]))
    return rounded(fixed.select("id", mt.mag_class(F.col("main_mag")).alias("mag_bin"), F.col("h").alias("hours")))


def extreme_floor_search(spark, sf):
    df = predictions(spark, sf).select("window", "main_mag", "true_mag", F.col("mag_c").alias("pred_mag"), F.col("risk").alias("probability"))
    return rounded(ru.extreme_floor_search(df, ["window"]))


def expected_bucket_hours(spark, sf):
    """Expected time from aligned bucket probabilities; the third class is never seen."""
    from tremorframe.functions.windows import align_probabilities, expected_hours

    raw = F.array(F.col("risk"), 1 - F.col("risk"), F.pmod(F.col("group_id"), F.lit(5)) / F.lit(10.0))
    labels = F.array(F.lit(0), F.lit(1), F.lit(3))
    df = predictions(spark, sf).withColumn("h", expected_hours(F.col("window"), align_probabilities(raw, labels)))
    return rounded(df.groupBy("window").agg(F.avg("h").alias("mean_hours"), F.min("h").alias("min_hours"), F.max("h").alias("max_hours")))


def rule_forecast(spark, sf):
    from tremorframe.functions.windows import bound_30d_mag, midpoint_hours, rule_mag

    w = F.col("window")
    return rounded(predictions(spark, sf).groupBy("window", "main_mag").agg(
        F.first(rule_mag(w, F.col("main_mag"))).alias("rule_mag"), F.first(midpoint_hours(w)).alias("rule_hours"),
        F.max(bound_30d_mag(F.col("mag_c"), F.col("main_mag"))).alias("bounded_top")))


QUERIES = {
    f.__name__: f for f in (
        time_folds, purged_folds, purged_folds_gate, expanding_windows, holdout_split, gain_cut, simplex_weights,
        simplex_late_weights, fusion_objectives, two_model_weights, ridge_stacking, weighted_fusion, ensemble_metrics,
        null_aware_mean, hybrid_pick, post_calibration, extreme_postprocessing, risk_adjust_search, risk_time_search,
        risk_adjusted, floor_rule_search, floor_rule_choice, floor_rule_applied, oof_first_rule, hour_shift_table,
        hour_shift_search, directional_shift, residual_corrected, extreme_floor_search, expected_bucket_hours,
        rule_forecast,
    )
}

# --- SQL twins -------------------------------------------------------------------------------


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


RANKED = f"""{DATED_SQL},
ranked AS (SELECT id, time, true_days, row_number() OVER (ORDER BY time, id) - 1 AS row_index, count(*) OVER () AS n FROM dated)"""


def _fold_bounds(k: int) -> str:
    return f"""{RANKED},
f AS (SELECT i AS fold, n, n - ({k} - i + 1) * (n // {k + 1}) AS a, n - ({k} - i) * (n // {k + 1}) AS b
      FROM (SELECT DISTINCT n FROM ranked), (SELECT unnest(generate_series(1, {k})) AS i))"""


def _purged(k: int, steps) -> str:
    counts = ", ".join(
        f"count(*) FILTER (r.row_index < f.a AND r.time <= v.start - INTERVAL {int(d)} DAY) AS c{i}" for i, (d, _, _) in enumerate(steps))
    rows = " ".join(f"WHEN c{i} >= greatest({least}, a * {share}::DOUBLE) THEN c{i}" for i, (_, least, share) in enumerate(steps))
    days = " ".join(f"WHEN c{i} >= greatest({least}, a * {share}::DOUBLE) THEN {d}" for i, (d, least, share) in enumerate(steps))
    return f"""WITH {_fold_bounds(k)},
v AS (SELECT fold, min(time) AS start FROM f JOIN ranked ON row_index = a GROUP BY 1),
c AS (SELECT f.fold, f.a, f.b, {counts} FROM f JOIN v USING (fold), ranked r GROUP BY 1, 2, 3)
SELECT CAST(fold AS INT) AS fold, a AS train_rows, b - a AS valid_rows, CASE {rows} ELSE a END AS purged_rows,
       CAST(CASE {days} END AS DOUBLE) AS purge_days FROM c"""


GRID4 = """g AS (SELECT i.i / 50.0::DOUBLE AS w_0, j.i / 50.0::DOUBLE AS w_1, k.i / 50.0::DOUBLE AS w_2, (50 - i.i - j.i - k.i) / 50.0::DOUBLE AS w_3,
  row_number() OVER (ORDER BY i.i, j.i, k.i) - 1 AS point
  FROM range(51) i(i), range(51) j(i), range(51) k(i) WHERE i.i + j.i + k.i <= 50)"""
GRID3 = """g AS (SELECT i.i / 50.0::DOUBLE AS w_0, j.i / 50.0::DOUBLE AS w_1, (50 - i.i - j.i) / 50.0::DOUBLE AS w_2,
  row_number() OVER (ORDER BY i.i, j.i) - 1 AS point FROM range(51) i(i), range(51) j(i) WHERE i.i + j.i <= 50)"""
LONG_WEIGHTS = """long_rows AS (
  SELECT id, 0.5::DOUBLE AS w, mag_a AS p FROM dated
  UNION ALL SELECT id, 0.3::DOUBLE, CASE WHEN id % 7 <> 0 THEN mag_b END FROM dated
  UNION ALL SELECT id, 0.2::DOUBLE, mag_c FROM dated)"""
SIDES = """sides AS (SELECT id AS mainshock_id, w AS "window", main_mag, mag_a, mag_b, days_a, days_b * 3 AS hours_b,
  CASE w WHEN 'T1' THEN 0.0 WHEN 'T2' THEN 24.0 ELSE 72.0 END AS lo, CASE w WHEN 'T1' THEN 24.0 WHEN 'T2' THEN 72.0 ELSE 168.0 END AS hi
  FROM dated, (SELECT unnest(['T1', 'T2', 'T3']) AS w))"""
BOUNDS = """pw AS (SELECT *, CASE "window" WHEN 'T1' THEN 0.0 WHEN 'T2' THEN 24.0 ELSE 72.0 END AS lo,
  CASE "window" WHEN 'T1' THEN 24.0 WHEN 'T2' THEN 72.0 ELSE 168.0 END AS hi,
  CASE WHEN true_mag >= main_mag - 1.2::DOUBLE THEN 4.0 ELSE 1.0 END AS w FROM preds)"""
CUTS = """qs AS (SELECT "window", quantile_cont(risk, 0.6) AS a, quantile_cont(risk, 0.7) AS b, quantile_cont(risk, 0.8) AS c,
  quantile_cont(risk, 0.9) AS d FROM pw GROUP BY 1),
cuts AS (SELECT DISTINCT "window", unnest([0.05::DOUBLE, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, a, b, c, d]) AS threshold FROM qs)"""
TENTHS = "(SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS {})"


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


FLOOR_GRID = f"""grid AS (SELECT * FROM (SELECT unnest({_list(ru.FLOOR_THRESHOLDS)}) AS threshold),
  (SELECT unnest({_list(ru.FLOOR_MARGINS)}) AS margin), (SELECT unnest({_list(ru.FLOOR_STRENGTHS)}) AS strength)),
rr AS (SELECT "window", plate_type = 'A' AS vis, main_mag AS m, true_mag AS y, mag_c AS p, count(*) AS c FROM preds GROUP BY ALL),
moved AS (SELECT g.*, r.*, round_even(CASE WHEN m >= threshold AND m - margin > p THEN least(p + strength * (m - margin - p), m - 0.5) ELSE p END * 10, 0) / 10 AS q
          FROM rr r, grid g),
found AS (
  SELECT "window", threshold, margin, strength,
    sum(c * abs(q - y)) FILTER (vis) / sum(c) FILTER (vis) AS visible_mae, sqrt(sum(c * pow(q - y, 2)) FILTER (vis) / sum(c) FILTER (vis)) AS visible_rmse,
    max(abs(q - y)) FILTER (vis) AS visible_max_abs, CAST(coalesce(sum(c) FILTER (vis AND q <> p), 0) AS BIGINT) AS visible_changed,
    (sum(c * abs(q - y)) FILTER (NOT vis) - sum(c * abs(p - y)) FILTER (NOT vis)) / sum(c) FILTER (NOT vis) AS oof_mae_delta,
    sqrt(sum(c * pow(q - y, 2)) FILTER (NOT vis) / sum(c) FILTER (NOT vis)) - sqrt(sum(c * pow(p - y, 2)) FILTER (NOT vis) / sum(c) FILTER (NOT vis)) AS oof_rmse_delta,
    sum(c * (abs(q - y) - abs(p - y))) FILTER (NOT vis AND m >= threshold) / sum(c) FILTER (NOT vis AND m >= threshold) AS oof_high_mae_delta,
    CAST(coalesce(sum(c) FILTER (NOT vis AND q <> round_even(p * 10, 0) / 10), 0) AS BIGINT) AS oof_changed
  FROM moved GROUP BY 1, 2, 3, 4)"""
SHIFT = f"""sh AS (SELECT unnest({_list(ru.SHIFTS)}) AS shift),
base_rows AS (SELECT "window", true_hours, hours_a AS p, (group_id % 3600) / 3600.0::DOUBLE AS fraction,
   CASE "window" WHEN 'T1' THEN 0.01 WHEN 'T2' THEN 24.01 ELSE 72.01 END AS lo, CASE "window" WHEN 'T1' THEN 24.0 WHEN 'T2' THEN 72.0 ELSE 168.0 END AS hi FROM preds),
er AS (SELECT "window", shift, round_even(least(greatest(p + shift, lo), hi), 0) - fraction - true_hours AS e FROM base_rows, sh),
st AS (SELECT "window", shift, count(*) AS n, sum(e * e) AS ss, sum(abs(e)) AS sa FROM er GROUP BY 1, 2)"""

ORACLES = {
    "time_folds": f"""WITH {_fold_bounds(5)}
SELECT id, row_index, coalesce((SELECT fold FROM f WHERE row_index >= a AND row_index < b), 0) AS fold FROM ranked""",
    "purged_folds": _purged(5, fd.PURGE_TREES),
    "purged_folds_gate": _purged(8, fd.PURGE_GATE),
    "expanding_windows": f"""WITH {RANKED},
p AS (SELECT DISTINCT n, n // 3 AS start, greatest(10, n // 10) AS stride FROM ranked),
w AS (SELECT i + 1 AS "window", start + i * stride AS a, start + (i + 1) * stride AS b FROM p, range(0, 100) t(i) WHERE start + (i + 1) * stride <= n)
SELECT w."window", count(*) FILTER (row_index < a) AS train_rows, count(*) FILTER (row_index >= a) AS valid_rows,
  {r('avg(true_days) FILTER (row_index >= a)', 'valid_mean_days')} FROM w JOIN ranked ON row_index < b GROUP BY 1""",
    "holdout_split": f"""WITH {RANKED}
SELECT CASE WHEN row_index < n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'train' ELSE 'valid' END AS part, count(*) AS n, max(epoch_us(time)) AS last_us
FROM ranked GROUP BY 1""",
    "gain_cut": """WITH g AS (SELECT p_brand AS feature, CAST(sum(p_size) AS DOUBLE) AS gain FROM part GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY gain DESC, feature) AS rank, sum(gain) OVER (ORDER BY gain DESC, feature ROWS UNBOUNDED PRECEDING) / sum(gain) OVER () AS share FROM g),
k AS (SELECT greatest(5, count(*) FILTER (share < 0.85) + 1) AS keep FROM c)
SELECT feature, gain, rank, round(share, 6) AS share FROM c, k WHERE rank <= keep""",
    "simplex_weights": f"""WITH {DATED_SQL}, {GRID4},
s AS (SELECT point, sqrt(avg(pow(w_0 * mag_a + w_1 * mag_b + w_2 * mag_c + w_3 * mag_d - true_mag, 2))) AS score FROM dated, g GROUP BY 1)
SELECT w_0, w_1, w_2, w_3, {r('score', 'score')} FROM s JOIN g USING (point) ORDER BY s.score, point LIMIT 1""",
    "simplex_late_weights": f"""WITH {DATED_SQL}, {GRID3},
e AS (SELECT point, w_0, w_1, w_2, w_0 * days_a + w_1 * days_b + w_2 * days_c - true_days AS e FROM dated, g)
SELECT point, w_0, w_1, w_2, {r('sqrt(avg(CASE WHEN e > 0 THEN 2.0 ELSE 1.0 END * e * e))', 'score')} FROM e GROUP BY ALL""",
    "fusion_objectives": f"""WITH {DATED_SQL}, g AS (SELECT i AS point, i * 0.02::DOUBLE AS w FROM range(51) t(i)),
e AS (SELECT point, w * days_a + (1.0 - w) * days_b - true_days AS e FROM dated, g),
s AS (SELECT point, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN e > 0 THEN 2.0 ELSE 1.0 END * abs(e)) AS late FROM e GROUP BY 1),
o AS (SELECT point, unnest(['rmse', 'mae', 'mae+rmse', 'time_mae', 'time_mae+rmse']) AS objective,
             unnest([rmse, mae, mae + rmse, late, late + rmse]) AS score FROM s)
SELECT objective, point, {r('score', 'score')} FROM o QUALIFY row_number() OVER (PARTITION BY objective ORDER BY round(o.score, 10), point) = 1""",
    "two_model_weights": f"""WITH {PREDICTIONS_SQL}, g AS (SELECT i AS point, i * 0.05::DOUBLE AS w FROM range(21) t(i)),
e AS (SELECT point, CASE WHEN true_mag >= main_mag - 1.2::DOUBLE THEN 3.0 ELSE 1.0 END AS s, w * (hours_a + 0.013::DOUBLE) + (1.0 - w) * (hours_b + 0.007::DOUBLE) - true_hours AS e FROM preds, g),
l AS (SELECT *, CASE WHEN e > 0 THEN 2.0 ELSE 1.0 END * s AS lw FROM e)
SELECT point, {r('sqrt(sum(lw * e * e) / sum(lw))', 'score')} FROM l GROUP BY 1""",
    "weighted_fusion": f"""WITH {DATED_SQL}, {LONG_WEIGHTS}
SELECT id, {r('sum(w * p) / sum(w) FILTER (p IS NOT NULL)', 'fused')} FROM long_rows GROUP BY 1""",
    "ensemble_metrics": f"""WITH {DATED_SQL},
x AS (SELECT greatest(0.5::DOUBLE * mag_a + 0.3 * mag_b + 0.2 * mag_c, 0.0) - true_mag AS me,
             greatest(0.5::DOUBLE * days_a + 0.3 * days_b + 0.2 * days_c, 0.0) - true_days AS te FROM dated),
s AS (SELECT count(*) AS n, sqrt(avg(me * me)) AS a, sqrt(avg(CASE WHEN te > 0 THEN 2.0 ELSE 1.0 END * te * te)) AS b FROM x)
SELECT n, {r('a', 'mag_rmse')}, {r('b', 'time_asymmetric_rmse')}, {r('a + b', 'combined')} FROM s""",
    "null_aware_mean": f"""WITH {DATED_SQL} SELECT id, round(CASE WHEN id % 3 > 0 THEN (mag_a + mag_b) / 2 ELSE mag_a END, 6) AS mag_mean FROM dated""",
    "hybrid_pick": f"""WITH {DATED_SQL}, {SIDES}
SELECT mainshock_id, "window", round(CASE WHEN "window" = 'T1' AND mag_b > mag_a THEN mag_b ELSE mag_a END, 6) AS pred_mag,
  round(CASE WHEN "window" = 'T1' AND mag_b > mag_a THEN hours_b ELSE days_a END, 6) AS pred_hours,
  CASE WHEN "window" = 'T1' AND mag_b > mag_a THEN 'legal_risk_t1_max' ELSE 'score_model' END AS source FROM sides""",
    "post_calibration": f"""WITH {DATED_SQL}, {SIDES}
SELECT mainshock_id, "window",
  round(least(greatest(mag_a + CASE "window" WHEN 'T1' THEN -0.1 WHEN 'T2' THEN 0.1 ELSE 0.0 END::DOUBLE, 0.0), main_mag + 0.5), 6) AS pred_mag,
  round(least(greatest(days_a + CASE "window" WHEN 'T1' THEN 0.5 WHEN 'T3' THEN -2.0 ELSE 0.0 END::DOUBLE, lo + 1e-6), hi), 6) AS pred_hours FROM sides""",
    "extreme_postprocessing": f"""WITH {PREDICTIONS_SQL}, {BOUNDS},
x AS (SELECT id, "window", greatest(CASE WHEN risk >= 0.5 THEN 0.5 * mag_b + 0.5 * greatest(mag_b, greatest(main_mag - 1.2::DOUBLE, 0.0))
        + CASE WHEN "window" = 'T1' THEN 0.1::DOUBLE ELSE 0.0 END ELSE mag_b END, 0.0) AS m,
      CASE WHEN risk >= 0.5 THEN least(greatest(0.9::DOUBLE * hours_a + 0.1::DOUBLE * least(hours_a, lo + (hi - lo) * 0.3::DOUBLE), lo + 1e-6), hi) ELSE hours_a END AS h FROM pw)
SELECT id, "window", {r('m', 'mag')}, {r('h', 'hours')} FROM x""",
    "risk_adjust_search": f"""WITH {PREDICTIONS_SQL}, {BOUNDS}, {CUTS},
grid AS (SELECT * FROM cuts, (SELECT unnest({_list(ru.RISK_MARGINS)}) AS margin), {TENTHS.format('weight')}),
e AS (SELECT g."window", threshold, margin, weight, p.w, risk >= threshold AS act,
   least(CASE WHEN risk >= threshold THEN (1.0 - weight) * mag_b + weight * greatest(mag_b, greatest(main_mag - margin, 0.0)) ELSE mag_b END, main_mag + 0.5) - true_mag AS e
   FROM pw p JOIN grid g ON g."window" = p."window")
SELECT "window", {r('threshold', 'threshold')}, margin, weight, {r('sqrt(sum(w * e * e) / sum(w))', 'objective')},
  {r('avg(CASE WHEN act THEN 1.0 ELSE 0.0 END)', 'active_rate')} FROM e GROUP BY e."window", e.threshold, margin, weight""",
    "risk_time_search": f"""WITH {PREDICTIONS_SQL}, {BOUNDS}, {CUTS},
grid AS (SELECT * FROM cuts, (SELECT unnest({_list(ru.RISK_FRACTIONS)}) AS fraction), {TENTHS.format('weight')}),
e AS (SELECT g."window", threshold, fraction, weight, p.w, risk >= threshold AS act,
   least(greatest(CASE WHEN risk >= threshold THEN (1.0 - weight) * hours_a + weight * least(hours_a, lo + (hi - lo) * fraction) ELSE hours_a END, lo + 1e-6), hi) - true_hours AS e
   FROM pw p JOIN grid g ON g."window" = p."window"),
l AS (SELECT *, CASE WHEN e > 0 THEN 2.0 ELSE 1.0 END * w AS lw FROM e)
SELECT "window", {r('threshold', 'threshold')}, fraction, weight, {r('sqrt(sum(lw * e * e) / sum(lw))', 'objective')},
  {r('avg(CASE WHEN act THEN 1.0 ELSE 0.0 END)', 'active_rate')} FROM l GROUP BY l."window", l.threshold, fraction, weight""",
    "risk_adjusted": f"""WITH {PREDICTIONS_SQL}, {BOUNDS},
x AS (SELECT id, "window", least(CASE WHEN risk >= 0.3 THEN 0.6::DOUBLE * mag_b + 0.4::DOUBLE * greatest(mag_b, greatest(main_mag - 0.8::DOUBLE, 0.0)) ELSE mag_b END, main_mag + 0.5) AS m,
  least(greatest(CASE WHEN risk >= 0.3 THEN 0.6::DOUBLE * hours_a + 0.4::DOUBLE * least(hours_a, lo + (hi - lo) * 0.2::DOUBLE) ELSE hours_a END, lo + 1e-6), hi) AS h FROM pw)
SELECT id, "window", {r('m', 'mag')}, {r('h', 'hours')} FROM x""",
    "floor_rule_search": f"""WITH {PREDICTIONS_SQL}, {FLOOR_GRID}
SELECT "window", threshold, margin, strength, {r('visible_mae', 'visible_mae')}, {r('visible_rmse', 'visible_rmse')},
  {r('visible_max_abs', 'visible_max_abs')}, visible_changed, {r('oof_mae_delta', 'oof_mae_delta')}, {r('oof_rmse_delta', 'oof_rmse_delta')},
  {r('oof_high_mae_delta', 'oof_high_mae_delta')}, oof_changed FROM found""",
    "floor_rule_choice": f"""WITH {PREDICTIONS_SQL}, {FLOOR_GRID},
modes AS (SELECT unnest(['safe', 'balanced', 'public_max']) AS mode),
k AS (SELECT mode, f.*, CASE mode WHEN 'safe' THEN coalesce(oof_rmse_delta <= 5e-4 AND oof_high_mae_delta <= 0, FALSE)
       WHEN 'balanced' THEN coalesce(oof_mae_delta <= 0 AND oof_high_mae_delta <= 0, FALSE) ELSE TRUE END AS ok FROM found f, modes)
SELECT mode, "window", round(visible_rmse, 6) AS visible_rmse, visible_changed FROM k
QUALIFY row_number() OVER (PARTITION BY mode, "window" ORDER BY ok DESC, round(k.visible_rmse, 12), round(visible_mae, 12), visible_changed) = 1""",
    "floor_rule_applied": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT id, "window", mag_c, round_even(CASE WHEN main_mag >= 7.5 AND main_mag - 2.0 > mag_c THEN least(mag_c + 0.6::DOUBLE * (main_mag - 2.0 - mag_c), main_mag - 0.5) ELSE mag_c END * 10, 0) / 10 AS p FROM preds)
SELECT id, "window", {r('p', 'mag')}, p > mag_c + 1e-9 AS raised FROM x""",
    "oof_first_rule": f"""WITH {PREDICTIONS_SQL},
rr AS (SELECT "window", main_mag AS m, true_mag AS y, mag_c AS p, count(*) AS c FROM preds WHERE plate_type <> 'A' GROUP BY ALL),
grid AS (SELECT * FROM (SELECT unnest({_list(ru.OOF_THRESHOLDS)}) AS threshold), (SELECT unnest({_list(ru.FLOOR_MARGINS)}) AS margin),
  (SELECT unnest({_list(ru.FLOOR_STRENGTHS)}) AS strength)),
mv AS (SELECT *, m >= threshold AND m - margin > p AS boost, greatest(CASE WHEN m >= threshold AND m - margin > p
   THEN least((1 - strength) * p + strength * (m - margin), m - 0.5) ELSE p END, 0.0) AS q FROM rr, grid),
s AS (SELECT "window", threshold, margin, strength, sum(c) AS n, sum(c) FILTER (m >= threshold) AS hn, count(*) FILTER (boost) AS bo,
  sum(c * abs(q - y)) FILTER (m >= threshold) / sum(c) FILTER (m >= threshold) AS h1, sum(c * abs(p - y)) FILTER (m >= threshold) / sum(c) FILTER (m >= threshold) AS h0,
  sqrt(sum(c * pow(q - y, 2)) / sum(c)) AS r1, sqrt(sum(c * pow(p - y, 2)) / sum(c)) AS r0, sum(c * abs(q - y)) / sum(c) AS m1, sum(c * abs(p - y)) / sum(c) AS m0
  FROM mv GROUP BY 1, 2, 3, 4)
SELECT "window", {r('h1', 'oof_high_mae')}, {r('r1', 'oof_rmse')}, {r('m1', 'oof_mae')} FROM s
WHERE n >= 20 AND hn >= 8 AND bo > 0 AND h1 < h0 AND r1 <= r0 + 0.001 AND m1 <= m0 + 0.001
QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY round(h1, 9), round(r1, 9), threshold, margin, strength) = 1""",
    "hour_shift_table": f"""WITH {PREDICTIONS_SQL}, {SHIFT}
SELECT "window", shift, n, {r('sqrt(ss / n)', 'rmse')}, {r('sa / n', 'mae')} FROM st""",
    "hour_shift_search": f"""WITH RECURSIVE {PREDICTIONS_SQL}, {SHIFT},
b AS (SELECT "window", sqrt(ss / n) AS base FROM st WHERE shift = 0),
al AS (SELECT st.* FROM st JOIN b USING ("window") WHERE sqrt(ss / n) <= base + 0.01),
b0 AS (SELECT sqrt(sum(ss) / sum(n)) AS base_rmse FROM st WHERE shift = 0),
tr AS (SELECT x.shift AS a, y.shift AS b, z.shift AS c, sqrt((x.ss + y.ss + z.ss) / (x.n + y.n + z.n)) AS rmse,
       row_number() OVER (ORDER BY x.shift, y.shift, z.shift) AS k
       FROM al x, al y, al z WHERE x."window" = 'T1' AND y."window" = 'T2' AND z."window" = 'T3'),
wk AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, base_rmse AS rmse, base_rmse FROM b0
  UNION ALL
  SELECT t.k, CASE WHEN ok THEN t.a ELSE w.a END, CASE WHEN ok THEN t.b ELSE w.b END, CASE WHEN ok THEN t.c ELSE w.c END,
         CASE WHEN ok THEN t.rmse ELSE w.rmse END, w.base_rmse
  FROM (SELECT w.*, t.rmse <= w.base_rmse + 0.01 AND t.rmse < w.rmse - 0.005 AS ok FROM wk w JOIN tr t ON t.k = w.k + 1) w JOIN tr t ON t.k = w.k + 1)
SELECT {r('base_rmse', 'base_rmse')}, a AS "shift_T1", b AS "shift_T2", c AS "shift_T3", {r('rmse', 'rmse')} FROM wk ORDER BY k DESC LIMIT 1""",
    "directional_shift": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT CASE WHEN hours_a < 98 THEN 'fast' WHEN hours_a >= 135 THEN 'slow' ELSE 'mid' END AS z, hours_a AS p, true_hours AS y FROM preds WHERE "window" = 'T3')
SELECT coalesce(z, 'ALL') AS zone, count(*) AS n, {r('avg(abs(p - y))', 'mae_before')},
  {r("avg(abs(least(greatest(CASE WHEN p < 98 THEN p + 8 WHEN p >= 135 THEN p - 12 ELSE p END, 73.0), 167.0) - y))", 'mae_after')},
  {r('avg(p - y)', 'mean_residual')} FROM x GROUP BY ROLLUP (z)""",
    "residual_corrected": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT *, hours_a - true_hours AS res, CASE WHEN main_mag <= 6.5 THEN 0 WHEN main_mag <= 7.0 THEN 1 WHEN main_mag <= 7.5 THEN 2 WHEN main_mag <= 8.0 THEN 3 ELSE 4 END AS rc,
   CASE WHEN main_mag < 6.5 THEN 0 WHEN main_mag < 7.0 THEN 1 WHEN main_mag < 7.5 THEN 2 WHEN main_mag < 8.0 THEN 3 ELSE 4 END AS lc FROM preds WHERE "window" = 'T3'),
bb AS (SELECT rc, avg(res) AS bias FROM x GROUP BY 1), gb AS (SELECT avg(res) AS g FROM x)
SELECT id, ['<6.5', '6.5-7.0', '7.0-7.5', '7.5-8.0', '>=8.0'][lc + 1] AS mag_bin,
  {r('least(greatest(hours_a - g - 0.5 * coalesce(bias, 0.0), 73.0), 167.0)', 'hours')} FROM x LEFT JOIN bb ON bb.rc = x.lc, gb""",
    "extreme_floor_search": f"""WITH {PREDICTIONS_SQL},
grid AS (SELECT * FROM (SELECT 0.2::DOUBLE + 0.05::DOUBLE * i AS threshold FROM range(12) t(i)), (SELECT 0.25::DOUBLE * i AS margin FROM range(10) t(i)))
SELECT "window", {r('threshold', 'threshold')}, margin, {r('avg(abs(CASE WHEN risk >= threshold THEN greatest(mag_c, main_mag - margin) + greatest(0.0, (main_mag - mag_c - margin) * 0.5) ELSE mag_c END - true_mag))', 'mae')}
FROM preds, grid GROUP BY preds."window", grid.threshold, margin""",
    "expected_bucket_hours": f"""WITH {PREDICTIONS_SQL},
x AS (SELECT "window", risk AS a, 1 - risk AS b, (group_id % 5) / 10.0::DOUBLE AS d,
   CASE "window" WHEN 'T1' THEN [1.5::DOUBLE, 4.5, 9.0, 18.0] WHEN 'T2' THEN [30.0::DOUBLE, 42.0, 54.0, 66.0] ELSE [84.0::DOUBLE, 108.0, 132.0, 156.0] END AS c FROM preds),
h AS (SELECT "window", (a * c[1] + b * c[2] + d * c[4]) / (a + b + d) AS h FROM x)
SELECT "window", {r('avg(h)', 'mean_hours')}, {r('min(h)', 'min_hours')}, {r('max(h)', 'max_hours')} FROM h GROUP BY 1""",
    "rule_forecast": f"""WITH {PREDICTIONS_SQL}
SELECT "window", main_mag, round(greatest(0.0, main_mag - CASE "window" WHEN 'T1' THEN 1.15 WHEN 'T2' THEN 1.35 ELSE 1.55 END::DOUBLE), 6) AS rule_mag,
  CASE "window" WHEN 'T1' THEN 12.0::DOUBLE WHEN 'T2' THEN 48.0 ELSE 120.0 END AS rule_hours,
  round(max(least(greatest(mag_c, greatest(0.0, main_mag - 3.0)), main_mag + 0.5)), 6) AS bounded_top FROM preds GROUP BY 1, 2""",
}
