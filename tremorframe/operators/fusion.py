"""Combining model predictions: weight search, weight application, post-processing."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.windows import (
    clamp_hours, clamp_mag, finite, lower_hours, midpoint_hours, rule_mag, upper_hours,
)

# --- weight grids: small parameter tables, independent of the data --------------------------


def simplex_grid(models: int, step: float = 0.02) -> list[tuple[float, ...]]:
    """Weight vectors that sum to one, in lexicographic order; two models use a plain line."""
    if models == 1:
        return [(1.0,)]
    if models == 2:
        return [(float(w), float(1.0 - w)) for w in np.arange(0.0, 1.0 + step / 2.0, step)]
    parts = int(1.0 / step)
    heads = itertools.product(range(parts + 1), repeat=models - 1)
    return [(*(h / parts for h in head), (parts - sum(head)) / parts) for head in heads if sum(head) <= parts]


def square_grid(step: float = 0.02) -> list[tuple[float, float, float]]:
    """Three-model grid laid over the first two weights."""
    line = [float(w) for w in np.arange(0.0, 1.0 + step / 2.0, step)]
    return [(a, b, 1.0 - a - b) for a in line for b in line if a + b <= 1.0]


def random_simplex(models: int, seed: int = 42) -> list[tuple[float, ...]]:
    """Seeded exponential draws scaled to sum one, for four or more models."""
    draws = np.random.RandomState(seed).exponential(1.0, (max(500, models * 200), models))
    return [tuple(float(x) for x in row / row.sum()) for row in draws]


# --- scores over a grid ----------------------------------------------------------------------

OBJECTIVES = ("rmse", "mae", "mae+rmse", "late_rmse", "time_mae", "time_mae+rmse")


def gram(df: DataFrame, predictions: list[str], target: str) -> tuple[np.ndarray, int]:
    """Products of the models' errors, summed in one aggregate row.

    With weights that sum to one the fused error is linear in the models' errors, so any
    weighted RMSE follows from this matrix and the rows are read once, whatever the grid.
    """
    errors = [F.col(p) - F.col(target) for p in predictions]
    pairs = [(i, j) for i in range(len(errors)) for j in range(i, len(errors))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(errors[i] * errors[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(errors), len(errors)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, row["n"]


def grid_sums(df: DataFrame, predictions: list[str], target: str, grid: list[tuple[float, ...]],
              late_weight: float = 2.0, weight: str | None = None) -> DataFrame:
    """Error sums per grid point for objectives that depend on the sign of the error.

    Each task keeps one vector per sum over its rows, so a task emits one row per grid point
    and only those are shuffled.
    """
    weights = np.array(grid).T
    columns = [*predictions, target] + ([weight] if weight else [])
    models = len(predictions)

    def partial(batches):
        totals = np.zeros((6, weights.shape[1]))
        for frame in batches:
            values = frame.to_numpy(dtype=float)
            for at in range(0, len(values), 256):
                block = values[at:at + 256]
                error = block[:, :models] @ weights - block[:, models:models + 1]
                w = block[:, models + 1:] if weight else np.ones((len(block), 1))
                side = np.where(error > 0.0, late_weight, 1.0)
                squared, size = error * error, np.abs(error)
                totals[0] += len(block)
                totals[1] += (w * squared).sum(axis=0)
                totals[2] += size.sum(axis=0)
                totals[3] += (w * side * squared).sum(axis=0)
                totals[4] += (side * size).sum(axis=0)
                totals[5] += (w * side).sum(axis=0)
        yield pd.DataFrame({"point": np.arange(weights.shape[1]), **{f"s{i}": totals[i] for i in range(6)}})

    sums = df.select(*columns).dropna().mapInPandas(
        partial, "point long, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
    return sums.groupBy("point").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])


def objective_column(objective: str) -> Column:
    n = F.col("s0")
    rmse, mae, late_mae = F.sqrt(F.col("s1") / n), F.col("s2") / n, F.col("s4") / n
    return {
        "rmse": rmse, "mae": mae, "mae+rmse": mae + rmse, "late_rmse": F.sqrt(F.col("s3") / n),
        "time_mae": late_mae, "time_mae+rmse": late_mae + rmse,
        "late_weighted_rmse": F.sqrt(F.col("s3") / F.col("s5")),
    }[objective]


def grid_scores(df: DataFrame, predictions: list[str], target: str, grid: list[tuple[float, ...]],
                objective: str = "rmse", late_weight: float = 2.0, weight: str | None = None) -> DataFrame:
    """(point, w_0.., score) for every weight vector of the grid."""
    spark = df.sparkSession
    names = [f"w_{i}" for i in range(len(predictions))]
    if objective == "rmse" and weight is None:
        g, n = gram(df.dropna(subset=[*predictions, target]), predictions, target)
        w = np.array(grid)
        scores = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", w, g, w), 0.0) / max(n, 1))
        frame = pd.DataFrame(w, columns=names)
        frame.insert(0, "point", np.arange(len(w)))
        frame["score"] = scores
        return spark.createDataFrame(frame)
    points = spark.createDataFrame(
        [(i, *w) for i, w in enumerate(grid)], ", ".join(["point long", *[f"{n} double" for n in names]]))
    sums = grid_sums(df, predictions, target, grid, late_weight, weight)
    return points.join(sums.select("point", objective_column(objective).alias("score")), "point")


def best_weights(scores: DataFrame, predictions: list[str], digits: int = 4) -> dict[str, float]:
    """First best grid point, rounded and scaled to sum one."""
    top = scores.orderBy("score", "point").first()
    raw = [round(float(top[f"w_{i}"]), digits) for i in range(len(predictions))]
    total = sum(raw)
    return {p: round(w / total, digits) for p, w in zip(predictions, raw)}


def fit_weights(df: DataFrame, target: str, predictions: list[str], objective: str = "rmse",
                step: float = 0.02, method: str = "grid") -> dict[str, float]:
    """Weights from out-of-fold rows, equal when no row is usable.

    ``method``: "grid" walks the simplex in ``step``s (two or three models), "draws" takes seeded random points
    (any number). The caller chooses; neither the rows nor the models switch it.
    """
    present = [p for p in predictions if p in df.columns]
    if not present:
        return {}
    usable = df.dropna(subset=[target, *present])
    if len(present) == 1 or usable.isEmpty():
        return {p: 1.0 / len(present) for p in present}
    if method == "draws":
        grid = random_simplex(len(present))
    elif len(present) <= 3:
        grid = simplex_grid(2, step) if len(present) == 2 else square_grid(step)
    else:
        raise ValueError("the grid holds two or three models; choose method='draws'")
    top = grid_scores(usable, present, target, grid, objective).orderBy("score", "point").first()
    return {p: float(top[f"w_{i}"]) for i, p in enumerate(present)}


def stack_nonnegative(df: DataFrame, predictions: list[str], target: str,
                      alphas=(0.01, 0.1, 1.0, 10.0, 100.0), late_weight: float | None = None) -> DataFrame:
    """Non-negative ridge stacking on standardised predictions: one candidate per alpha.

    Spark sums the weighted cross products (one row); the solve is over at most four
    coefficients, so every active set is tried. ``late_weight`` weighs rows whose mean
    prediction is late. Scores of the normalised weights come from ``grid_scores``.
    """
    usable = df.dropna(subset=[*predictions, target])
    m = len(predictions)
    mean_prediction = sum((F.col(p) for p in predictions[1:]), F.col(predictions[0])) / m
    w = F.when(mean_prediction > F.col(target), F.lit(late_weight)).otherwise(1.0) if late_weight else F.lit(1.0)
    stats = usable.agg(*[F.avg(p).alias(f"m{i}") for i, p in enumerate(predictions)],
                       *[F.stddev_pop(p).alias(f"s{i}") for i, p in enumerate(predictions)]).first()
    scale = [stats[f"s{i}"] or 1.0 for i in range(m)]
    z = [(F.col(p) - stats[f"m{i}"]) / scale[i] for i, p in enumerate(predictions)]
    cross = usable.agg(*[F.sum(w * z[i] * z[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(m)],
                       *[F.sum(w * z[i] * F.col(target)).alias(f"b{i}") for i in range(m)]).first()
    a = np.array([[cross[f"a{i}_{j}"] for j in range(m)] for i in range(m)])
    b = np.array([cross[f"b{i}"] for i in range(m)])
    grid = []
    for alpha in alphas:
        best, coefficients = 0.0, np.zeros(m)
        for size in range(1, m + 1):
            for active in map(list, itertools.combinations(range(m), size)):
                x = np.linalg.solve(a[np.ix_(active, active)] + alpha * np.eye(size), b[active])
                value = -b[active] @ x / 2
                if (x >= 0).all() and value < best - 1e-12:
                    best, coefficients = value, np.zeros(m)
                    coefficients[active] = x
        raw = coefficients / np.array(scale)
        if raw.sum() > 0:
            grid.append(tuple(float(v) for v in raw / raw.sum()))
    grid = grid or [tuple(1.0 / m for _ in predictions)]
    return grid_scores(usable, predictions, target, grid, "late_rmse" if late_weight else "rmse", late_weight or 2.0)


# --- applying weights ------------------------------------------------------------------------


def normalized(weights: dict[str, float]) -> dict[str, float]:
    positive = {k: max(0.0, v) for k, v in weights.items()}
    total = sum(positive.values())
    return {k: (v / total if total > 0 else 1.0 / len(weights)) for k, v in positive.items()}


def nested_weights(weights: dict) -> dict[str, dict[str, float]]:
    """Old flat tables apply to both targets; the nested form has one table per target."""
    if any(isinstance(v, dict) for v in weights.values()):
        return {target: normalized(weights.get(target, {})) for target in ("mag", "time")}
    return {target: normalized(weights) for target in ("mag", "time")}


def normalize_weight_rows(rows: DataFrame, target: str = "target", weight: str = "w") -> DataFrame:
    """The same on a weights table (target, model, w)."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    totals = rows.groupBy(target).agg(F.sum(w).alias("_t"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_t") > 0, w / F.col("_t")).otherwise(1.0 / F.col("_n"))
    return rows.join(totals, target).withColumn(weight, share).drop("_t", "_n")


def fused(predictions: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the models that gave a value; their plain mean when none has weight."""
    active = {k: w for k, w in weights.items() if k in predictions and w > 0}
    zero = F.lit(0.0)
    total = sum((F.when(predictions[k].isNotNull(), F.lit(float(w))).otherwise(zero) for k, w in active.items()), zero)
    weighted = sum((F.coalesce(predictions[k] * float(w), zero) for k, w in active.items()), zero)
    return F.when(total > 0, weighted / total).otherwise(F.coalesce(null_mean(list(predictions.values())), zero))


def null_mean(columns: list[Column]) -> Column:
    """Mean over the non-null columns."""
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def fuse_long(long_df: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Fusion of a long table (keys, model, pred) with a weights table (model, w)."""
    joined = long_df.join(weights, "model", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    usable = F.col("pred").isNotNull() & (F.col("w") > 0)
    total = F.sum(F.when(usable, F.col("w")))
    weighted = F.sum(F.when(usable, F.col("w") * F.col("pred")))
    return joined.groupBy(*keys).agg(
        F.when(total > 0, weighted / total).otherwise(F.coalesce(F.avg("pred"), F.lit(0.0))).alias("fused"))


# --- window predictions ----------------------------------------------------------------------


def hybrid_pick(score: DataFrame, legal: DataFrame) -> DataFrame:
    """Score model everywhere, except T1 where the larger magnitude wins."""
    keys = ["mainshock_id", "window"]
    s = score.select(*keys, F.struct("pred_mag", "pred_hours").alias("s"))
    l = legal.select(*keys, F.struct("pred_mag", "pred_hours").alias("l"))
    swap = (F.col("window") == "T1") & (F.col("l.pred_mag") > F.col("s.pred_mag"))
    chosen = F.when(swap, F.col("l")).otherwise(F.col("s"))
    return s.join(l, keys).select(
        *keys, chosen["pred_mag"].alias("pred_mag"), chosen["pred_hours"].alias("pred_hours"),
        F.when(swap, "legal_risk_t1_max").otherwise("score_model").alias("source"))


def parse_calibration(text: str) -> dict[str, float]:
    """``T1:-0.1,T2:0.1`` to a table; an empty or switched-off text gives none."""
    if text.strip().lower() in {"", "none", "off", "false", "0"}:
        return {}
    out = {}
    for item in filter(str.strip, text.split(",")):
        window, _, delta = item.partition(":")
        if window.strip().upper() not in ("T1", "T2", "T3"):
            raise ValueError(f"unknown calibration window: {item!r}")
        out[window.strip().upper()] = float(delta)
    return out


def _per_window(window: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, delta in table.items():
        out = F.when(window == name, F.lit(delta)).otherwise(out)
    return out


def calibrate(df: DataFrame, mag: dict[str, float], hours: dict[str, float]) -> DataFrame:
    """Additive per-window calibration, then the window clamp."""
    window = F.col("window")
    return df.withColumns({
        "pred_mag": clamp_mag(F.col("pred_mag") + _per_window(window, mag), F.col("main_mag")),
        "pred_hours": clamp_hours(F.col("pred_hours") + _per_window(window, hours), window),
    })


def extreme_adjusted(mag: Column, hours: Column, probability: Column, main_mag: Column, window: Column,
                     threshold: float = 0.5, uplift: float = 0.5, margin: float = 1.2, shift: float = 0.1,
                     t1_bonus: float = 0.0, only_earlier: bool = True) -> tuple[Column, Column]:
    """Where a large event is likely: raise towards the floor and move to the early anchor.

    ``only_earlier`` keeps predictions that are already before the anchor in place; the
    packaged predictors pull them towards it as well.
    """
    high = probability >= threshold
    floor = F.greatest(main_mag - margin, F.lit(0.0))
    raised = (1.0 - uplift) * mag + uplift * F.greatest(mag, floor)
    if t1_bonus > 0:
        raised = F.when(window == "T1", raised + t1_bonus).otherwise(raised)
    low, top = lower_hours(window), upper_hours(window)
    anchor = low + (top - low) * 0.3
    goal = F.least(hours, anchor) if only_earlier else anchor
    moved = (1.0 - shift) * hours + shift * goal
    if only_earlier:
        moved = F.least(F.greatest(moved, low + 1e-6), top)
    return (F.greatest(F.when(high, raised).otherwise(mag), F.lit(0.0)), F.when(high, moved).otherwise(hours))


def guarded_bias(window: Column, bias: Column, share: float = 0.20) -> Column:
    """Time bias of T2 and T3 limited to a share of the window width."""
    most = (upper_hours(window) - lower_hours(window)) * share
    return F.when(window.isin("T2", "T3"), F.greatest(-most, F.least(most, bias))).otherwise(bias)


def window_prediction(window: Column, main_mag: Column, mags: dict[str, Column], hours: dict[str, Column],
                      mag_weights: dict[str, float], hour_weights: dict[str, float]) -> tuple[Column, Column]:
    """Weighted window prediction, or the rule forecast when either target has no weight."""
    def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
        live = {k: w for k, w in weights.items() if k in values and w > 0}
        return fused({k: values[k] for k in live}, live) if live else F.lit(None).cast("double")

    m, h = weighted(mags, mag_weights), weighted(hours, hour_weights)
    usable = m.isNotNull() & h.isNotNull()
    return (
        F.when(usable, clamp_mag(m, main_mag)).otherwise(rule_mag(window, main_mag)),
        F.when(usable, clamp_hours(h, window)).otherwise(midpoint_hours(window)),
    )


def decoupled_prediction(df: DataFrame, mags: dict[str, str], expected_hours: str, probability: str,
                         mag_weights: dict[str, float], mag_bias: dict[str, float] | None = None,
                         time_bias: dict[str, float] | None = None, **extreme) -> DataFrame:
    """Fused magnitude, bucket time, extreme adjustment, guarded biases, clamp."""
    window, main = F.col("window"), F.col("main_mag")
    mag = fused({k: F.col(c) for k, c in mags.items()}, mag_weights)
    hours = F.coalesce(finite(F.col(expected_hours)), midpoint_hours(window))
    mag, hours = extreme_adjusted(mag, hours, F.coalesce(F.col(probability), F.lit(0.0)), main, window,
                                  only_earlier=False, **extreme)
    mag = mag + _per_window(window, mag_bias or {})
    hours = hours + guarded_bias(window, _per_window(window, time_bias or {}))
    return df.withColumns({"pred_mag": clamp_mag(mag, main), "pred_hours": clamp_hours(hours, window)})


def single_horizon_prediction(df: DataFrame, mags: dict[str, str], hours: dict[str, str], probability: str,
                              mag_weights: dict[str, float], hour_weights: dict[str, float], **extreme) -> DataFrame:
    """168 h prediction: fusion of the magnitude and of the time candidates, then as above."""
    window, main = F.lit("H168"), F.col("main_mag")
    mag = F.greatest(fused({k: F.col(c) for k, c in mags.items()}, mag_weights), F.lit(0.0))
    bounded = {k: clamp_hours(F.col(c), window) for k, c in hours.items()}
    time = fused(bounded, hour_weights)
    mag, time = extreme_adjusted(mag, time, F.coalesce(F.col(probability), F.lit(0.0)), main, window,
                                 only_earlier=False, **extreme)
    return df.withColumns({"pred_mag": clamp_mag(mag, main), "pred_hours": clamp_hours(time, window)})


def gate(df: DataFrame, threshold: float, quiet_mag: float = 0.0, quiet_time: float = 0.0) -> DataFrame:
    """Below the threshold the sequence counts as quiet and gets the configured values."""
    quiet = F.col("probability") < threshold
    return df.withColumns({
        "pred_mag": F.when(quiet, F.lit(quiet_mag)).otherwise(F.col("pred_mag")),
        "pred_time": F.when(quiet, F.lit(quiet_time)).otherwise(F.col("pred_time")),
        "gated": quiet,
    })
