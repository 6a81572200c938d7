"""Searches over adjustment rules.

Rows never meet the full parameter grid: a threshold only splits the rows, so rows are
counted per threshold class first, and parameters in which the error is quadratic are
evaluated from sums. What is left is summed per task in NumPy, so a task emits one row per
class and parameter point. The searches end in tables of at most a few thousand rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.seismic import round_even
from tremorframe.functions.windows import lower_hours, upper_hours
from tremorframe.operators.ranking import exact_quantiles

# Search ranges.
RISK_THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50)
RISK_QUANTILES = (0.60, 0.70, 0.80, 0.90)
RISK_MARGINS = (0.4, 0.6, 0.8, 1.0, 1.2, 1.4)
RISK_FRACTIONS = (0.05, 0.10, 0.20, 0.35, 0.50)
RISK_WEIGHTS = tuple(round(0.1 * k, 1) for k in range(1, 11))
FLOOR_THRESHOLDS = (7.0, 7.1, 7.2, 7.3, 7.4, 7.5, 7.6, 7.7, 7.8, 8.0, 8.2, 8.5)
FLOOR_MARGINS = tuple(round(0.8 + 0.1 * k, 1) for k in range(29))
FLOOR_STRENGTHS = tuple(round(0.1 * k, 1) for k in range(1, 11))
OOF_THRESHOLDS = tuple(round(7.0 + 0.1 * k, 1) for k in range(16))
SHIFTS = tuple(round(-3.0 + 0.5 * k, 1) for k in range(13))
SHIFT_BOUNDS = {"T1": (0.01, 24.0), "T2": (24.01, 72.0), "T3": (72.01, 168.0)}
FAST_HOURS, FAST_SHIFT, SLOW_HOURS, SLOW_SHIFT, T3_CLIP = 98.0, 8.0, 135.0, -12.0, (73.0, 167.0)


def _options(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _passed(value: Column, cuts) -> Column:
    """How many of the fixed cuts a value reaches."""
    return sum(((value >= float(c)).cast("int") for c in cuts), F.lit(0))


def class_sums(df: DataFrame, classes: list[str], inputs: list[str], points: list[tuple], evaluate, sums: list[str],
               maxima: tuple[str, ...] = ()) -> DataFrame:
    """Sums (and maxima) of ``evaluate`` per class and parameter point.

    ``evaluate`` gets input columns of shape (n, 1) and parameters of shape (1, p). A task
    holds one vector per class and result; classes are few (groups x thresholds).
    """
    grid = np.array(points, dtype=float).T[:, None, :]
    names = [*sums, *maxima]
    schema = df.select(*classes).schema.simpleString()[len("struct<"):-1]

    def partial(batches):
        totals: dict = {}
        for frame in batches:
            for key, rows in frame.groupby(classes, sort=False, dropna=False):
                store = totals.setdefault(key, {n: np.zeros(grid.shape[2]) for n in names})
                values = [rows[c].to_numpy(dtype=float)[:, None] for c in inputs]
                for at in range(0, len(rows), 2048):
                    made = evaluate(*[v[at:at + 2048] for v in values], *grid)
                    for n in sums:
                        store[n] += np.broadcast_to(made[n], (len(values[0][at:at + 2048]), grid.shape[2])).sum(axis=0)
                    for n in maxima:
                        store[n] = np.maximum(store[n], made[n].max(axis=0))
        for key, store in totals.items():
            yield pd.DataFrame({**dict(zip(classes, key)), "point": np.arange(grid.shape[2]), **store})

    fields = ", ".join([schema.replace(",", ", "), "point int", *[f"{n} double" for n in names]])
    out = df.select(*classes, *inputs).mapInPandas(partial, fields)
    return out.groupBy(*classes, "point").agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima])


def _point_columns(points: list[tuple], names: list[str]) -> list[Column]:
    """Parameter values of a point number."""
    return [F.element_at(_options([p[i] for p in points]), F.col("point") + 1).alias(n) for i, n in enumerate(names)]


def risk_thresholds(df: DataFrame, groups: list[str], risk: str) -> DataFrame:
    """Fixed thresholds and risk quantiles per group, sorted and distinct (at most eleven)."""
    quantiles = exact_quantiles(df, groups, risk, list(RISK_QUANTILES))
    names = [f"q{i}" for i in range(len(RISK_QUANTILES))]
    cuts = F.array_sort(F.array_distinct(F.concat(_options(RISK_THRESHOLDS), F.array(*names))))
    fresh = []
    for i, name in enumerate(names):
        known = F.col(name).isin(*RISK_THRESHOLDS)
        for earlier in names[:i]:
            known = known | (F.col(name) == F.col(earlier))
        fresh.append(F.when(~known, F.col(name)).alias(name))
    return quantiles.select(*groups, cuts.alias("cuts"), *fresh)


def _risk_class(risk: Column) -> Column:
    """Number of thresholds a risk reaches: the fixed ones and the quantiles that are not among them."""
    own = [F.coalesce((risk >= F.col(f"q{i}")).cast("int"), F.lit(0)) for i in range(len(RISK_QUANTILES))]
    return sum(own, _passed(risk, RISK_THRESHOLDS))


def risk_mag_search(df: DataFrame, groups: list[str], base: str, main_mag: str, risk: str, truth: str,
                    weight: str) -> DataFrame:
    """Weighted RMSE of every (threshold, margin, weight) of the magnitude adjustment.

    After the upper bound M + 0.5 the adjusted error is e + w * d with d >= 0, so three sums
    per threshold class and margin give the score at any weight.
    """
    cuts = risk_thresholds(df, groups, risk)
    bounded = F.least(F.col(base), F.col(main_mag) + 0.5)
    # a row per group, few groups: rows stay where they are, a join by group would gather each group in one task
    rows = df.join(F.broadcast(cuts.drop("cuts")), groups).select(
        *groups, _risk_class(F.col(risk)).alias("passed"), F.col(weight).alias("s"),
        (bounded - F.col(truth)).alias("e"), bounded.alias("b"), F.col(main_mag).alias("m"))
    sums = [F.sum("s").alias("sw"), F.sum(F.col("s") * F.col("e") * F.col("e")).alias("see"),
            F.count(F.lit(1)).alias("n")]
    for i, margin in enumerate(RISK_MARGINS):
        lift = F.greatest(F.greatest(F.col("m") - margin, F.lit(0.0)) - F.col("b"), F.lit(0.0))
        sums += [F.sum(F.col("s") * F.col("e") * lift).alias(f"sed{i}"), F.sum(F.col("s") * lift * lift).alias(f"sdd{i}")]
    classes = rows.groupBy(*groups, "passed").agg(*sums).join(cuts.select(*groups, "cuts"), groups)
    spread = classes.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cuts")))).withColumn(
        "threshold", F.element_at("cuts", F.col("k")))
    on = F.col("passed") >= F.col("k")

    def active(name: str) -> Column:
        return F.sum(F.when(on, F.col(name)).otherwise(0.0)).alias(name)

    per_cut = spread.groupBy(*groups, "threshold").agg(
        F.sum("sw").alias("sw"), F.sum("see").alias("see"), F.sum("n").alias("n"),
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("n_active"),
        *[active(f"{kind}{i}") for i in range(len(RISK_MARGINS)) for kind in ("sed", "sdd")])
    options = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"sed{i}").alias("sed"), F.col(f"sdd{i}").alias("sdd"))
                        for i, m in enumerate(RISK_MARGINS)])
    grid = per_cut.filter("n_active > 0").withColumn("o", F.explode(options)).withColumn(
        "weight", F.explode(_options(RISK_WEIGHTS)))
    w = F.col("weight")
    score = F.sqrt(F.greatest(F.col("see") + 2 * w * F.col("o.sed") + w * w * F.col("o.sdd"), F.lit(0.0)) / F.col("sw"))
    return grid.select(*groups, "threshold", F.col("o.margin").alias("margin"), "weight", score.alias("objective"),
                       (F.col("n_active") / F.col("n")).alias("active_rate"))


def risk_time_search(df: DataFrame, groups: list[str], base: str, window: str, risk: str, truth: str,
                     weight: str, late_weight: float = 2.0) -> DataFrame:
    """Late-weighted RMSE of every (threshold, fraction, weight) of the time adjustment.

    The sign of the error decides its weight, so rows meet the 50 (fraction, weight) points
    inside a task; the thresholds are again laid over class sums.
    """
    cuts = risk_thresholds(df, groups, risk)
    points = list(itertools.product(RISK_FRACTIONS, RISK_WEIGHTS))
    rows = df.join(F.broadcast(cuts.drop("cuts")), groups).select(
        *groups, _risk_class(F.col(risk)).alias("passed"), F.col(weight).cast("double").alias("s"), F.col(base).alias("b"),
        F.col(truth).alias("y"), lower_hours(F.col(window)).alias("lo"), upper_hours(F.col(window)).alias("hi"))

    def evaluate(s, b, y, lo, hi, fraction, share):
        def squared(prediction):
            error = np.minimum(np.maximum(prediction, lo + 1e-6), hi) - y
            w = np.where(error > 0, late_weight, 1.0) * s
            return w * error * error, w

        moved = squared((1.0 - share) * b + share * np.minimum(b, lo + (hi - lo) * fraction))
        still = squared(b)
        return {"adj_see": moved[0], "adj_sw": moved[1], "base_see": still[0], "base_sw": still[1], "n": np.ones_like(b)}

    classes = class_sums(rows, [*groups, "passed"], ["s", "b", "y", "lo", "hi"], points, evaluate,
                         ["adj_see", "adj_sw", "base_see", "base_sw", "n"]).join(cuts.select(*groups, "cuts"), groups)
    spread = classes.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cuts")))).withColumn(
        "threshold", F.element_at("cuts", F.col("k")))
    on = F.col("passed") >= F.col("k")

    def mixed(name: str) -> Column:
        return F.sum(F.when(on, F.col(f"adj_{name}")).otherwise(F.col(f"base_{name}")))

    out = spread.groupBy(*groups, "threshold", "point").agg(
        F.sqrt(mixed("see") / mixed("sw")).alias("objective"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("a"),
        F.sum("n").alias("n"))
    return out.filter("a > 0").select(
        *groups, "threshold", *_point_columns(points, ["fraction", "weight"]), "objective",
        (F.col("a") / F.col("n")).alias("active_rate"))


def apply_risk_mag(mag: Column, main_mag: Column, risk: Column, threshold: float, margin: float, weight: float) -> Column:
    raised = F.greatest(mag, F.greatest(main_mag - margin, F.lit(0.0)))
    moved = F.when(risk >= threshold, (1.0 - weight) * mag + weight * raised).otherwise(mag)
    return F.least(moved, main_mag + 0.5)


def apply_risk_hours(hours: Column, window: Column, risk: Column, threshold: float, fraction: float, weight: float) -> Column:
    low, top = lower_hours(window), upper_hours(window)
    early = F.least(hours, low + (top - low) * fraction)
    moved = F.when(risk >= threshold, (1.0 - weight) * hours + weight * early).otherwise(hours)
    return F.least(F.greatest(moved, low + 1e-6), top)


# --- floor rule ------------------------------------------------------------------------------


def floor_rule(mag: Column, main_mag: Column, threshold, margin, strength, cap=0.5) -> Column:
    """Raise a low prediction of a large mainshock part of the way to M - margin; one decimal."""
    floor = main_mag - margin
    lifted = F.least(mag + strength * (floor - mag), main_mag - cap)
    return round_even(F.when((main_mag >= threshold) & (floor > mag), lifted).otherwise(mag), 1)


def _floor_classes(df: DataFrame, groups: list[str], pred: str, main_mag: str, truth: str, cap: float,
                   thresholds, margins, strengths, rounded_reference: bool) -> DataFrame:
    """Error sums per group and (threshold, margin, strength), with the high-magnitude part.

    Rows below the lowest threshold are never adjusted and enter as one class.
    """
    cuts = _options(thresholds)
    points = list(itertools.product(margins, strengths))
    rows = df.select(*groups, _passed(F.col(main_mag), thresholds).alias("passed"), F.col(pred).alias("p"),
                     F.col(main_mag).alias("m"), F.col(truth).alias("y"))

    def scored(value, p, y):
        error, before = value - y, p - y
        reference = np.rint(p * 10.0) / 10.0 if rounded_reference else p
        return {"n": np.ones_like(error), "sa": np.abs(error), "ss": error * error, "mx": np.abs(error),
                "ch": (value != reference).astype(float), "sa0": np.abs(before), "ss0": before * before}

    def still(p, m, y, margin, strength):
        return scored(np.rint(p * 10.0) / 10.0 + 0.0 * margin, p, y)

    def lifted(p, m, y, margin, strength):
        floor = m - margin
        raised = np.minimum(p + strength * (floor - p), m - cap)
        return scored(np.rint(np.where(floor > p, raised, p) * 10.0) / 10.0, p, y)

    names = ["n", "sa", "ss", "ch", "sa0", "ss0"]
    keys, inputs = [*groups, "passed"], ["p", "m", "y"]
    base = class_sums(rows, keys, inputs, [points[0]], still, names, ("mx",)).drop("point")
    lifted_sums = class_sums(rows.filter("passed > 0"), keys, inputs, points, lifted, names, ("mx",)).select(
        *keys, *names, "mx", *_point_columns(points, ["margin", "strength"]))
    ks = F.sequence(F.lit(1), F.lit(len(thresholds)))
    quiet = (
        base.withColumn("k", F.explode(ks)).filter(F.col("passed") < F.col("k"))
        .withColumn("margin", F.explode(_options(margins))).withColumn("strength", F.explode(_options(strengths)))
        .withColumn("high", F.lit(False)))
    active = (lifted_sums.withColumn("k", F.explode(ks)).filter(F.col("passed") >= F.col("k"))
              .withColumn("high", F.lit(True)))
    both = quiet.unionByName(active)
    high = F.col("high")
    return both.groupBy(*groups, "k", "margin", "strength").agg(
        F.sum("n").alias("n"), F.sum("sa").alias("sa"), F.sum("ss").alias("ss"), F.max("mx").alias("mx"),
        F.sum("ch").cast("bigint").alias("ch"), F.sum("sa0").alias("sa0"), F.sum("ss0").alias("ss0"),
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("hn"), F.sum(F.when(high, F.col("sa"))).alias("hsa"),
        F.sum(F.when(high, F.col("sa0"))).alias("hsa0"),
    ).withColumn("threshold", F.element_at(cuts, F.col("k")))


def floor_rule_search(visible: DataFrame, oof: DataFrame, groups: list[str], cap: float = 0.5,
                      thresholds=FLOOR_THRESHOLDS, margins=FLOOR_MARGINS, strengths=FLOOR_STRENGTHS) -> DataFrame:
    """Every floor rule with its metrics on the visible set and its effect out of fold."""
    keys = [*groups, "threshold", "margin", "strength"]
    grid = (thresholds, margins, strengths)
    v = _floor_classes(visible, groups, "pred_mag", "main_mag", "true_mag", cap, *grid, rounded_reference=False).select(
        *keys, (F.col("sa") / F.col("n")).alias("visible_mae"), F.sqrt(F.col("ss") / F.col("n")).alias("visible_rmse"),
        F.col("mx").alias("visible_max_abs"), F.col("ch").alias("visible_changed"))
    o = _floor_classes(oof, groups, "pred_mag", "main_mag", "true_mag", cap, *grid, rounded_reference=True).select(
        *keys, ((F.col("sa") - F.col("sa0")) / F.col("n")).alias("oof_mae_delta"),
        (F.sqrt(F.col("ss") / F.col("n")) - F.sqrt(F.col("ss0") / F.col("n"))).alias("oof_rmse_delta"),
        F.when(F.col("hn") > 0, (F.col("hsa") - F.col("hsa0")) / F.col("hn")).alias("oof_high_mae_delta"),
        F.col("ch").alias("oof_changed"))
    return v.join(o, keys)


def choose_rule(candidates: DataFrame, groups: list[str], mode: str = "balanced") -> DataFrame:
    """Best rule per group under the constraints of ``mode``; all rules when none qualifies."""
    allowed = {
        "safe": (F.col("oof_rmse_delta") <= 5e-4) & (F.col("oof_high_mae_delta") <= 0),
        "balanced": (F.col("oof_mae_delta") <= 0) & (F.col("oof_high_mae_delta") <= 0),
        "public_max": F.lit(True),
    }[mode]
    order = F.struct(F.when(F.coalesce(allowed, F.lit(False)), 0).otherwise(1), F.round("visible_rmse", 12),
                     F.round("visible_mae", 12), "visible_changed", "threshold", "margin", "strength")
    columns = [c for c in candidates.columns if c not in groups]
    best = candidates.groupBy(*groups).agg(F.min_by(F.struct(*columns), order).alias("b"))
    return best.select(*groups, "b.*")


def oof_first_rule(oof: DataFrame, groups: list[str], tolerance: float = 0.001, least_high: int = 8,
                   least_rows: int = 20, cap: float = 0.5, thresholds=OOF_THRESHOLDS, margins=FLOOR_MARGINS,
                   strengths=FLOOR_STRENGTHS) -> DataFrame:
    """Rule with the lowest high-magnitude error that does not degrade the whole set.

    Predictions are not rounded here. RMSE decides among rules with the same error.
    """
    cuts = _options(thresholds)
    rows = oof.select(*groups, _passed(F.col("main_mag"), thresholds).alias("passed"), F.col("pred_mag").alias("p"),
                      F.col("main_mag").alias("m"), F.col("true_mag").alias("y"))
    e0, kept = F.col("p") - F.col("y"), F.greatest(F.col("p"), F.lit(0.0)) - F.col("y")
    whole = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e0)).alias("sa0"), F.sum(e0 * e0).alias("ss0"),
        F.sum(F.abs(kept)).alias("sa"), F.sum(kept * kept).alias("ss"))
    points = list(itertools.product(margins, strengths))

    def lifted(p, m, y, margin, strength):
        floor = m - margin
        boost = floor > p
        raised = np.minimum((1.0 - strength) * p + strength * floor, m - cap)
        before, after = np.maximum(p, 0.0) - y, np.maximum(np.where(boost, raised, p), 0.0) - y
        return {"da": np.abs(after) - np.abs(before), "ds": after * after - before * before, "sa1": np.abs(after),
                "sa0": np.abs(p - y), "n": np.ones_like(p), "boosted": boost.astype(float)}

    moved = class_sums(rows.filter("passed > 0"), [*groups, "passed"], ["p", "m", "y"], points, lifted,
                       ["da", "ds", "sa1", "sa0", "n", "boosted"]).select(
        *groups, "passed", "da", "ds", "sa1", "sa0", "n", "boosted", *_point_columns(points, ["margin", "strength"]))
    ks = F.sequence(F.lit(1), F.lit(len(thresholds)))
    high = (
        moved.withColumn("k", F.explode(ks)).filter(F.col("passed") >= F.col("k"))
        .groupBy(*groups, "k", "margin", "strength")
        .agg(F.sum("da").alias("da"), F.sum("ds").alias("ds"), F.sum("sa0").alias("hsa0"), F.sum("sa1").alias("hsa1"),
             F.sum("n").alias("hn"), F.sum("boosted").alias("boosted")))
    scored = high.join(whole, groups).select(
        *groups, F.element_at(cuts, F.col("k")).alias("threshold"), "margin", "strength", "hn", "n", "boosted",
        (F.col("hsa1") / F.col("hn")).alias("oof_high_mae"), (F.col("hsa0") / F.col("hn")).alias("_h0"),
        F.sqrt((F.col("ss") + F.col("ds")) / F.col("n")).alias("oof_rmse"), F.sqrt(F.col("ss0") / F.col("n")).alias("_r0"),
        ((F.col("sa") + F.col("da")) / F.col("n")).alias("oof_mae"), (F.col("sa0") / F.col("n")).alias("_m0"))
    fine = (
        (F.col("n") >= least_rows) & (F.col("hn") >= least_high) & (F.col("boosted") > 0)
        & (F.col("oof_high_mae") < F.col("_h0")) & (F.col("oof_rmse") <= F.col("_r0") + tolerance)
        & (F.col("oof_mae") <= F.col("_m0") + tolerance))
    order = F.struct(F.round("oof_high_mae", 9), F.round("oof_rmse", 9), "threshold", "margin", "strength")
    picked = ["threshold", "margin", "strength", "oof_high_mae", "oof_rmse", "oof_mae"]
    return scored.filter(fine).groupBy(*groups).agg(F.min_by(F.struct(*picked), order).alias("b")).select(*groups, "b.*")


# --- time shifts -----------------------------------------------------------------------------


def shifted_hours(hours: Column, window: Column, shift: Column, fraction: Column) -> Column:
    """Hours after a shift, the clip to the window and the whole-hour stamp.

    A stamp has no minutes, so the hours it stands for lack the sub-hour part of the start.
    """
    low, top = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (lo, hi) in SHIFT_BOUNDS.items():
        low = F.when(window == name, F.lit(lo)).otherwise(low)
        top = F.when(window == name, F.lit(hi)).otherwise(top)
    moved = F.least(F.greatest(hours + shift, low), top)
    return F.rint(moved) - fraction


def shift_table(df: DataFrame, shifts=SHIFTS) -> DataFrame:
    """Squared and absolute error sums per window and shift: 39 rows whatever the input."""
    error = shifted_hours(F.col("pred_hours"), F.col("window"), F.col("shift"), F.col("fraction")) - F.col("true_hours")
    return df.withColumn("shift", F.explode(_options(shifts))).groupBy("window", "shift").agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("ss"), F.sum(F.abs(error)).alias("sa"))


def shift_search(df: DataFrame, tolerance: float = 0.01, gain: float = 0.005, shifts=SHIFTS) -> DataFrame:
    """Shift triple that lowers the overall RMSE without degrading a window.

    Windows are independent, so the triples are built from three small tables. A triple
    replaces the current best only when it gains more than ``gain``, in grid order; that
    walk over the accepted triples is one fold over an array.
    """
    table = shift_table(df, shifts)
    base = table.filter(F.col("shift") == 0.0).select("window", F.sqrt(F.col("ss") / F.col("n")).alias("base"))
    allowed = table.join(base, "window").filter(F.sqrt(F.col("ss") / F.col("n")) <= F.col("base") + tolerance)
    triple = None
    for name in SHIFT_BOUNDS:
        part = allowed.filter(F.col("window") == name).select(
            F.lit(1).alias("_j"), F.col("shift").alias(f"shift_{name}"), F.col("ss").alias(f"_ss_{name}"),
            F.col("n").alias(f"_n_{name}"))
        triple = part if triple is None else triple.join(part, "_j")
    total = sum((F.col(f"_ss_{w}") for w in SHIFT_BOUNDS), F.lit(0.0))
    n = sum((F.col(f"_n_{w}") for w in SHIFT_BOUNDS), F.lit(0))
    names = [f"shift_{w}" for w in SHIFT_BOUNDS]
    scored = triple.select(*names, F.sqrt(total / n).alias("rmse"))
    start = table.filter(F.col("shift") == 0.0).agg(F.sqrt(F.sum("ss") / F.sum("n")).alias("base_rmse"))
    walk = scored.agg(F.array_sort(F.collect_list(F.struct(*names, "rmse"))).alias("all"))
    joined = start.withColumn("_j", F.lit(1)).join(walk.withColumn("_j", F.lit(1)), "_j")
    first = F.struct(*[F.lit(0.0).alias(c) for c in names], F.col("base_rmse").alias("rmse"))
    best = F.aggregate(
        F.coalesce("all", F.array().cast("array<struct<shift_T1:double,shift_T2:double,shift_T3:double,rmse:double>>")),
        first,
        lambda acc, x: F.when((x["rmse"] <= F.col("base_rmse") + tolerance) & (x["rmse"] < acc["rmse"] - gain), x)
        .otherwise(acc))
    return joined.select("base_rmse", best.alias("b")).select("base_rmse", "b.*")


def directional_shift(hours: Column) -> Column:
    moved = F.when(hours < FAST_HOURS, hours + FAST_SHIFT).when(hours >= SLOW_HOURS, hours + SLOW_SHIFT).otherwise(hours)
    return F.least(F.greatest(moved, F.lit(T3_CLIP[0])), F.lit(T3_CLIP[1]))


def directional_check(df: DataFrame) -> DataFrame:
    """Error before and after the T3 shift and the mean residual per zone."""
    t3 = df.filter(F.col("window") == "T3")
    p, y = F.col("pred_hours"), F.col("true_hours")
    zone = F.when(p < FAST_HOURS, "fast").when(p >= SLOW_HOURS, "slow").otherwise("mid")
    return t3.withColumn("zone", zone).rollup("zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - y)).alias("mae_before"),
        F.avg(F.abs(directional_shift(p) - y)).alias("mae_after"), F.avg(p - y).alias("mean_residual"),
    ).withColumn("zone", F.coalesce("zone", F.lit("ALL")))


def residual_corrected(hours: Column, main_mag: Column, class_bias: dict[str, float], global_bias: float,
                       model_residual: Column | None = None) -> Column:
    """T3 time correction from the biases, or mostly from the residual model where it has a value."""
    from tremorframe.operators.metrics import mag_class

    # The class used at application is left-closed while the bias table is right-closed.
    names = {"<6.5": "5-6.5", "6.5-7.0": "6.5-7", "7.0-7.5": "7-7.5", "7.5-8.0": "7.5-8", ">=8.0": "8+"}
    bias = F.lit(0.0)
    for label, key in names.items():
        bias = F.when(mag_class(main_mag) == label, F.lit(float(class_bias.get(key) or 0.0))).otherwise(bias)
    correction = -F.lit(float(global_bias)) - 0.5 * bias
    if model_residual is not None:
        correction = F.coalesce(-(0.3 * global_bias + 0.7 * model_residual), correction)
    return F.least(F.greatest(hours + correction, F.lit(T3_CLIP[0])), F.lit(T3_CLIP[1]))


def extreme_floor_search(df: DataFrame, groups: list[str]) -> DataFrame:
    """Mean absolute error of every (probability threshold, floor margin) of the risk floor."""
    thresholds = [0.2 + 0.05 * k for k in range(12)]
    margins = [0.25 * k for k in range(10)]
    cuts = _options(thresholds)
    p, m, y, margin = F.col("pred_mag"), F.col("main_mag"), F.col("true_mag"), F.col("margin")
    lifted = F.greatest(p, m - margin) + F.greatest(F.lit(0.0), (m - p - margin) * 0.5)
    classes = (
        df.withColumn("passed", _passed(F.col("probability"), thresholds)).withColumn("margin", F.explode(_options(margins)))
        .groupBy(*groups, "passed", "margin")
        .agg(F.sum(F.abs(lifted - y)).alias("adj"), F.sum(F.abs(p - y)).alias("base"), F.count(F.lit(1)).alias("n")))
    spread = classes.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    error = F.sum(F.when(F.col("passed") >= F.col("k"), F.col("adj")).otherwise(F.col("base"))) / F.sum("n")
    return spread.groupBy(*groups, "k", "margin").agg(error.alias("mae")).select(
        *groups, F.element_at(cuts, F.col("k")).alias("threshold"), "margin", "mae")


def apply_extreme_floor(mag: Column, main_mag: Column, probability: Column, threshold: Column, margin: Column) -> Column:
    raised = F.greatest(mag, main_mag - margin)
    return F.when((probability >= threshold) & (raised > mag + 0.05), round_even(raised, 1)).otherwise(mag)

