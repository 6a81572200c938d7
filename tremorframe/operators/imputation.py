"""Filling and scaling: statistics are fitted on one table and applied to any other.

Fitting returns a dictionary with one entry per column, so only column-count-sized results
reach the driver; quantiles are exact and distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import FEATURE_DEFAULTS, FEATURE_DEFAULTS_BY_PLATE
from tremorframe.functions.windows import finite
from tremorframe.operators.folds import Fold
from tremorframe.operators.ranking import exact_quantiles, global_running_sum
from tremorframe.session import durable

# Priors that replace the fitted median in the sequence-model table.
PRIOR_FILLS = {"gr_b_value": 1.0, "omori_p": 1.0, "omori_c": 0.05, "etas_p": 1.0, "etas_c": 0.05}


def unpivot_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (feature, value) rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_p")).select("_p.*")


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    if not columns:
        return {}
    rows = exact_quantiles(unpivot_numeric(df, columns), ["feature"], "value", probabilities).collect()
    return {r["feature"]: [r[f"q{i}"] for i in range(len(probabilities))] for r in rows}


def columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    """One aggregate row: which columns miss a value."""
    if not columns:
        return []
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def impute(df: DataFrame, columns: list[str], indicators: bool = True,
           plate_column: str | None = "nearest_plate_boundary_type") -> DataFrame:
    """Fill by plate-type default, then global default, then column median, then zero.

    A ``<column>_missing`` flag is added for every column that had a null.
    """
    present = [c for c in columns if c in df.columns]
    holes = columns_with_nulls(df, present)
    medians = column_quantiles(df, [c for c in holes if c not in FEATURE_DEFAULTS], [0.5])
    filled: dict[str, Column] = {}
    for c in holes:
        kind = dict(df.dtypes)[c]
        options = [F.col(c)]
        if c in FEATURE_DEFAULTS:
            if plate_column and plate_column in df.columns:
                for plate, defaults in FEATURE_DEFAULTS_BY_PLATE.items():
                    if c in defaults:
                        options.append(F.when(F.col(plate_column) == plate, F.lit(defaults[c])))
            options.append(F.lit(FEATURE_DEFAULTS[c]))
        else:
            options.append(F.lit(medians.get(c, [0.0])[0]))
        target = "double" if kind != "boolean" else "boolean"
        filled[c] = F.coalesce(*[o.cast(target) for o in options])
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in holes] if indicators else []
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns], *flags)


@dataclass
class Preprocessor:
    """Fill values, indicator columns and scaling fitted on a training fold."""

    columns: list[str]
    kind: str = "robust"
    fills: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def filled(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(float(self.fills.get(name, 0.0))))


def fit_preprocessor(train: DataFrame, columns: list[str], kind: str = "robust",
                     indicators: bool = True, priors: dict[str, float] = PRIOR_FILLS) -> Preprocessor:
    """Fit on the training fold only.

    robust: median and inter-quartile range; standard: mean and population deviation. A zero
    spread counts as one.
    """
    fitted = Preprocessor(list(columns), kind)
    fitted.indicators = columns_with_nulls(train, columns) if indicators else []
    medians = column_quantiles(train, [c for c in columns if c not in priors], [0.5])
    fitted.fills = {c: float(priors.get(c, (medians.get(c) or [0.0])[0] or 0.0)) for c in columns}
    full = train.select(*[fitted.filled(c).alias(c) for c in columns])
    if kind == "robust":
        quartiles = column_quantiles(full, columns, [0.25, 0.5, 0.75])
        fitted.centre = {c: quartiles[c][1] for c in columns}
        fitted.scale = {c: (quartiles[c][2] - quartiles[c][0]) or 1.0 for c in columns}
    elif kind == "standard":
        row = full.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        fitted.centre = {c: row[f"m_{c}"] for c in columns}
        fitted.scale = {c: row[f"s_{c}"] or 1.0 for c in columns}
    else:
        raise ValueError(f"unknown scaler: {kind}")
    return fitted


def fold_preprocessors(ranked: DataFrame, folds: list[Fold], columns: list[str], priors: dict[str, float] = PRIOR_FILLS) -> DataFrame:
    """``feature, fold, n, nulls, fill, centre, scale, mean, deviation`` of the training rows of every fold, all exact.

    Equal values are counted first, with one count per fold; one range sort by (feature, value) and running sums of these counts
    serve all folds, instead of a fit per fold. ``fill`` is the prior or the median of the known values; centre and scale are median
    and inter-quartile range after filling, mean and deviation are those after filling too. A spread of zero counts as one.
    """
    numbers = range(len(folds))
    marked = ranked.select(*[f.trains().cast("long").alias(f"_f{k}") for k, f in zip(numbers, folds)], *[F.col(c).cast("double").alias(c) for c in columns])
    long = marked.select(*[f"_f{k}" for k in numbers], F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("value")) for c in columns])).alias("_p")).select("*", "_p.*").drop("_p")
    counted = durable(long.groupBy("feature", "value").agg(*[F.sum(f"_f{k}").alias(f"c{k}") for k in numbers]))
    nulls = counted.groupBy("feature").agg(*[F.sum(F.when(F.col("value").isNull(), F.col(f"c{k}")).otherwise(0)).alias(f"z{k}") for k in numbers])
    known = global_running_sum(counted.filter("value IS NOT NULL"), [F.col("feature"), F.col("value")], {f"c{k}": f"b{k}" for k in numbers})
    bounds = known.groupBy("feature").agg(*[F.min(f"b{k}").alias(f"s{k}") for k in numbers], *[F.sum(f"c{k}").alias(f"n{k}") for k in numbers])
    placed = known.join(F.broadcast(bounds), "feature")  # a row per feature

    def holds(k: int, position: Column) -> Column:
        low = F.col(f"b{k}") - F.col(f"s{k}")
        return (low <= position) & (position < low + F.col(f"c{k}"))

    def at(k: int, position: Column) -> Column:
        return F.max(F.when(holds(k, position), F.col("value")))

    def median(k: int) -> Column:
        place = (F.col(f"n{k}") - 1) * F.lit(0.5)
        return (at(k, F.floor(place)) + at(k, F.ceil(place))) / 2

    prior = F.coalesce(*[F.when(F.col("feature") == c, F.lit(float(v))) for c, v in priors.items() if c in columns], F.lit(None).cast("double"))
    fills = placed.groupBy("feature").agg(*[median(k).alias(f"m{k}") for k in numbers])
    fills = nulls.join(fills, "feature", "left").select(
        "feature", *[f"z{k}" for k in numbers], *[F.coalesce(prior, F.col(f"m{k}"), F.lit(0.0)).alias(f"fill{k}") for k in numbers])
    full = placed.join(F.broadcast(fills), "feature")

    def filled(k: int, share: float) -> Column:
        """A quantile of the known values and z copies of the fill: positions behind the copies are moved by z."""
        total, z = F.col(f"n{k}") + F.col(f"z{k}"), F.col(f"z{k}")
        place = (total - 1) * F.lit(share)

        def value(position: Column) -> Column:
            behind = position - z
            inside = F.when(holds(k, position) & (F.col("value") < F.col(f"fill{k}")), F.col("value")) \
                .when(holds(k, behind) & (F.col("value") >= F.col(f"fill{k}")), F.col("value"))
            return F.coalesce(F.max(inside), F.max(f"fill{k}"))

        low, high = value(F.floor(place)), value(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    def moments(k: int) -> list[Column]:
        shift = F.col("value") - F.col(f"fill{k}")  # filled rows add nothing
        total = F.max(F.col(f"n{k}") + F.col(f"z{k}"))
        first, second = F.sum(shift * F.col(f"c{k}")) / total, F.sum(shift * shift * F.col(f"c{k}")) / total
        return [(F.max(f"fill{k}") + first).alias("mean"), F.sqrt(F.greatest(second - first * first, F.lit(0.0))).alias("deviation")]

    rows = []
    for k, f in zip(numbers, folds):
        mean, deviation = moments(k)
        part = full.groupBy("feature").agg(
            F.max(f"n{k}").alias("n"), F.max(f"z{k}").alias("nulls"), F.max(f"fill{k}").alias("fill"), filled(k, 0.25).alias("_q1"),
            filled(k, 0.5).alias("centre"), filled(k, 0.75).alias("_q3"), mean, deviation)
        scale = F.col("_q3") - F.col("_q1")
        rows.append(part.select("feature", F.lit(f.fold).alias("fold"), "n", "nulls", "fill", "centre", F.when(scale == 0, 1.0).otherwise(scale).alias("scale"), "mean",
                                F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation")).alias("deviation")))
    return reduce(DataFrame.unionByName, rows)


def apply_preprocessor(df: DataFrame, fitted: Preprocessor, keep: list[str] = ()) -> DataFrame:
    """Scaled columns plus indicators; anything not finite becomes zero."""
    scaled = [
        F.coalesce(finite((fitted.filled(c) - F.lit(fitted.centre[c])) / F.lit(fitted.scale[c])), F.lit(0.0)).alias(c)
        for c in fitted.columns
    ]
    flags = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in fitted.indicators]
    return df.select(*keep, *scaled, *flags)


def stable_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """A reproducible sample of ``rows`` rows: the smallest key hashes (a top-k, not a full sort)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)
