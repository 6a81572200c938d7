"""Tree regressors and classifiers on purged time folds: all folds, kinds and targets of a call are one job."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.functions.windows import log_target, unlog_target
from tremorframe.models.boosting import Fit, fit_all, models_of, scores_by_key
from tremorframe.models.trees import Size
from tremorframe.operators.folds import Fold, assign_fold

#: The reference's sizes; the forest has as many trees as there are rounds.
SIZES = {"boosted": Size(), "forest": Size(bagged=True, row_share=1.0, column_share=1.0, node_columns=1 / 3, least=1.0)}
#: The gate and extreme classifier, and the time buckets.
GATE_SIZE = Size(rounds=300, depth=6, rate=0.03)
BUCKET_SIZE = Size(rounds=500, depth=6, rate=0.03)
YEAR_DAYS = 366.0


@contextmanager
def held(df: DataFrame):
    """Keep a training table while a model reads it repeatedly."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def regression(name: str, kind: str, train: Column, label: Column, score: Column | None = None, params: dict | None = None,
               late_weight: float | None = None) -> Fit:
    """A regressor of one kind. With ``late_weight`` boosting weighs errors of late predictions inside every round (label on the
    log scale); a forest has no such objective."""
    late = late_weight is not None and kind == "boosted"
    return Fit(name, train, label, score, objective="late" if late else "squared", size=SIZES[kind].with_(params), late_weight=late_weight or 2.0)


def oof_regression(ranked: DataFrame, folds: list[Fold], columns: list[str], mag: str, time: str,
                   kinds: tuple[str, ...] = ("boosted", "forest"), params: dict[str, dict] | None = None,
                   keep: list[str] = (), late_weight: float | None = None,
                   time_cap: float = YEAR_DAYS) -> DataFrame:
    """Out-of-fold predictions of both targets: time is learned as log1p, results are floored at 0."""
    params = params or {}
    fits = [regression(f"{kind}_{target}", kind, fold.trains(), label, fold.validates(), params.get(kind), weight)
            for fold in folds for kind in kinds
            for target, label, weight in (("mag", F.col(mag), None), ("time", log_target(F.col(time)), late_weight))]
    scores = scores_by_key(fit_all(ranked, "row_index", columns, fits), fits, "row_index")
    out = {}
    for kind in kinds:
        out[f"{kind}_pred_mag"] = F.greatest(F.col(f"{kind}_mag"), F.lit(0.0))
        out[f"{kind}_pred_time"] = F.least(F.greatest(unlog_target(F.col(f"{kind}_time")), F.lit(0.0)), F.lit(time_cap))
    return assign_fold(ranked, folds).join(scores, "row_index").withColumns(out).select(*keep, mag, time, "fold", *out)


def balance(df: DataFrame, groups: dict[str, Column], label: str) -> dict[str, Column]:
    """Balanced weights n / (classes * count) for each group of rows, a condition each: a count per group and class."""
    counts = df.agg(*[F.count_if(where & (F.col(label) == k)).alias(f"{name}_{k}") for name, where in groups.items() for k in (0, 1)]).first()
    out = {}
    for name in groups:
        none, some = counts[f"{name}_0"], counts[f"{name}_1"]
        classes = (none > 0) + (some > 0)
        out[name] = F.when(F.col(label) == 1, F.lit((none + some) / max(classes * some, 1))).otherwise(F.lit((none + some) / max(classes * none, 1)))
    return out


def gates(df: DataFrame, groups: dict[str, tuple[Column, Column]], label: str, name: str, params: dict | None = None) -> list[Fit]:
    """Balanced binary models, one for each group (rows that train, rows that are scored); all rows of one class give its constant."""
    weights = balance(df, {k: train for k, (train, _) in groups.items()}, label)
    return [Fit(name, train, F.col(label), score, weights[k], "logistic", GATE_SIZE.with_(params)) for k, (train, score) in groups.items()]


def oof_gate(ranked: DataFrame, folds: list[Fold], columns: list[str], label: str = "label",
             keep: list[str] = (), params: dict | None = None) -> DataFrame:
    """``probability`` of class 1 out of fold."""
    fits = gates(ranked, {f"f{f.fold}": (f.trains(), f.validates()) for f in folds}, label, "probability", params)
    scores = scores_by_key(fit_all(ranked, "row_index", columns, fits), fits, "row_index")
    return assign_fold(ranked, folds).join(scores, "row_index").select(*keep, label, "probability", "fold")


def buckets(name: str, train: Column, label: str, score: Column | None = None, params: dict | None = None) -> Fit:
    """Four-class time buckets; a class that no training row has gets no probability."""
    return Fit(name, train, F.col(label), score, objective="classes", size=BUCKET_SIZE.with_(params), classes=4)


def fit_pipelines(df: DataFrame, columns: list[str], targets: dict[str, tuple[str, Column]], key: str,
                  params: dict[str, dict] | None = None) -> dict[str, PipelineModel]:
    """Final models on all rows, fitted together: ``{output: (kind, label)}`` to saveable pipelines. Feed it an imputed table."""
    fits = [regression(name, kind, F.lit(True), label, params=(params or {}).get(kind)) for name, (kind, label) in targets.items()]
    found = models_of(fit_all(df, key, columns, fits, keep=True), fits, columns)
    return {name: PipelineModel([found[name]]) for name in targets}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(train: DataFrame, columns: list[str], target: str, key: str, kind: str = "boosted",
                params: dict | None = None) -> DataFrame:
    """(feature, gain) rows of one model fit: shares of the summed gain."""
    fits = [regression(target, kind, F.lit(True), F.col(target), params=params)]
    gains = models_of(fit_all(train, key, columns, fits, keep=True), fits, columns)[target].trees().gains
    total = float(gains.sum()) or 1.0
    return train.sparkSession.createDataFrame([(c, float(v) / total) for c, v in zip(columns, gains)], "feature string, gain double")
