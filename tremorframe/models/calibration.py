"""Residual calibrators of window magnitudes."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import WINDOWS
from tremorframe.models.boosting import Fit, fit_all, models_of, scores_by_key
from tremorframe.models.training import held
from tremorframe.models.trees import Size
from tremorframe.operators.folds import hash_fold
from tremorframe.operators.imputation import apply_preprocessor, fit_preprocessor
from tremorframe.operators.metrics import rmse
from tremorframe.operators.ranking import global_row_number

# Residual limits (low, high, high for M >= 8) per candidate.
LIMITS = {"conservative": (-0.2, 0.4, 0.5), "balanced": (-0.3, 0.6, 0.8), "aggressive": (-0.4, 0.8, 1.0)}
CALIBRATORS = ("ridge", "huber", "isotonic", "boosted")
#: The reference's sizes of the boosted calibrator and of the residual model.
CALIBRATOR_SIZE = Size(rounds=100, depth=2, rate=0.1, row_share=1.0, column_share=1.0, l1=0.0, l2=0.0, gain=0.0, least=1.0)
RESIDUAL_SIZE = Size(rounds=150, depth=3, rate=0.05, row_share=0.8, column_share=1.0, l1=0.0, l2=1.0, gain=0.0)


def calibration_table(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features and residual of rows with a positive target."""
    rows = df.filter(F.col("true_mag") > 0)
    flags = {f"high_{int(cut * 10)}": (F.col("main_mag") >= cut).cast("double") for cut in (7.5, 8.0, 8.5)}
    flags |= {f"win_{w}": (F.col("window") == w).cast("double") for w in WINDOWS}
    out = rows.withColumns({**flags, "mag_gap": F.col("main_mag") - F.col("pred_mag"),
                            "residual": F.col("true_mag") - F.col("pred_mag")})
    return out, ["pred_mag", "main_mag", "mag_gap", *flags]


def limited(residual: Column, main_mag: Column, limits: tuple[float, float, float]) -> Column:
    low, high, top = limits
    most = F.when(main_mag >= 8.0, F.lit(top)).otherwise(F.lit(high))
    return F.least(F.greatest(residual, F.lit(low)), most)


def fit_calibrator(train: DataFrame, kind: str, columns: list[str], key: str = "row_index"):
    """A function that adds ``residual_pred`` to a table. Scaling is fitted on ``train`` only; trees need none."""
    if kind == "boosted":
        fits = [Fit("residual_pred", F.lit(True), F.col("residual"), size=CALIBRATOR_SIZE)]
        return models_of(fit_all(train, key, columns, fits, keep=True), fits, columns)["residual_pred"].transform
    if kind == "isotonic":
        # a row per prediction with its mean and count pools the same: else all rows of one prediction would meet in one task's memory
        with held(train.groupBy(F.col("pred_mag").alias("x")).agg(F.avg("residual").alias("label"), F.count("*").cast("double").alias("w"))) as data:
            model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w").fit(data)

        def isotonic(df: DataFrame) -> DataFrame:
            out = model.transform(df.withColumn("x", F.col("pred_mag")))
            bounded = F.least(F.greatest(F.col("prediction"), F.lit(-1.5)), F.lit(2.0))
            return out.withColumn("residual_pred", bounded).drop("x", "prediction")

        return isotonic
    scaler = fit_preprocessor(train, columns, kind="standard", indicators=False, priors={})
    assembler = VectorAssembler(inputCols=[f"_s_{c}" for c in columns], outputCol="features")

    def vectors(df: DataFrame) -> DataFrame:
        scaled = apply_preprocessor(df, scaler, keep=[F.struct(*df.columns).alias("_row")])
        renamed = scaled.select("_row", *[F.col(c).alias(f"_s_{c}") for c in columns])
        return assembler.transform(renamed).select("_row.*", "features")

    with held(vectors(train).select("features", F.col("residual").alias("label"))) as data:
        if kind == "ridge":
            model = LinearRegression(regParam=1.0 / max(data.count(), 1), elasticNetParam=0.0, standardization=False).fit(data)
        else:
            model = LinearRegression(loss="huber", epsilon=1.35, maxIter=200).fit(data)

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(vectors(df)).withColumnRenamed("prediction", "residual_pred").drop("features")

    return predict


def compare_calibrators(train: DataFrame, held_out: DataFrame, columns: list[str], kinds=CALIBRATORS) -> DataFrame:
    """Error of the limited residual on the newer rows for every calibrator and limit set."""
    out = None
    for kind in kinds:
        scored = fit_calibrator(train, kind, columns)(held_out)
        for name, limits in LIMITS.items():
            error = limited(F.col("residual_pred"), F.col("main_mag"), limits) - F.col("residual")
            part = scored.agg(
                F.lit(kind).alias("model"), F.lit(name).alias("candidate"), F.count(F.lit(1)).alias("n"),
                F.avg(F.abs(error)).alias("mae"), rmse(error).alias("rmse"), F.avg(F.abs("residual")).alias("mae_before"))
            out = part if out is None else out.unionByName(part)
    return out


def oof_residual(df: DataFrame, key: str, residual: str, columns: list[str], folds: int = 5,
                 clip: float | None = None, params: dict | None = None) -> DataFrame:
    """Out-of-fold boosted prediction of a residual over hash folds (stable for a key); ``clip`` bounds the target if given."""
    bounded = F.col(residual) if clip is None else F.least(F.greatest(F.col(residual), F.lit(-clip)), F.lit(clip))
    rows = global_row_number(df.withColumn("_fold", hash_fold(key, folds)), [F.col(key)])
    fits = [Fit("residual_pred", F.col("_fold") != fold, bounded, F.col("_fold") == fold, size=RESIDUAL_SIZE.with_({"seed": 42 + fold} | (params or {})))
            for fold in range(folds)]
    scores = scores_by_key(fit_all(rows, "row_index", columns, fits), fits, "row_index")
    return rows.join(scores, "row_index").drop("_fold", "row_index")
