"""Saved heads with their preparation: one pipeline scores raw sequence features, the same in any session."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.constants import FEATURE_DEFAULTS, WINDOW_BOUNDS
from tremorframe.functions.windows import expected_hours, finite, log_target, time_bucket, unlog_target
from tremorframe.models.boosting import fit_all, models_of
from tremorframe.models.heads import head_columns
from tremorframe.models.training import buckets, gates, regression
from tremorframe.operators.features import legal_features
from tremorframe.operators.fusion import null_mean
from tremorframe.operators.imputation import column_quantiles
from tremorframe.operators.labels import extreme_flag
from tremorframe.session import durable

NAMES = ("mainshock_id", "mainshock_time", "mainshock_mag")


class LegalView(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The columns that a window may see, with its observed counts: a pipeline cannot read later observations."""

    window = Param(Params._dummy(), "window", "forecast window", TypeConverters.toString)

    @keyword_only
    def __init__(self, window: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return legal_features(df, self.getOrDefault("window"))


class FilledFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features as doubles; what is missing, not finite or absent takes the value fitted on the training rows."""

    fills = Param(Params._dummy(), "fills", "value of each feature, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, fills: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def fitted(train: DataFrame, columns: list[str]) -> FilledFeatures:
        """Fixed defaults where a feature has one, else the exact median of the training rows (0 if all are missing)."""
        open_columns = [c for c in columns if c not in FEATURE_DEFAULTS]
        known = train.select(*[finite(F.col(c).cast("double")).alias(c) for c in open_columns])
        medians = column_quantiles(known, open_columns, [0.5]) if open_columns else {}
        return FilledFeatures(fills=json.dumps({
            c: float(FEATURE_DEFAULTS[c] if c in FEATURE_DEFAULTS else (medians.get(c) or [0.0])[0] or 0.0) for c in columns}))

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = json.loads(self.getOrDefault("fills"))
        return df.withColumns({
            c: F.coalesce(finite(F.col(c).cast("double")), F.lit(v)) if c in df.columns else F.lit(v) for c, v in fills.items()})


class HeadOutputs(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Raw heads to results inside the window's bounds: magnitudes from 0, hours in the window, bucket hours, their mean."""

    window = Param(Params._dummy(), "window", "forecast window", TypeConverters.toString)
    kinds = Param(Params._dummy(), "kinds", "kinds of trees", TypeConverters.toListString)

    @keyword_only
    def __init__(self, window: str | None = None, kinds: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        window, kinds = self.getOrDefault("window"), self.getOrDefault("kinds")
        low, high = WINDOW_BOUNDS[window]
        mags = [F.greatest(F.col(f"_mag_{k}"), F.lit(0.0)) for k in kinds]
        hours = [F.least(F.greatest(unlog_target(F.col(f"_hours_{k}")), F.lit(low + 1e-6)), F.lit(high)) for k in kinds]
        return df.select(
            *[c for c in NAMES if c in df.columns], F.lit(window).alias("window"), *[m.alias(f"mag_{k}") for m, k in zip(mags, kinds)],
            *[h.alias(f"hours_{k}") for h, k in zip(hours, kinds)], null_mean(mags).alias("mag_mean"), "bucket_probs",
            expected_hours(F.lit(window), F.col("bucket_probs")).alias("hours_bucket"), "extreme_prob")


def fit_window_pipeline(ranked: DataFrame, window: str, kinds: tuple[str, ...] = ("boosted", "forest"),
                        params: dict[str, dict] | None = None, margin: float = 1.2) -> PipelineModel:
    """Every head of one window fitted on all rows of ``ranked`` (raw features, targets, row_index) in one job.

    The pipeline holds the legal view, the fills, the trees of all heads and the bounds, so it scores tables without targets
    and with missing features. A row without a target does not train that target's heads; training sees the same fills as scoring.
    """
    params = params or {}
    mag, hours = f"target_{window}_max_mag", f"target_{window}_time_to_max_hours"
    view = LegalView(window=window)
    legal = view.transform(ranked)
    columns = head_columns(legal)
    fills = FilledFeatures.fitted(legal, columns)
    targets = ranked.select(
        "mainshock_id", "row_index", log_target(F.col(hours)).alias("_y_hours"), F.col(mag).alias("_y_mag"),
        F.when(F.col(hours).isNotNull(), time_bucket(F.lit(window), F.col(hours))).alias("bucket"),
        extreme_flag(F.col(mag), F.col("mainshock_mag"), margin).cast("int").alias("extreme"))
    table = durable(fills.transform(legal).select("mainshock_id", *columns).join(targets, "mainshock_id"))
    every = F.lit(True)
    fits = [regression(f"_{what}_{kind}", kind, every, F.col(f"_y_{what}"), params=params.get(kind))
            for kind in kinds for what in ("mag", "hours")]
    fits.append(buckets("bucket_probs", every, "bucket", params=params.get("buckets")))
    fits += gates(table, {"all": (every, F.lit(False))}, "extreme", "extreme_prob", params.get("extreme"))
    found = models_of(fit_all(table, "row_index", columns, fits, keep=True), fits, columns)
    return PipelineModel([view, fills, *[found[f.name] for f in fits], HeadOutputs(window=window, kinds=list(kinds))])
