"""Feature selection by importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_by_gain(gains: DataFrame, ratio: float = 0.85, least: int = 30) -> DataFrame:
    """Features by falling gain until ``ratio`` of the total, at least ``least`` of them.

    The table has one row per feature, so one ordered window is enough. Without any gain the shares are null and the first ``least`` stay.
    """
    order = Window.orderBy(F.desc("gain"), "feature")
    ranked = gains.select(
        "feature", "gain", F.row_number().over(order).cast("bigint").alias("rank"),
        F.try_divide(F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("gain").over(Window.partitionBy()))
        .alias("share"))
    keep = F.greatest(F.lit(least), F.count_if(F.col("share") < ratio).over(Window.partitionBy()) + 1)
    return ranked.withColumn("_k", keep).filter(F.col("rank") <= F.col("_k")).drop("_k")
