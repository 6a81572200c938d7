"""Global order without a single-task window: ranks, running sums, exact quantiles.

Rows are range-partitioned on their sort keys and written once; per-partition totals
(as many rows as partitions) give the offsets. Every result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorframe.session import durable


def _sorted_parts(df: DataFrame, keys: list[Column]) -> DataFrame:
    return durable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def _offsets(totals: DataFrame, columns: list[str]) -> DataFrame:
    """Exclusive running totals over the per-partition rows (one row per partition)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns]
    )


def global_row_number(df: DataFrame, keys: list[Column], name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in the order of ``keys`` (make them unique)."""
    parts = _sorted_parts(df, keys)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return (
        parts.join(F.broadcast(_offsets(sizes, ["_n"])), "_part")
        .withColumn(name, (F.col("_before__n") + F.col("_pos")).cast("bigint"))
        .drop("_part", "_pos", "_before__n")
    )


def numbered_with_previous(df: DataFrame, group: str, keys: list[Column], value: str) -> DataFrame:
    """``row_index`` in the order of (group, keys), and ``previous``: ``value`` of the row before in the same group.

    A group of any size lies over several range partitions; the last row of a partition is handed to the next one.
    """
    parts = _sorted_parts(df, [F.col(group), *keys])
    last = F.struct(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max_by(last, "_pos").alias("_last"))
    order = Window.orderBy("_part")
    handed = ends.select(
        "_part", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(order).alias("_handed"))
    before = F.coalesce(F.lag(last).over(Window.partitionBy("_part").orderBy("_pos")), F.col("_handed"))
    return (
        parts.join(F.broadcast(handed), "_part").withColumn("_prior", before)
        .withColumns({"row_index": (F.col("_before") + F.col("_pos")).cast("bigint"),
                      "previous": F.when(F.col("_prior.g") == F.col(group), F.col("_prior.v"))})
        .drop("_part", "_pos", "_before", "_handed", "_prior")
    )


def global_running_sum(df: DataFrame, keys: list[Column], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums: ``sums`` maps a value column to the name of its result.

    The window runs inside range partitions, so its task size is the partition size.
    """
    parts = _sorted_parts(df, keys)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(_offsets(totals, list(sums))), "_part")
    for value, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(f"_before_{value}"))
    return out.drop("_part", "_pos", *[f"_before_{c}" for c in sums])


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group as one column per probability (q0, q1, ...).

    Equal values are counted before the sort, so a hot group is spread over the range
    partitions instead of being gathered in one aggregate buffer.
    """
    if not groups:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probabilities).drop("_all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = global_running_sum(counted, [*[F.col(g) for g in groups], F.col(value)], {"_c": "_first"})
    bounds = ranked.groupBy(*groups).agg(F.min("_first").alias("_start"), F.sum("_c").alias("_n"))
    placed = ranked.join(bounds, groups)
    low = F.col("_first") - F.col("_start")
    high = low + F.col("_c") - 1
    wanted = []
    for i, p in enumerate(probabilities):
        target = F.lit(p) * (F.col("_n") - 1)
        floor, ceil = F.floor(target), F.ceil(target)
        lower = F.max(F.when((low <= floor) & (floor <= high), F.col(value)))
        upper = F.max(F.when((low <= ceil) & (ceil <= high), F.col(value)))
        share = F.max(target - floor)
        wanted.append((lower + (upper - lower) * share).alias(f"q{i}"))
    return placed.groupBy(*groups).agg(*wanted)
