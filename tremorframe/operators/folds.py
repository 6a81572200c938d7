"""Time-ordered folds, purging, expanding windows and holdouts.

Positions come from a distributed global rank. A fold plan is one small row per fold; train
and validation sets are filters on the ranked table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.operators.ranking import global_row_number

DAY_US = 86_400_000_000


def with_time_rank(df: DataFrame, time: str, id_: str) -> DataFrame:
    """``row_index`` in time order (ties by id) and ``time_us``."""
    return global_row_number(df, [F.col(time), F.col(id_)]).withColumn("time_us", F.unix_micros(time))


@dataclass(frozen=True)
class Fold:
    fold: int
    train_end: int
    valid_end: int
    valid_start_us: int
    cutoff_us: int | None = None
    train_rows: int = 0
    purge_days: float | None = None

    def trains(self) -> Column:
        """Whether a row of the ranked table trains."""
        before = F.col("row_index") < self.train_end
        return before if self.cutoff_us is None else before & (F.col("time_us") <= self.cutoff_us)

    def validates(self) -> Column:
        return (F.col("row_index") >= self.train_end) & (F.col("row_index") < self.valid_end)

    def train(self, ranked: DataFrame) -> DataFrame:
        return ranked.filter(self.trains())

    def valid(self, ranked: DataFrame) -> DataFrame:
        return ranked.filter(self.validates())


# Fixed values: (days, least rows, least share of the fold) in the order they are tried.
PURGE_TREES = ((30.0, 10, 0.2), (7.0, 5, 0.1))
PURGE_GATE = ((30.0, 20, 0.3),)
PURGE_DEEP = ((30.0, 10, 0.3),)


def fold_bounds(n: int, folds: int) -> list[tuple[int, int, int]]:
    """(fold, validation start, validation end): equal blocks at the end of the table."""
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    return [(i + 1, n - (folds - i) * size, n - (folds - i - 1) * size) for i in range(folds)]


def plan_folds(ranked: DataFrame, folds: int = 5, purge=PURGE_TREES, strict: bool = False) -> list[Fold]:
    """Expanding folds with the purge gap that leaves enough training rows.

    Two aggregates of one row each: block start and end times, then training rows per gap.
    ``strict`` refuses a validation block that starts at the very time training ends; without
    it the id decides between equal times.
    """
    bounds = fold_bounds(ranked.count(), folds)
    at = {}
    for number, start, _ in bounds:
        at[f"v{number}"] = F.min(F.when(F.col("row_index") == start, F.col("time_us")))
        at[f"t{number}"] = F.max(F.when(F.col("row_index") == start - 1, F.col("time_us")))
    times = ranked.agg(*[e.alias(n) for n, e in at.items()]).first()
    for number, _, _ in bounds:
        start, end = times[f"v{number}"], times[f"t{number}"]
        if start < end or (strict and start == end):
            raise RuntimeError(f"fold {number}: validation must start after training ends")
    counts = {}
    for number, start, _ in bounds:
        for step, (days, _, _) in enumerate(purge):
            inside = (F.col("row_index") < start) & (F.col("time_us") <= times[f"v{number}"] - int(days * DAY_US))
            counts[f"c{number}_{step}"] = F.count_if(inside)
    left = ranked.agg(*[e.alias(n) for n, e in counts.items()]).first() if counts else {}
    plan = []
    for number, start, end in bounds:
        chosen = (None, start, None)
        for step, (days, least, share) in enumerate(purge):
            if left[f"c{number}_{step}"] >= max(least, start * share):
                chosen = (times[f"v{number}"] - int(days * DAY_US), left[f"c{number}_{step}"], days)
                break
        plan.append(Fold(number, start, end, times[f"v{number}"], *chosen))
    return plan


def fold_table(ranked: DataFrame, folds: list[Fold]) -> DataFrame:
    rows = [(f.fold, f.train_end, f.valid_end - f.train_end, f.train_rows, f.purge_days) for f in folds]
    return ranked.sparkSession.createDataFrame(
        rows, "fold int, train_rows long, valid_rows long, purged_rows long, purge_days double")


def assign_fold(ranked: DataFrame, folds: list[Fold]) -> DataFrame:
    """``fold`` = the fold a row validates (0 for the first block)."""
    number = F.lit(0)
    for f in folds:
        inside = (F.col("row_index") >= f.train_end) & (F.col("row_index") < f.valid_end)
        number = F.when(inside, F.lit(f.fold)).otherwise(number)
    return ranked.withColumn("fold", number)


def expanding_windows(n: int, min_train: int, stride: int, least: int = 10) -> list[tuple[int, int, int]]:
    """(window, train end, validation end) while a full stride fits."""
    if stride < least:
        return []
    return [(i + 1, end, end + stride) for i, end in enumerate(range(min_train, n - stride + 1, stride))]


def holdout_start(ranked: DataFrame, share: float = 0.2, n: int | None = None) -> int:
    """Position of the first row of the holdout."""
    n = ranked.count() if n is None else n
    return n - max(1, int(n * share))


def holdout_split(ranked: DataFrame, share: float = 0.2, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Everything but the last ``share`` of the rows, and those rows (at least one)."""
    cut = holdout_start(ranked, share, n)
    return ranked.filter(F.col("row_index") < cut), ranked.filter(F.col("row_index") >= cut)


def hash_fold(id_: str, folds: int, seed: int = 0):
    """Fold number from the id: stable under any partitioning."""
    return F.pmod(F.xxhash64(F.col(id_).cast("string"), F.lit(seed)), F.lit(folds)).cast("int")
