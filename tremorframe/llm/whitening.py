"""Whitening of embeddings: identical vectors are grouped, fitted once with their weights, whitened once and joined back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, stash, travels

travels(__name__)

#: Steps of the grid: an entry c becomes floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Eigenvalues below this share of the greatest one count as zero.
FLAT = 1e-12
_SAFE = float(2**62)


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` is the sum of weights, ``sums`` the exact weighted sums per dimension, ``values`` and ``vectors``
    (columns) the eigenvalues and unit eigenvectors of the covariance by falling eigenvalue, ``trace`` their sum."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def on_grid(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``id, x`` of ``id, vector`` rows: entries as long numbers. Rows with a null vector, or with a null or non-finite entry,
    go, and so do empty vectors and those with an entry beyond the range of a long."""
    entries = F.transform("vector", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall("vector", lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(_SAFE)), F.lit(False)))
    return rows.filter(F.col("vector").isNotNull()).filter(F.size("vector") > 0).filter(fits).select("id", entries.alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``x, copies``: counted on the map side first, so a vector in a third of all rows costs a row per task."""
    return rows.groupBy("x").agg(F.count("*").alias("copies"))


def _stacks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The vectors of each batch as one matrix, in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part


def _partial(rows: DataFrame, dim: int, step, start) -> np.ndarray:
    """Sum over all rows of what ``step(matrix, weights)`` gives: a ``start``-shaped part per task, its rows summed in groups.
    A group holds one line of each task's part, and the driver only the sum, which has the size of the model."""
    shape = start.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start.copy()
        for x, part in _stacks(batches):
            total += step(x, part.column("w").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(total), pa.list_(pa.from_numpy_dtype(start.dtype)))], ["line", "part"])

    kind = "long" if start.dtype == np.int64 else "double"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": group["line"].iloc[:1], "part": [np.sum(np.stack(group["part"].to_list()), axis=0)]})

    found = rows.mapInArrow(run, f"line int, part array<{kind}>").groupBy("line").applyInPandas(add, f"line int, part array<{kind}>").collect()
    out = start.copy()
    for r in found:
        out[r["line"]] = r["part"]
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """Fit ``x, w`` rows, one for each distinct vector, w its weight; None without rows.

    Sums are exact. The covariance (divisor: sum of weights) is a product of centred matrices, weighted by row, summed over
    tasks; only dim x dim numbers reach the driver, which finds the eigenvectors.
    """
    head = vectors.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    dim = head["d"]
    sums = _partial(vectors, dim, lambda x, w: np.concatenate([(x * w[:, None]).sum(axis=0), [w.sum()]])[None, :], np.zeros((1, dim + 1), np.int64))[0]
    n, sums = int(sums[-1]), sums[:-1]
    mean = np.array([s // n + (s % n) / n for s in sums.tolist()])

    def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred * w[:, None])

    covariance = _partial(vectors, dim, product, np.zeros((dim, dim))) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    return Whitening(n, sums, np.where(values > max(values[0], 0.0) * FLAT, values, 0.0), basis, float(np.trace(covariance)))


def whiten_distinct(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """The rows with ``deviation`` (long: sum over dimensions of (n * x - sum) ** 2, null beyond the range of a long) and
    ``whitened`` (the centred vector on each of the first ``components`` components, over the root of the eigenvalue; null
    where that is zero)."""
    k = min(components, len(model.values))
    n, sums = model.n, model.sums
    mean = np.array([s // n + (s % n) / n for s in sums.tolist()])
    usable = model.values[:k] > 0
    basis = model.vectors[:, :k] / np.sqrt(np.where(usable, model.values[:k], 1.0))

    def deviations(x: np.ndarray) -> list[int | None]:
        # every step must fit, not only the sum
        largest = max(float(n) * float(np.abs(x).max(initial=0)), float(np.abs(sums).max(initial=0)))
        if 4 * largest * largest * len(sums) < _SAFE:
            away = n * x - sums
            return (away * away).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in _stacks(batches):
            out = (x - mean) @ basis
            lists = pa.array([[v if ok else None for v, ok in zip(row, usable, strict=True)] for row in out.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(deviations(x), pa.int64()), lists],
                                             [*part.schema.names, "deviation", "whitened"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int) -> float | None:
    """Largest entry, by size, of the weighted covariance of ``whitened`` minus the identity, over the components that are set."""
    width = whitened.select(F.size(F.filter("whitened", lambda v: v.isNotNull())).alias("k")).first()
    if width is None or width["k"] < 1:
        return None
    k = width["k"]
    rows = whitened.select(F.slice("whitened", 1, k).alias("x"), "w")
    mean = _partial(rows, k, lambda y, w: (y * w[:, None]).sum(axis=0)[None, :], np.zeros((1, k)))[0] / n
    spread = _partial(rows, k, lambda y, w: (y - mean).T @ ((y - mean) * w[:, None]), np.zeros((k, k))) / n
    return float(np.abs(spread - np.eye(k)).max())


def join_back(rows: DataFrame, values: DataFrame, copies: str = "copies") -> DataFrame:
    """``rows`` (``id, x``) with the columns of ``values`` (one row for each x).

    Vectors that hold more than one in 4 P rows (P: shuffle partitions) are fewer than 4 P, whatever the table's size: these are
    broadcast. The others are joined by sort-merge, where no key is hot any more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = values.agg(F.sum(copies)).first()[0] or 0
    hot = values.filter(F.col(copies) > total // (4 * parts))
    marked = rows.join(F.broadcast(hot), "x", "left")
    names = [c for c in values.columns if c != "x"]
    direct = marked.filter(F.col(copies).isNotNull()).select("id", "x", *names)
    rest = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(
        values.filter(F.col(copies) <= total // (4 * parts)).hint("merge"), "x").select("id", "x", *names)
    return direct.unionByName(rest)


def whiten(rows: DataFrame, weights: str = "one", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``id, n, copies, deviation, whitened, explained, identity_error`` for each usable row of ``id, vector``.

    Vectors are put on a grid and identical ones grouped. The fit gives each distinct vector the weight one (``weights`` =
    "one") or its number of copies ("count"); ``n`` is the sum of weights. Each distinct vector is whitened once and joined back.
    ``explained`` is the eigenvalues' shares of the covariance's trace.

    Unusable rows (null vector or entry, NaN, infinite, empty) are left out; so are vectors of another length than most
    distinct ones have (the longest of equally common lengths). Repeated rows and null ids stay rows of their own. With
    one distinct vector every component is null and so are ``explained`` and the error. An empty table gives an empty result.
    Vectors of any length work while dim x dim numbers fit the driver and the tasks. Other columns are ignored.
    """
    gridded = on_grid(rows, scale)
    grouped = stash(distinct_vectors(gridded).withColumn("w", F.col("copies") if weights == "count" else F.lit(1).cast("long")), "vectors")
    length = grouped.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return gridded.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("n", "long"), ("copies", "long"), ("deviation", "long"), ("whitened", "array<double>"),
            ("explained", "array<double>"), ("identity_error", "double"))])
    grouped = grouped.filter(F.size("x") == length["d"])
    model = fit(grouped)
    whitened = stash(whiten_distinct(grouped, model, components), "whitened")
    error = identity_error(whitened, model.n)
    k = min(components, len(model.values))
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:k]]
    joined = join_back(gridded.filter(F.size("x") == length["d"]), whitened.select("x", "copies", "deviation", "whitened"))
    return joined.select(
        "id", F.lit(model.n).cast("long").alias("n"), "copies", "deviation", "whitened",
        F.array(*[F.lit(v).cast("double") for v in explained]).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding, fitted on the distinct vectors."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = whiten(rows)
    return out.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), "identity_error")
