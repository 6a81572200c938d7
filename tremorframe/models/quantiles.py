"""Quantile forest: the target distribution of the leaves a row falls into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorframe.models import trees
from tremorframe.models.boosting import Fit, clean, fit_all, models_of
from tremorframe.models.training import SIZES

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def quantile_forest(rows: DataFrame, columns: list[str], train: Column, test: Column, target: str, key: str,
                    bins: int = 256, quantiles=QUANTILES, params: dict | None = None) -> DataFrame:
    """``key, q10, ...`` of the test rows; the median is the point forecast. ``key`` is a unique whole number.

    A leaf is kept as counts over target bins. The bins are quantiles of the training targets from the least to the greatest, so
    no target is clipped and dense ranges have fine bins. The counts travel inside the model (trees x leaves x bins numbers at most,
    however many rows there are), so test rows are neither exploded nor shuffled. Values are exact to a bin.
    """
    asked = [i / bins for i in range(bins + 1)]
    edges = sorted(set(rows.filter(train).agg(F.percentile_approx(F.col(target).cast("double"), asked, 100 * bins)).first()[0] or ()))
    if not edges:
        raise ValueError("no training targets")
    places = np.array(edges if len(edges) > 1 else [edges[0], edges[0]])
    fits = [Fit("forest", train, F.col(target), size=SIZES["forest"].with_(params), leaf_edges=places)]
    model = models_of(fit_all(rows, key, columns, fits, keep=True), fits, columns)["forest"].trees()
    held = rows.sparkSession.sparkContext.broadcast(model.write())
    goals = list(quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = trees.Model.read(held.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = at_quantiles(forest.spread(x), forest.leaf_edges, goals) if batch.num_rows else np.zeros((0, len(goals)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(len(goals))]],
                                             [key, *names])

    names = [f"q{int(round(q * 100)):02d}" for q in quantiles]
    return rows.filter(test).select(F.col(key).cast("long").alias(key), clean(columns).alias("x")).mapInArrow(
        run, f"`{key}` long, " + ", ".join(f"{n} double" for n in names))


def at_quantiles(mass: np.ndarray, edges: np.ndarray, goals: list[float]) -> np.ndarray:
    """Rows x goals: linear inside the bin in which the cumulative weight reaches the goal."""
    total = np.cumsum(mass, axis=1)
    out = np.empty((len(mass), len(goals)))
    at = np.arange(len(mass))
    for k, q in enumerate(goals):
        goal = q * total[:, -1]
        place = np.minimum((total < (goal - 1e-12)[:, None]).sum(axis=1), mass.shape[1] - 1)
        inside = (goal - (total[at, place] - mass[at, place])) / np.maximum(mass[at, place], 1e-300)
        out[:, k] = edges[place] + np.clip(inside, 0.0, 1.0) * (edges[place + 1] - edges[place])
    return out
