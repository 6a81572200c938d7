"""Whitening against NumPy on the distinct vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w int, copies string, n double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "c", 2.0) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]


def random_rows(rng, n, dim):
    base = [[rng.gauss(0, 1 + d) for d in range(dim)] for _ in range(n)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(n + i, rng.choice(base[:5])) for i in range(n)]  # copies
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_numpy(spark, weights):
    rows = random_rows(random.Random(1), 120, 6)
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (None, rows[0][1]),
             (905, [1.0, 2.0])]
    kept = [(i, x) for i, x in usable(rows) if len(x) == 6]
    names = [x for _, x in kept]
    distinct = sorted(set(names))
    w = np.array([names.count(x) if weights == "count" else 1 for x in distinct])
    n, x = int(w.sum()), np.array(distinct)
    sums = (x * w[:, None]).sum(axis=0)
    centred = x - sums / n
    v = centred.T @ (centred * w[:, None]) / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    vectors = table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "x", "n")
    got = whitening.whiten(vectors, weights).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    exact = dict(kept)
    signs = None
    for r in got:
        place = np.array(exact[r.id])
        assert (r.n, r.copies, r.deviation) == (n, names.count(exact[r.id]), int(((n * place - sums) ** 2).sum()))
        want = (place - sums / n) @ basis[:, :4] / np.sqrt(values[:4])
        signs = np.sign(want * np.array(r.whitened)) if signs is None else signs
        assert np.allclose(want * signs, r.whitened, atol=1e-9)
        assert np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9) and r.identity_error < 1e-9


def test_query(spark, tmp_path):
    rows = random_rows(random.Random(2), 60, 5)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in rows for c in (1, 2, 3, 4))
    same = {(r.component, r.whitened) for r in got if r.vec_id in {i for i, v in rows if v == rows[0][1]}}
    assert len(same) == 4  # copies of a vector have equal values


def test_no_rows_one_vector_and_flat_dimensions(spark):
    def whiten(rows):
        return whitening.whiten(table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).collect()

    assert whiten([]) == [] and whiten([(1, None)]) == []
    one = whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 2
    flat = whiten([(1, [1.0, 2.0]), (2, [3.0, 2.0])])
    assert sorted(r.whitened[0] for r in flat) == pytest.approx([-1, 1]) and all(r.whitened[1] is None and r.explained == [1.0, 0.0] for r in flat)


def test_deviation_is_exact_beyond_double_precision_and_null_beyond_long(spark):
    rows = [(1, [2.0**20, 0.0]), (2, [-2.0**20 + 1, 1.0]), (3, [3.0, 5.0])]
    x = dict(usable(rows))
    n, sums = 3, [sum(v[d] for v in x.values()) for d in range(2)]
    got = whitening.whiten(table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).collect()
    assert {r.id: r.deviation for r in got} == {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    far = whitening.whiten(table(spark, [(1, [2.0**40]), (2, [0.0])]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).collect()
    assert [r.deviation for r in far] == [None, None] and all(abs(abs(r.whitened[0]) - 1) < 1e-9 for r in far)


def test_hot_vectors_are_broadcast_and_the_rest_merged(spark):
    rows = [(i, [1.0, 2.0] if i % 2 else [float(i), 0.0]) for i in range(400)]
    gridded = whitening.on_grid(table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    values = whitening.distinct_vectors(gridded).withColumn("mark", F.size("x"))
    joined = whitening.join_back(gridded, values)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert sorted(r.id for r in joined.collect()) == list(range(400))
