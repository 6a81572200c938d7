"""Histogram trees against a plain booster, numeric derivatives, and both ways to spread the work."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tremorframe.models import boosting, trees


def plain_boost(x, y, rounds, depth, rate, least, l1, l2, gain):
    """Exact greedy boosting by loops over all values: no histograms, levels or subtraction."""
    pred = np.full(len(y), np.rint(y.sum() * trees.GRID) / trees.GRID / len(y))

    def score(g, n):
        return (np.sign(g) * max(abs(g) - l1, 0)) ** 2 / (n + l2)

    def grow(rows, level):
        total = grad[rows].sum()
        best = (max(2 * gain, 1e-9), None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    low = rows[x[rows, f] <= cut]
                    if min(len(low), len(rows) - len(low)) < least:
                        continue
                    g = grad[low].sum()
                    gained = score(g, len(low)) + score(total - g, len(rows) - len(low)) - score(total, len(rows))
                    if gained > best[0]:
                        best = (gained, (f, cut))
        if best[1] is None:
            step[rows] = -np.sign(total) * max(abs(total) - l1, 0) / (len(rows) + l2) * rate
            return
        f, cut = best[1]
        grow(rows[x[rows, f] <= cut], level + 1)
        grow(rows[x[rows, f] > cut], level + 1)

    for _ in range(rounds):
        grad = np.rint((pred - y) * trees.GRID) / trees.GRID
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        pred = pred + step
    return pred


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 20, 200), rng.integers(0, 9, 200), rng.normal(size=200).round(1)]).astype(float)
    y = x[:, 0] / 4 + np.where(x[:, 1] > 4, 2.0, 0.0) * x[:, 2] + rng.normal(size=200) * 0.1
    edges = [np.unique(x[:, k]) for k in range(3)]
    return x, y, edges, trees.coded(x, edges)


WHOLE = {"row_share": 1.0, "column_share": 1.0}


def test_equals_a_plain_booster(data):
    x, y, edges, codes = data
    size = trees.Size(rounds=25, depth=4, rate=0.1, least=5, **WHOLE)
    (model, scores), = trees.fit(codes, np.arange(200), edges, [trees.Work("squared", size, y, np.ones(200))])
    want = plain_boost(x, y, 25, 4, 0.1, 5, size.l1, size.l2, size.gain)
    assert np.allclose(scores[:, 0], want, atol=1e-9)
    assert np.allclose(trees.Model.read(model.write()).predict(x)[:, 0], scores[:, 0])


@pytest.mark.parametrize("objective", ["squared", "late", "logistic", "classes"])
def test_gradients_are_derivatives_and_loss_falls(data, objective):
    _, y, edges, codes = data
    labels = {"squared": y, "late": np.log1p(np.abs(y)), "logistic": (y > 2).astype(float), "classes": np.clip(np.round(y), 0, 3)}[objective]
    classes = 4 if objective == "classes" else 1

    def loss(raw):
        if objective == "logistic":
            return np.log1p(np.exp(raw[:, 0])) - labels * raw[:, 0]
        if objective == "classes":
            return np.log(np.exp(raw).sum(axis=1)) - raw[np.arange(len(raw)), labels.astype(int)]
        if objective == "late":
            error = np.expm1(raw[:, 0]) - np.expm1(labels)
            return np.where(error > 0, 2.0, 1.0) * error ** 2
        return (raw[:, 0] - labels) ** 2 / 2

    raw = np.random.default_rng(1).normal(size=(200, classes)) * 0.3 + 0.5
    g, h = trees.gradients(objective, labels, raw)
    assert (h > 0).all()
    for k in range(classes):
        step = np.zeros_like(raw)
        step[:, k] = 1e-6
        assert np.allclose(g[:, k], (loss(raw + step) - loss(raw - step)) / 2e-6, rtol=1e-4, atol=1e-4)
    seen = []
    for rounds in (1, 5, 10, 20, 40):
        size = trees.Size(rounds=rounds, depth=3, rate=0.1, gain=0.0, l1=0.0, **WHOLE)
        (model, out), = trees.fit(codes, np.arange(200), edges, [trees.Work(objective, size, labels, np.ones(200), classes)])
        raw = np.log(np.maximum(out, 1e-12)) if objective == "classes" else np.log(out / (1 - out)) if objective == "logistic" else out
        seen.append(loss(raw).mean())
    assert all(b < a + 1e-12 for a, b in zip(seen, seen[1:]))


def test_late_errors_weigh_more(data):
    _, y, edges, codes = data
    labels, rng = np.log1p(np.abs(y)), np.random.default_rng(2)
    labels = np.maximum(labels + rng.normal(size=200) * 0.5, 0)
    size = trees.Size(rounds=60, depth=2, rate=0.1, **WHOLE)
    late = {}
    for weight in (1.0, 8.0):
        (_, out), = trees.fit(codes, np.arange(200), edges, [trees.Work("late", size, labels, np.ones(200), late_weight=weight)])
        late[weight] = (out[:, 0] > labels).mean()
    assert late[8.0] < late[1.0]


def test_classes_and_constants(data):
    _, y, edges, codes = data
    size = trees.Size(rounds=5, depth=2, rate=0.3, **WHOLE)
    labels = np.where(y > 2, 2.0, 0.0)
    (_, out), = trees.fit(codes, np.arange(200), edges, [trees.Work("classes", size, labels, np.ones(200), 4)])
    assert (out[:, [1, 3]] == 0).all() and np.allclose(out.sum(axis=1), 1) and ((out[:, 2] > 0.5) == (labels == 2)).mean() > 0.8
    for value in (0.0, 1.0):
        (model, out), = trees.fit(codes, np.arange(200), edges, [trees.Work("logistic", size, np.full(200, value), np.ones(200))])
        assert (out == value).all() and (trees.Model.read(model.write()).predict(np.zeros((2, 3))) == value).all()
    (_, out), = trees.fit(codes[:0], np.arange(0), edges, [trees.Work("squared", size, y[:0], y[:0])])
    assert out.shape == (0, 1)


def test_forest_counts_its_leaves(data):
    x, y, edges, codes = data
    size = trees.Size(rounds=20, depth=4, bagged=True, node_columns=0.5, least=1, **WHOLE)
    ends = np.quantile(y, [0, 0.25, 0.5, 0.75, 1])
    (model, out), = trees.fit(codes, np.arange(200), edges, [trees.Work("squared", size, y, np.ones(200), leaf_edges=ends)])
    again = trees.Model.read(model.write())
    assert np.allclose(again.predict(x), out) and np.corrcoef(out[:, 0], y)[0, 1] > 0.9
    assert np.allclose(again.spread(x).sum(axis=1), 1)
    assert sum(c[:, 2].sum() for c in again.counts) == 20 * 200  # every training row is in one leaf of each tree


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.hash("id") % 10).cast("double").alias("z")).withColumns(
        {"y": F.col("x") * 2 + F.col("z"), "c": F.col("id") % 3}).cache()


def some_fits():
    small = trees.Size(rounds=3, depth=2)
    forest = trees.Size(rounds=11, depth=2, bagged=True, column_share=1.0, node_columns=0.5, least=1)
    return [boosting.Fit("a", F.col("id") < 200, F.col("y"), F.col("id") >= 200, size=small),
            boosting.Fit("a", F.col("id") >= 100, F.col("y"), F.col("id") < 100, size=small),
            boosting.Fit("p", F.col("id") < 200, F.col("c"), F.col("id") >= 150, objective="classes", classes=4, size=small),
            boosting.Fit("f", F.lit(True), F.col("y"), F.lit(True), size=forest, leaf_edges=np.array([-9.0, 5.0, 20.0, 50.0]))]


def test_dealt_rows_give_the_same_trees(table, monkeypatch):
    alone = boosting.fit_all(table, "id", ["x", "z"], some_fits(), keep=True).orderBy("fit", "key").collect()
    monkeypatch.setattr(boosting, "WAVE", 2)  # two barrier stages
    dealt = boosting.fit_all(table, "id", ["x", "z"], some_fits(), keep=True, shard_rows=160).orderBy("fit", "key").collect()
    assert alone == dealt and len(alone) == 100 + 100 + 150 + 300 + 4


def test_scores_fill_one_column_and_models_save(spark, table, tmp_path):
    fits = some_fits()
    found = boosting.fit_all(table, "id", ["x", "z"], fits, keep=True)
    rows = {r.key: r for r in boosting.scores_by_key(found, fits).collect()}
    assert rows[50].a is not None and rows[150].a is None and rows[250].a is not None and len(rows[160].p) == 4 and rows[5].p is None
    PipelineModel([boosting.models_of(found, fits, ["x", "z"])["f"]]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(table).collect()
    assert all(r.f == rows[r.id].f for r in again)
    missing = PipelineModel.load(str(tmp_path / "m")).transform(table.limit(1).withColumn("x", F.lit(None).cast("double"))).first()
    assert missing.f is not None  # as zero


def test_dealt_levels_do_not_wait_for_gathers(table):
    """120 levels: a gather of a barrier stage takes a second each."""
    import time

    size = trees.Size(rounds=40, depth=3, gain=0.0)
    fits = [boosting.Fit("a", F.lit(True), F.col("y"), F.lit(True), size=size)]
    alone = boosting.fit_all(table, "id", ["x", "z"], fits).orderBy("key").collect()
    begun = time.monotonic()
    dealt = boosting.fit_all(table, "id", ["x", "z"], fits, shard_rows=100).orderBy("key").collect()
    assert alone == dealt and time.monotonic() - begun < 60


def test_shared_files_sum_the_parts_of_all_tasks(tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(boosting, "PIECES", 10)

    def task(me):
        total = boosting._Shared(str(tmp_path), me, 3)
        return [total(np.arange(n) * 2.0 ** me) for n in (4, 25, 1, 0, 11)]

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(task, range(3)))
    for parts in found:
        assert all((p == np.arange(n) * 7.0).all() and len(p) == n for p, n in zip(parts, (4, 25, 1, 0, 11)))


def test_without_a_shared_folder_the_gathers_give_the_same(table, monkeypatch):
    fits = some_fits()[:2]
    shared = boosting.fit_all(table, "id", ["x", "z"], fits, shard_rows=160).orderBy("fit", "key").collect()
    monkeypatch.setattr(boosting, "urlparse", lambda path: __import__("urllib.parse").parse.urlparse("hdfs://far" + path[5:]))
    assert boosting.fit_all(table, "id", ["x", "z"], fits, shard_rows=160).orderBy("fit", "key").collect() == shared


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_one_sum_for_both_derivatives_is_exact(kind, monkeypatch):
    """Rows over several chunks, deep trees and few rows in range: as with separate sums."""
    rng = np.random.default_rng(3)
    n = 5000
    codes, edges = rng.integers(0, 30, (n, 4)).astype(np.uint8), [np.arange(29.0)] * 4
    y = np.where(np.arange(n) < 3000, codes[:, 0] * 0.3 + rng.normal(size=n), np.nan)
    size = trees.Size(rounds=6, depth=9, gain=0.0, least=1.0, bagged=kind == "forest", node_columns=0.5 if kind == "forest" else 1.0)
    active = (np.arange(n) >= 500) & (np.arange(n) < 4000)

    def run(chunk, work):
        monkeypatch.setattr(trees, "CHUNK", chunk)
        (model, scores), = trees.fit(codes, np.arange(n), edges, [work])
        return model.write(), scores[:4000]

    whole = run(1 << 15, trees.Work("squared", size, y, None))
    small = run(256, trees.Work("squared", size, y, np.ones(n), active=active))
    monkeypatch.setattr(trees._Tree, "_pack", lambda t: setattr(t, "h", t.mask.astype(float) if t.h is None else t.h.astype(float)))
    plain = run(1 << 15, trees.Work("squared", size, y, np.ones(n)))
    assert whole[0] == small[0] == plain[0]
    assert (whole[1] == plain[1]).all() and (whole[1] == small[1]).all()


def test_columns_with_the_same_bins_are_summed_once(data, monkeypatch):
    x, y, edges, codes = data
    wide, many = codes[:, [0, 1, 0, 2, 1, 0]], [edges[k] for k in (0, 1, 0, 2, 1, 0)]
    assert trees.twins(np.ascontiguousarray(wide.T)).tolist() == [0, 1, 0, 3, 1, 0]
    works = [trees.Work(objective, trees.Size(rounds=6, depth=4, node_columns=0.6, bagged=bagged), labels, weights, classes)
             for objective, bagged, labels, weights, classes in (
                 ("squared", False, y, None, 1), ("squared", True, y, None, 1), ("logistic", False, (y > 2).astype(float), np.where(y > 2, 1.3, 0.7), 1),
                 ("classes", False, np.clip(np.round(y), 0, 3), None, 4))]
    summed = []
    count = np.bincount
    monkeypatch.setattr(trees.np, "bincount", lambda *a: summed.append(1) or count(*a))
    once = trees.fit(wide, np.arange(200), many, works)
    fewer = len(summed)
    monkeypatch.setattr(trees, "twins", lambda lines: np.arange(len(lines)))
    each = trees.fit(wide, np.arange(200), many, works)
    assert fewer < 0.8 * (len(summed) - fewer)
    assert all((a == b).all() and m.write() == n.write() for (m, a), (n, b) in zip(once, each))


def test_models_with_most_rows_and_trees_start_first(spark):
    df = spark.range(100).withColumns({"row_index": F.col("id"), "a": F.rand(1), "y": F.rand(2)})
    fits = [boosting.Fit("old", F.col("id") < 20, F.col("y"), F.col("id") >= 90, size=trees.Size(rounds=3)),
            boosting.Fit("new", F.col("id") < 80, F.col("y"), F.col("id") >= 90, size=trees.Size(rounds=3)),
            boosting.Fit("classes", F.col("id") < 80, (F.col("y") > 0.5).cast("int"), F.col("id") >= 90, objective="classes", classes=4, size=trees.Size(rounds=3))]
    assert boosting._by_cost(df, fits) == (100, [2, 1, 0])
    tables = [boosting._table(df, "row_index", boosting.clean(["a"]), fits, [2, 1, 0])]
    coded = boosting._coded(tables[0], boosting.bin_edges(df, ["a"]))
    assert coded.schema["x"].dataType.typeName() == "binary" and coded.agg(F.max(F.length("x"))).first()[0] == 1
    found = boosting.fit_all(df, "row_index", ["a"], fits, keep=True)
    assert {(r["fit"], r["count"]) for r in found.groupBy("fit").count().collect()} == {(0, 11), (1, 11), (2, 11)}


def test_sums_may_be_asked_for_a_step_later(tmp_path, monkeypatch):
    """Two steps are on their way at a time, over many steps, also when sums are made in pieces."""
    from concurrent.futures import ThreadPoolExecutor

    def task(me):
        shared, found, open_ = boosting._Shared(str(tmp_path / str(boosting.PIECES)), me, 3), [], []
        for step in range(60):
            open_.append(shared.post(np.arange(1 + step % 7) * 2.0 ** me + step))
            if len(open_) == 2:
                found.append(open_.pop(0)())
        return found + [open_.pop()()]

    for pieces in (5, 1 << 19):
        monkeypatch.setattr(boosting, "PIECES", pieces)
        (tmp_path / str(pieces)).mkdir()
        with ThreadPoolExecutor(3) as pool:
            for found in pool.map(task, range(3)):
                assert all((p == np.arange(1 + step % 7) * 7.0 + 3 * step).all() for step, p in enumerate(found)) and len(found) == 60


def test_rows_are_counted_while_other_sums_are_on_their_way(data):
    """Models in two groups: each hands in its level before the sums of the other are asked for. The trees are those of each model alone."""
    _, y, edges, codes = data
    log = []

    def add(parts):  # the totals of the labels, once
        return parts

    def post(parts):
        log.append("post")
        return lambda: log.append("sum") or parts

    add.post = post
    works = [trees.Work("squared", trees.Size(rounds=4, depth=3, bagged=k % 2 == 1), y * (1 + k), None) for k in range(4)]
    together = trees.fit(codes, np.arange(200), edges, works, add)
    assert log[:6] == ["post", "post", "sum", "post", "sum", "post"]
    for work, (model, scores) in zip(works, together):
        (alone, same), = trees.fit(codes, np.arange(200), edges, [work])
        assert model.write() == alone.write() and (scores == same).all()


def test_models_of_one_seed_share_their_draws(data, monkeypatch):
    _, y, edges, codes = data
    calls, hashed = [], trees._hashed
    monkeypatch.setattr(trees, "_hashed", lambda *a: calls.append(1) or hashed(*a))
    sizes = (trees.Size(rounds=5, depth=2), trees.Size(rounds=5, depth=2, bagged=True))
    trees.fit(codes, np.arange(200), edges, [trees.Work("squared", sizes[k % 2], y + k, None) for k in range(8)])
    assert len(calls) == 10  # five steps of either way, not eight models of five


def test_rows_in_files_give_the_same_trees(table, data, monkeypatch):
    """A task whose rows outgrow HELD_BYTES keeps them in files: over several stretches, for every objective and both kinds."""
    x, y, edges, codes = data
    monkeypatch.setattr(trees, "CHUNK", 32)
    monkeypatch.setattr(trees.Room, "EVERY", 1)
    labels = np.where(np.arange(200) < 150, y, np.nan)
    works = [trees.Work(objective, trees.Size(rounds=4, depth=depth, bagged=bagged, row_share=share), found, weights, classes, leaf_edges=ends, active=np.arange(200) >= 120)
             for objective, bagged, found, weights, classes, ends, share, depth in (
                 ("squared", False, labels, None, 1, None, 0.8, 5), ("squared", False, labels, None, 1, None, 1.0, 2), ("late", False, np.log1p(np.abs(labels)), None, 1, None, 0.8, 9),
                 ("squared", True, labels, None, 1, np.quantile(y, [0, 0.5, 1]), 1.0, 5), ("squared", True, labels, np.where(y > 2, 1.5, 0.5), 1, None, 1.0, 3),
                 ("classes", False, np.where(np.isnan(labels), np.nan, np.clip(np.round(y), 0, 3)), None, 4, None, 0.8, 3))]
    held = trees.fit(codes, np.arange(200), edges, works)
    room = trees.Room(tempfile.gettempdir())
    filed = trees.fit(codes, np.arange(200), edges, works, room=room)
    assert all(m.write() == n.write() and (a[120:] == b[120:]).all() for (m, a), (n, b) in zip(held, filed))
    pages = len(room.maps)
    trees.fit(codes, np.arange(200), edges, [trees.Work("squared", trees.Size(rounds=40, depth=3), y, None)], room=room)
    assert len(room.maps) - pages < 20  # rounds take what earlier ones gave back
    alone = boosting.fit_all(table, "id", ["x", "z"], some_fits(), keep=True).orderBy("fit", "key").collect()
    monkeypatch.setattr(boosting, "HELD_BYTES", 0)
    assert boosting.fit_all(table, "id", ["x", "z"], some_fits(), keep=True, shard_rows=160).orderBy("fit", "key").collect() == alone


@pytest.mark.parametrize("bagged", [False, True])
def test_cuts_weighed_in_blocks_of_nodes_are_the_same(data, monkeypatch, bagged):
    _, y, edges, codes = data
    work = trees.Work("squared", trees.Size(rounds=5, depth=6, gain=0.0, bagged=bagged, node_columns=0.6), y, None)
    (whole, scores), = trees.fit(codes, np.arange(200), edges, [work])
    monkeypatch.setattr(trees, "CELLS", 1)
    (blocks, same), = trees.fit(codes, np.arange(200), edges, [work])
    assert whole.write() == blocks.write() and (scores == same).all()
