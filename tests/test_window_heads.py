"""The window queries run every head for all windows, kinds and folds, on rate features too."""

import os

import pytest
from pyspark.sql import functions as F

from tremorframe.plans import learning

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def calls(monkeypatch):
    """heads.oof_window without its fits: the validation rows of each fold with constant predictions."""
    made = []

    def oof_window(table, window, folds, width, kinds=("boosted", "forest"), params=None):
        made.append((window, len(folds), tuple(kinds)))
        out = None
        for fold in folds:
            part = fold.valid(table).withColumns({
                **{f"mag_{k}": F.lit(5.0) for k in kinds}, **{f"hours_{k}": F.lit(10.0) for k in kinds},
                "hours_bucket": F.lit(12.0), "extreme_prob": F.lit(0.1), "window": F.lit(window), "fold": F.lit(fold.fold)})
            out = part if out is None else out.unionByName(part)
        return out

    monkeypatch.setattr(learning.heads, "oof_window", oof_window)
    return made


@pytest.fixture(scope="module")
def trained(spark):
    return learning._training_table(spark, SF)


@pytest.mark.parametrize("name", ["oof_buckets", "decoupled_predictions", "single_horizon_predictions"])
def test_all_windows_kinds_and_folds(spark, calls, trained, monkeypatch, name):
    monkeypatch.setattr(learning, "_training_table", lambda *a, **b: trained)
    rows = learning.QUERIES[name](spark, SF).collect()
    windows = ["H168"] if name.startswith("single") else ["T1", "T2", "T3"]
    assert calls == [(w, 5, ("boosted", "forest")) for w in windows]
    n = trained.count() // 6 * 5
    assert len(rows) == n * len(windows)
    if "window" in rows[0].asDict():
        assert {w: sum(r.window == w for r in rows) for w in windows} == {w: n for w in windows}


def test_models_of_the_last_window_see_the_rates(trained):
    columns = learning.heads.window_table(trained, "T3")[1]
    assert {"omori_p", "etas_mu"} <= set(columns)
    assert not any(c.startswith(("omori_", "etas_")) for w in ("T1", "T2") for c in learning.heads.window_table(trained, w)[1])
