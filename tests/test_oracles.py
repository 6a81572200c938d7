"""Every registered query at the smallest scale: equal to its SQL twin, or at least runnable."""

import math
import os
import re

import pytest

import __spark_entry__ as contract
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    message, _ = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not message


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline", n)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    assert all(r[c] is None or math.isfinite(r[c]) for r in rows for c in numbers)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
