"""Run registered queries beside their SQL twins: ``python tests/compare.py SF [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(df, con, sql):
    """Empty text when both sides agree exactly, else the first difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} | {bad[0][1]}", len(got)
    return "", len(got)


def main():
    import __spark_entry__ as contract
    from tremorframe.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                          spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                message, count = compare(df, con, oracles[name])
            else:
                message, count = "", len(df.collect())
        except Exception as error:  # report and go on with the next query
            message, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if not message and count else 'FAIL'} {kind} {name} rows={count} {time.time() - start:.1f}s {message}",
              flush=True)


if __name__ == "__main__":
    main()
