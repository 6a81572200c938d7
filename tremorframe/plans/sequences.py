"""Queries: catalog, pairs, labels, sequences, declustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorframe.constants import GK_OTHER, GK_WINDOWS, TIME_BUCKETS, WINDOWS
from tremorframe.operators import labels as lab
from tremorframe.operators import sequences as seq
from tremorframe.operators.spatial_join import first_by_time, interval_pairs
from tremorframe.plans.inputs import BASE_SQL, CATALOG_SQL, catalog, hav_sql, log_moment, pairs_sql, rounded

US = "unix_micros(mainshock_time)"


def _main(spark, sf):
    return seq.mainshocks(catalog(spark, sf))


def _keys(df):
    """Replace the timestamp by epoch microseconds for comparison across engines."""
    return df.withColumn("mainshock_time", F.unix_micros("mainshock_time")).withColumnRenamed(
        "mainshock_time", "mainshock_us")


def catalog_view(spark, sf):
    return catalog(spark, sf).select("id", F.unix_micros("time").alias("time_us"), "latitude", "longitude",
                                     "depth", "mag")


def mainshocks(spark, sf):
    return _keys(_main(spark, sf))


def sequence_mainshock(spark, sf):
    """Mainshock of each place: one landed sequence per location."""
    events = catalog(spark, sf).withColumn("sequence_id", F.concat_ws("_", "latitude", "longitude"))
    return _keys(seq.sequence_mainshock(events)).drop("sequence_id")


def aftershock_pairs(spark, sf):
    pairs = interval_pairs(_main(spark, sf), catalog(spark, sf), after_seconds=168 * 3600)
    return rounded(pairs.select("mainshock_id", "id", "distance_km", "elapsed_hours", "mag"))


def early_events_capped(spark, sf):
    pairs = interval_pairs(_main(spark, sf), catalog(spark, sf), after_seconds=72 * 3600)
    return first_by_time(pairs, 256).select("mainshock_id", "id", F.col("position").cast("bigint").alias("position"))


def window_labels(spark, sf):
    out = lab.window_labels(_main(spark, sf), catalog(spark, sf))
    return rounded(_keys(out))


def _labels(spark, sf):
    return lab.window_labels(_main(spark, sf), catalog(spark, sf))


def h168_labels(spark, sf):
    return rounded(lab.single_horizon_labels(_labels(spark, sf)).select(
        "mainshock_id", "target_H168_max_mag", "target_H168_time_to_max_hours", "has_H168_aftershock"))


def extreme_labels(spark, sf):
    long_df = lab.long_windows(_labels(spark, sf), ["mainshock_id", "mainshock_mag"])
    main, mag = F.col("mainshock_mag"), F.col("true_mag")
    return long_df.select("mainshock_id", "window", lab.extreme_flag(mag, main).alias("extreme"),
                          lab.risk_flag(mag, main).alias("risk"))


def time_bucket_labels(spark, sf):
    long_df = lab.long_windows(_labels(spark, sf), ["mainshock_id"])
    return lab.with_time_buckets(long_df).select(
        "mainshock_id", "window", F.col("time_bucket").cast("bigint").alias("time_bucket"))


def positive_rate(spark, sf):
    """Share of mainshocks with any event in (3 d, 30 d]: the label of the gate."""
    truth = seq.holdout_truth(_main(spark, sf), catalog(spark, sf))
    labelled = lab.positive_label(truth.withColumn("has_target_aftershock", F.col("true_max_mag") > 0))
    return labelled.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("positive_rate"))


def sequences_30d(spark, sf):
    out = log_moment(seq.build_sequences(catalog(spark, sf)), "early_energy_sum")
    return rounded(_keys(out))


def samples_168h(spark, sf):
    return rounded(_keys(seq.build_window_samples(catalog(spark, sf))))


def decluster_gk(spark, sf):
    return seq.decluster(catalog(spark, sf)).select("id", "mag", "is_background")


def gk_windows(spark, sf):
    """Reach of every event under the declustering table."""
    from tremorframe.functions.seismic import gk_days, gk_km

    mag = F.col("mag")
    return catalog(spark, sf).select("id", gk_days(mag).alias("gk_days"), gk_km(mag).alias("gk_km"))


def holdout_truth(spark, sf):
    truth = seq.holdout_truth(_main(spark, sf), catalog(spark, sf))
    return rounded(truth.select("mainshock_id", "mainshock_mag", "true_max_mag", "true_time_to_max_days"))


QUERIES = {
    f.__name__: f for f in (
        catalog_view, mainshocks, sequence_mainshock, aftershock_pairs, early_events_capped, window_labels,
        h168_labels, extreme_labels, time_bucket_labels, positive_rate, sequences_30d, samples_168h,
        decluster_gk, gk_windows, holdout_truth,
    )
}

MAIN_OUT = "mainshock_id, t0 AS mainshock_us, lat0 AS mainshock_lat, lon0 AS mainshock_lon, m0 AS mainshock_mag, d0 AS mainshock_depth"


def _window_columns(alias: str = "") -> str:
    out = []
    for w, (lo, hi) in WINDOWS.items():
        out.append(f"coalesce(b_{w}.mag, 0.0) AS target_{w}_max_mag")
        out.append(f"coalesce(b_{w}.hours, {(lo + hi) / 2}) AS target_{w}_time_to_max_hours")
        out.append(f"b_{w} IS NOT NULL AS has_{w}_aftershock")
    return ", ".join(out)


def labels_sql(main: str = "main") -> str:
    best = ", ".join(
        f"arg_min(struct_pack(mag := mag, hours := elapsed_hours), struct_pack(a := -mag, b := elapsed_us)) "
        f"FILTER (elapsed_hours > {lo} AND elapsed_hours <= {hi}) AS b_{w}" for w, (lo, hi) in WINDOWS.items())
    return f"""
{pairs_sql(168, 'pairs168', main)},
best AS (SELECT mainshock_id, {best} FROM pairs168 GROUP BY mainshock_id),
labels_wide AS (
  SELECT m.*, {_window_columns()} FROM {main} m LEFT JOIN best USING (mainshock_id)
)"""


def long_sql() -> str:
    return ",\nlong_labels AS (" + " UNION ALL ".join(
        f"SELECT mainshock_id, m0, '{w}' AS \"window\", target_{w}_max_mag AS true_mag, "
        f"target_{w}_time_to_max_hours AS true_hours FROM labels_wide" for w in WINDOWS) + ")"


LABEL_OUT = ", ".join(
    f"round(target_{w}_max_mag, 6) AS target_{w}_max_mag, "
    f"round(target_{w}_time_to_max_hours, 6) AS target_{w}_time_to_max_hours, has_{w}_aftershock" for w in WINDOWS)


def greedy_sql(nodes: str, order: str, reach_us: str, reach_km: str, extra: str = "") -> str:
    """Ordered recursion: step k settles the nodes of rank k and drops what they cover.

    The state of every node travels through the recursion, so no kept list is needed.
    """
    return f"""
ranked AS (SELECT *, dense_rank() OVER (ORDER BY {order}) AS rk FROM {nodes}),
walk AS (
  SELECT 0 AS step, id, us, latitude, longitude, mag, rk, TRUE AS alive FROM ranked
  UNION ALL
  SELECT w.step + 1, w.id, w.us, w.latitude, w.longitude, w.mag, w.rk,
         w.alive AND NOT EXISTS (
           SELECT 1 FROM walk p
           WHERE p.alive AND p.rk = w.step + 1 AND w.rk > p.rk AND w.us > p.us AND w.us <= p.us + {reach_us}
             AND abs(w.latitude - p.latitude) <= 5 {extra}
             AND {hav_sql('p.latitude', 'p.longitude', 'w.latitude', 'w.longitude')} <= {reach_km})
  FROM walk w WHERE w.step < (SELECT max(rk) FROM ranked)
),
settled AS (SELECT id, alive FROM walk WHERE step = (SELECT max(rk) FROM ranked))"""


def eligible_sql(hours: int, need_any: bool) -> str:
    any_event = f"""AND EXISTS (SELECT 1 FROM catalog e WHERE e.us > m.t0 AND e.us <= m.t0 + {hours * 3600}000000)""" if need_any else ""
    return f"""
{pairs_sql(hours, 'pairs_all')},
eligible AS (
  SELECT m.* FROM main m
  WHERE NOT EXISTS (SELECT 1 FROM pairs_all p WHERE p.mainshock_id = m.mainshock_id AND p.mag > m.m0) {any_event}
),
nodes AS (SELECT mainshock_id AS id, t0 AS us, lat0 AS latitude, lon0 AS longitude, m0 AS mag FROM eligible)"""


def _gk_case(position: int, alias: str = "") -> str:
    rows = " ".join(f"WHEN {alias}mag >= {r[0]} AND {alias}mag < {r[1]} THEN {r[position]}" for r in GK_WINDOWS)
    return f"CAST(CASE {rows} ELSE {GK_OTHER[position - 2]} END AS DOUBLE)"


def _bucket_case() -> str:
    rows = " ".join(
        f"WHEN \"window\" = '{w}' AND true_hours <= {hi} THEN {i}"
        for w, buckets in TIME_BUCKETS.items() for i, (_, hi) in enumerate(buckets[:3]))
    return f"CAST(CASE {rows} ELSE 3 END AS BIGINT)"


_TRUTH = f"""
{pairs_sql(720, 'pairs30')},
best30 AS (
  SELECT mainshock_id, arg_min(struct_pack(mag := mag, us := elapsed_us), struct_pack(a := -mag, b := elapsed_us)) AS b
  FROM pairs30 WHERE elapsed_us > 259200000000 GROUP BY mainshock_id
),
truth AS (
  SELECT m.mainshock_id, m.m0, coalesce(b.mag, 0.0) AS true_max_mag,
         coalesce((b.us - 259200000000) / 86400000000.0::DOUBLE, 0.0) AS true_days
  FROM main m LEFT JOIN best30 USING (mainshock_id)
)"""

ORACLES = {
    "catalog_view": f"WITH {CATALOG_SQL} SELECT id, us AS time_us, latitude, longitude, depth, mag FROM catalog",
    "mainshocks": f"WITH {BASE_SQL} SELECT {MAIN_OUT} FROM main",
    "sequence_mainshock": f"""WITH {CATALOG_SQL}
SELECT id AS mainshock_id, us AS mainshock_us, latitude AS mainshock_lat, longitude AS mainshock_lon,
       mag AS mainshock_mag, depth AS mainshock_depth
FROM catalog QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY mag DESC, us, id) = 1""",
    "aftershock_pairs": f"""WITH {BASE_SQL}, {pairs_sql(168)}
SELECT mainshock_id, id, round(distance_km, 6) AS distance_km, round(elapsed_hours, 6) AS elapsed_hours, mag FROM pairs""",
    "early_events_capped": f"""WITH {BASE_SQL}, {pairs_sql(72)}
SELECT mainshock_id, id, position FROM (
  SELECT mainshock_id, id, row_number() OVER (PARTITION BY mainshock_id ORDER BY us, id) AS position FROM pairs)
WHERE position <= 256""",
    "window_labels": f"WITH {BASE_SQL}, {labels_sql()} SELECT {MAIN_OUT}, {LABEL_OUT} FROM labels_wide",
    "h168_labels": f"""WITH {BASE_SQL}, {labels_sql()},
best_mag AS (SELECT *, greatest(target_T1_max_mag, target_T2_max_mag, target_T3_max_mag) AS bm FROM labels_wide)
SELECT mainshock_id, round(bm, 6) AS target_H168_max_mag,
       round(CASE WHEN bm > 0 THEN least(
         CASE WHEN target_T1_max_mag = bm THEN target_T1_time_to_max_hours ELSE 1e9 END,
         CASE WHEN target_T2_max_mag = bm THEN target_T2_time_to_max_hours ELSE 1e9 END,
         CASE WHEN target_T3_max_mag = bm THEN target_T3_time_to_max_hours ELSE 1e9 END) ELSE 84.0 END, 6)
         AS target_H168_time_to_max_hours,
       bm > 0 AS has_H168_aftershock
FROM best_mag""",
    "extreme_labels": f"""WITH {BASE_SQL}, {labels_sql()}{long_sql()}
SELECT mainshock_id, "window", true_mag > 0 AND true_mag >= m0 - 1.2::DOUBLE AS extreme,
       true_mag >= m0 - 2.0::DOUBLE OR true_mag >= 6.5 AS risk FROM long_labels""",
    "time_bucket_labels": f"""WITH {BASE_SQL}, {labels_sql()}{long_sql()}
SELECT mainshock_id, "window", {_bucket_case()} AS time_bucket FROM long_labels""",
    "positive_rate": f"""WITH {BASE_SQL}, {_TRUTH}
SELECT count(*) AS n, round(avg(CASE WHEN true_max_mag > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM truth""",
    "sequences_30d": f"""WITH RECURSIVE {BASE_SQL}, {eligible_sql(720, True)},
{greedy_sql('nodes', 'us, id', '2592000000000', '100.0')},
kept AS (SELECT e.* FROM eligible e JOIN settled s ON s.id = e.mainshock_id AND s.alive),
stats AS (
  SELECT mainshock_id,
    count(*) FILTER (elapsed_us <= 259200000000) AS n,
    max(mag) FILTER (elapsed_us <= 259200000000) AS mx,
    avg(mag) FILTER (elapsed_us <= 259200000000) AS av,
    sum(pow(10.0, 1.5 * mag + 4.8)) FILTER (elapsed_us <= 259200000000) AS en,
    arg_min(struct_pack(mag := mag, us := elapsed_us), struct_pack(a := -mag, b := elapsed_us, c := id))
      FILTER (elapsed_us > 259200000000) AS b
  FROM pairs_all GROUP BY mainshock_id)
SELECT {MAIN_OUT}, coalesce(n, 0) AS early_aftershock_count, coalesce(mx, 0.0) AS early_max_mag,
       round(coalesce(av, 0.0), 6) AS early_mean_mag, round(log10(coalesce(en, 0.0) + 1.0), 6) AS early_energy_sum,
       b IS NOT NULL AS has_target_aftershock, b.mag AS target_max_mag,
       round((b.us - 259200000000) / 86400000000.0::DOUBLE, 6) AS target_time_to_max_days
FROM kept LEFT JOIN stats USING (mainshock_id)""",
    "samples_168h": f"""WITH RECURSIVE {BASE_SQL}, {eligible_sql(168, False)},
{greedy_sql('nodes', 'us, id', '604800000000', '100.0')},
kept AS (SELECT e.* FROM eligible e JOIN settled s ON s.id = e.mainshock_id AND s.alive),
{labels_sql('kept')}
SELECT {MAIN_OUT}, {LABEL_OUT} FROM labels_wide""",
    "decluster_gk": f"""WITH RECURSIVE {CATALOG_SQL},
{greedy_sql('catalog', 'mag DESC', f"CAST({_gk_case(2, 'p.')} * 86400000000 AS BIGINT)", _gk_case(3, 'p.'))}
SELECT s.id, c.mag, s.alive AS is_background FROM settled s JOIN catalog c USING (id)""",
    "gk_windows": f"WITH {CATALOG_SQL} SELECT id, {_gk_case(2)} AS gk_days, {_gk_case(3)} AS gk_km FROM catalog",
    "holdout_truth": f"""WITH {BASE_SQL}, {_TRUTH}
SELECT mainshock_id, m0 AS mainshock_mag, true_max_mag, round(true_days, 6) AS true_time_to_max_days FROM truth""",
}
