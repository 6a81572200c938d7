"""Queries: estimators, feature tables, event features, reference joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremorframe.constants import BIN_HOURS, FEATURE_DEFAULTS, FEATURE_DEFAULTS_BY_PLATE
from tremorframe.functions import focal as foc
from tremorframe.functions.geo import haversine_km
from tremorframe.operators import estimators as est
from tremorframe.operators import event_features as ev
from tremorframe.operators import features as ft
from tremorframe.operators import imputation as imp
from tremorframe.operators import rates
from tremorframe.operators import reference as ref
from tremorframe.operators.sequences import mainshocks, sequence_mainshock
from tremorframe.operators.spatial_join import interval_pairs, live_pairs
from tremorframe.plans.inputs import BASE_SQL, catalog, hav_sql, log_moment, pairs_sql, rounded, table


def _main(spark, sf):
    return mainshocks(catalog(spark, sf))


def _pairs(spark, sf, *extra):
    keys = ["mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", *extra]
    return interval_pairs(_main(spark, sf).select(*keys), catalog(spark, sf), after_seconds=72 * 3600)


def _live_pairs(spark, sf):
    return live_pairs(_main(spark, sf).select("mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon"),
                      catalog(spark, sf).select("time", "latitude", "longitude", "mag"), after_seconds=72 * 3600)


def early_stats(spark, sf):
    return rounded(log_moment(est.early_stats(_pairs(spark, sf)), "early_energy_sum"))


def time_bins(spark, sf):
    energies = [f"energy_{h}h" for h in BIN_HOURS]
    return rounded(log_moment(est.time_bins(_pairs(spark, sf)), *energies))


def sub_windows(spark, sf):
    out = est.sub_windows(est.time_bins(_pairs(spark, sf)))
    return rounded(out.select("mainshock_id", "count_0_12h", "count_12_24h", "count_24_72h",
                              "decay_count_ratio_early_late", "decay_count_gradient", "decay_energy_gradient"))


def bath(spark, sf):
    stats = _main(spark, sf).join(est.early_stats(_pairs(spark, sf)), "mainshock_id", "left")
    return rounded(est.bath_features(stats).select("mainshock_id", "bath_deficit", "bath_early_max_mag", "bath_valid"))


def mc_maxc(spark, sf):
    return est.completeness_magnitude(_pairs(spark, sf))


def gr_b(spark, sf):
    return rounded(est.gutenberg_richter(_pairs(spark, sf)))


def productivity(spark, sf):
    fitted = est.gutenberg_richter(_pairs(spark, sf))
    out = est.productivity_index(_main(spark, sf).join(fitted, "mainshock_id"))
    return rounded(out.select("mainshock_id", "productivity_index"))


def anisotropy(spark, sf):
    """Axis ratio and azimuth only where the minor axis is above rounding noise."""
    out = est.anisotropy(_pairs(spark, sf))
    real = F.col("anisotropy_minor_axis_km") > 1e-3
    return rounded(out.withColumns({
        "anisotropy_minor_axis_km": F.round("anisotropy_minor_axis_km", 3),
        "anisotropy_axis_ratio": F.when(real, F.col("anisotropy_axis_ratio")),
        "anisotropy_azimuth_deg": F.when(real, F.col("anisotropy_azimuth_deg")),
    }))


def omori_grid(spark, sf):
    with _live_pairs(spark, sf) as pairs:
        return rounded(rates.omori_fit(pairs))


def etas_em(spark, sf):
    """Maximum likelihood at fixed decay p = 1, c = 0.05, so that the result does not hang on the Omori grid."""
    main = _main(spark, sf)
    decay = main.select("mainshock_id", F.lit(1.0).alias("omori_p"), F.lit(0.05).alias("omori_c"),
                        F.lit(True).alias("omori_valid"))
    with _live_pairs(spark, sf) as pairs:
        out = rates.etas_fit(pairs, main, decay, est.gutenberg_richter(pairs()))
    return rounded(out.select("mainshock_id", "etas_mu", "etas_amplitude", "etas_nll", "etas_n", "etas_valid",
                              "etas_branching_ratio", "etas_expected_count", "etas_triggered_fraction",
                              "etas_triggered_mag_sum", "etas_bg_rate_total"), 5)


def _event_features(spark, sf):
    return ev.event_features(_pairs(spark, sf, "mainshock_mag"))


def event_features(spark, sf):
    return rounded(_event_features(spark, sf).withColumn("position", F.col("position").cast("bigint")))


def event_graph_edges(spark, sf):
    return rounded(ev.graph_edges(_event_features(spark, sf)).select("mainshock_id", "src", "dst", "weight"))


def augmented_events(spark, sf):
    kept = ["mainshock_id", "id", "position", "dropped", "rel_x_km", "rel_y_km", "mag", "dt_days", "distance_km"]
    return rounded(ev.augmented(_event_features(spark, sf), seed=7).select(*kept))


def region_event_features(spark, sf):
    """Events after the largest one of their latitude belt: a few sequences that grow with the table."""
    events = catalog(spark, sf).withColumn("belt", F.floor(F.col("latitude") / 60))
    main = sequence_mainshock(events, "belt").drop("mainshock_depth")
    elapsed = F.unix_micros("time") - F.unix_micros("mainshock_time")
    met = events.join(F.broadcast(main), "belt").withColumns({  # a row for each of a few belts
        "elapsed_us": elapsed,
        "distance_km": haversine_km(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("latitude"), F.col("longitude"))})
    out = ev.event_features(met.filter("elapsed_us > 0"))
    return rounded(out.select("mainshock_id", "id", "position", "dt_days", "rel_x_km", "rel_y_km", "distance_km", "mag_diff",
                              "inter_event_interval_hours", "normalized_energy"))


def _features(spark, sf, with_rates=False):
    return ft.sequence_features(_main(spark, sf), catalog(spark, sf), with_rates=with_rates)


def sequence_features(spark, sf):
    """The whole feature table with Omori and ETAS columns."""
    return _features(spark, sf, True).drop("mainshock_time")


LEGAL_TEST = {
    "T1": ["mainshock_mag", "mainshock_depth", "count_obs_0h", "energy_obs_0h"],
    "T2": ["mainshock_mag", "early_aftershock_count", "count_obs_24h", "count_1h", "count_ratio_1h_obs",
           "count_rate_12h", "count_12_24h", "decay_count_gradient", "decay_energy_gradient",
           "obs_count_per_main_mag", "energy_ratio_6h_obs"],
    "T3": ["mainshock_mag", "early_max_mag", "early_aftershock_count", "count_72h", "count_ratio_24h_obs",
           "count_rate_72h", "count_12_24h", "decay_count_gradient", "obs_count_per_main_mag",
           "bath_deficit", "gr_b_value"],
}


def legal_features_t1(spark, sf):
    return rounded(ft.legal_features(_features(spark, sf), "T1").select("mainshock_id", *LEGAL_TEST["T1"]))


def legal_features_t2(spark, sf):
    return rounded(ft.legal_features(_features(spark, sf), "T2").select("mainshock_id", *LEGAL_TEST["T2"]))


def legal_features_t3(spark, sf):
    return rounded(ft.legal_features(_features(spark, sf), "T3").select("mainshock_id", *LEGAL_TEST["T3"]))


def legal_features_h168(spark, sf):
    return rounded(ft.legal_features(_features(spark, sf), "H168").select("mainshock_id", *LEGAL_TEST["T1"]))


DERIVED_TEST = ["mag_ratio_early_main", "mag_diff_main_early", "count_ratio_1h_72h", "count_ratio_24h_72h",
                "energy_ratio_24h_72h", "b_value_times_mag", "log_depth", "depth_mag_ratio",
                "productivity_per_event", "decay_count_ratio_early_late", "decay_count_gradient", "log_energy_sum"]


def derived_features(spark, sf):
    return rounded(ft.derived_features(_features(spark, sf)).select("mainshock_id", *DERIVED_TEST))


IMPUTED = ["gr_b_value", "gr_a_value", "gr_mc", "productivity_index", "etas_mu"]


def _with_plate(df):
    number = F.pmod(F.col("mainshock_id").cast("bigint"), F.lit(4)).cast("int") + 1
    return df.withColumn("nearest_plate_boundary_type", F.element_at(
        F.array(F.lit("SUB"), F.lit("OTF"), F.lit("OSR"), F.lit("UNK")), number))


def imputed_features(spark, sf):
    """Defaults by plate type and in general; ``mag_gap`` has no default and takes its median."""
    df = _with_plate(_features(spark, sf))
    df = df.withColumn("etas_mu", F.lit(None).cast("double")).withColumn(
        "mag_gap", F.when(F.col("mainshock_depth") < 50, F.col("mainshock_mag") - F.col("early_max_mag")))
    names = [*IMPUTED, "mag_gap"]
    out = imp.impute(df, names)
    return rounded(out.select("mainshock_id", *names, *[_flag(out, c, F.lit(0)) for c in names]))


def _flag(df, name, absent):
    """A missing flag exists only for columns with a null; the query always shows it."""
    flag = f"{name}_missing"
    return F.col(flag) if flag in df.columns else absent.alias(flag)


SCALED = ["mainshock_mag", "mainshock_depth", "gr_b_value", "early_mean_mag"]


def scaled_features(spark, sf):
    df = _features(spark, sf)
    fitted = imp.fit_preprocessor(df, SCALED)
    out = imp.apply_preprocessor(df, fitted, keep=["mainshock_id"])
    return rounded(out.select("mainshock_id", *SCALED, _flag(out, "gr_b_value", F.lit(0.0))))


def standard_scaled_features(spark, sf):
    df = _features(spark, sf)
    fitted = imp.fit_preprocessor(df, SCALED, kind="standard", indicators=False)
    return rounded(imp.apply_preprocessor(df, fitted, keep=["mainshock_id"]))


def feature_matrix(spark, sf):
    """Training-column matrix of the feature table; an absent column is NULL."""
    df = _features(spark, sf)
    columns = ["mainshock_mag", "early_aftershock_count", "bath_valid", "absent_column"]
    return ft.model_matrix(df, columns, keep=["mainshock_id"])


def focal_catalog(spark, sf):
    """A focal-mechanism catalog with a row per event, up to 90 s and 22 km off: some events find no row within a minute."""
    e = catalog(spark, sf).withColumn("n", F.col("id").cast("bigint"))
    n = F.col("n")

    def number(factor, modulus, shift=0.0):
        return F.pmod(n * factor, F.lit(modulus)).cast("double") + F.lit(shift)

    rake = number(11, 360, -180.0)
    shift_us = (F.pmod(n, F.lit(7)) - 3) * 30_000_000
    return e.select(
        F.timestamp_micros(F.unix_micros("time") + shift_us).alias("time"),
        (F.col("latitude") + (F.pmod(n, F.lit(5)) - 2) * F.lit(0.1)).alias("latitude"),
        (F.col("longitude") + (F.pmod(n, F.lit(4)) - 1) * F.lit(0.1)).alias("longitude"),
        F.when(F.pmod(n, F.lit(10)) != 0, number(7, 360)).alias("strike1"), number(3, 90).alias("dip1"),
        rake.alias("rake1"), number(13, 360).alias("strike2"), number(5, 90).alias("dip2"),
        number(17, 360, -180.0).alias("rake2"), number(2, 90).alias("plunge_P"), number(19, 360).alias("trend_P"),
        number(23, 90).alias("plunge_T"), number(29, 360).alias("trend_T"),
        (number(31, 100) / 100.0).alias("f_clvd"), foc.catalog_fault_code(rake).alias("fault_type"),
    )


FOCAL_OUT = ["strike1", "dip1", "rake1", "f_clvd"]


def focal_asof(spark, sf):
    out = ref.with_focal_asof(_main(spark, sf), focal_catalog(spark, sf))
    return rounded(out.select("mainshock_id", *FOCAL_OUT, "fault_type", "fault_type_Thrust", "fault_type_SS",
                              "fault_type_UNK", "gcmt_time_diff_seconds", "gcmt_distance_km",
                              "focal_mechanism_valid"))


def focal_nearest(spark, sf):
    out = ref.with_focal_nearest(_main(spark, sf), focal_catalog(spark, sf))
    return rounded(out.select("mainshock_id", *FOCAL_OUT, "fault_type_NF", "fault_type_SS", "fault_type_TF",
                              "fault_type_UNK", "focal_mechanism_valid"))


def fault_types(spark, sf):
    f = focal_catalog(spark, sf)
    kind = foc.fault_type(F.col("rake1"))
    return f.groupBy(kind.alias("fault_type"), foc.fault_code(kind).alias("short_code"),
                     F.col("fault_type").alias("catalog_code")).agg(F.count(F.lit(1)).alias("n"))


def boundary_segments(spark, sf):
    """Boundary segments derived from the supplier table."""
    k = F.col("s_suppkey")
    lat = F.lit(-62.0) + F.pmod(k * 37, F.lit(130))
    lon = F.lit(-178.0) + F.pmod(k * 53, F.lit(350))
    return table(spark, sf, "supplier").select(
        k.alias("segment_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("SUB", "OTF", "OSR", "CCB")]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
        .alias("plate_type"),
        lat.alias("lat1"), lon.alias("lon1"),
        (lat + (F.pmod(k, F.lit(9)) - 4)).alias("lat2"), (lon + (F.pmod(k, F.lit(7)) - 3)).alias("lon2"))


def nearest_boundary(spark, sf):
    out = ref.nearest_boundary(_main(spark, sf), boundary_segments(spark, sf))
    return rounded(out.select("mainshock_id", "plate_boundary_distance_km", "nearest_plate_boundary_type",
                              "plate_type_SUB", "plate_type_OTF", "plate_type_OSR", "plate_type_UNK"), 4)


QUERIES = {
    f.__name__: f for f in (
        early_stats, time_bins, sub_windows, bath, mc_maxc, gr_b, productivity, anisotropy, omori_grid, etas_em,
        event_features, event_graph_edges, augmented_events, region_event_features, sequence_features, legal_features_t1,
        legal_features_t2, legal_features_t3, legal_features_h168, derived_features, imputed_features,
        scaled_features, standard_scaled_features, feature_matrix, focal_asof, focal_nearest, fault_types,
        nearest_boundary,
    )
}

# --- SQL twins -------------------------------------------------------------------------------

PAIRS72 = f"{BASE_SQL}, {pairs_sql(72)}"
MOMENT = "pow(10.0, 1.5 * mag + 4.8)"

AGG = "agg AS (SELECT mainshock_id, count(*) AS n, max(mag) AS mx, avg(mag) AS av, " + f"sum({MOMENT}) AS en, " + ", ".join(
    f"count(*) FILTER (elapsed_hours <= {h}) AS c{h}, "
    f"coalesce(sum({MOMENT}) FILTER (elapsed_hours <= {h}), 0.0) AS e{h}" for h in BIN_HOURS
) + " FROM pairs GROUP BY mainshock_id)"

GR = f"""
hist AS (SELECT mainshock_id, round(mag, 1) AS b, count(*) AS c FROM pairs GROUP BY ALL),
mode AS (SELECT mainshock_id, arg_min(b, struct_pack(x := -c, y := b)) AS mc, sum(c) AS total FROM hist GROUP BY 1),
full_part AS (
  SELECT p.mainshock_id, any_value(mc) AS mc, any_value(total) AS total,
         count(*) FILTER (mag >= mc) AS nc, avg(mag) FILTER (mag >= mc) AS mean_mag
  FROM pairs p JOIN mode USING (mainshock_id) GROUP BY 1),
gr AS (
  SELECT *, total >= 5 AND nc >= 5 AND mean_mag - (mc - 0.05) > 0 AS ok,
         {math.log10(math.e)!r}::DOUBLE / (mean_mag - (mc - 0.05)) AS b FROM full_part)"""

ALL = f"{PAIRS72}, {AGG}, {GR}, " + """
wide AS (
  SELECT m.*, coalesce(n, 0) AS n, coalesce(mx, 0.0) AS mx, coalesce(av, 0.0) AS av, coalesce(en, 0.0) AS en, """ + ", ".join(
    f"coalesce(c{h}, 0) AS c{h}, coalesce(e{h}, 0.0) AS e{h}" for h in BIN_HOURS) + """,
    CASE WHEN mx > 0 THEN m0 - mx ELSE m0 END AS deficit, CASE WHEN mx > 0 THEN mx END AS bmax,
    CASE WHEN ok THEN b END AS b, CASE WHEN ok THEN log10(nc) + b * mc END AS a,
    CASE WHEN total >= 5 THEN mc END AS mc
  FROM main m LEFT JOIN agg USING (mainshock_id) LEFT JOIN gr USING (mainshock_id))"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def omori_sql(points: int = 47, rounds: int = 4, keep: int = 3) -> str:
    last = float(points - 1)
    lo, hi = math.log(1e-4), math.log(10.0)
    parts = [f"""
times AS (SELECT mainshock_id, elapsed_us / 86400000000.0::DOUBLE AS t FROM pairs),
counts AS (SELECT mainshock_id, count(*) AS n FROM times GROUP BY 1),
steps AS (SELECT unnest(generate_series(0, {points - 1})) AS k),
s0 AS (SELECT mainshock_id, n, 0.2::DOUBLE AS p_lo, 2.5::DOUBLE AS p_hi, {lo!r}::DOUBLE AS u_lo, {hi!r}::DOUBLE AS u_hi
       FROM counts WHERE n >= 8)"""]
    for i in range(rounds):
        parts.append(f"""
g{i} AS (SELECT s.mainshock_id, s.n, p_lo, p_hi, u_lo, u_hi, k AS i, u_lo + (u_hi - u_lo) * k / {last} AS u FROM s{i} s, steps),
t{i} AS (SELECT g.mainshock_id, g.i, sum(ln(t + exp(u))) AS s FROM g{i} g JOIN times USING (mainshock_id) GROUP BY 1, 2),
c{i} AS (SELECT g.*, t.s, k AS j, p_lo + (p_hi - p_lo) * k / {last} AS p
         FROM g{i} g JOIN t{i} t USING (mainshock_id, i), steps),
d{i} AS (SELECT *, CASE WHEN abs(p - 1.0) < 1e-4 THEN ln((exp(u) + 3.0) / (exp(u) + 0.0))
                ELSE (pow(exp(u) + 3.0, 1.0 - p) - pow(exp(u), 1.0 - p)) / (1.0 - p) END AS integral FROM c{i}),
e{i} AS (SELECT *, n - n * ln(n / integral) + p * s AS nll FROM d{i}),
b{i} AS (SELECT * FROM e{i} QUALIFY row_number() OVER (PARTITION BY mainshock_id ORDER BY nll, i, j) = 1),
s{i + 1} AS (SELECT mainshock_id, n, p, u, nll, integral,
  greatest(0.2, p - (p_hi - p_lo) / {last} * {keep}) AS p_lo, least(2.5, p + (p_hi - p_lo) / {last} * {keep}) AS p_hi,
  greatest({lo!r}, u - (u_hi - u_lo) / {last} * {keep}) AS u_lo, least({hi!r}, u + (u_hi - u_lo) / {last} * {keep}) AS u_hi
  FROM b{i})""")
    return f"""WITH {PAIRS72}, {','.join(parts)}
SELECT c.mainshock_id, round(p, 6) AS omori_p, round(exp(u), 6) AS omori_c, round(f.n / integral, 6) AS omori_k,
       round(nll, 6) AS omori_nll, c.n AS omori_n,
       coalesce(abs(p - 0.2) < 1e-4 OR abs(p - 2.5) < 1e-4, FALSE) AS omori_p_boundary_hit,
       coalesce(NOT (abs(p - 0.2) < 1e-4 OR abs(p - 2.5) < 1e-4), FALSE) AS omori_valid
FROM counts c LEFT JOIN s{rounds} f USING (mainshock_id)"""


def _etas_search(source: str, target: str) -> str:
    """SQL that closes in on the optimum of ``source`` (m0, m1, a0, a1, lo, hi), as the operator does."""
    parts, rounds = rates.PARTS, rates.ROUNDS
    return f"""
{target} AS (
  SELECT 0 AS step, * FROM {source}
  UNION ALL
  SELECT step + 1, mainshock_id, n, integral, gain, m0, m1, a0, a1, first, last,
         lo + (hi - lo) / {parts + 1}.0 * falling, lo + (hi - lo) / {parts + 1}.0 * (falling + 1)
  FROM (SELECT e.*, len(list_filter(range(1, {parts + 1}), lambda k: e.m1 * 3.0 + e.a1 * e.integral < list_sum(list_transform(r.g, lambda g:
          (e.m1 + e.a1 * g) / (e.m0 + e.m1 * (e.lo + (e.hi - e.lo) * (k / {parts + 1}.0::DOUBLE))
                               + (e.a0 + e.a1 * (e.lo + (e.hi - e.lo) * (k / {parts + 1}.0::DOUBLE))) * g))))) AS falling
        FROM {target} e JOIN ready r USING (mainshock_id) WHERE e.step < {rounds})
)"""


ETAS_SQL = f"""WITH RECURSIVE {PAIRS72}, {GR},
thin AS (SELECT mainshock_id, m0, elapsed_us / 86400000000.0::DOUBLE AS t, mag FROM pairs),
seqs AS (
  SELECT mainshock_id, any_value(m0) AS m0, count(*) AS n, list(pow(t + 0.05, -1.0) ORDER BY t) AS g,
         list(mag ORDER BY t) AS mags, ln(3.05 / 0.05::DOUBLE) AS integral
  FROM thin GROUP BY 1),
ready AS (SELECT s.* EXCLUDE (m0), exp(0.5 * (m0 - 2.5)) AS gain, s.n >= 10 AND coalesce(gr.ok, FALSE) AS fits
          FROM seqs s LEFT JOIN gr USING (mainshock_id)),
line AS (
  SELECT *, first AS lo, greatest(first, last) AS hi FROM (
    SELECT mainshock_id, n, integral, gain, n / 3.0::DOUBLE AS m0, -n / 3.0::DOUBLE AS m1, 0.0::DOUBLE AS a0, n / integral AS a1,
           greatest(1.0 - 30.0 / n::DOUBLE, 1e-6 * gain * integral / n) AS first,
           least(1.0 - 3e-6 / n::DOUBLE, 100.0 * gain * integral / n) AS last
    FROM ready WHERE fits)),
{_etas_search("line", "walk")},
settled AS (SELECT *, (lo + hi) / 2 AS x, (lo + hi) / 2 - first <= 1e-9 * abs(last - first) AS low_end,
            last - (lo + hi) / 2 <= 1e-9 * abs(last - first) AS high_end FROM walk WHERE step = {rates.ROUNDS}),
judged AS (
  SELECT *, CASE WHEN low_end THEN m0 + m1 * first >= 10.0 * (1 - 1e-12) WHEN high_end THEN m0 + m1 * last <= 1e-6 * (1 + 1e-6) ELSE FALSE END AS on_mu,
         least(10.0, greatest(1e-6, m0 + m1 * x)) AS mu_at, least(100.0 * gain, greatest(1e-6 * gain, a1 * x)) AS a_at
  FROM settled),
bound AS (
  SELECT mainshock_id, n, integral, gain, CASE WHEN on_mu THEN mu_at ELSE 0.0 END AS m0, CASE WHEN on_mu THEN 0.0 ELSE 1.0 END::DOUBLE AS m1,
         CASE WHEN on_mu THEN 0.0 ELSE a_at END AS a0, CASE WHEN on_mu THEN 1.0 ELSE 0.0 END::DOUBLE AS a1, first, last,
         CASE WHEN on_mu THEN 1e-6 * gain ELSE 1e-6 END AS lo, CASE WHEN on_mu THEN 100.0 * gain ELSE 10.0 END AS hi
  FROM judged WHERE low_end OR high_end),
{_etas_search("bound", "side")},
fit AS (
  SELECT mainshock_id, mu_at AS mu, a_at AS a FROM judged WHERE NOT (low_end OR high_end)
  UNION ALL
  SELECT mainshock_id, m0 + m1 * (lo + hi) / 2, a0 + a1 * (lo + hi) / 2 FROM side WHERE step = {rates.ROUNDS})
SELECT r.mainshock_id, round(mu, 5) AS etas_mu, round(a, 5) AS etas_amplitude,
  round(mu * 3.0 + a * integral - list_sum(list_transform(g, lambda x: ln(mu + a * x))), 5) AS etas_nll,
  r.n AS etas_n, fits AS etas_valid,
  round(a * integral / (mu * 3.0 + a * integral), 5) AS etas_branching_ratio,
  round(mu * 3.0 + a * integral, 5) AS etas_expected_count,
  round(list_sum(list_transform(g, lambda x: a * x / (mu + a * x))) / r.n, 5) AS etas_triggered_fraction,
  CASE WHEN fits THEN round(list_sum(list_transform(list_zip(g, mags), lambda z: a * z[1] / (mu + a * z[1]) * z[2])), 5) END
    AS etas_triggered_mag_sum,
  round(mu * 3.0, 5) AS etas_bg_rate_total
FROM ready r LEFT JOIN fit USING (mainshock_id)"""

EVENTS = f"""{PAIRS72},
capped AS (
  SELECT *, row_number() OVER (PARTITION BY mainshock_id ORDER BY us, id) AS position,
         elapsed_us / 86400000000.0::DOUBLE AS dt,
         6371.0 * cos(radians(lat0)) * (radians(longitude) - radians(lon0)) AS x,
         6371.0 * (radians(latitude) - radians(lat0)) AS y
  FROM pairs),
ef AS (
  SELECT mainshock_id, id, position, dt, x, y, distance_km, depth, mag, mag - m0 AS mag_diff, us,
    CASE WHEN count(*) OVER w >= 2 THEN (dt - coalesce(lag(dt) OVER (PARTITION BY mainshock_id ORDER BY us, id), 0.0)) * 24.0
         ELSE 0.0 END AS gap,
    CASE WHEN count(*) OVER w >= 3 THEN {1 / math.log(10)!r}::DOUBLE / (sum(mag) OVER w + 1e-12) ELSE 0.0 END AS proxy,
    {MOMENT} / greatest(sum({MOMENT}) OVER w, 1e-12) AS share
  FROM capped WINDOW w AS (PARTITION BY mainshock_id))"""


def draw_sql(tag: str, seed: int = 7) -> str:
    return f"((('0x' || substr(md5(mainshock_id || '|' || id || '|{tag}|{seed}'), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"


def shaken_sql(value: str, name: str) -> str:
    normal = f"sqrt(-2.0 * ln({draw_sql(name + '-r')})) * cos({2 * math.pi!r}::DOUBLE * {draw_sql(name + '-a')})"
    return f"CASE WHEN dropped THEN 0.0::DOUBLE ELSE round({value} + {normal} * 2.0, 6) END AS {name}"


def _plate_case(column: str, inner: str) -> str:
    rows = " ".join(
        f"WHEN plate = '{t}' THEN {d[column]}" for t, d in FEATURE_DEFAULTS_BY_PLATE.items() if column in d)
    default = FEATURE_DEFAULTS[column]
    fill = f"CASE {rows} ELSE {default} END" if rows else f"{default}"
    return f"round(CAST(coalesce({inner}, {fill}) AS DOUBLE), 6) AS {column}"


FOCAL = f"""
focal AS (
  SELECT n, us + (n % 7 - 3) * 30000000 AS us, latitude + (n % 5 - 2) * 0.1::DOUBLE AS latitude,
         longitude + (n % 4 - 1) * 0.1::DOUBLE AS longitude,
         CASE WHEN n % 10 <> 0 THEN CAST(n * 7 % 360 AS DOUBLE) END AS strike1, CAST(n * 3 % 90 AS DOUBLE) AS dip1,
         CAST(n * 11 % 360 AS DOUBLE) - 180.0 AS rake1, (n * 31 % 100) / 100.0::DOUBLE AS f_clvd
  FROM (SELECT *, CAST(id AS BIGINT) AS n FROM catalog)),
coded AS (
  SELECT *,
    CASE WHEN rake1 BETWEEN 45 AND 135 THEN 'Thrust' WHEN rake1 BETWEEN -135 AND -45 THEN 'Normal' ELSE 'Strike-Slip' END AS kind,
    CASE WHEN abs(rake1) <= 30 OR abs(rake1) >= 120 THEN 'SS'
         WHEN rake1 > 0 THEN CASE WHEN abs(rake1) >= 60 THEN 'TF' ELSE 'NF' END
         ELSE CASE WHEN abs(rake1) >= 60 THEN 'NF' ELSE 'TF' END END AS code
  FROM focal)"""


def _focal_match(seconds: int, radius: float, order: str) -> str:
    return f"""
met AS (
  SELECT m.mainshock_id, f.*, abs(f.us - m.t0) AS gap_us,
         {hav_sql('m.lat0', 'm.lon0', 'f.latitude', 'f.longitude')} AS dist
  FROM main m JOIN coded f ON f.us BETWEEN m.t0 - {seconds}000000 AND m.t0 + {seconds}000000
   AND {hav_sql('m.lat0', 'm.lon0', 'f.latitude', 'f.longitude')} <= {radius}
  QUALIFY row_number() OVER (PARTITION BY m.mainshock_id ORDER BY {order}) = 1)"""


def _mx(lon: str) -> str:
    return f"6378137.0 * radians({lon})"


def _my(lat: str) -> str:
    return f"6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2))"


ORACLES = {
    "early_stats": f"""WITH {PAIRS72}, {AGG}
SELECT mainshock_id, n AS early_aftershock_count, mx AS early_max_mag, {r('av', 'early_mean_mag')},
       {r('log10(en + 1.0)', 'early_energy_sum')} FROM agg""",
    "time_bins": f"WITH {PAIRS72}, {AGG} SELECT mainshock_id, " + ", ".join(
        f"c{h} AS count_{h}h, {r(f'log10(e{h} + 1.0)', f'energy_{h}h')}" for h in BIN_HOURS) + " FROM agg",
    "sub_windows": f"""WITH {PAIRS72}, {AGG}
SELECT mainshock_id, c12 AS count_0_12h, greatest(0, c24 - c12) AS count_12_24h, greatest(0, c72 - c24) AS count_24_72h,
       {r('c12 / greatest(c24 - c12, 1)', 'decay_count_ratio_early_late')},
       {r('(c12 - greatest(0, c72 - c24)) / greatest(c72, 1)', 'decay_count_gradient')},
       {r('(e12 - greatest(0.0, e72 - e24)) / greatest(e72, 1e-10)', 'decay_energy_gradient')} FROM agg""",
    "bath": f"""WITH {ALL} SELECT mainshock_id, {r('deficit', 'bath_deficit')}, {r('bmax', 'bath_early_max_mag')},
       bmax IS NOT NULL AS bath_valid FROM wide""",
    "mc_maxc": f"WITH {PAIRS72}, {GR} SELECT mainshock_id, mc AS gr_mc, CAST(total AS BIGINT) AS n_events FROM mode",
    "gr_b": f"""WITH {PAIRS72}, {GR}
SELECT mainshock_id, {r('CASE WHEN ok THEN b END', 'gr_b_value')}, {r('CASE WHEN ok THEN log10(nc) + b * mc END', 'gr_a_value')},
       CASE WHEN total >= 5 THEN mc END AS gr_mc, CAST(CASE WHEN total >= 5 THEN nc ELSE total END AS BIGINT) AS gr_n,
       ok AS gr_valid FROM gr""",
    "productivity": f"WITH {ALL} SELECT mainshock_id, {r('a - b * m0', 'productivity_index')} FROM wide WHERE n > 0",
    "anisotropy": f"""WITH {PAIRS72},
xy AS (SELECT mainshock_id, 6371.0 * cos(radians(lat0)) * (radians(longitude) - radians(lon0)) AS x,
              6371.0 * (radians(latitude) - radians(lat0)) AS y FROM pairs),
mo AS (SELECT mainshock_id, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b, count(*) AS n FROM xy GROUP BY 1),
ax AS (SELECT *, sqrt(greatest((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 0.0)) AS major,
              sqrt(greatest((a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b), 0.0)) AS minor FROM mo)
SELECT mainshock_id, CASE WHEN n >= 3 THEN round(major, 6) END AS anisotropy_major_axis_km,
       CASE WHEN n >= 3 THEN round(minor, 3) END AS anisotropy_minor_axis_km,
       CASE WHEN n >= 3 AND minor > 1e-3 THEN round(major / greatest(minor, 1e-9), 6) END AS anisotropy_axis_ratio,
       CASE WHEN n >= 3 AND minor > 1e-3 THEN round((degrees(atan2(2 * b, d - a)) / 2 + 180.0) % 180.0, 6) END AS anisotropy_azimuth_deg,
       n AS anisotropy_n, n >= 3 AS anisotropy_valid FROM ax""",
    "omori_grid": omori_sql(),
    "etas_em": ETAS_SQL,
    "event_features": f"""WITH {EVENTS}
SELECT mainshock_id, id, position, {r('dt', 'dt_days')}, {r('ln(1.0 + dt)', 'log_dt_days')}, {r('x', 'rel_x_km')},
       {r('y', 'rel_y_km')}, {r('distance_km', 'distance_km')}, depth, mag, {r('atan2(x, y)', 'azimuth_rad')},
       {r('mag_diff', 'mag_diff')}, {r('gap', 'inter_event_interval_hours')}, {r('proxy', 'local_b_value_proxy')},
       {r('share', 'normalized_energy')} FROM ef""",
    "augmented_events": f"""WITH {EVENTS},
top AS (SELECT *, max(mag) OVER (PARTITION BY mainshock_id) AS top FROM ef),
drawn AS (SELECT *, mag < top - 1.5 AND {draw_sql('drop')} < 0.1 AS dropped FROM top)
SELECT mainshock_id, id, position, dropped, {', '.join(shaken_sql(c, s) for c, s in (('x', 'rel_x_km'), ('y', 'rel_y_km')))},
  {', '.join(f"CASE WHEN dropped THEN 0.0::DOUBLE ELSE {r_plain} END AS {name}" for r_plain, name in (
      ('round(mag, 6)', 'mag'), ('round(dt, 6)', 'dt_days'), ('round(distance_km, 6)', 'distance_km')))} FROM drawn""",
    "region_event_features": f"""WITH {BASE_SQL},
belts AS (SELECT *, floor(latitude / 60) AS belt FROM catalog),
mains AS (SELECT * FROM (SELECT belt, id AS mainshock_id, us AS us0, latitude AS lat0, longitude AS lon0, mag AS m0,
  row_number() OVER (PARTITION BY belt ORDER BY mag DESC, us, id) AS k FROM belts) WHERE k = 1),
met AS (SELECT b.*, m.* EXCLUDE (belt, k), (us - us0) / 86400000000.0::DOUBLE AS dt FROM belts b JOIN mains m USING (belt) WHERE us > us0)
SELECT mainshock_id, id, row_number() OVER w AS position, {r('dt', 'dt_days')},
  {r('6371.0 * cos(radians(lat0)) * (radians(longitude) - radians(lon0))', 'rel_x_km')}, {r('6371.0 * (radians(latitude) - radians(lat0))', 'rel_y_km')},
  {r(hav_sql('lat0', 'lon0', 'latitude', 'longitude'), 'distance_km')}, {r('mag - m0', 'mag_diff')},
  {r('CASE WHEN count(*) OVER (PARTITION BY mainshock_id) >= 2 THEN (dt - coalesce(lag(dt) OVER w, 0.0)) * 24.0 ELSE 0.0 END', 'inter_event_interval_hours')},
  {r(f'{MOMENT} / greatest(sum({MOMENT}) OVER (PARTITION BY mainshock_id), 1e-12)', 'normalized_energy')}
FROM met WINDOW w AS (PARTITION BY mainshock_id ORDER BY us, id)""",
    "event_graph_edges": f"""WITH {EVENTS},
edges AS (
  SELECT s.mainshock_id, s.id AS src, d.id AS dst,
         exp(-(pow(d.x - s.x, 2) + pow(d.y - s.y, 2)) / 5000.0) * exp({math.log1p(math.exp(0.5))!r}::DOUBLE * (s.mag - 2.5)) AS w
  FROM ef s JOIN ef d ON s.mainshock_id = d.mainshock_id AND s.dt < d.dt
   AND sqrt(pow(d.x - s.x, 2) + pow(d.y - s.y, 2)) < 100.0)
SELECT mainshock_id, src, dst, round(w / greatest(sum(w) OVER (PARTITION BY mainshock_id, dst), 1e-8), 6) AS weight FROM edges""",
    "legal_features_t1": f"""WITH {BASE_SQL} SELECT mainshock_id, m0 AS mainshock_mag, d0 AS mainshock_depth,
       0.0::DOUBLE AS count_obs_0h, 0.0::DOUBLE AS energy_obs_0h FROM main""",
    "legal_features_t2": f"""WITH {ALL}
SELECT mainshock_id, m0 AS mainshock_mag, CAST(c24 AS DOUBLE) AS early_aftershock_count, CAST(c24 AS DOUBLE) AS count_obs_24h,
       c1 AS count_1h, {r('c1 / greatest(c24, 1)', 'count_ratio_1h_obs')}, {r('c12 / 12.0', 'count_rate_12h')},
       CAST(greatest(c24 - c12, 0) AS DOUBLE) AS count_12_24h,
       {r('(c12 - greatest(c24 - c12, 0)) / greatest(c24, 1)', 'decay_count_gradient')},
       {r('(e12 - greatest(e24 - e12, 0.0)) / greatest(e24, 1e-10)', 'decay_energy_gradient')},
       {r('c24 / greatest(m0, 1.0)', 'obs_count_per_main_mag')}, {r('e6 / greatest(e24, 1e-10)', 'energy_ratio_6h_obs')} FROM wide""",
    "legal_features_t3": f"""WITH {ALL}
SELECT mainshock_id, m0 AS mainshock_mag, mx AS early_max_mag, CAST(c72 AS DOUBLE) AS early_aftershock_count, c72 AS count_72h,
       {r('c24 / greatest(c72, 1)', 'count_ratio_24h_obs')}, {r('c72 / 72.0', 'count_rate_72h')},
       CAST(greatest(c24 - c12, 0) AS DOUBLE) AS count_12_24h,
       {r('(c12 - greatest(c24 - c12, 0)) / greatest(c24, 1)', 'decay_count_gradient')},
       {r('c72 / greatest(m0, 1.0)', 'obs_count_per_main_mag')}, {r('deficit', 'bath_deficit')}, {r('b', 'gr_b_value')} FROM wide""",
    "legal_features_h168": f"""WITH {BASE_SQL} SELECT mainshock_id, m0 AS mainshock_mag, d0 AS mainshock_depth,
       0.0::DOUBLE AS count_obs_0h, 0.0::DOUBLE AS energy_obs_0h FROM main""",
    "derived_features": f"""WITH {ALL}
SELECT mainshock_id, {r('mx / greatest(m0, 1.0)', 'mag_ratio_early_main')}, {r('m0 - mx', 'mag_diff_main_early')},
       {r('c1 / greatest(c72, 1)', 'count_ratio_1h_72h')}, {r('c24 / greatest(c72, 1)', 'count_ratio_24h_72h')},
       {r('e24 / greatest(e72, 1e-10)', 'energy_ratio_24h_72h')}, {r('b * m0', 'b_value_times_mag')},
       {r('ln(1.0 + greatest(d0, 0.0))', 'log_depth')}, {r('d0 / greatest(m0, 1.0)', 'depth_mag_ratio')},
       {r('(a - b * m0) / greatest(n, 1)', 'productivity_per_event')},
       {r('c12 / greatest(greatest(c72 - c24, 0), 1)', 'decay_count_ratio_early_late')},
       {r('(c12 - greatest(c72 - c24, 0)) / greatest(c72, 1)', 'decay_count_gradient')},
       {r('ln(1.0 + en)', 'log_energy_sum')} FROM wide""",
    "imputed_features": f"""WITH {ALL},
plated AS (SELECT *, ['SUB', 'OTF', 'OSR', 'UNK'][CAST(mainshock_id AS BIGINT) % 4 + 1] AS plate, a - b * m0 AS prod,
                  CASE WHEN d0 < 50 THEN m0 - mx END AS mag_gap, NULL::DOUBLE AS emu FROM wide)
SELECT mainshock_id, {_plate_case('gr_b_value', 'b')}, {_plate_case('gr_a_value', 'a')}, {_plate_case('gr_mc', 'mc')},
       {_plate_case('productivity_index', 'prod')}, {_plate_case('etas_mu', 'emu')},
       round(coalesce(mag_gap, median(mag_gap) OVER ()), 6) AS mag_gap,
       CAST(b IS NULL AS INT) AS gr_b_value_missing, CAST(a IS NULL AS INT) AS gr_a_value_missing,
       CAST(mc IS NULL AS INT) AS gr_mc_missing, CAST(prod IS NULL AS INT) AS productivity_index_missing,
       1 AS etas_mu_missing,
       CAST(mag_gap IS NULL AS INT) AS mag_gap_missing FROM plated""",
    "scaled_features": f"""WITH {ALL},
f AS (SELECT mainshock_id, m0, d0, coalesce(b, 1.0) AS b, b IS NULL AS miss, av FROM wide)
SELECT mainshock_id, """ + ", ".join(
        f"round(({c} - median({c}) OVER ()) / coalesce(nullif(quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER (), 0), 1), 6) AS {n}"
        for c, n in (("m0", "mainshock_mag"), ("d0", "mainshock_depth"), ("b", "gr_b_value"), ("av", "early_mean_mag"))
    ) + ", CAST(miss AS DOUBLE) AS gr_b_value_missing FROM f",
    "standard_scaled_features": f"""WITH {ALL},
f AS (SELECT mainshock_id, m0, d0, coalesce(b, 1.0) AS b, av FROM wide)
SELECT mainshock_id, """ + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {n}"
        for c, n in (("m0", "mainshock_mag"), ("d0", "mainshock_depth"), ("b", "gr_b_value"), ("av", "early_mean_mag"))
    ) + " FROM f",
    "feature_matrix": f"""WITH {ALL} SELECT mainshock_id, m0 AS mainshock_mag, CAST(n AS DOUBLE) AS early_aftershock_count,
       CASE WHEN bmax IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS bath_valid, NULL::DOUBLE AS absent_column FROM wide""",
    "focal_asof": f"""WITH {BASE_SQL}, {FOCAL}, {_focal_match(60, 50.0, 'gap_us, dist, f.us')}
SELECT m.mainshock_id, strike1, dip1, rake1, {r('f_clvd', 'f_clvd')}, coalesce(kind, 'Unknown') AS fault_type,
       CAST(coalesce(kind, '') = 'Thrust' AS INT) AS "fault_type_Thrust",
       CAST(coalesce(kind, '') = 'Strike-Slip' AS INT) AS "fault_type_SS",
       CAST(kind IS NULL AS INT) AS "fault_type_UNK",
       {r('gap_us / 1000000.0', 'gcmt_time_diff_seconds')}, {r('dist', 'gcmt_distance_km')},
       strike1 IS NOT NULL AS focal_mechanism_valid
FROM main m LEFT JOIN met USING (mainshock_id)""",
    "focal_nearest": f"""WITH {BASE_SQL}, {FOCAL}, {_focal_match(86400, 200.0, 'dist, f.us')}
SELECT m.mainshock_id, strike1, dip1, rake1, {r('f_clvd', 'f_clvd')},
       CAST(coalesce(code, '') = 'NF' AS INT) AS "fault_type_NF", CAST(coalesce(code, '') = 'SS' AS INT) AS "fault_type_SS",
       CAST(coalesce(code, '') = 'TF' AS INT) AS "fault_type_TF", CAST(code IS NULL AS INT) AS "fault_type_UNK",
       strike1 IS NOT NULL AS focal_mechanism_valid
FROM main m LEFT JOIN met USING (mainshock_id)""",
    "fault_types": f"""WITH {BASE_SQL}, {FOCAL}
SELECT kind AS fault_type, CASE kind WHEN 'Thrust' THEN 'TF' WHEN 'Normal' THEN 'NF' ELSE 'SS' END AS short_code,
       code AS catalog_code, count(*) AS n FROM coded GROUP BY ALL""",
    "nearest_boundary": f"""WITH {BASE_SQL},
seg AS (
  SELECT s_suppkey AS k, ['SUB', 'OTF', 'OSR', 'CCB'][s_suppkey % 4 + 1] AS kind,
         -62.0::DOUBLE + s_suppkey * 37 % 130 AS lat1, -178.0::DOUBLE + s_suppkey * 53 % 350 AS lon1 FROM supplier),
seg2 AS (SELECT *, lat1 + (k % 9 - 4) AS lat2, lon1 + (k % 7 - 3) AS lon2 FROM seg),
line AS (SELECT k, kind, {_mx('lon1')} AS ax, {_my('lat1')} AS ay, {_mx('lon2')} AS bx, {_my('lat2')} AS by_ FROM seg2),
pt AS (SELECT mainshock_id, {_mx('lon0')} AS px, {_my('lat0')} AS py FROM main),
along AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM pt, line),
tt AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM along),
ds AS (SELECT *, sqrt(pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2)) AS d FROM tt),
nb AS (SELECT mainshock_id, d / 1000.0 AS km, CASE WHEN kind = 'CCB' THEN 'UNK' ELSE kind END AS kind FROM ds
       QUALIFY row_number() OVER (PARTITION BY mainshock_id ORDER BY d, k) = 1)
SELECT mainshock_id, round(km, 4) AS plate_boundary_distance_km, kind AS nearest_plate_boundary_type,
       CAST(kind = 'SUB' AS INT) AS "plate_type_SUB", CAST(kind = 'OTF' AS INT) AS "plate_type_OTF",
       CAST(kind = 'OSR' AS INT) AS "plate_type_OSR", CAST(kind = 'UNK' AS INT) AS "plate_type_UNK" FROM nb""",
}
