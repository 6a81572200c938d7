"""Aftershock-rate models: Omori-Utsu by grid refinement, simplified ETAS by convex line searches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorframe.session import durable

BOUNDARY_TOLERANCE = 1e-4


def decay_integral(p: Column, c: Column, start: float, end: float) -> Column:
    """Integral of (t + c)^-p; the logarithm replaces it when p is within 1e-4 of one."""
    near_one = F.abs(p - 1.0) < BOUNDARY_TOLERANCE
    q = 1.0 - p
    return F.when(near_one, F.log((c + end) / (c + start))).otherwise(
        (F.pow(c + end, q) - F.pow(c + start, q)) / F.when(near_one, F.lit(1.0)).otherwise(q))


def _observed(pairs: DataFrame | Callable[..., DataFrame], start_day: float, end_day: float, *columns: str) -> Callable[..., DataFrame]:
    """``(state, made) -> mainshock_id, columns, t``, the state's columns and those made of them, for the pairs inside the observation.

    A table of pairs is written once and joined with each state. Live pairs (``spatial_join.live_pairs``) take the
    state along to their join, so they are neither written nor shuffled.
    """
    days = F.col("elapsed_us") / F.lit(86_400_000_000.0)

    def inside(df: DataFrame, *more: str) -> DataFrame:
        return df.select("mainshock_id", *columns, days.alias("t"), *more).filter((F.col("t") > start_day) & (F.col("t") <= end_day))

    if isinstance(pairs, DataFrame):
        stored = durable(inside(pairs))
        return lambda state=None, made=None: stored if state is None else stored.join(state.withColumns(made or {}), "mainshock_id")
    return lambda state=None, made=None: inside(pairs()) if state is None else inside(
        pairs(state, made), *[c for c in state.columns if c != "mainshock_id"], *(made or ()))


#: Sequences whose grids are in memory together.
GRIDS = 500


def _best_cells(rows: DataFrame, points: int, start: float, end: float) -> DataFrame:
    """``mainshock_id, n, p, u, nll, integral`` and the bounds: the least cell (the first of equal ones, by c, then p) of every row's grid."""
    sums = [f"s{i}" for i in range(points)]
    bounds = ["p_lo", "p_hi", "u_lo", "u_hi"]
    step = np.arange(points) / float(points - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), GRIDS):
                part = batch.iloc[at:at + GRIDS]
                lo_p, hi_p, lo_u, hi_u = (part[c].to_numpy()[:, None] for c in bounds)
                p, u = lo_p + (hi_p - lo_p) * step, lo_u + (hi_u - lo_u) * step
                c, q, n = np.exp(u)[:, :, None], (1.0 - p)[:, None, :], part["n"].to_numpy(float)[:, None, None]
                near_one = np.abs(q) < BOUNDARY_TOLERANCE
                integral = np.where(near_one, np.log((c + end) / (c + start)),
                                    ((c + end) ** q - (c + start) ** q) / np.where(near_one, 1.0, q))
                nll = n - n * np.log(n / integral) + p[:, None, :] * part[sums].to_numpy()[:, :, None]
                best = np.where(np.isnan(nll), np.inf, nll).reshape(len(part), -1).argmin(1)
                row, i, j = np.arange(len(part)), best // points, best % points
                yield part[["mainshock_id", "n", *bounds]].assign(p=p[row, j], u=u[row, i], nll=nll[row, i, j], integral=integral[row, i, j])

    made = [T.StructField(c, T.DoubleType()) for c in (*bounds, "p", "u", "nll", "integral")]
    return rows.select("mainshock_id", "n", *bounds, *sums).mapInPandas(
        run, T.StructType([rows.schema["mainshock_id"], rows.schema["n"], *made]))


def omori_fit(
    pairs: DataFrame | Callable[..., DataFrame], obs_days: float = 3.0, min_events: int = 8,
    p_bounds: tuple[float, float] = (0.2, 2.5), c_bounds: tuple[float, float] = (1e-4, 10.0),
    points: int = 47, rounds: int = 4, keep_cells: int = 3, start_day: float = 0.0,
) -> DataFrame:
    """Maximum likelihood over (p, log c) on a grid that closes in on the best cell.

    Given c, the events enter only through n and S(c) = sum ln(t + c). So a round meets the
    events once and sums S(c) per grid value, a column each, with map-side combine; the grid of
    p and c is laid over that row. K has the closed form n / integral.
    ``pairs``: a table, or live pairs.
    """
    last = points - 1
    times = _observed(pairs, start_day, obs_days)
    counts = durable(times().groupBy("mainshock_id").agg(F.count(F.lit(1)).alias("n")))
    low_c, high_c = math.log(c_bounds[0]), math.log(c_bounds[1])
    state = counts.filter(F.col("n") >= min_events).select(
        "mainshock_id", "n", F.lit(p_bounds[0]).alias("p_lo"), F.lit(p_bounds[1]).alias("p_hi"),
        F.lit(low_c).alias("u_lo"), F.lit(high_c).alias("u_hi"))
    steps = F.sequence(F.lit(0), F.lit(last))

    for _ in range(rounds):
        grid_c = F.transform(steps, lambda i: F.exp(F.col("u_lo") + (F.col("u_hi") - F.col("u_lo")) * i / F.lit(float(last))))
        sums = times(state.select("mainshock_id", "u_lo", "u_hi"), {"cs": grid_c}).groupBy("mainshock_id").agg(*[
            F.sum(F.log(F.col("t") + F.col("cs")[i])).alias(f"s{i}") for i in range(points)])
        best = _best_cells(state.join(sums, "mainshock_id"), points, start_day, obs_days)
        step_p = (F.col("p_hi") - F.col("p_lo")) / F.lit(float(last)) * keep_cells
        step_u = (F.col("u_hi") - F.col("u_lo")) / F.lit(float(last)) * keep_cells
        state = durable(best.select(
            "mainshock_id", "n", "p", "u", "nll", "integral",
            F.greatest(F.lit(p_bounds[0]), F.col("p") - step_p).alias("p_lo"),
            F.least(F.lit(p_bounds[1]), F.col("p") + step_p).alias("p_hi"),
            F.greatest(F.lit(low_c), F.col("u") - step_u).alias("u_lo"),
            F.least(F.lit(high_c), F.col("u") + step_u).alias("u_hi"),
        ))
    hit = (F.abs(F.col("p") - p_bounds[0]) < BOUNDARY_TOLERANCE) | (
        F.abs(F.col("p") - p_bounds[1]) < BOUNDARY_TOLERANCE)
    fit = state.select(
        "mainshock_id", F.col("p").alias("omori_p"), F.exp("u").alias("omori_c"),
        (F.col("n") / F.col("integral")).alias("omori_k"), F.col("nll").alias("omori_nll"),
        hit.alias("omori_p_boundary_hit"), (~hit).alias("omori_valid"))
    return counts.join(fit, "mainshock_id", "left").select(
        "mainshock_id", "omori_p", "omori_c", "omori_k", "omori_nll", F.col("n").alias("omori_n"),
        F.coalesce("omori_p_boundary_hit", F.lit(False)).alias("omori_p_boundary_hit"),
        F.coalesce("omori_valid", F.lit(False)).alias("omori_valid"),
    )


# Bounds of the background rate, and of the amplitude in units of its gain. Fixed values.
MU_BOUNDS = (1e-6, 10.0)
AMPLITUDE_BOUNDS = (1e-6, 100.0)
PARTS, ROUNDS = 26, 8


def _close_in(rates: Callable[[DataFrame], DataFrame], state: DataFrame, obs_days: float) -> DataFrame:
    """Minimise the likelihood of each sequence on its segment ``lo .. hi``.

    On a segment the rate of an event is (m0 + m1 x) + (a0 + a1 x) g, and the negative likelihood is convex in x. A
    round sums its derivative at PARTS inner points, with map-side combine, and keeps the part where the sign
    changes: ROUNDS rounds leave a 1e-11th of the segment. The state is a row per sequence; no event is collected.
    ``rates`` gives the events ``g`` with a state's columns.
    """
    ends = [F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(k / (PARTS + 1)) for k in range(PARTS + 2)]
    for _ in range(ROUNDS):
        met = rates(state.select("mainshock_id", "m0", "m1", "a0", "a1", "lo", "hi"))
        slopes = met.groupBy("mainshock_id").agg(*[F.sum(
            (F.col("m1") + F.col("a1") * F.col("g"))
            / (F.col("m0") + F.col("m1") * ends[k] + (F.col("a0") + F.col("a1") * ends[k]) * F.col("g"))).alias(f"s{k}")
            for k in range(1, PARTS + 1)])
        falling = sum((F.col("m1") * obs_days + F.col("a1") * F.col("integral") < F.col(f"s{k}")).cast("int") for k in range(1, PARTS + 1))
        step = (F.col("hi") - F.col("lo")) / F.lit(float(PARTS + 1))
        state = durable(state.join(slopes, "mainshock_id").withColumn("_falling", falling).select(
            *[c for c in state.columns if c not in ("lo", "hi")],
            (F.col("lo") + step * F.col("_falling")).alias("lo"), (F.col("lo") + step * (F.col("_falling") + 1)).alias("hi")))
    return state


def etas_fit(
    pairs: DataFrame | Callable[..., DataFrame], main: DataFrame, omori: DataFrame, gr: DataFrame, obs_days: float = 3.0,
    min_events: int = 10, max_events: int | None = None, mc: float = 2.5, alpha: float = 0.5,
) -> DataFrame:
    """Background rate mu and triggering amplitude A with fixed decay (p, c), by maximum likelihood on all events.

    The likelihood is convex in (mu, A). At its inner optimum mu T + A I is the number of events, so the first
    search runs along that line; where it ends on a bound, the other parameter is searched alone. K0 and alpha
    act only through A = K0 exp(alpha (M - mc)), so alpha stays at its start value and K0 follows from A.
    ``max_events`` thins larger sequences by a stable hash; it is off by default.
    ``pairs``: a table, or live pairs; thinned ones are a table.
    """
    if max_events is not None:
        table = pairs if isinstance(pairs, DataFrame) else pairs()
        by_hash = Window.partitionBy("mainshock_id").orderBy(F.xxhash64("id"), "id")
        days = F.col("elapsed_us") / F.lit(86_400_000_000.0)
        pairs = table.filter((days > 0) & (days <= obs_days)).withColumn("_r", F.row_number().over(by_hash)).filter(F.col("_r") <= max_events)
    inside = _observed(pairs, 0.0, obs_days, "mag")
    usable = F.col("omori_valid")
    ready = durable(
        inside().groupBy("mainshock_id").agg(F.count(F.lit(1)).alias("n"))
        .join(omori.select("mainshock_id", "omori_p", "omori_c", "omori_valid"), "mainshock_id", "left")
        .join(gr.select("mainshock_id", "gr_valid"), "mainshock_id", "left")
        .join(main.select("mainshock_id", "mainshock_mag"), "mainshock_id")
        .withColumn("p", F.when(usable, F.col("omori_p")).otherwise(F.lit(1.0)))
        .withColumn("c", F.when(usable, F.col("omori_c")).otherwise(F.lit(0.05)))
        .withColumn("integral", decay_integral(F.col("p"), F.col("c"), 0.0, obs_days))
        .withColumn("gain", F.exp(F.lit(alpha) * (F.col("mainshock_mag") - mc)))
        .withColumn("fits", (F.col("n") >= min_events) & F.coalesce(F.col("gr_valid"), F.lit(False)))
        .select("mainshock_id", "n", "p", "c", "integral", "gain", "fits"))
    fitted = ready.filter("fits")

    def rates(state: DataFrame) -> DataFrame:
        met = inside(fitted.select("mainshock_id", "p", "c").join(state, "mainshock_id"))
        return met.withColumn("g", F.pow(F.col("t") + F.col("c"), -F.col("p")))

    n, total = F.col("n"), F.lit(float(obs_days))
    mu_floor, mu_top = [F.lit(b) for b in MU_BOUNDS]
    a_floor, a_top = [F.lit(b) * F.col("gain") for b in AMPLITUDE_BOUNDS]
    # x is the share of triggered events
    line = fitted.select(
        "mainshock_id", "n", "integral", "gain", (n / total).alias("m0"), (-n / total).alias("m1"), F.lit(0.0).alias("a0"),
        (n / F.col("integral")).alias("a1"),
        F.greatest(1.0 - mu_top * total / n, a_floor * F.col("integral") / n).alias("first"),
        F.least(1.0 - mu_floor * total / n, a_top * F.col("integral") / n).alias("last"),
    ).withColumns({"lo": F.col("first"), "hi": F.greatest("first", "last")})
    x = (F.col("lo") + F.col("hi")) / 2
    margin = 1e-9 * F.abs(F.col("last") - F.col("first"))
    low_end, high_end = x - F.col("first") <= margin, F.col("last") - x <= margin
    mu_low, mu_high = F.col("m0") + F.col("m1") * F.col("first"), F.col("m0") + F.col("m1") * F.col("last")
    on_mu = F.when(low_end, mu_low >= mu_top * (1 - 1e-12)).when(high_end, mu_high <= mu_floor * (1 + 1e-6)).otherwise(False)
    on_a = (low_end | high_end) & ~on_mu
    mu_at = F.least(mu_top, F.greatest(mu_floor, F.col("m0") + F.col("m1") * x))
    a_at = F.least(a_top, F.greatest(a_floor, F.col("a1") * x))
    settled = _close_in(rates, line, obs_days)
    alone = settled.select(
        "mainshock_id", "n", "integral", "gain", F.when(on_a, 0.0).otherwise(mu_at).alias("m0"), F.when(on_a, 1.0).otherwise(0.0).alias("m1"),
        F.when(on_mu, 0.0).otherwise(a_at).alias("a0"), F.when(on_mu, 1.0).otherwise(0.0).alias("a1"),
        F.when(on_mu, a_floor).when(on_a, mu_floor).otherwise(0.0).alias("lo"), F.when(on_mu, a_top).when(on_a, mu_top).otherwise(0.0).alias("hi"),
        (on_mu | on_a).alias("bound"))
    bound = alone.filter("bound").drop("bound")
    inner = alone.filter("NOT bound").drop("bound")
    solved = durable((inner if bound.isEmpty() else inner.unionByName(_close_in(rates, bound, obs_days))).select(
        "mainshock_id", (F.col("m0") + F.col("m1") * x).alias("mu"), (F.col("a0") + F.col("a1") * x).alias("a")))
    share = F.col("a") * F.col("g") / (F.col("mu") + F.col("a") * F.col("g"))
    sums = rates(solved).groupBy("mainshock_id").agg(
        F.sum(F.log(F.col("mu") + F.col("a") * F.col("g"))).alias("log_rate"), F.sum(share).alias("triggered"),
        F.sum(share * F.col("mag")).alias("mag_sum"))
    mu, a = F.col("mu"), F.col("a")
    expected = mu * obs_days + a * F.col("integral")
    when = F.col("fits")
    return durable(ready.join(solved, "mainshock_id", "left").join(sums, "mainshock_id", "left").select(
        "mainshock_id",
        mu.alias("etas_mu"), (a / F.col("gain")).alias("etas_K0"), F.when(when, F.lit(alpha)).alias("etas_alpha"),
        F.when(when, F.col("c")).alias("etas_c"), F.when(when, F.col("p")).alias("etas_p"),
        (expected - F.col("log_rate")).alias("etas_nll"), F.col("n").cast("bigint").alias("etas_n"),
        when.alias("etas_valid"),
        (a * F.col("integral") / expected).alias("etas_branching_ratio"),
        expected.alias("etas_expected_count"),
        (F.col("triggered") / F.col("n")).alias("etas_triggered_fraction"),
        F.col("mag_sum").alias("etas_triggered_mag_sum"),
        (mu * obs_days).alias("etas_bg_rate_total"),
        a.alias("etas_amplitude"),
    ))
