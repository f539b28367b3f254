"""Evidence of energy exchange between pairs of envelopes.

Envelopes are long series (source_id, n, t_s, a); pairs are aligned by an equi-join on the
rounded time or on a resampling grid, never by comparing all points with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio

PAIR = ["source_a", "source_b"]
#: Standard deviations below it count as none.
_FLAT = 1e-12


def prepare(series: DataFrame, start_s: float | None = None, stop_s: float | None = None, smooth_s: float | None = None) -> DataFrame:
    """Windowed, optionally smoothed by time, scaled to its own peak, with its squared energy."""
    s = series.filter(F.col("a").isNotNull() & ~F.isnan("a"))
    if start_s is not None:
        s = s.filter(F.col("t_s") >= start_s)
    if stop_s is not None:
        s = s.filter(F.col("t_s") <= stop_s)
    if smooth_s is not None:
        near = Window.partitionBy("source_id").orderBy("t_s").rangeBetween(-smooth_s / 2, smooth_s / 2)
        s = s.withColumn("a", F.avg("a").over(near))
    top = F.max("a").over(Window.partitionBy("source_id"))
    scaled = ratio(F.col("a"), top)
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("t_s")) - 1
    return s.select("source_id", n.alias("n"), "t_s", scaled.alias("a")).withColumn("energy", F.col("a") * F.col("a"))


def align(series: DataFrame, pairs: DataFrame, digits: int = 12) -> DataFrame:
    """Points that both sources of (source_a, source_b) have at the same rounded time."""
    s = series.select("source_id", F.round("t_s", digits).alias("at"), "a", "energy")
    left = pairs.join(s.withColumnRenamed("source_id", "source_a").withColumnRenamed("a", "x").withColumnRenamed("energy", "ex"), "source_a")
    right = s.withColumnRenamed("source_id", "source_b").withColumnRenamed("a", "y").withColumnRenamed("energy", "ey")
    w = Window.partitionBy(*PAIR).orderBy("t_s")
    return left.join(right, ["source_b", "at"]).withColumnRenamed("at", "t_s").withColumn("n", F.row_number().over(w) - 1).select(*PAIR, "n", "t_s", "x", "y", "ex", "ey")


def resample(series: DataFrame, step_s: float, last_s: float | None = None) -> DataFrame:
    """Linear interpolation on a regular grid, without extrapolation; up to each series' own last time or ``last_s``."""
    w = Window.partitionBy("source_id").orderBy("t_s")
    seg = series.select("source_id", "t_s", "a", F.lead("t_s").over(w).alias("t1"), F.lead("a").over(w).alias("a1"))
    first, last = F.ceil(F.col("t_s") / step_s - 1e-9), F.floor((F.col("t1") if last_s is None else F.least(F.col("t1"), F.lit(last_s))) / step_s + 1e-9)
    seg = seg.filter("t1 > t_s").withColumn("k0", first).withColumn("k1", last).filter("k1 >= k0").select("source_id", "t_s", "a", "t1", "a1", F.explode(F.sequence("k0", "k1")).alias("k"))
    g = F.col("k") * step_s
    value = F.col("a") + (F.col("a1") - F.col("a")) * (g - F.col("t_s")) / (F.col("t1") - F.col("t_s"))
    out = seg.select("source_id", F.col("k").alias("n"), g.alias("t_s"), value.alias("a")).groupBy("source_id", "n", "t_s").agg(F.max("a").alias("a"))
    return out.withColumn("energy", F.col("a") * F.col("a"))


def all_pairs(sources: DataFrame) -> DataFrame:
    """Unordered pairs within a group (group_id, source_id); a group is one recording's candidates."""
    a = sources.select("group_id", F.col("source_id").alias("source_a"))
    return a.join(sources.select("group_id", F.col("source_id").alias("source_b")), "group_id").filter("source_a < source_b").select(*PAIR)


def trends(aligned: DataFrame, limit: float = 1e-9) -> DataFrame:
    """Slopes of both envelopes, their classes, whether they oppose, and the share of opposed steps."""
    w = Window.partitionBy(*PAIR).orderBy("n")
    p = aligned.select("*", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    m = p.groupBy(*PAIR).agg(F.count("*").alias("n"), F.regr_slope("x", "t_s").alias("slope_x"), F.regr_slope("y", "t_s").alias("slope_y"), ratio(F.count_if(F.col("dx") * F.col("dy") < 0).cast("double"), F.count("dx").cast("double")).alias("opposed_steps"))
    kind = lambda c: F.when(F.col(c) >= limit, "increasing").when(F.col(c) <= -limit, "decreasing").otherwise("stable")
    return m.select("*", kind("slope_x").alias("trend_x"), kind("slope_y").alias("trend_y")).withColumn("opposed", (F.col("slope_x") >= limit) & (F.col("slope_y") <= -limit) | (F.col("slope_x") <= -limit) & (F.col("slope_y") >= limit))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient; missing where one side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def _pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    sx, sy = x.std(), y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx > _FLAT and sy > _FLAT else None


def _by_pair(aligned: DataFrame, found: str, kernel: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """Rows of ``found`` (names and kinds) that ``kernel(x, y)`` makes of each pair's points in order."""
    kinds = [(c, aligned.schema[c].dataType.simpleString()) for c in PAIR]
    names = [f.split()[0] for f in found.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in found.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("n").to_numpy(), kind="stable")
        x, y = (table.column(c).to_numpy(zero_copy_only=False)[at] for c in ("x", "y"))
        rows = kernel(x, y)
        own = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.table([*own, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [*PAIR, *names])

    return aligned.select(*PAIR, "n", "x", "y").groupBy(*PAIR).applyInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds) + f", {found}")


def lag_correlations(aligned: DataFrame, lags: range) -> DataFrame:
    """Correlation of x with y shifted by each lag that leaves points in common; a pair's lags are one kernel's work, without a row for each point and lag."""

    def kernel(x: np.ndarray, y: np.ndarray) -> list[tuple]:
        out = []
        for lag in lags:
            n = len(x) - abs(lag)
            if n > 0:
                out.append((lag, n, _pearson(x[max(-lag, 0) :][:n], y[max(lag, 0) :][:n])))
        return out

    return _by_pair(aligned, "lag int, n long, r double", kernel)


def best_negative(lagged: DataFrame) -> DataFrame:
    """The lag of the most negative correlation, the shortest of equal ones."""
    b = lagged.filter("r IS NOT NULL").groupBy(*PAIR).agg(F.min(F.struct(F.round("r", 12).alias("o"), F.abs("lag").alias("far"), "lag", "r")).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("zero_lag_r"))
    return b.select(*PAIR, "zero_lag_r", F.col("b.lag").alias("best_lag"), F.col("b.r").alias("best_r"))


def spearman(aligned: DataFrame) -> DataFrame:
    """Correlation of average ranks."""

    def ranks(c: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(*PAIR, c))
        return F.rank().over(Window.partitionBy(*PAIR).orderBy(c)) + (ties - 1) / 2

    r = aligned.select(*PAIR, ranks("x").alias("rx"), ranks("y").alias("ry"))
    return r.groupBy(*PAIR).agg(correlation(F.col("rx"), F.col("ry")).alias("rho"))


def shift_test(aligned: DataFrame) -> DataFrame:
    """Share of all circular shifts (the identity included) whose correlation is as negative as the observed one.

    All shifts of a pair at once as one product of transforms, so a pair costs n log n and no row a shift.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("n").to_numpy(), kind="stable")
        x, y = (table.column(c).to_numpy(zero_copy_only=False)[at] for c in ("x", "y"))
        sx, sy = x.std(), y.std()
        observed = p = None
        if sx > _FLAT and sy > _FLAT:
            u, v = x - x.mean(), y - y.mean()
            r = np.fft.irfft(np.conj(np.fft.rfft(u)) * np.fft.rfft(v), len(u)) / (len(u) * sx * sy)
            observed, p = float(r[0]), float((r <= r[0] + 1e-9).mean())
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([observed], pa.float64()), pa.array([p], pa.float64()), pa.array([len(x)], pa.int64())], [*PAIR, "observed", "p_value", "shifts"])

    rows = aligned.select(*(F.col(c).cast("long").alias(c) for c in PAIR), "n", "x", "y")
    return rows.groupBy(*PAIR).applyInArrow(run, ", ".join(f"{c} long" for c in PAIR) + ", observed double, p_value double, shifts long")


def block_order(seed: int, turn: int, blocks: int) -> list[int]:
    """The blocks by the md5 of ``seed:turn:block``: a permutation that any engine can repeat."""
    return sorted(range(blocks), key=lambda b: hashlib.md5(f"{seed}:{turn}:{b}".encode()).hexdigest())


def block_permutation_test(aligned: DataFrame, block: int = 3, permutations: int = 19, seed: int = 0) -> DataFrame:
    """How often correlation is as negative as observed when y's blocks are dealt anew, the observation itself counted.

    The least p_value is so 1 / (permutations + 1).  It is missing with fewer than four points, or if one side is constant.
    """

    def kernel(x: np.ndarray, y: np.ndarray) -> list[tuple]:
        observed = _pearson(x, y)
        if observed is None or len(x) < 4:
            return [(observed, None, 0)]
        parts = [y[i : i + block] for i in range(0, len(y), block)]
        u, v = (x - x.mean()) / x.std(), y.std()
        made = np.stack([np.concatenate([parts[b] for b in block_order(seed, turn, len(parts))]) for turn in range(permutations)]) if permutations else np.zeros((0, len(y)))
        r = (made - y.mean()) @ u / (len(y) * v)
        return [(observed, float((1 + (r <= observed + 1e-9).sum()) / (permutations + 1)), permutations)]

    return _by_pair(aligned, "observed double, p_value double, permutations long", kernel)


def delayed_growth(series: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Growth of the late peak over the least value before it, relative to the series' peak."""
    low = F.min("a").over(Window.partitionBy("source_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    g = series.select("source_id", "n", "a", low.alias("low"), F.max("a").over(Window.partitionBy("source_id")).alias("top"))
    return g.groupBy("source_id").agg(F.max(F.col("a") - F.col("low")).alias("growth"), F.max("top").alias("top")).select("source_id", ratio(F.col("growth"), F.col("top")).alias("growth_fraction"), F.coalesce(ratio(F.col("growth"), F.col("top")) >= fraction, F.lit(False)).alias("supported"))


def recovery(series: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Least value in the first two thirds, the highest after it, and the share of the drop that is regained."""
    size = F.count("*").over(Window.partitionBy("source_id"))
    s = series.select("source_id", "n", "a", size.alias("size"))
    low = s.filter(F.col("n") < F.floor(F.col("size") * 2 / 3)).groupBy("source_id").agg(F.min(F.struct("a", "n")).alias("m"))
    j = s.join(low, "source_id").groupBy("source_id").agg(F.first("m.a").alias("low"), F.max(F.when(F.col("n") <= F.col("m.n"), F.col("a"))).alias("before"), F.max(F.when(F.col("n") > F.col("m.n"), F.col("a"))).alias("after"))
    share = ratio(F.col("after") - F.col("low"), F.col("before") - F.col("low"))
    return j.select("source_id", "low", "before", "after", share.alias("recovery_fraction"), F.coalesce(share >= fraction, F.lit(False)).alias("supported"))


def pair_energy(aligned: DataFrame, limit: float = 0.35, stable: float = 0.7) -> DataFrame:
    """Course of the summed energy: mean, deviation, relative range, share of points near the mean."""
    p = aligned.select(*PAIR, (F.col("ex") + F.col("ey")).alias("e"))
    p = p.withColumn("mean", F.avg("e").over(Window.partitionBy(*PAIR)))
    m = p.groupBy(*PAIR, "mean").agg(F.stddev_pop("e").alias("std"), ratio(F.max("e") - F.min("e"), F.first("mean")).alias("relative_range"), F.avg((F.abs(F.col("e") - F.col("mean")) <= limit * F.col("mean")).cast("double")).alias("stable_fraction"))
    return m.select(*PAIR, "mean", "std", "relative_range", ratio(F.col("std"), F.col("mean")).alias("variation"), "stable_fraction", ((F.col("relative_range") <= limit) | (F.col("stable_fraction") >= stable)).alias("conserved"))


def dominance(aligned: DataFrame, hysteresis: float = 1.05) -> DataFrame:
    """Which source leads, with hysteresis: a lead holds until the other is clearly ahead."""
    w = Window.partitionBy(*PAIR).orderBy("n")
    lead = F.when(F.col("x") >= hysteresis * F.col("y"), "a").when(F.col("y") >= hysteresis * F.col("x"), "b")
    held = aligned.select(*PAIR, "n", lead.alias("now")).withColumn("lead", F.last("now", ignorenulls=True).over(w))
    s = held.withColumn("before", F.lag("lead").over(w))
    return s.groupBy(*PAIR).agg(F.count_if(F.col("lead") != F.col("before")).alias("switches"), F.count_if(F.col("lead") == "a").alias("a_points"), F.count_if(F.col("lead") == "b").alias("b_points")).withColumn("alternating", F.col("switches") >= 2)


def modulation_period(series: DataFrame) -> DataFrame:
    """Median interval between local maxima: points no lower than the one before and above the next, so that a plateau counts at its end."""
    w = Window.partitionBy("source_id").orderBy("n")
    s = series.select("source_id", "n", "t_s", "a", F.lag("a").over(w).alias("l"), F.lead("a").over(w).alias("h")).filter("a >= l AND a > h")
    return s.select("source_id", (F.col("t_s") - F.lag("t_s").over(w)).alias("gap")).groupBy("source_id").agg(F.median("gap").alias("period_s"), F.count("*").alias("maxima"))


def beating(frequencies: DataFrame, tolerance: float = 0.25, farthest_hz: float = 5.0) -> DataFrame:
    """Expected beat period of (source_a, source_b, fa, fb, period_s) against the observed one."""
    apart = F.abs(F.col("fa") - F.col("fb"))
    expected = ratio(F.lit(1.0), apart)
    possible = (apart <= farthest_hz) & (F.abs(F.col("period_s") - expected) <= tolerance * expected)
    return frequencies.select(*PAIR, apart.alias("separation_hz"), expected.alias("expected_s"), "period_s", F.coalesce(possible, F.lit(False)).alias("possible_beating"))


#: Weights of the score's parts.
WEIGHTS = {"opposed": 1.0, "negative": 1.0, "lagged": 0.75, "growth": 0.75, "recovery": 0.5, "alternating": 0.5, "conserved": 0.5, "tracking": 0.25}


def exchange_score(parts: DataFrame, support: float = 0.6, reserve: float = 0.4, missing: float = 0.05, beat: float = 0.2) -> DataFrame:
    """Score and status of pairs from boolean parts named as WEIGHTS, zero_lag_r and possible_beating."""
    gained = sum((F.when(F.col(k), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    penalty = F.when(F.col("zero_lag_r").isNull(), missing).otherwise(0.0) + F.when(F.col("growth"), 0.0).otherwise(missing) + F.when(F.col("possible_beating"), beat).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gained - penalty) / sum(WEIGHTS.values())))
    status = (
        F.when(F.col("zero_lag_r").isNull(), "insufficient_evidence")
        .when(~F.col("opposed"), "not_supported")
        .when(~F.col("negative"), "inconclusive")
        .when(score >= support, F.when(F.col("possible_beating"), "supported_with_reservations").otherwise("supported"))
        .when(score >= reserve, "inconclusive")
        .otherwise("not_supported")
    )
    return parts.select("*", score.alias("score"), status.alias("status"))
