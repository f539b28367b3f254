"""Hypotheses about chains, their parameters and quality factors.

All evidence is aggregated by chain; decisions are ordered CASE expressions.  Default limits
and weights are keyword arguments.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import le_tol, ratio

KEY = "chain_id"


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def upper_limit_score(value: Column, limit: float) -> Column:
    """1 at zero, 0 at the limit and beyond; missing stays missing."""
    return F.when(value.isNotNull(), 1 - _clip(value / limit))


def lower_limit_score(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), _clip(value / limit))


def mean_present(*values: Column) -> Column:
    some = F.array_compact(F.array(*values))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def evidence(nodes: DataFrame, labels: int = 5) -> DataFrame:
    """Coverage, frequency, association, tracking, decay and impact evidence of each chain.

    nodes: chain_id, node_index, frequency_hz, cost, tau_s, coverage, impact_excited.
    """
    w = Window.partitionBy(KEY).orderBy("node_index")
    n = nodes.select("*", (F.col("frequency_hz") - F.lag("frequency_hz").over(w)).alias("step"), F.when(F.col("tau_s") > 0, F.ln("tau_s")).alias("log_tau"))
    return n.groupBy(KEY).agg(
        F.count("*").alias("condition_count"), F.least(F.lit(1.0), F.count("*") / labels).alias("condition_coverage"), F.max(F.abs("step")).alias("max_step_hz"),
        F.when(F.count("*") > 1, F.abs(F.max_by("frequency_hz", "node_index") - F.min_by("frequency_hz", "node_index"))).alias("total_change_hz"),
        F.stddev_pop("frequency_hz").alias("trajectory_rmse_hz"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"), F.avg("coverage").alias("mean_tracking_coverage"),
        F.count("log_tau").alias("tau_count"), F.when(F.count("log_tau") > 1, F.max("log_tau") - F.min("log_tau")).alias("log_tau_range"), F.when(F.count("log_tau") > 1, F.stddev_pop("log_tau")).alias("log_tau_std"),
        F.count("impact_excited").alias("impact_count"), F.avg(F.col("impact_excited").cast("double")).alias("impact_fraction"),
    )


def _frequency_evidence(e: DataFrame, step_hz: float = 2.0, total_hz: float = 5.0, rmse_hz: float = 1.0) -> DataFrame:
    many = F.col("condition_count") > 1
    ok = lambda c, limit: F.when(many, le_tol(F.col(c), F.lit(limit)))
    score = F.when(many, mean_present(upper_limit_score(F.col("max_step_hz"), step_hz), upper_limit_score(F.col("total_change_hz"), total_hz), upper_limit_score(F.col("trajectory_rmse_hz"), rmse_hz)))
    return e.select("*", ok("max_step_hz", step_hz).alias("step_ok"), ok("total_change_hz", total_hz).alias("total_ok"), ok("trajectory_rmse_hz", rmse_hz).alias("rmse_ok"), score.alias("frequency_score"))


def frequency_evidence(e: DataFrame, step_hz: float = 2.0, total_hz: float = 5.0, rmse_hz: float = 1.0) -> DataFrame:
    return _frequency_evidence(e, step_hz, total_hz, rmse_hz).select(KEY, "max_step_hz", "total_change_hz", "trajectory_rmse_hz", "step_ok", "total_ok", "rmse_ok", "frequency_score")


def _decay_evidence(e: DataFrame, range_limit: float = 0.5, std_limit: float = 0.25, minimum: int = 2) -> DataFrame:
    enough = F.col("tau_count") >= minimum
    fine = F.when(enough, le_tol(F.col("log_tau_range"), F.lit(range_limit)) & le_tol(F.col("log_tau_std"), F.lit(std_limit)))
    score = F.when(enough, mean_present(upper_limit_score(F.col("log_tau_range"), range_limit), upper_limit_score(F.col("log_tau_std"), std_limit)))
    return e.select("*", fine.alias("consistent"), score.alias("decay_score"))


def decay_evidence(e: DataFrame, range_limit: float = 0.5, std_limit: float = 0.25, minimum: int = 2) -> DataFrame:
    return _decay_evidence(e, range_limit, std_limit, minimum).select(KEY, "tau_count", "log_tau_range", "log_tau_std", "consistent", "decay_score")


#: Weights of the score's components.
WEIGHTS = {"coverage": 1.0, "frequency": 4.0, "association": 1.0, "tracking": 1.0, "decay": 1.0, "impact": 1.0}


def scores(e: DataFrame, penalty: float = 0.05) -> DataFrame:
    """Weighted mean of the available component scores less the penalty of each missing evidence."""
    j = _frequency_evidence(_decay_evidence(e))
    part = {
        "coverage": F.col("condition_coverage"),
        "frequency": F.col("frequency_score"),
        "association": F.when(F.col("mean_cost").isNotNull(), mean_present(upper_limit_score(F.col("max_cost"), 1.0), upper_limit_score(F.col("mean_cost"), 0.75))),
        "tracking": lower_limit_score(F.col("mean_tracking_coverage"), 0.8),
        "decay": F.col("decay_score"),
        "impact": F.when(F.col("impact_count") > 0, F.col("impact_fraction")),
    }
    gained = sum((F.coalesce(part[k] * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(part[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    missing = sum((F.when(part[k].isNull(), 1).otherwise(0) for k in ("tracking", "decay", "impact")), F.lit(0))
    return j.select("*", *(v.alias(f"{k}_part") for k, v in part.items()), missing.alias("missing_evidence"), _clip(ratio(gained, weight) - penalty * missing).alias("score"))


def hypotheses(e: DataFrame, accept: float = 0.75, reserve: float = 0.55) -> DataFrame:
    """One row a chain: status accepted, accepted_with_reservations, inconclusive, insufficient_evidence or rejected."""
    s = scores(e)
    bad = lambda c: F.coalesce(~F.col(c), F.lit(False)).cast("int")
    rejections = bad("step_ok") + bad("total_ok") + bad("rmse_ok") + F.coalesce((F.col("max_cost") > 1.0).cast("int"), F.lit(0)) + F.coalesce((F.col("mean_cost") > 0.75).cast("int"), F.lit(0)) + bad("consistent")
    reservations = F.col("missing_evidence") + F.coalesce((F.col("impact_fraction") < 0.5).cast("int"), F.lit(0)) + F.coalesce((F.col("mean_tracking_coverage") < 0.8).cast("int"), F.lit(0))
    status = (
        F.when(F.col("condition_coverage") < 1, "rejected")
        .when(F.col("condition_count") < 2, "insufficient_evidence")
        .when(rejections > 0, "rejected")
        .when(reservations > 0, F.when(F.col("score") >= reserve, "accepted_with_reservations").otherwise("inconclusive"))
        .when(F.col("score") >= accept, "accepted")
        .otherwise("inconclusive")
    )
    return s.select(KEY, "condition_count", "score", rejections.alias("rejection_count"), reservations.alias("reservation_count"), status.alias("status"))


# ---- parameters ---------------------------------------------------------------------


def weighted_median(values: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """First value at which the running share of weight reaches one half."""
    w = Window.partitionBy(by).orderBy(value)
    run = values.filter(F.col(weight) > 0).select(by, value, F.sum(weight).over(w).alias("part"), F.sum(weight).over(Window.partitionBy(by)).alias("total"))
    return run.groupBy(by).agg(F.min(F.when(F.col("part") >= 0.5 * F.col("total") - 1e-12, F.col(value))).alias("weighted_median"))


def locations(nodes: DataFrame) -> DataFrame:
    """Frequency of each chain by every location method, and its dispersion."""
    w = F.coalesce("coverage", F.lit(0.0))
    counted, over = F.when(w > 0, w), Window.partitionBy(KEY)
    n = nodes.select("*", F.sum(counted).over(over.orderBy("frequency_hz")).alias("__part"), F.sum(counted).over(over).alias("__total"))
    # the median as ``weighted_median`` has it, inside the one grouping
    middle = F.min(F.when((w > 0) & (F.col("__part") >= 0.5 * F.col("__total") - 1e-12), F.col("frequency_hz")))
    return n.groupBy(KEY).agg(
        F.count("*").alias("n"), F.avg("frequency_hz").alias("mean_hz"), F.median("frequency_hz").alias("median_hz"), F.exp(F.avg(F.ln("frequency_hz"))).alias("geometric_hz"),
        ratio(F.sum(F.col("frequency_hz") * w), F.sum(w)).alias("weighted_mean_hz"), F.stddev_samp("frequency_hz").alias("std_hz"), (F.max("frequency_hz") - F.min("frequency_hz")).alias("range_hz"),
        (F.stddev_pop("frequency_hz") / F.avg("frequency_hz")).alias("variation"), middle.alias("weighted_median_hz"),
    )


def normalised_weights(nodes: DataFrame, weight: str) -> DataFrame:
    """Each node's share of its chain's weight; missing weights count as zero, all-zero ones as equal."""
    w = F.coalesce(weight, F.lit(0.0))
    over = Window.partitionBy(KEY)
    total = F.sum(w).over(over)
    return nodes.select(KEY, "node_index", F.when(total > 0, w / total).otherwise(1 / F.count("*").over(over)).alias("weight"))


def trajectories(nodes: DataFrame) -> DataFrame:
    """Line through frequency over the place in the chain; r² is missing for a constant."""
    m = nodes.groupBy(KEY).agg(
        F.count("*").alias("n"), F.regr_sxx("frequency_hz", "node_index").alias("xx"), F.regr_syy("frequency_hz", "node_index").alias("yy"), F.regr_sxy("frequency_hz", "node_index").alias("xy"),
        (F.max_by("frequency_hz", "node_index") - F.min_by("frequency_hz", "node_index")).alias("signed_change_hz"),
    )
    fine = F.col("xx") > 0
    slope = F.col("xy") / F.col("xx")
    sse = F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * slope)
    return m.select(KEY, "n", "signed_change_hz", F.when(fine, slope).alias("slope_hz_per_step"), F.when(fine & (F.col("yy") > 1e-12), 1 - sse / F.col("yy")).alias("r_squared"), F.when(fine, F.sqrt(sse / F.col("n"))).alias("rmse_hz"))


def uncertainties(nodes: DataFrame) -> DataFrame:
    """Sample deviation, standard error, scaled median absolute deviation and the largest of them."""
    m = nodes.withColumn("middle", F.median("frequency_hz").over(Window.partitionBy(KEY))).groupBy(KEY).agg(
        F.stddev_samp("frequency_hz").alias("std_hz"), F.when(F.count("*") > 1, F.stddev_samp("frequency_hz") / F.sqrt(F.count("*"))).alias("standard_error_hz"), (1.4826 * F.median(F.abs(F.col("frequency_hz") - F.col("middle")))).alias("scaled_mad_hz")
    )
    return m.withColumn("conservative_hz", F.greatest("std_hz", "standard_error_hz", "scaled_mad_hz"))


def decay(nodes: DataFrame, range_limit: float = 0.5, std_limit: float = 0.25, minimum: int = 2) -> DataFrame:
    """Geometric-mean decay time, its spread and multiplicative bounds, decay rates and times to -20, -40 and -60 dB."""
    m = nodes.filter("tau_s > 0").groupBy(KEY).agg(F.count("*").alias("tau_count"), F.avg(F.ln("tau_s")).alias("lm"), (F.max(F.ln("tau_s")) - F.min(F.ln("tau_s"))).alias("log_range"), F.stddev_pop(F.ln("tau_s")).alias("log_std"), F.stddev_samp(F.ln("tau_s")).alias("ls"))
    tau = F.exp("lm")
    valid = (F.col("tau_count") >= minimum) & le_tol(F.col("log_range"), F.lit(range_limit)) & le_tol(F.col("log_std"), F.lit(std_limit))
    return m.select(
        KEY, "tau_count", tau.alias("tau_s"), "log_range", "log_std", valid.alias("valid"), (tau * F.exp(-F.col("ls"))).alias("lower_s"), (tau * F.exp("ls")).alias("upper_s"), (1 / tau).alias("amplitude_rate"), (2 / tau).alias("energy_rate"),
        *((tau * math.log(10) * k).alias(f"to_minus_{20 * k}_db_s") for k in (1, 2, 3)),
    )


_DRAWS = 16  # draws whose places are kept from batch to batch
_AT_ONCE = 1 << 21


def _hashes(seed: int, first: int, last: int, n: int) -> np.ndarray:
    """What the draws of samples ``first`` to ``last`` are taken by, a row a sample."""
    return np.array([[int(hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:8], 16) for i in range(n)] for k in range(first, last)], np.int64)


def _resampled(values: np.ndarray, hashes: Callable[[int, int], np.ndarray], samples: int, middle: bool) -> np.ndarray:
    """The location of every sample (a row each) of every row of ``values``."""
    n = values.shape[1]
    out, columns = np.empty((samples, len(values))), np.ascontiguousarray(values.T)
    step = max(1, _AT_ONCE // (n * max(1, len(values))))
    for k in range(0, samples, step):
        places = hashes(k, min(k + step, samples)) % n
        if middle:
            drawn = np.sort(columns[places], axis=1)
            out[k : k + step] = (drawn[:, (n + 1) // 2 - 1] + drawn[:, n // 2]) / 2
        else:
            total = np.zeros((len(places), len(values)))
            for draw in places.T:
                total += columns[draw]
            out[k : k + step] = total / n
    return out


def bootstrap(nodes: DataFrame, value: str = "frequency_hz", location: str = "mean", samples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Bounds and deviation of a chain's location from resampling with replacement.

    location: mean, median or geometric (the mean in the domain of logarithms).  Missing values, and others than positive
    ones for geometric, take no part.  Draws come from the md5 of ``seed:sample:draw``, so any
    engine repeats them; they are the same for all chains and are hashed once a task.  A chain's values, one a label at most,
    are an array; chains of equal length are resampled together, a bounded part at a time.
    """
    v = F.ln(value) if location == "geometric" else F.col(value)
    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0 if location == "geometric" else F.lit(True))
    held = nodes.filter(fine).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("node_index", v.cast("double").alias("v")))).alias("s")).select(KEY, F.col("s.v").alias("v"))
    schema = StructType([held.schema[KEY], *(StructField(c, DoubleType()) for c in ("lower", "upper", "std"))])
    arrow = to_arrow_schema(schema)

    def quantile(m: np.ndarray, q: float) -> np.ndarray:
        low, share = int(q * (samples - 1)), q * (samples - 1) % 1
        one, two = m[low], m[min(low + 1, samples - 1)]
        return one + (two - one) * share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _hashes(seed, 0, samples, _DRAWS)
        for batch in batches:
            lists = batch.column("v")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            begin, size = ends[:-1], np.diff(ends)
            for n in np.unique(size):
                hashes = (lambda i, j, n=n: known[i:j, :n]) if n <= _DRAWS else (lambda i, j, n=n: _hashes(seed, i, j, n))
                rows = np.flatnonzero(size == n)
                step = max(1, _AT_ONCE // max(samples, int(n)))
                for i in range(0, len(rows), step):
                    x = rows[i : i + step]
                    m = _resampled(flat[begin[x][:, None] + np.arange(n)], hashes, samples, location == "median")
                    with np.errstate(all="ignore"):
                        m = np.sort(np.exp(m) if location == "geometric" else m, axis=0)
                        # sums in order, as a fold over the sorted samples has them
                        mean, square = np.zeros(len(x)), np.zeros(len(x))
                        for row in m:
                            mean += row
                        mean /= samples
                        for row in m:
                            square += (row - mean) * (row - mean)
                        std = np.sqrt(square / (samples - 1)) if samples > 1 else np.full(len(x), np.nan)
                        columns = [batch.column(KEY).take(pa.array(x)), *(pa.array(c) for c in (quantile(m, (1 - level) / 2), quantile(m, (1 + level) / 2))), pa.array(std, from_pandas=samples < 2)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return held.mapInArrow(run, schema)


def parameter_status(hypothesis: DataFrame, place: DataFrame, decays: DataFrame, variation: float = 0.02) -> DataFrame:
    j = hypothesis.join(place, KEY).join(decays.select(KEY, "tau_s", F.col("valid").alias("tau_valid")), KEY, "left")
    status = (
        F.when(F.col("status").isin("rejected", "insufficient_evidence", "inconclusive"), "insufficient_evidence")
        .when((F.col("n") < 2) | (F.col("variation") > variation), "insufficient_evidence")
        .when(~F.coalesce("tau_valid", F.lit(False)), "partial")
        .when(F.col("status") == "accepted_with_reservations", "valid_with_reservations")
        .otherwise("valid")
    )
    return j.select(KEY, F.col("mean_hz").alias("frequency_hz"), "tau_s", status.alias("parameter_status"))


# ---- quality factors ----------------------------------------------------------------


def q_from_decay(params: DataFrame) -> DataFrame:
    """Q = π f τ and its linearly propagated uncertainty, from (frequency_hz, tau_s, frequency_u, tau_u)."""
    q = F.pi() * F.col("frequency_hz") * F.col("tau_s")
    u = q * F.sqrt(F.pow(F.col("frequency_u") / F.col("frequency_hz"), F.lit(2.0)) + F.pow(F.col("tau_u") / F.col("tau_s"), F.lit(2.0)))
    fine = (F.col("frequency_hz") > 1e-12) & (F.col("tau_s") > 1e-12)
    return params.select("*", F.when(fine, q).alias("q_decay"), F.when(fine, u).alias("q_decay_u"))


def crossings(f: np.ndarray, mag: np.ndarray, targets: np.ndarray, level_db: float) -> dict[str, np.ndarray]:
    """For each target the local peak nearest to it and where the spectrum falls to ``level_db`` of it on either side (NaN: nowhere).

    A table of minima over spans of powers of two is descended from the peak outward, all targets at a
    time: a crossing costs the logarithm of the spectrum's length, however wide the peak.
    """
    tops = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] > mag[2:])) + 1 if len(mag) > 2 else np.zeros(0, int)
    if not len(tops):
        return {}
    right = np.searchsorted(f[tops], targets)
    near = np.stack([tops[np.clip(right - 1, 0, len(tops) - 1)], tops[np.clip(right, 0, len(tops) - 1)]])
    away = np.abs(f[near] - targets)
    first = (away[0] < away[1]) | ((away[0] == away[1]) & (mag[near[0]] >= mag[near[1]]))
    peak = np.where(first, near[0], near[1])
    cut = mag[peak] * 10 ** (level_db / 20)
    table = [mag]
    while 2 << (len(table) - 1) <= len(mag):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    low, high = peak.copy(), peak.copy()
    for step in reversed(range(len(table))):
        span, least = 1 << step, table[step]
        to = low - span
        low = np.where((to >= 0) & (least[np.maximum(to, 0)] > cut), to, low)
        fits = high + span < len(mag)
        high = np.where(fits & (least[np.minimum(high + 1, len(least) - 1)] > cut), high + span, high)
    a, z = low - 1, high + 1

    def between(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        there = (outer >= 0) & (outer < len(mag))
        o, i = np.clip(outer, 0, len(mag) - 1), inner
        return np.where(there, f[o] + (cut - mag[o]) / (mag[i] - mag[o]) * (f[i] - f[o]), np.nan)

    with np.errstate(divide="ignore", invalid="ignore"):
        return {"peak_hz": f[peak], "low_hz": between(a, low), "high_hz": between(z, high)}


def bandwidths(bins: DataFrame, targets: DataFrame, level_db: float = -3.0) -> DataFrame:
    """Width of the local peak nearest to each target at ``level_db``: interpolated crossings on either side.

    bins: recording_id, k, f_hz, mag; targets: recording_id, target_hz.  A recording's spectrum and its
    targets meet once; bins and targets are never joined.
    """
    kind = bins.schema["recording_id"].dataType.simpleString()
    names = ("peak_hz", "low_hz", "high_hz")

    def run(key: tuple, spectrum: pa.Table, wanted: pa.Table) -> pa.Table:
        spectrum = spectrum.sort_by("k")
        goal = np.unique(wanted.column("target_hz").drop_null().to_numpy(zero_copy_only=False)) if len(wanted) else np.zeros(0)
        found = crossings(spectrum.column("f_hz").to_numpy(), spectrum.column("mag").to_numpy(), goal, level_db) if len(spectrum) and len(goal) else {}
        rows = len(goal) if found else 0
        return pa.table(
            [pa.array([key[0].as_py()] * rows, key[0].type), pa.array(goal[:rows]), *(pa.array(found.get(c, np.zeros(0)), from_pandas=True) for c in names)], ["recording_id", "target_hz", *names]
        )

    both = bins.select("recording_id", "k", "f_hz", "mag").groupBy("recording_id").cogroup(targets.select(F.col("recording_id").alias("of"), F.col("target_hz").cast("double").alias("target_hz")).groupBy("of"))
    out = both.applyInArrow(run, f"recording_id {kind}, target_hz double, peak_hz double, low_hz double, high_hz double")
    out = out.withColumn("bandwidth_hz", F.col("high_hz") - F.col("low_hz"))
    return out.withColumn("q_bandwidth", ratio(F.col("peak_hz"), F.col("bandwidth_hz")))


def resolution_class(width: Column, resolution: Column) -> Column:
    x = width / resolution
    return F.when(x.isNull(), "unavailable").when(x < 1, "unresolved").when(x < 2, "resolution_limited").when(x < 4, "marginally_resolved").otherwise("well_resolved")


def compare_q(both: DataFrame, relative: float = 0.20, log_limit: float = math.log(1.25), partial: float = 2.0) -> DataFrame:
    """Symmetric relative and log difference of the two estimates, and how consistent they are."""
    a, b = F.col("q_decay"), F.col("q_bandwidth")
    two = a.isNotNull() & b.isNotNull()
    rel = F.when(two, F.abs(a - b) / ((a + b) / 2))
    log = F.when(two, F.abs(F.ln(a / b)))
    kind = F.when(~two, "unavailable").when((rel <= relative) & (log <= log_limit), "consistent").when((rel <= partial * relative) & (log <= partial * log_limit), "partially_consistent").otherwise("inconsistent")
    return both.select("*", rel.alias("relative_difference"), log.alias("log_difference"), kind.alias("consistency"))


def combine_q(compared: DataFrame) -> DataFrame:
    """Geometric mean where consistent; the only one available; decay where partly consistent; missing otherwise."""
    a, b, c = F.col("q_decay"), F.col("q_bandwidth"), F.col("consistency")
    q = F.when(c == "consistent", F.sqrt(a * b)).when(c == "unavailable", F.coalesce(a, b)).when(c == "partially_consistent", a)
    status = F.when(a.isNull() & b.isNull(), "insufficient_evidence").when(c == "inconsistent", "inconclusive").when(c == "unavailable", "partial").when(c == "partially_consistent", "valid_with_reservations").otherwise("valid")
    return compared.select("*", q.alias("representative_q"), ((a + b) / 2).alias("arithmetic_q"), status.alias("q_status"))
