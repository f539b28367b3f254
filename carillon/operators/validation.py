"""Estimates against known truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import is_finite, ratio
from .kernels import nearest_pairs

_EPS = 1e-9


def value_errors(truth: DataFrame, found: DataFrame, on: list[str], absolute: float, relative: float) -> DataFrame:
    """Signed, absolute, relative and log error of ``estimate`` against ``true``; a missing estimate fails."""
    j = truth.join(found, on, "left")
    e = F.col("estimate") - F.col("true")
    rel = F.when(F.col("true") != 0, F.abs(e) / F.abs("true"))
    status = F.when(F.col("estimate").isNull(), "failed").when((F.abs(e) <= absolute) & (rel <= relative), "passed").otherwise("failed")
    return j.select(
        *on, "true", "estimate", e.alias("signed_error"), F.abs(e).alias("absolute_error"), rel.alias("relative_error"), F.when((F.col("estimate") > 0) & (F.col("true") > 0), F.ln(F.col("estimate") / F.col("true"))).alias("log_error"),
        status.alias("status"), F.when(F.col("estimate").isNull(), "no_valid_estimate").alias("reason"),
    )


def bandwidth_errors(truth: DataFrame, resolution: float, relative: float = 0.5) -> DataFrame:
    """Widths of (true, estimate): not identifiable without truth, limited where the truth is under two resolutions."""
    rel = ratio(F.abs(F.col("estimate") - F.col("true")), F.col("true"))
    status = F.when(F.col("true").isNull(), "not_identifiable").when(F.col("true") / resolution < 2, "resolution_limited").when(F.col("estimate").isNull(), "failed").when(rel <= relative, "passed").otherwise("failed")
    return truth.select("*", rel.alias("relative_error"), status.alias("status"))


def set_metrics(expected: DataFrame, found: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Correct, missing and wrong members with precision, recall and F1 of each group."""
    e = expected.select(*group, *key).distinct().withColumn("e", F.lit(1))
    f = found.select(*group, *key).distinct().withColumn("f", F.lit(1))
    m = e.join(f, [*group, *key], "full").groupBy(*group).agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("correct"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("incorrect"))
    return set_rates(m)


def set_rates(m: DataFrame) -> DataFrame:
    """Precision, recall and F1 of counts: correct, missing, incorrect."""
    p = ratio(F.col("correct").cast("double"), (F.col("correct") + F.col("incorrect")).cast("double"))
    r = ratio(F.col("correct").cast("double"), (F.col("correct") + F.col("missing")).cast("double"))
    return m.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def trial_quantiles(errors: DataFrame, by: list[str], minimum_pass: float = 0.8) -> DataFrame:
    """5th, 50th and 95th percentile of trial errors, and whether enough trials passed."""
    q = F.percentile("error", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    m = errors.groupBy(*by).agg(F.count("*").alias("trials"), q.alias("q"), F.avg(F.col("passed").cast("double")).alias("pass_fraction"))
    return m.select(*by, "trials", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"), "pass_fraction", (F.col("pass_fraction") >= minimum_pass).alias("passed"))


def confusion(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Counts of expected against found status."""
    return expected.join(found, on, "full").groupBy("expected_status", "found_status").agg(F.count("*").alias("n"))


def match_tracks(components: DataFrame, tracks: DataFrame, by: str = "scenario", limit_hz: float = 2.0) -> DataFrame:
    """Tracks (by, track_id, frequency_hz) given to components (by, component_id, f0): nearest pairs first, each once.

    Of equally near pairs that with the least component goes first, then that with the least track.  No pairs are listed: both sides
    lie on one scale, cut where neighbours are farther apart than the limit, and a run's task gets its components and tracks alone.
    An id has one frequency; repeated rows of it are one.
    """
    place = lambda c: F.col(c).cast("double").alias("hz")
    kind = {"component_id": components.schema["component_id"].dataType, "track_id": tracks.schema["track_id"].dataType}
    own = components.select(by, place("f0"), F.col("component_id"), F.lit(None).cast(kind["track_id"]).alias("track_id"), F.lit(True).alias("wanted"))
    both = own.unionByName(tracks.select(by, place("frequency_hz"), F.lit(None).cast(kind["component_id"]).alias("component_id"), "track_id", F.lit(False).alias("wanted")))
    both = both.filter(is_finite(F.col("hz"))).distinct().withColumn("cell", F.floor(F.col("hz") / (4 * limit_hz + _EPS)).cast("long"))
    # cells are chained, not rows: a run goes on where a cell's first place is within the limit of the last one before
    w = Window.partitionBy(by).orderBy("cell")
    cells = both.groupBy(by, "cell").agg(F.min("hz").alias("low"), F.max("hz").alias("high"))
    fresh = F.lag("high").over(w).isNull() | (F.col("low") - F.lag("high").over(w) > limit_hz)
    cells = cells.withColumn("at", F.when(fresh, F.col("cell"))).select(by, "cell", F.last("at", ignorenulls=True).over(w).alias("run"))
    schema = StructType([components.schema[by], components.schema["component_id"], tracks.schema["track_id"]]).add("apart_hz", "double")
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        wanted = table.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        parts = []
        for side, name in ((wanted, "component_id"), (~wanted, "track_id")):
            part = table.filter(pa.array(side)).sort_by([(name, "ascending")])  # places are in the order of ids
            parts.append((part.column(name), part.column("hz").to_numpy()))
        (components_, f), (tracks_, g) = parts
        i, j = nearest_pairs(f, g, limit_hz)
        columns = {by: pa.repeat(table.column(by)[0], len(i)), "component_id": components_.take(pa.array(i)), "track_id": tracks_.take(pa.array(j)), "apart_hz": pa.array(np.abs(f[i] - g[j]))}
        return pa.table([columns[c] for c in arrow.names], arrow.names).cast(arrow)

    found = both.join(cells.hint("merge"), [by, "cell"]).drop("cell").groupBy(by, "run").applyInArrow(run, schema)
    return components.select(by, "component_id").join(found.hint("merge"), [by, "component_id"], "left").withColumn("status", F.when(F.col("track_id").isNull(), "missed").otherwise("matched"))


def candidate_recovery(components: DataFrame, candidates: DataFrame, by: str = "scenario", limit_hz: float = 2.0, limit_relative: float = 0.01, most_missed: int = 0, most_false: int = 0) -> DataFrame:
    """Expected components found, missed, found but rejected, and false candidates of each scenario, and whether it passes.

    components: by, component_id, f0, detectable; candidates: by, candidate_id, frequency_hz, accepted.
    """
    wanted = components.filter("detectable").select(by, "component_id", "f0")
    given = match_tracks(wanted, candidates.select(by, F.col("candidate_id").alias("track_id"), "frequency_hz"), by, limit_hz).join(wanted.hint("merge"), [by, "component_id"])
    # within both limits
    given = given.withColumn("track_id", F.when(F.col("apart_hz") / F.col("f0") <= limit_relative, F.col("track_id")))
    taken = given.filter("track_id IS NOT NULL").select(by, F.col("track_id").alias("candidate_id"), F.lit(True).alias("taken"))
    c = candidates.join(taken.hint("merge"), [by, "candidate_id"], "left").groupBy(by).agg(
        F.count_if(F.col("taken").isNull() & F.col("accepted")).alias("false_count"), F.count_if(F.col("taken").isNotNull() & ~F.col("accepted")).alias("rejected_expected_count")
    )
    g = given.groupBy(by).agg(F.count("*").alias("expected_count"), F.count("track_id").alias("matched_count"))
    out = g.join(c, by, "left").fillna(0, ["false_count", "rejected_expected_count"]).withColumn("missed_count", F.col("expected_count") - F.col("matched_count"))
    return out.withColumn("passed", (F.col("missed_count") <= most_missed) & (F.col("false_count") <= most_false) & (F.col("rejected_expected_count") == 0))


def exchange_recovery(expected: DataFrame, barred: DataFrame, found: DataFrame, by: str = "scenario") -> DataFrame:
    """True, false and missed exchanging pairs of each scenario with precision, recall, F1 and lag error.

    expected, barred: by, source_a, source_b (in either order), expected also lag_s; found: the same with status and best_lag_s.
    """
    pair = [F.least("source_a", "source_b").alias("a"), F.greatest("source_a", "source_b").alias("b")]
    e = expected.select(by, *pair, F.col("lag_s").alias("true_lag_s"), F.lit(True).alias("e"))
    n = barred.select(by, *pair, F.lit(True).alias("n"))
    f = found.select(by, *pair, F.col("status").isin("supported", "supported_with_reservations").alias("s"), (F.col("status") == "inconclusive").alias("i"), "best_lag_s")
    j = e.join(n, [by, "a", "b"], "full").join(f, [by, "a", "b"], "full")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    m = j.groupBy(by).agg(
        F.count_if(is_("e") & is_("s")).alias("true_positive"), F.count_if(is_("n") & is_("s")).alias("false_positive"), F.count_if(is_("e") & ~is_("s")).alias("false_negative"), F.count_if(is_("s")).alias("supported"),
        F.count_if(is_("i")).alias("inconclusive"), F.max(F.when(is_("e") & is_("s"), F.abs(F.col("best_lag_s") - F.col("true_lag_s")))).alias("lag_error_s"),
    )
    tp = F.col("true_positive").cast("double")
    p = F.when(F.col("supported") > 0, tp / F.col("supported")).when(F.col("true_positive") + F.col("false_negative") == 0, 1.0)
    r = F.when(F.col("true_positive") + F.col("false_negative") > 0, tp / (F.col("true_positive") + F.col("false_negative"))).otherwise(1.0)
    m = m.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))
    return m.withColumn("passed", (F.col("false_positive") == 0) & (F.col("false_negative") == 0))


def scenario_status(parts: DataFrame, by: str = "scenario") -> DataFrame:
    """One verdict for each scenario from (by, part, status) of its validations: failed if any failed, then insufficient
    evidence if none passed, then with reservations if any is not identifiable or limited, else passed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = parts.groupBy(by).agg(F.count("*").alias("parts"), n("passed").alias("passed_count"), n("failed").alias("failed_count"), n("not_identifiable", "resolution_limited").alias("limited_count"))
    verdict = F.when(F.col("failed_count") > 0, "failed").when(F.col("passed_count") == 0, "insufficient_evidence").when(F.col("limited_count") > 0, "passed_with_reservations").otherwise("passed")
    return g.withColumn("status", verdict)


def trajectory_errors(truth: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Errors over time of (by, t_s, frequency_hz) against the line f0 + drift t: mean, root mean square, largest, and slope error."""
    j = points.join(truth.select(*by, "f0", "drift"), by).withColumn("e", F.col("frequency_hz") - F.col("f0") - F.col("drift") * F.col("t_s"))
    return j.groupBy(*by).agg(
        F.count("*").alias("points"), F.avg("e").alias("mean_error_hz"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms_error_hz"), F.max(F.abs("e")).alias("largest_error_hz"), (F.regr_slope("frequency_hz", "t_s") - F.max("drift")).alias("slope_error")
    )
