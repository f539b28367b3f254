"""Counts, reasons and overall verdicts over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import short_id

#: Statuses in the order in which summaries list them.
PARAMETER_STATUSES = ("valid", "valid_with_reservations", "partial", "insufficient_evidence", "invalid")
Q_STATUSES = ("valid", "valid_with_reservations", "partial", "inconclusive", "insufficient_evidence", "invalid")
EXCHANGE_STATUSES = ("supported", "supported_with_reservations", "inconclusive", "not_supported", "insufficient_evidence", "invalid")
VALIDATION_STATUSES = ("passed", "passed_with_reservations", "failed", "not_identifiable", "insufficient_evidence")
STAGE_STATUSES = ("completed", "completed_with_reservations", "insufficient_evidence", "blocked", "failed", "skipped")
ANALYSIS_STATUSES = ("invalid_input", "insufficient_evidence", "failed", "partial", "completed_with_reservations", "completed")


def status_summary(rows: DataFrame, status: str, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """``total`` and a count for each status, in one row (for each of ``by``)."""
    counts = [F.count_if(F.col(status) == n).alias(f"{n}_count") for n in names]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), *counts)


def chain_counts(chains: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """One row: chains in all, complete, partial and of a single condition, emerging and disappearing ones, and their nodes."""
    single, whole = F.col("node_count") == 1, F.col("complete")
    return chains.agg(
        F.count("*").alias("chain_count"), F.count_if(whole).alias("complete_chain_count"), F.count_if(~whole & ~single).alias("partial_chain_count"), F.count_if(single & ~whole).alias("singleton_chain_count"),
        F.count_if("emerging").alias("emerging_chain_count"), F.count_if("disappearing").alias("disappearing_chain_count"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("candidate_count"),
        F.coalesce(F.sum(F.when(~single, F.col("node_count"))), F.lit(0)).alias("matched_candidate_count"),
    )


def provenance(nodes: DataFrame, settings_fingerprint: str) -> DataFrame:
    """chain_id, the labels, recordings and candidates that it comes from in chain order, and an id of them with the settings."""
    listed = nodes.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("node_index", "label_idx", "recording_id", "candidate_id"))).alias("n"))
    text = lambda c: F.concat_ws(",", F.transform(f"n.{c}", lambda x: x.cast("string"))).alias(c)
    out = listed.select("chain_id", F.size("n").cast("long").alias("sources"), text("label_idx"), text("recording_id"), text("candidate_id"))
    return out.withColumn("provenance_id", short_id(F.lit(settings_fingerprint), F.col("chain_id"), F.col("candidate_id"), bits="sha256"))


def sequence_problems(pairs: DataFrame, labels: int) -> DataFrame:
    """lower_idx, higher_idx, problem of (lower_idx, higher_idx) pair results that do not form one run over the labels.

    A pair may be there once only, must be of neighbours, and no neighbours may be without one.
    """
    spark = pairs.sparkSession
    wanted = spark.range(labels - 1).select(F.col("id").cast("int").alias("lower_idx"), (F.col("id") + 1).cast("int").alias("higher_idx"))
    counted = pairs.groupBy("lower_idx", "higher_idx").agg(F.count("*").alias("n"))
    twice = counted.filter("n > 1").select("lower_idx", "higher_idx", F.lit("duplicate_pair").alias("problem"))
    extra = counted.join(wanted, ["lower_idx", "higher_idx"], "left_anti").select("lower_idx", "higher_idx", F.lit("not_adjacent").alias("problem"))
    missing = wanted.join(counted, ["lower_idx", "higher_idx"], "left_anti").withColumn("problem", F.lit("missing_pair"))
    return twice.unionByName(extra).unionByName(missing)


def mean_of_present(*values: Column) -> Column:
    """Mean of the values that are not missing; missing without any."""
    n = sum((F.when(v.isNull(), 0).otherwise(1) for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n)


def replicate_quality(rows: DataFrame, minimum_duration_s: float | None = None) -> DataFrame:
    """Quality of each recording: the mean of what is known of not clipped, duration, SNR, coverage and accepted share.

    rows: recording_id, clipping_fraction, duration_s, snr_db, tracking_coverage, accepted_fraction; each may be missing.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    length = F.col("duration_s")
    duration = F.when(length > 0, 1.0).when(length.isNotNull(), 0.0) if minimum_duration_s is None else F.when(length.isNotNull(), clip(length / minimum_duration_s))
    snr = F.when(F.col("snr_db").isNotNull() & ~F.isnan("snr_db") & (F.abs("snr_db") != float("inf")), clip(F.col("snr_db") / 60))
    parts = [F.when(F.col("clipping_fraction").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("clipping_fraction"))), duration, snr, F.col("tracking_coverage"), F.col("accepted_fraction")]
    short = F.lit(False) if minimum_duration_s is None else F.coalesce(length < minimum_duration_s, F.lit(False))
    return rows.select(
        "recording_id", parts[0].alias("not_clipped"), parts[1].alias("duration_quality"), parts[2].alias("snr_quality"), mean_of_present(*parts).alias("quality"),
        F.coalesce(F.col("clipping_fraction") > 0, F.lit(False)).alias("clipping_present"), short.alias("short_duration"),
    )


def analysis_status(stages: DataFrame, by: str = "experiment_id", allow_partial: bool = True) -> DataFrame:
    """Overall status of each experiment from (by, status, enabled) of its stages and (input_valid, valid_recordings).

    The first that holds of: invalid input, no valid recording, a failed stage, a blocked one, an enabled one without enough
    evidence (partial if partial results are allowed), one with reservations, completed.
    """
    is_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    poor = F.coalesce(F.bool_or((F.col("status") == "insufficient_evidence") & F.col("enabled")), F.lit(False))
    status = (
        F.when(~F.bool_and("input_valid"), "invalid_input")
        .when(F.max("valid_recordings") == 0, "insufficient_evidence")
        .when(is_("failed"), "failed")
        .when(is_("blocked"), "partial")
        .when(poor, "partial" if allow_partial else "insufficient_evidence")
        .when(is_("completed_with_reservations"), "completed_with_reservations")
        .otherwise("completed")
    )
    return stages.groupBy(by).agg(F.count("*").alias("stages"), status.alias("analysis_status"))


def first_sources(parameters: DataFrame, spectra: DataFrame) -> DataFrame:
    """For each parameter estimate (chain_id, label_idx of its conditions) the first label that has a spectrum."""
    there = spectra.select("label_idx").distinct()
    return parameters.join(there, "label_idx", "left_semi").groupBy("chain_id").agg(F.min("label_idx").alias("source_idx"))


def structural_context(nodes: DataFrame, splits: DataFrame, merges: DataFrame, reject_split: bool = False, reserve_split: bool = True, reject_merge: bool = False, reserve_merge: bool = True) -> DataFrame:
    """How many split sources and merge targets each chain holds, and whether it passes, with reservation or without."""
    s = splits.select(F.col("pair").alias("label_idx"), F.col("lower_recording_id").alias("recording_id"), F.col("lower_candidate_id").alias("candidate_id"), F.lit(1).alias("s"))
    m = merges.select((F.col("pair") + 1).alias("label_idx"), F.col("higher_recording_id").alias("recording_id"), F.col("higher_candidate_id").alias("candidate_id"), F.lit(1).alias("m"))
    keys = ["label_idx", "recording_id", "candidate_id"]
    c = nodes.select("chain_id", *keys).join(s.hint("merge"), keys, "left").join(m.hint("merge"), keys, "left").groupBy("chain_id").agg(F.count("s").alias("split_context_count"), F.count("m").alias("merge_context_count"))
    has_s, has_m = F.col("split_context_count") > 0, F.col("merge_context_count") > 0
    passes = ~((has_s & F.lit(reject_split)) | (has_m & F.lit(reject_merge)))
    reserve = (has_s & F.lit(reserve_split and not reject_split)) | (has_m & F.lit(reserve_merge and not reject_merge))
    return c.select("*", passes.alias("passes"), (reserve & passes).alias("requires_reservation"))


def window_coverage(points: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Share of the window from ``start`` to ``end`` between its first and last point; 0 with fewer than two."""
    inside = F.when((F.col("t_s") >= start) & (F.col("t_s") <= end), F.col("t_s"))
    g = points.withColumn("__in", inside).withColumn("__w", end - start).groupBy(*by).agg(F.count("__in").alias("points"), (F.max("__in") - F.min("__in")).alias("span"), F.max("__w").alias("w"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("span") / F.col("w")))
    return g.select(*by, "points", F.when(F.col("points") >= 2, part).otherwise(0.0).alias("coverage"))


def band_summaries(bins: DataFrame, bands: list[tuple[str, float, float]], present: float = 0.1) -> DataFrame:
    """Course of each band's energy over the frames of (recording_id, frame, t_s, f_hz, mag): first, last and largest
    energy, fractions, trend, share of frames in which the band is present and when it first is not."""
    energy = F.col("mag") * F.col("mag")
    sums = [F.sum(F.when((F.col("f_hz") >= lo) & (F.col("f_hz") < hi), energy).otherwise(0.0)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(bands)]
    frames = bins.groupBy("recording_id", "frame").agg(F.first("t_s").alias("t_s"), F.sum(energy).alias("all"), *sums).filter(F.col("all") > 0)
    rows = frames.select("recording_id", "frame", "t_s", "all", F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.col(f"b{i}").alias("energy")) for i, (n, _, _) in enumerate(bands)))).alias("x"))
    rows = rows.select("recording_id", "frame", "t_s", "x.band", "x.energy", (F.col("x.energy") / F.col("all")).alias("fraction"))
    below = F.min(F.when(F.col("fraction") < present, F.col("t_s")))
    return rows.groupBy("recording_id", "band").agg(
        F.min_by("energy", "frame").alias("initial_energy"), F.max_by("energy", "frame").alias("final_energy"), F.max("energy").alias("maximum_energy"), F.min_by("fraction", "frame").alias("initial_fraction"),
        F.max_by("fraction", "frame").alias("final_fraction"), F.regr_slope("fraction", "t_s").alias("fraction_slope"), F.avg((F.col("fraction") >= present).cast("double")).alias("coverage"), below.alias("below_s"),
    )


def nearest_peaks(targets: DataFrame, peaks: DataFrame) -> DataFrame:
    """The peak nearest to each (recording_id, target_hz), the lower of two: one as-of look down and one up."""
    nothing = F.lit(None).cast("double")
    both = targets.select("recording_id", F.col("target_hz").alias("f"), "target_hz", nothing.alias("peak_hz")).unionByName(peaks.select("recording_id", F.col("f_hz").alias("f"), nothing.alias("target_hz"), F.col("f_hz").alias("peak_hz")))
    w = Window.partitionBy("recording_id").orderBy("f", F.col("peak_hz").isNull())
    low = F.last("peak_hz", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("peak_hz", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("low", low).withColumn("high", high).filter("target_hz IS NOT NULL")
    down, up = F.col("target_hz") - F.col("low"), F.col("high") - F.col("target_hz")
    near = F.when(F.col("high").isNull() | (down <= up), F.col("low")).otherwise(F.col("high"))
    return seen.select("recording_id", "target_hz", near.alias("peak_hz"), F.abs(near - F.col("target_hz")).alias("apart_hz"))


def peak_bandwidths(targets: DataFrame, peaks: DataFrame, resolution_hz: float) -> DataFrame:
    """Bandwidth and Q of the peak nearest to each target from the peak's width at half prominence.

    peaks: recording_id, f_hz, width_bins.  Resolved in classes by widths of the resolution; invalid without a width.
    """
    found = nearest_peaks(targets, peaks).join(peaks.select("recording_id", F.col("f_hz").alias("peak_hz"), (F.col("width_bins") * resolution_hz).alias("bandwidth_hz")), ["recording_id", "peak_hz"], "left")
    x = F.col("bandwidth_hz") / resolution_hz
    kind = F.when(x.isNull(), "unavailable").when(x < 1, "unresolved").when(x < 2, "resolution_limited").when(x < 4, "marginally_resolved").otherwise("well_resolved")
    fine = F.coalesce(F.col("bandwidth_hz") > 0, F.lit(False)) & F.coalesce(F.col("peak_hz") > 0, F.lit(False))
    return found.select("recording_id", "target_hz", "peak_hz", "bandwidth_hz", kind.alias("resolution"), F.when(fine, F.col("peak_hz") / F.col("bandwidth_hz")).alias("q_bandwidth"), fine.alias("valid"))


def bandwidth_q_uncertainty(rows: DataFrame) -> DataFrame:
    """Linear propagation to Q = f / b of (frequency_hz, bandwidth_hz, frequency_u, bandwidth_u); missing where either is."""
    q = F.col("frequency_hz") / F.col("bandwidth_hz")
    relative = F.sqrt(F.pow(F.col("frequency_u") / F.col("frequency_hz"), F.lit(2.0)) + F.pow(F.col("bandwidth_u") / F.col("bandwidth_hz"), F.lit(2.0)))
    u = q * relative
    return rows.select("*", q.alias("q_bandwidth"), u.alias("q_u"), F.when(u.isNotNull(), F.greatest(F.lit(0.0), q - u)).alias("q_low"), (q + u).alias("q_high"), relative.alias("q_relative_u"))


def impact_compatible(lower: Column, higher: Column, lower_class: Column | None = None, higher_class: Column | None = None) -> Column:
    """Whether two candidates agree in impact evidence; missing where either has none."""
    same = lower == higher
    if lower_class is not None and higher_class is not None:
        same = same | lower_class.eqNullSafe(higher_class)
    return F.when(lower.isNotNull() & higher.isNotNull(), same)


def unmatched_reasons(refs: DataFrame, pairs: DataFrame, found: DataFrame, side: str = "lower", max_cost: float = 1.0, needed: tuple[str, ...] = ()) -> DataFrame:
    """Why each reference of a side is without a match: the first that holds of no other side, an ambiguous match in the
    pair, none within the frequency gate, evidence missing (columns ``needed``), costs above the limit, none compatible.

    pairs: admissible by frequency, with cost; found: matches with ``ambiguous``.
    """
    shift = 0 if side == "lower" else 1
    keys = ["pair", "recording_id", "candidate_id"]
    own = refs.withColumn("pair", F.col("label_idx") - shift).filter("pair >= 0 AND pair <= 3")
    used = found.select("pair", *(F.col(f"{side}_{k}").alias(k) for k in keys[1:]))
    alone = own.join(used, keys, "left_anti")
    other = refs.select((F.col("label_idx") - (1 - shift)).alias("pair")).distinct().withColumn("opposite", F.lit(True))
    vague = found.filter("ambiguous").select("pair").distinct().withColumn("vague", F.lit(True))
    seen = pairs.select("pair", *(F.col(f"{side}_{k}").alias(k) for k in keys[1:]), F.col(f"{'higher' if side == 'lower' else 'lower'}_candidate_id").alias("partner"), "cost")
    lacks = F.lit(False)
    if needed:
        gaps = refs.select(F.col("candidate_id").alias("partner"), F.greatest(*(F.col(c).isNull() for c in needed), F.lit(False)).alias("partner_lacks"))
        seen = seen.join(gaps, "partner", "left")
        lacks = F.col("partner_lacks")
    seen = seen.groupBy(*keys).agg(F.count("*").alias("near"), F.bool_or(F.col("cost") > max_cost).alias("dear"), F.bool_or(lacks).alias("gaps"))
    mine = F.greatest(*(F.col(c).isNull() for c in needed), F.lit(False)) if needed else F.lit(False)
    reason = (
        F.when(F.col("opposite").isNull(), "insufficient_data")
        .when(F.col("vague"), "ambiguous_match")
        .when(F.col("near").isNull(), "no_candidate_in_frequency_range")
        .when(F.coalesce("gaps", F.lit(False)) | mine, "missing_required_evidence")
        .when(F.col("dear"), "cost_above_threshold")
        .otherwise("no_compatible_candidate")
    )
    return alone.join(other, "pair", "left").join(vague, "pair", "left").join(seen, keys, "left").select(*keys, reason.alias("reason"))
