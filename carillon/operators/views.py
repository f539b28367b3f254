"""What the published figures show, as small tables; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .export import decimate


def waveform(sig: DataFrame, points: int = 2000) -> DataFrame:
    """Extremes of blocks, so that peaks survive: about ``points`` points a recording."""
    longest = sig.agg(F.max("n")).first()[0] or 0
    return decimate(sig.select("recording_id", "n", "x"), "recording_id", max(1, 2 * (longest + 1) // points))


def envelope(env: DataFrame, points: int = 2000) -> DataFrame:
    longest = env.agg(F.max("n")).first()[0] or 0
    return decimate(env.select("recording_id", "n", F.col("envelope").alias("x")), "recording_id", max(1, 2 * (longest + 1) // points))


def decay_overlay(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Measured and fitted levels of tracks: fits give slope_per_s and tau_s."""
    first = points.groupBy("recording_id", "track_id").agg(F.min("t_s").alias("t0"), F.min_by("amplitude", "t_s").alias("a0"))
    j = points.join(first, ["recording_id", "track_id"]).join(fits.select("recording_id", "track_id", "slope_per_s"), ["recording_id", "track_id"])
    return j.select("recording_id", "track_id", "t_s", "amplitude", (F.col("a0") * F.exp(F.col("slope_per_s") * (F.col("t_s") - F.col("t0")))).alias("fitted"))


def spectrogram(bins: DataFrame) -> DataFrame:
    return bins.select("recording_id", "t_s", "f_hz", F.when(F.col("mag") > 0, 20 * F.log10("mag")).alias("level_db"))


def frequency_tracks(points: DataFrame) -> DataFrame:
    return points.select("recording_id", "track_id", "t_s", "frequency_hz", "amplitude")


def associations(matches: DataFrame) -> DataFrame:
    """A line for each match: its two ends."""
    ends = F.explode(F.array(F.struct(F.col("pair").alias("label_idx"), F.col("lower_hz").alias("frequency_hz")), F.struct((F.col("pair") + 1).alias("label_idx"), F.col("higher_hz").alias("frequency_hz")))).alias("e")
    return matches.select("pair", "lower_candidate_id", "higher_candidate_id", "cost", ends).select("pair", "lower_candidate_id", "higher_candidate_id", "cost", "e.label_idx", "e.frequency_hz")


def chain_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select("chain_id", "node_index", "label_idx", "frequency_hz")


def status_counts(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("status").agg(F.count("*").alias("n"))


def metric_lines(agg: DataFrame) -> DataFrame:
    return agg.select("metric", "label_idx", "median", (F.col("median") - F.col("mad")).alias("low"), (F.col("median") + F.col("mad")).alias("high"))


def lag_curve(lagged: DataFrame, step_s: float) -> DataFrame:
    return lagged.select("source_a", "source_b", (F.col("lag") * step_s).alias("lag_s"), "r")


def global_spectrum(bins: DataFrame, floor_db: float = -120.0) -> DataFrame:
    """Levels of every bin over the recording's strongest one."""
    top = F.max("mag").over(Window.partitionBy("recording_id"))
    level = F.when(F.col("mag") > 0, F.greatest(20 * F.log10(F.col("mag") / top), F.lit(floor_db))).otherwise(F.lit(floor_db))
    return bins.select("recording_id", "f_hz", "mag", level.alias("relative_db"))


def spectral_peaks(peaks: DataFrame) -> DataFrame:
    """A marker for each peak: where it is, how high, and how far down its base lies."""
    return peaks.select("recording_id", F.coalesce("refined_hz", "f_hz").alias("f_hz"), "mag", (F.col("mag") - F.col("prominence")).alias("base"))


def candidates(refs: DataFrame) -> DataFrame:
    return refs.select("label_idx", "recording_id", "candidate_id", "frequency_hz", "tau_s", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("series"))


def cluster_members(members: DataFrame) -> DataFrame:
    """Members of each cluster with their distance to the cluster's mean."""
    mean = members.groupBy("label_idx", "cluster_id").agg(F.avg("frequency_hz").alias("mean_hz"))
    return members.join(mean, ["label_idx", "cluster_id"]).select("label_idx", "cluster_id", "recording_id", "candidate_id", "frequency_hz", (F.col("frequency_hz") - F.col("mean_hz")).alias("from_mean_hz"))


def trajectories(nodes: DataFrame) -> DataFrame:
    """Node frequencies of each chain with the line through them."""
    fit = nodes.groupBy("chain_id").agg(F.regr_slope("frequency_hz", "node_index").alias("slope"), F.regr_intercept("frequency_hz", "node_index").alias("start"))
    return nodes.join(fit, "chain_id").select("chain_id", "label_idx", "frequency_hz", (F.col("start") + F.col("slope") * F.col("node_index")).alias("fitted_hz"))


def parameters(estimates: DataFrame) -> DataFrame:
    return estimates.select("chain_id", "frequency_hz", "tau_s", F.col("parameter_status").alias("series"))


def q_factors(combined: DataFrame, key: str = "chain_id") -> DataFrame:
    """A row for each estimate of Q that there is."""
    rows = combined.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(c).alias("q")) for n, c in (("decay", "q_decay"), ("bandwidth", "q_bandwidth"), ("representative", "representative_q"))))).alias("e"))
    return rows.select(key, "e.method", "e.q").filter("q IS NOT NULL")


def bandwidth_lines(widths: DataFrame) -> DataFrame:
    """Vertical lines at the crossings and the peak of each target."""
    rows = widths.select("recording_id", "target_hz", F.explode(F.array(*(F.struct(F.lit(n).alias("line"), F.col(c).alias("f_hz")) for n, c in (("lower", "low_hz"), ("peak", "peak_hz"), ("upper", "high_hz"))))).alias("e"))
    return rows.select("recording_id", "target_hz", "e.line", "e.f_hz").filter("f_hz IS NOT NULL")


def exchange_evidence(exchange: DataFrame) -> DataFrame:
    """A cell for each kind of evidence of each pair."""
    kinds = ("opposed", "negative", "growth", "recovery", "possible_beating")
    rows = exchange.select("source_a", "source_b", "status", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("present")) for k in kinds))).alias("e"))
    return rows.select("source_a", "source_b", "status", "e.kind", "e.present")


def true_and_estimated(errors: DataFrame, on: list[str]) -> DataFrame:
    return errors.select(*on, "true", "estimate", "status")


def campaign(verdicts: DataFrame) -> DataFrame:
    """Scenarios by status."""
    return verdicts.groupBy("status").agg(F.count("*").alias("scenarios"))
