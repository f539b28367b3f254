"""Recording-level operators over long samples (recording_id, n, t_s, x).

Windows are partitioned by recording; nothing is ordered across recordings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dbfs, ratio

BY = "recording_id"


def recording_metrics(sig: DataFrame, clip_at: float = 1.0) -> DataFrame:
    """peak, rms, crest (missing for silence), levels, clipping, DC offset."""
    a = F.abs("x")
    m = sig.groupBy(BY).agg(F.max(a).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg("x").alias("dc_offset"), F.bool_or(a >= clip_at).alias("clipping"), F.count("*").alias("n_samples"))
    return m.select(BY, "peak", "rms", ratio(F.col("peak"), F.col("rms")).alias("crest"), dbfs(F.col("peak")).alias("peak_dbfs"), dbfs(F.col("rms")).alias("rms_dbfs"), "dc_offset", "clipping", "n_samples")


def mono(channels: DataFrame) -> DataFrame:
    """Mean over channels of (recording_id, channel, n, x)."""
    return channels.groupBy(BY, "n").agg(F.avg("x").alias("x"))


def interval(sig: DataFrame, start_s: float, end_s: float, rate: float) -> DataFrame:
    """Half-open [start, end) in whole samples, both ends rounded up; indices start anew."""
    from math import ceil

    a, b = ceil(start_s * rate), ceil(end_s * rate)
    return sig.filter((F.col("n") >= a) & (F.col("n") < b)).withColumn("n", F.col("n") - a)


def impact(sig: DataFrame, peak_fraction: float = 0.05, noise_factor: float = 8.0) -> DataFrame:
    """First sample at or above the threshold up to the peak; threshold from peak and baseline noise."""
    amp = sig.select(BY, "n", "t_s", F.abs("x").alias("a"))
    peak = amp.groupBy(BY).agg(F.min(F.struct((-F.col("a")).alias("m"), F.col("n"))).alias("p"), F.count("*").alias("size"))
    peak = peak.select(BY, (-F.col("p.m")).alias("peak"), F.col("p.n").alias("peak_n"), F.greatest(F.lit(1), F.least(F.col("p.n"), F.floor(F.col("size") / 10))).alias("base"))
    both = amp.join(peak, BY)
    base = both.filter(F.col("n") < F.col("base"))
    centre = base.groupBy(BY).agg(F.median("a").alias("centre"))
    spread = base.join(centre, BY).groupBy(BY).agg(F.first("centre").alias("centre"), F.median(F.abs(F.col("a") - F.col("centre"))).alias("mad"))
    limits = spread.select(BY, (F.col("centre") + noise_factor * F.col("mad")).alias("noise"))
    limit = F.greatest(peak_fraction * F.col("peak"), F.col("noise"))
    return (
        both.join(limits, BY)
        .withColumn("threshold", limit)
        .groupBy(BY, "peak", "peak_n", "threshold")
        .agg(F.min(F.when((F.col("n") <= F.col("peak_n")) & (F.col("a") >= F.col("threshold")), F.col("n"))).alias("impact_n"))
        .withColumn("impact_n", F.coalesce("impact_n", "peak_n"))
        .withColumn("confidence", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log10(ratio(F.col("peak"), F.col("threshold"))) / 2)), F.lit(0.0)))
    )


def transient_end(sig: DataFrame, hits: DataFrame, hold: int = 4, fraction: float = 0.2) -> DataFrame:
    """First start behind the peak whose next ``hold`` samples all stay below; the last sample if there is none."""
    ahead = Window.partitionBy(BY).orderBy("n").rowsBetween(0, hold - 1)
    runs = sig.select(BY, "n", F.max(F.abs("x")).over(ahead).alias("top"), F.count("*").over(ahead).alias("full"))
    quiet = (F.col("n") > F.col("peak_n")) & (F.col("full") == hold) & (F.col("top") < F.greatest(fraction * F.col("peak"), F.col("threshold")))
    return runs.join(hits.select(BY, "peak", "peak_n", "threshold"), BY).groupBy(BY).agg(F.coalesce(F.min(F.when(quiet, F.col("n"))), F.max("n")).alias("transient_end_n"))


def noise_floor(sig: DataFrame, window: int) -> DataFrame:
    """The quietest window of ``window`` samples at hops of half its length, plus the last full one; earliest of equals."""
    hop = max(1, window // 2)
    size = F.count("*").over(Window.partitionBy(BY))
    last = F.col("size") - window
    near = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("n") - window + 1) / hop)), F.floor(F.col("n") / hop))
    starts = F.transform(near, lambda k: k * hop)
    own = F.array_union(F.filter(starts, lambda s: s <= last), F.when((F.col("n") >= last) & (last >= 0), F.array(last)).otherwise(F.array().cast("array<bigint>")))
    placed = sig.select(BY, "n", "x").withColumn("size", size).select(BY, "x", F.explode(own).alias("start"))
    rms = placed.groupBy(BY, "start").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / window).alias("rms"))
    best = rms.groupBy(BY).agg(F.min(F.struct(F.round("rms", 12).alias("r"), F.col("start"), F.col("rms"))).alias("b"))
    return best.select(BY, F.col("b.start").alias("start_n"), F.col("b.rms").alias("noise_rms"))


def temporal_metrics(sig: DataFrame, rate: float) -> DataFrame:
    """Peak, rms, crest, dynamic range between the 5th and 95th percentile of non-zero magnitudes, energy."""
    a = F.abs("x")
    m = sig.groupBy(BY).agg(
        F.max(a).alias("peak"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.percentile(F.when(a > 0, a), 0.05).alias("p5"),
        F.percentile(F.when(a > 0, a), 0.95).alias("p95"),
        (F.sum(F.col("x") * F.col("x")) / rate).alias("energy"),
    )
    spread = F.when(F.col("p95").isNull(), F.lit(float("-inf"))).when(F.col("p5") == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.col("p95") / F.col("p5")))
    return m.select(BY, "peak", "rms", ratio(F.col("peak"), F.col("rms")).alias("crest"), spread.alias("dynamic_range_db"), "energy")


def _rows(before: int, after: int):
    return Window.partitionBy(BY).orderBy("n").rowsBetween(before, after)


def moving_rms(sig: DataFrame, window: int) -> DataFrame:
    """Root of the centred moving mean square; samples beyond the ends are zero."""
    total = F.sum(F.col("x") * F.col("x")).over(_rows(-(window // 2), (window - 1) // 2))
    return sig.select(BY, "n", F.sqrt(total / window).alias("envelope"))


def moving_peak(sig: DataFrame, window: int) -> DataFrame:
    return sig.select(BY, "n", F.max(F.abs("x")).over(_rows(-(window // 2), window - window // 2 - 1)).alias("envelope"))


def cumulative_energy(sig: DataFrame, rate: float) -> DataFrame:
    return sig.select(BY, "n", (F.sum(F.col("x") * F.col("x")).over(_rows(Window.unboundedPreceding, 0)) / rate).alias("energy"))


def configured_envelope(recs: DataFrame, method: str, window: int = 65, rate: float = 1.0) -> DataFrame:
    """recording_id, n, envelope of (recording_id, samples) by the named method: hilbert, moving_rms, moving_peak or cumulative_energy."""
    if method == "hilbert":
        from .spectrum import hilbert_envelope

        return hilbert_envelope(recs)
    sig = recs.select(BY, F.posexplode("samples").alias("n", "x")).select(BY, F.col("n").cast("long").alias("n"), "x")
    if method == "cumulative_energy":
        return cumulative_energy(sig, rate).withColumnRenamed("energy", "envelope")
    if method not in ("moving_rms", "moving_peak"):
        raise ValueError(f"no such envelope: {method}")
    return (moving_rms if method == "moving_rms" else moving_peak)(sig, window)


def signal_to_noise(sig: DataFrame, window: int) -> DataFrame:
    """Level of the recording over its noise floor: 0 for silence, inf without noise."""
    rms = sig.groupBy(BY).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    snr = F.when(F.col("rms") == 0, 0.0).when(F.col("noise_rms") == 0, float("inf")).otherwise(20 * F.log10(F.col("rms") / F.col("noise_rms")))
    return rms.join(noise_floor(sig, window), BY).select(BY, "rms", "noise_rms", snr.alias("snr_db"))


def longest_run(flags: DataFrame, flag: str) -> DataFrame:
    """Longest run of consecutive true ``flag`` by ``n``."""
    w = Window.partitionBy(BY).orderBy("n")
    own = Window.partitionBy(BY, flag).orderBy("n")
    runs = flags.select(BY, flag, (F.row_number().over(w) - F.row_number().over(own)).alias("run")).filter(flag).groupBy(BY, "run").count()
    best = runs.groupBy(BY).agg(F.max("count").alias("longest_run"))
    return flags.select(BY).distinct().join(best, BY, "left").select(BY, F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def excitation(sig: DataFrame, hits: DataFrame, rate: float, before_s: float = 0.01, after_s: float = 0.20, clip: float = 0.999, near: float = 0.95) -> DataFrame:
    """Impact-relative analysis window: extremes, asymmetry, energy, its 5–95 % duration, attack, clipping."""
    at = hits.select(BY, (F.col("impact_n") / rate).alias("hit_s"))
    inside = sig.join(at, BY).withColumn("rel_s", F.col("t_s") - F.col("hit_s")).filter((F.col("rel_s") >= -before_s - 1e-12) & (F.col("rel_s") <= after_s + 1e-12))
    w = Window.partitionBy(BY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(BY)
    a = F.abs("x")
    marked = inside.select(
        BY, "n", "t_s", "x", a.alias("a"), F.sum(F.col("x") * F.col("x")).over(w).alias("part"), F.sum(F.col("x") * F.col("x")).over(whole).alias("total"), F.max(a).over(whole).alias("top")
    )
    m = marked.groupBy(BY).agg(
        F.max("a").alias("peak_absolute"),
        F.max("x").alias("peak_positive"),
        F.min("x").alias("peak_negative"),
        F.avg("x").alias("dc_offset"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        (F.sum(F.col("x") * F.col("x")) / rate).alias("energy"),
        F.min(F.when(F.col("part") >= 0.05 * F.col("total"), F.col("t_s"))).alias("t5"),
        F.min(F.when(F.col("part") >= 0.95 * F.col("total"), F.col("t_s"))).alias("t95"),
        F.min(F.when(F.col("a") >= 0.1 * F.col("top"), F.col("t_s"))).alias("t_rise"),
        F.min(F.when(F.col("a") == F.col("top"), F.col("t_s"))).alias("t_peak"),
        F.count_if(F.col("a") >= clip).alias("clipped"),
        F.count_if(F.col("a") >= near).alias("near_clipped"),
        F.count("*").alias("n_samples"),
    )
    lower = F.abs("peak_negative")
    return m.select(
        BY, "peak_absolute", "peak_positive", "peak_negative", ratio(F.col("peak_positive") - lower, F.col("peak_absolute")).alias("asymmetry"), "dc_offset", "rms", "energy",
        dbfs(F.col("rms")).alias("level_dbfs"), ratio(F.col("peak_absolute"), F.col("rms")).alias("crest"), (F.col("t95") - F.col("t5")).alias("impulse_duration_s"),
        (F.col("t_peak") - F.col("t_rise")).alias("attack_s"), "clipped", "near_clipped", "n_samples",
    )


def dynamic_order(values: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(label_idx, value) in dynamic order: each step tied, ordered or an inversion."""
    w = Window.orderBy("label_idx")  # five labels at most
    step = values.select("label_idx", "value", F.lead("label_idx").over(w).alias("next_idx"), F.lead("value").over(w).alias("next_value")).filter("next_idx IS NOT NULL")
    change = F.col("next_value") - F.col("value")
    return step.select("label_idx", "next_idx", change.alias("change"), F.when(F.abs(change) <= tolerance, "tie").when(change > 0, "ordered").otherwise("inversion").alias("relation"))
