"""Framed spectra and their course over time."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, robust_slope
from .kernels import amplitude_spectrum

BY = "recording_id"


def stft_bins(recs: DataFrame, rate: float, length: int, hop: int, window: str = "hann", remove_mean: bool = True, pad_end: bool = False) -> DataFrame:
    """recording_id, frame, t_s (the middle of the frame), k, f_hz, mag; incomplete frames are left out or padded with zeros."""

    def run(batches):
        for batch in batches:
            ids, frames, mags = [], [], []
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.asarray(s or [], float)
                if pad_end and len(x) and (len(x) < length or (len(x) - length) % hop):
                    x = np.concatenate([x, np.zeros(length - len(x) if len(x) < length else hop - (len(x) - length) % hop)])
                if len(x) < length:
                    continue
                cut = np.lib.stride_tricks.sliding_window_view(x, length)[::hop]
                for i, row in enumerate(amplitude_spectrum(cut, window, None, remove_mean)):
                    ids.append(name)
                    frames.append(i)
                    mags.append(row.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(frames, pa.int64()), pa.array(mags, pa.list_(pa.float64()))], [BY, "frame", "mags"])

    kind = dict(recs.dtypes)[BY]
    rows = recs.select(BY, "samples").mapInArrow(run, f"{BY} {kind}, frame long, mags array<double>")
    t = (F.col("frame") * hop + (length - 1) / 2) / rate
    return rows.select(BY, "frame", t.alias("t_s"), F.posexplode("mags").alias("k", "mag")).select(BY, "frame", "t_s", F.col("k").cast("long").alias("k"), (F.col("k") * rate / length).alias("f_hz"), "mag")


def frame_stats(bins: DataFrame, silence: float = 0.0) -> DataFrame:
    """Largest and median magnitude of each frame, and whether it is silent."""
    return bins.groupBy(BY, "frame", "t_s").agg(F.max("mag").alias("top"), F.median("mag").alias("floor")).withColumn("silent", F.col("top") <= silence)


def frame_peaks(bins: DataFrame, height: float | None = None) -> DataFrame:
    """Strict local maxima of every frame with log-parabolic refinement; plateaus are left to ``spectrum.peaks``."""
    w = Window.partitionBy(BY, "frame").orderBy("k")
    b = bins.select("*", F.lag("mag").over(w).alias("l"), F.lead("mag").over(w).alias("r"), (F.lead("f_hz").over(w) - F.col("f_hz")).alias("step"))
    b = b.filter((F.col("mag") > F.col("l")) & (F.col("mag") > F.col("r")))
    if height is not None:
        b = b.filter(F.col("mag") >= height)
    positive = (F.col("l") > 0) & (F.col("r") > 0)
    shift = 0.5 * (F.ln("l") - F.ln("r")) / (F.ln("l") - 2 * F.ln("mag") + F.ln("r"))
    place = Window.partitionBy(BY, "frame").orderBy("k")
    return b.select(BY, "frame", "t_s", (F.row_number().over(place) - 1).alias("peak"), "k", "f_hz", "mag", F.when(positive, F.col("f_hz") + shift * F.col("step")).alias("refined_hz"))


def frame_descriptors(bins: DataFrame) -> DataFrame:
    """One row a frame: energy, centroid, spread, flatness, entropy, dominant bin; silent frames stay with missing values."""
    p = bins.select(BY, "frame", "t_s", "k", "f_hz", (F.col("mag") * F.col("mag")).alias("p"))
    first = p.groupBy(BY, "frame", "t_s").agg(
        F.sum("p").alias("energy"),
        F.sum(F.col("p") * F.col("f_hz")).alias("pf"),
        F.sum(F.col("p") * F.col("f_hz") * F.col("f_hz")).alias("pff"),
        F.exp(F.avg(F.when(F.col("p") > 0, F.ln("p")))).alias("geometric"),
        F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("arithmetic"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p"))).alias("plnp"),
        F.count_if(F.col("p") > 0).alias("positive"),
        F.min(F.struct((-F.round("p", 12)).alias("m"), F.col("f_hz"))).alias("top"),
    )
    e = F.col("energy")
    valid = e > 1e-24
    centroid = F.col("pf") / e
    return first.select(
        BY, "frame", "t_s", valid.alias("valid"), "energy", F.when(valid, centroid).alias("centroid_hz"),
        F.when(valid, F.sqrt(F.greatest(F.lit(0.0), F.col("pff") / e - centroid * centroid))).alias("spread_hz"),
        F.when(valid, ratio(F.col("geometric"), F.col("arithmetic"))).alias("flatness"),
        F.when(valid & (F.col("positive") > 1), (F.ln(e) - F.col("plnp") / e) / F.ln("positive")).alias("entropy"),
        F.when(valid, F.col("top.f_hz")).alias("dominant_hz"),
    )


#: Per-frame metrics that are followed over time.
METRICS = ("energy", "centroid_hz", "spread_hz", "flatness", "entropy")


def long_metrics(frames: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return frames.filter("valid").unpivot([BY, "frame", "t_s"], list(metrics), "metric", "value").filter("value IS NOT NULL")


def summary(frames: DataFrame) -> DataFrame:
    """First, last, least and largest value of every metric over valid frames."""
    return long_metrics(frames).groupBy(BY, "metric").agg(F.min_by("value", "frame").alias("first"), F.max_by("value", "frame").alias("last"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count("*").alias("valid_frames"))


def regions(frames: DataFrame, windows: list[tuple[str, float, float]]) -> DataFrame:
    """Medians over half-open time windows, one row a window; missing where no frame lies in it."""
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("region"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in windows))).alias("w")
    inside = (F.col("t_s") >= F.col("w.low")) & (F.col("t_s") < F.col("w.high"))
    return long_metrics(frames).select(BY, "t_s", "metric", "value", at).groupBy(BY, "metric", F.col("w.region").alias("region")).agg(F.median(F.when(inside, F.col("value"))).alias("median"), F.count_if(inside).alias("frames"))


def trends(frames: DataFrame, minimum: int = 3) -> DataFrame:
    """Least-squares course of each metric: slope, intercept, r² (1 for a constant), root mean square error."""
    m = long_metrics(frames).groupBy(BY, "metric").agg(
        F.count("*").alias("n"), robust_slope("value", "t_s").alias("slope"), F.regr_intercept("value", "t_s").alias("intercept"), F.regr_syy("value", "t_s").alias("sst"), F.regr_sxx("value", "t_s").alias("sxx"), F.regr_sxy("value", "t_s").alias("sxy")
    )
    enough = (F.col("n") >= minimum) & (F.col("sxx") > 0)
    sse = F.greatest(F.lit(0.0), F.col("sst") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return m.select(
        BY, "metric", "n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("intercept")).alias("intercept"),
        F.when(enough, F.when(F.col("sst") <= 1e-24, 1.0).otherwise(1 - sse / F.col("sst"))).alias("r_squared"), F.when(enough, F.sqrt(sse / F.col("n"))).alias("rmse"),
    )


def change_points(values: DataFrame, window: int = 2, persistence: int = 2, threshold: float = 1.0, stable: float | None = None) -> DataFrame:
    """Places in a metric's series (recording_id, metric, n, t_s, value) where the medians before and after differ for ``persistence`` places."""
    w = Window.partitionBy(BY, "metric").orderBy("n")
    before = F.collect_list("value").over(w.rowsBetween(-window, -1))
    after = F.collect_list("value").over(w.rowsBetween(0, window - 1))

    def middle(a):
        s = F.array_sort(a)
        return (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)) / 2

    both = values.select(BY, "metric", "n", "t_s", before.alias("b"), after.alias("a")).filter((F.size("b") == window) & (F.size("a") == window))
    jump = both.select(BY, "metric", "n", "t_s", (middle(F.col("a")) - middle(F.col("b"))).alias("change"), (F.array_max("b") - F.array_min("b")).alias("unrest"))
    hit = F.abs("change") >= threshold
    if stable is not None:
        hit = hit & (F.col("unrest") <= stable)
    marked = jump.withColumn("hit", hit)
    marked = marked.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(BY, "metric", "hit").orderBy("n"))).filter("hit")
    runs = marked.groupBy(BY, "metric", "run").agg(F.min("n").alias("at"), F.min_by("t_s", "n").alias("t_s"), F.min_by("change", "n").alias("change"), F.count("*").alias("places"))
    return runs.filter(F.col("places") >= persistence).select(BY, "metric", "at", "t_s", "change", "places")


def _sliding_median(x: np.ndarray, radius: int) -> np.ndarray:
    """Medians of windows that are shorter at the ends; the window stays sorted, so a step is one insertion and one removal."""
    window = sorted(x[:radius].tolist())
    out = np.empty(len(x))
    for i in range(len(x)):
        if i + radius < len(x):
            insort(window, x[i + radius])
        if i - radius - 1 >= 0:
            del window[bisect_left(window, x[i - radius - 1])]
        k = len(window)
        out[i] = (window[(k - 1) // 2] + window[k // 2]) / 2
    return out


def smooth(values: DataFrame, radius: int, method: str = "mean", chunk: int = 65_536) -> DataFrame:
    """Centred moving mean or median with shorter windows at the ends; ``none`` leaves values as they are.

    Medians are taken by chunks of a series, each with the neighbours that its windows reach, so that no long series is one group.
    """
    if method == "none":
        return values.select(BY, "metric", "n", "t_s", "value")
    w = Window.partitionBy(BY, "metric").orderBy("n")
    if method == "mean":
        return values.select(BY, "metric", "n", "t_s", F.avg("value").over(w.rowsBetween(-radius, radius)).alias("value"))
    if method != "median":
        raise ValueError(f"unknown method {method}")
    placed = values.select(BY, "metric", "n", "t_s", "value", (F.row_number().over(w) - 1).alias("at"))
    reach = F.sequence(F.floor(F.greatest(F.col("at") - radius, F.lit(0)) / chunk), F.floor((F.col("at") + radius) / chunk))
    schema = values.select(BY, "metric", "n", "t_s", F.col("value").cast("double").alias("value")).schema

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        own = pa.array(at // chunk == key[2].as_py())
        made = _sliding_median(table.column("value").to_numpy(zero_copy_only=False).astype(float), radius)
        return table.select([BY, "metric", "n", "t_s"]).append_column("value", pa.array(made)).filter(own)

    return placed.withColumn("chunk", F.explode(reach)).groupBy(BY, "metric", "chunk").applyInArrow(run, schema)


# ---- frames relative to an impact ----------------------------------------------------


def frame_layout(recs: DataFrame, hits: DataFrame, rate: float, length: int, hop: int, start_s: float = 0.0, end_s: float | None = None, pad_end: bool = False, tolerance: float = 1e-9) -> DataFrame:
    """Where the frames of each recording begin, in a window relative to its impact, and what happened to the window.

    recs: recording_id, samples.  hits: recording_id, hit_s.  One row a recording with begin and stop (in samples),
    complete frames, whether a padded one follows, and notes in order.  A window that lies outside of the
    signal has no frames; one that reaches over an end is clipped to it.
    """
    size = F.greatest(F.size("samples"), F.lit(0)).alias("size")
    r = recs.select(BY, size).join(hits.select(BY, "hit_s"), BY)
    duration = F.col("size") / rate
    asked, until = F.col("hit_s") + start_s, duration if end_s is None else F.col("hit_s") + end_s
    low, high = F.greatest(F.lit(0.0), asked), F.least(duration, until)
    outside = (until <= 0) | (asked >= duration) | (high <= low)
    begin, stop = F.ceil(low * rate - tolerance).cast("long"), F.floor(high * rate + tolerance).cast("long")
    r = r.select(BY, "hit_s", outside.alias("outside"), F.when(~outside, begin).alias("begin"), F.when(~outside, stop).alias("stop"), (asked < 0).alias("early"), (until > duration).alias("late"))
    room = F.col("stop") - F.col("begin")
    r = r.withColumn("frames", F.coalesce(F.when(room >= length, F.floor((room - length) / hop) + 1), F.lit(0)).cast("long"))
    rest = F.col("stop") - (F.col("begin") + F.col("frames") * hop)
    r = r.withColumn("padded", F.coalesce((rest > 0) & F.lit(pad_end), F.lit(False))).withColumn("rest", F.when(rest > 0, rest))
    notes = F.array(
        F.when(~F.col("outside") & F.col("early"), "analysis_start_clipped_to_signal"),
        F.when(~F.col("outside") & F.col("late"), "analysis_end_clipped_to_signal"),
        F.when(F.col("outside"), "analysis_window_outside_signal"),
        F.when(F.col("padded"), "temporal_padding_applied").when(F.col("rest").isNotNull(), F.concat(F.lit("final_incomplete_frame_discarded_samples="), F.col("rest").cast("string"))),
        F.when(~F.col("outside") & (F.col("frames") == 0) & ~F.lit(pad_end), "segment_shorter_than_frame_duration"),
    )
    return r.select(BY, "hit_s", "begin", "stop", "frames", "padded", F.array_join(F.filter(notes, lambda x: x.isNotNull()), ",").alias("notes"))


def impact_frames(recs: DataFrame, layout: DataFrame, rate: float, length: int, hop: int, window: str = "hann", minimum_energy: float = 1e-24) -> DataFrame:
    """Every frame of ``frame_layout`` with its descriptors, its strongest peak, and why it is not valid.

    recording_id, frame, start_s, center_s, relative_s (from the impact), padded, valid, reason, energy, centroid_hz,
    dominant_hz (the strongest bin), strongest_peak_hz, strongest_share (of the energy) and whether that peak is the dominant bin.
    A padded frame is filled with zeros.  A recording's frames are one kernel's work.
    """
    kind = dict(recs.dtypes)[BY]
    names = ("frame", "at", "padded", "reason", "energy", "centroid_hz", "dominant_hz", "strongest_peak_hz", "strongest_share", "peak_is_dominant")
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), *[pa.float64()] * 5, pa.bool_()]
    f = np.arange(length // 2 + 1) * rate / length

    def describe(x: np.ndarray) -> tuple:
        if not len(x):
            return ("insufficient_frame_samples", *[None] * 6)
        if not np.isfinite(x).all():
            return ("nonfinite_frame_samples", *[None] * 6)
        mag = amplitude_spectrum(np.pad(x, (0, length - len(x)))[None], window)[0]
        power = mag * mag
        energy = float(power.sum())
        if energy < minimum_energy:
            return ("frame_energy_below_threshold", energy, *[None] * 5)
        # the first of bins that are equal but for rounding
        dominant = int((np.round(power, 12) == np.round(power, 12).max()).argmax())
        peaks = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] > mag[2:])) + 1
        top = int(peaks[power[peaks].argmax()]) if len(peaks) else None
        share = None if top is None else float(power[top] / energy)
        return (None, energy, float((power * f).sum() / energy), float(f[dominant]), None if top is None else float(f[top]), share, top == dominant if top is not None else False)

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for name, samples, begin, count, padded in zip(*(batch.column(c).to_pylist() for c in (BY, "samples", "begin", "frames", "padded")), strict=True):
                x = np.array([np.nan if v is None else v for v in samples or []], float)
                for i in range(count + bool(padded)):
                    at = begin + i * hop
                    ids.append(name)
                    rows.append((i, at, i == count, *describe(x[at : at + length])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [BY, *names])

    both = recs.select(BY, "samples").join(layout.select(BY, "begin", "frames", "padded"), BY)
    schema = f"{BY} {kind}, frame long, at long, padded boolean, reason string, energy double, centroid_hz double, dominant_hz double, strongest_peak_hz double, strongest_share double, peak_is_dominant boolean"
    made = both.select(BY, "samples", "begin", "frames", "padded").mapInArrow(run, schema)
    centre = (F.col("at") + length / 2) / rate
    return made.join(layout.select(BY, "hit_s"), BY).select(
        BY, "frame", (F.col("at") / rate).alias("start_s"), centre.alias("center_s"), (centre - F.col("hit_s")).alias("relative_s"), "padded", F.col("reason").isNull().alias("valid"), "reason", *names[4:]
    )
