"""Spectra, peaks and spectral descriptors.

A recording's samples are one array, so its transform is one Arrow-batched kernel call and
needs no shuffle; bins are then a long table (recording_id, k, f_hz, mag).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dbfs, is_finite, ratio
from .kernels import amplitude_spectrum, analytic_envelope, find_peaks

BY = "recording_id"
#: Recordings that a kernel holds at once, however many a batch has.
_AT_ONCE = 256


def _per_recording(recs: DataFrame, kernel, out: str = "values") -> DataFrame:
    """``kernel(samples) -> array`` on every row of (recording_id, samples) and how many samples it has, row by row within Arrow batches."""

    def run(batches):
        for batch in (b.slice(i, _AT_ONCE) for b in batches for i in range(0, len(b), _AT_ONCE)):
            held = [np.asarray(s or (), float) for s in batch.column(1).to_pylist()]
            rows = [kernel(x) if len(x) else np.zeros(0) for x in held]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int32()), values], [BY, "size", out])

    kind = dict(recs.dtypes)[BY]
    return recs.select(BY, "samples").mapInArrow(run, f"{BY} {kind}, size int, {out} array<double>")


def spectrum_bins(recs: DataFrame, rate: float, window: str = "hann", n_fft: int | None = None, remove_mean: bool = True) -> DataFrame:
    """recording_id, k, f_hz, mag."""
    mags = _per_recording(recs.filter(F.size("samples") > 0), lambda x: amplitude_spectrum(x, window, n_fft, remove_mean))
    size = F.lit(n_fft) if n_fft else F.col("size")
    return mags.select(BY, "size", F.posexplode("values").alias("k", "mag")).select(BY, F.col("k").cast("long").alias("k"), (F.col("k") * rate / size).alias("f_hz"), "mag")


def hilbert_envelope(recs: DataFrame) -> DataFrame:
    return _per_recording(recs, analytic_envelope).select(BY, F.posexplode("values").alias("n", "envelope")).select(BY, F.col("n").cast("long").alias("n"), "envelope")


def spectrum_levels(bins: DataFrame) -> DataFrame:
    """Levels in dB of full scale; missing stands for minus infinity."""
    return bins.select(BY, "k", "f_hz", F.when(is_finite(dbfs(F.col("mag"))), dbfs(F.col("mag"))).alias("level_dbfs"))


def dominant_bin(bins: DataFrame) -> DataFrame:
    best = bins.groupBy(BY).agg(F.min(F.struct((-F.round("mag", 9)).alias("m"), F.col("k"), F.col("f_hz"), F.col("mag"))).alias("b"))
    return best.select(BY, F.col("b.k").alias("k"), F.col("b.f_hz").alias("f_hz"), F.col("b.mag").alias("mag"))


def peaks(bins: DataFrame, height: float | None = None, prominence: float | None = None, distance: int | None = None, noise_bins: int = 21, keep: int | None = None) -> DataFrame:
    """Spectral peaks with prominence, width, log-parabolic refinement, local noise floor and SNR, by frequency.

    keep: at most so many, the strongest (of equal ones the lowest).
    """
    arrays = bins.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("k", "f_hz", "mag"))).alias("b"))  # one recording's bins

    def run(batches):
        for batch in (b.slice(i, _AT_ONCE) for b in batches for i in range(0, len(b), _AT_ONCE)):
            ids, rows = [], []
            starts = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            flat = batch.column(1).flatten()
            every = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "f_hz", "mag")}
            for name, begin, end in zip(batch.column(0).to_pylist(), starts[:-1], starts[1:], strict=True):
                k, f, y = (every[c][begin:end] for c in ("k", "f_hz", "mag"))
                for p, prom, width in find_peaks(y, height, prominence, distance):
                    refined = None
                    if y[p - 1] > 0 and y[p] > 0 and y[p + 1] > 0:
                        a, c, d = np.log(y[p - 1 : p + 2])
                        bend = a - 2 * c + d
                        shift = 0.5 * (a - d) / bend if bend else 2.0
                        refined = float(f[p] + shift * (f[1] - f[0])) if abs(shift) <= 1 else None
                    half = noise_bins // 2
                    near = [y[i] for i in range(max(0, p - half), min(len(y), p + half + 1)) if abs(i - p) > 1]
                    floor = float(np.median(near)) if near else None
                    snr = 20 * float(np.log10(y[p] / floor)) if floor else None
                    ids.append(name)
                    rows.append((int(k[p]), float(f[p]), float(y[p]), prom, width, refined, floor, snr))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])],
                [BY, "k", "f_hz", "mag", "prominence", "width_bins", "refined_hz", "noise_floor", "snr_db"],
            )

    kind = dict(bins.dtypes)[BY]
    found = arrays.mapInArrow(run, f"{BY} {kind}, k long, f_hz double, mag double, prominence double, width_bins double, refined_hz double, noise_floor double, snr_db double")
    if keep is not None:
        best = Window.partitionBy(BY).orderBy(F.desc(F.round("mag", 9)), "k")
        found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).drop("r")
    return found


# ---- descriptors over linear power ---------------------------------------------------


def powers(bins: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    p = bins.select(BY, "k", "f_hz", (F.col("mag") * F.col("mag")).alias("p"))
    if low is not None:
        p = p.filter(F.col("f_hz") >= low)
    return p if high is None else p.filter(F.col("f_hz") <= high)


def moments(power: DataFrame) -> DataFrame:
    """Energy, centroid, spread, skewness, raw kurtosis, flatness, entropy, crest."""
    first = power.groupBy(BY).agg(F.sum("p").alias("total"), ratio(F.sum(F.col("p") * F.col("f_hz")), F.sum("p")).alias("centroid"))
    d = F.col("f_hz") - F.col("centroid")
    share = F.col("p") / F.col("total")
    m = (
        power.join(first, BY)
        .groupBy(BY, "total", "centroid")
        .agg(
            F.when(F.col("total") > 0, F.sum(F.col("p") * d * d) / F.col("total")).alias("variance"),
            F.when(F.col("total") > 0, F.sum(F.col("p") * d * d * d) / F.col("total")).alias("m3"),
            F.when(F.col("total") > 0, F.sum(F.col("p") * d * d * d * d) / F.col("total")).alias("m4"),
            F.exp(F.avg(F.when(F.col("p") > 0, F.ln("p")))).alias("geometric"),
            F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("arithmetic"),
            (-F.sum(F.when(F.col("p") > 0, share * F.ln(share)))).alias("h"),
            F.count_if(F.col("p") > 0).alias("positive"),
            F.max("p").alias("top"),
            F.avg("p").alias("mean_p"),
        )
    )
    wide = F.col("variance") > 1e-12
    return m.select(
        BY, "total", "centroid", F.sqrt("variance").alias("spread"), F.when(wide, F.col("m3") / F.pow("variance", F.lit(1.5))).alias("skewness"),
        F.when(wide, F.col("m4") / (F.col("variance") * F.col("variance"))).alias("kurtosis"), ratio(F.col("geometric"), F.col("arithmetic")).alias("flatness"),
        F.when(F.col("positive") > 1, F.col("h") / F.ln("positive")).alias("entropy"), ratio(F.col("top"), F.col("mean_p")).alias("crest"),
    )


#: Shares of energy below a rolloff frequency.
ROLLOFFS = (0.05, 0.5, 0.85, 0.9, 0.95)


def rolloffs(power: DataFrame, shares: tuple[float, ...] = ROLLOFFS) -> DataFrame:
    """First frequency at which the running energy reaches each share."""
    run = power.select(
        BY, "f_hz", F.sum("p").over(Window.partitionBy(BY).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("part"), F.sum("p").over(Window.partitionBy(BY)).alias("total")
    )
    return run.groupBy(BY).agg(*(F.min(F.when(F.col("part") >= s * F.col("total") - 1e-12, F.col("f_hz"))).alias(f"rolloff_{round(100 * s)}") for s in shares))


def band_energy(power: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """Energy and its share in half-open bands."""
    band = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in bands))).alias("b")
    total = power.groupBy(BY).agg(F.sum("p").alias("total"))
    inside = power.select(BY, "f_hz", "p", band).groupBy(BY, F.col("b.band").alias("band")).agg(F.sum(F.when((F.col("f_hz") >= F.col("b.low")) & (F.col("f_hz") < F.col("b.high")), F.col("p")).otherwise(0.0)).alias("energy"))
    return inside.join(total, BY).select(BY, "band", "energy", ratio(F.col("energy"), F.col("total")).alias("energy_fraction"))


def tonal_residual(power: DataFrame, found: DataFrame, half_hz: float) -> DataFrame:
    """Energy within ``half_hz`` of any peak, and the rest.

    Each bin looks at the nearest peak below and above it, so the work is a sort of bins and peaks.
    """
    nothing = F.lit(None).cast("double")
    both = power.select(BY, "f_hz", "p", nothing.alias("peak_hz")).unionByName(found.select(BY, "f_hz", nothing.alias("p"), F.col("f_hz").alias("peak_hz")))
    up = Window.partitionBy(BY).orderBy("f_hz", F.col("peak_hz").isNull())  # a peak before the bin at its place
    below = F.last("peak_hz", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("peak_hz", ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("below", below).withColumn("above", above).filter("p IS NOT NULL")
    tonal = F.coalesce(F.col("f_hz") - F.col("below") <= half_hz, F.lit(False)) | F.coalesce(F.col("above") - F.col("f_hz") <= half_hz, F.lit(False))
    m = near.groupBy(BY).agg(F.sum(F.when(tonal, F.col("p")).otherwise(0.0)).alias("tonal"), F.sum("p").alias("total"))
    return m.select(BY, "tonal", (F.col("total") - F.col("tonal")).alias("residual"), ratio(F.col("tonal"), F.col("total")).alias("tonal_fraction"))


def occupied_band(power: DataFrame, fraction_of_top: float = 0.01) -> DataFrame:
    """Lowest and highest frequency whose power reaches a share of the largest."""
    top = F.max("p").over(Window.partitionBy(BY))
    m = power.select(BY, "f_hz", (F.col("p") >= fraction_of_top * top).alias("in")).groupBy(BY).agg(
        F.min(F.when(F.col("in"), F.col("f_hz"))).alias("low_hz"), F.max(F.when(F.col("in"), F.col("f_hz"))).alias("high_hz"), F.avg(F.col("in").cast("double")).alias("occupied_fraction")
    )
    return m.withColumn("bandwidth_hz", F.col("high_hz") - F.col("low_hz"))


def peak_spacing(found: DataFrame) -> DataFrame:
    """Statistics of the distances of neighbouring peaks, and peaks per Hz between the outer ones."""
    w = Window.partitionBy(BY).orderBy("f_hz")
    gaps = found.select(BY, "f_hz", (F.col("f_hz") - F.lag("f_hz").over(w)).alias("gap"))
    m = gaps.groupBy(BY).agg(F.count("*").alias("peak_count"), F.median("gap").alias("median_spacing_hz"), F.avg("gap").alias("mean_spacing_hz"), F.min("gap").alias("min_spacing_hz"), (F.max("f_hz") - F.min("f_hz")).alias("span_hz"))
    return m.select("*", ratio(F.col("peak_count").cast("double"), F.col("span_hz")).alias("density_per_hz"))


def peak_isolation(found: DataFrame, width_hz: float) -> DataFrame:
    """Nearest neighbours of each peak, their distance, and how much a band of ``width_hz`` overlaps it."""
    w = Window.partitionBy(BY).orderBy("f_hz")
    near = found.select(BY, "k", "f_hz", (F.col("f_hz") - F.lag("f_hz").over(w)).alias("below_hz"), (F.lead("f_hz").over(w) - F.col("f_hz")).alias("above_hz"))
    nearest = F.least("below_hz", "above_hz")
    overlap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (width_hz - nearest) / width_hz))
    return near.select(BY, "k", "f_hz", "below_hz", "above_hz", nearest.alias("nearest_hz"), F.coalesce(overlap, F.lit(0.0)).alias("overlap"), (F.coalesce(overlap, F.lit(0.0)) == 0).alias("isolated"))


def mismatches(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Names of the fields in which two descriptions differ, missing being a value."""
    b = right.select(*on, *(F.col(c).alias(f"__{c}") for c in fields))
    odd = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields)))
    return left.join(b, on).select(*on, odd.alias("mismatches"), (F.size(odd) == 0).alias("comparable"))
