"""Signals with known content, generated on the executors from ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _times(spark: SparkSession, duration_s: float, rate: int) -> DataFrame:
    n = spark.range(round(duration_s * rate)).withColumnRenamed("id", "n")
    return n.select("n", (F.col("n") / rate).alias("t_s"))


def _put(frame: DataFrame, x: Column) -> DataFrame:
    return frame.select("n", "t_s", x.alias("x"))


def pure_sine(spark: SparkSession, frequency_hz: float, duration_s: float = 1.0, rate: int = 1024, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    return _put(_times(spark, duration_s, rate), amplitude * F.sin(2 * np.pi * frequency_hz * F.col("t_s") + phase))


def linear_chirp(spark: SparkSession, start_hz: float, end_hz: float, duration_s: float = 1.0, rate: int = 1024, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    t = F.col("t_s")
    turn = 2 * np.pi * (start_hz * t + 0.5 * (end_hz - start_hz) / duration_s * t * t) + phase
    return _put(_times(spark, duration_s, rate), amplitude * F.sin(turn))


def damped_sum(spark: SparkSession, components: list[tuple[float, float, float, float]], duration_s: float = 1.0, rate: int = 1024) -> DataFrame:
    """Sum of (frequency, decay rate per second, amplitude, phase); a rate of 0 is a plain sine."""
    t = F.col("t_s")
    parts = [a * F.exp(-d * t) * F.sin(2 * np.pi * f * t + p) for f, d, a, p in components]
    return _put(_times(spark, duration_s, rate), sum(parts, F.lit(0.0)))


def impulse(spark: SparkSession, at: int, duration_s: float = 1.0, rate: int = 1024, amplitude: float = 1.0) -> DataFrame:
    return _put(_times(spark, duration_s, rate), F.when(F.col("n") == at, float(amplitude)).otherwise(0.0))


def _from_array(spark: SparkSession, values: np.ndarray, rate: int) -> DataFrame:
    one = spark.createDataFrame([(values.tolist(),)], "v array<double>")
    return one.select(F.posexplode("v").alias("n", "x")).select(F.col("n").cast("long").alias("n"), (F.col("n") / rate).alias("t_s"), "x")


def white_noise(spark: SparkSession, duration_s: float, rate: int, rms: float, seed: int) -> DataFrame:
    """Seeded normal noise scaled to an exact root mean square; one recording's length at a time."""
    x = np.random.default_rng(seed).standard_normal(round(duration_s * rate))
    return _from_array(spark, _scaled(x, rms), rate)


#: Fixed values of a well-known filter from white to pink noise: pole and gain of each state, then two direct gains.
PINK_POLES = ((0.99886, 0.0555179), (0.99332, 0.0750759), (0.96900, 0.1538520), (0.86650, 0.3104856), (0.55000, 0.5329522), (-0.7616, -0.0168980))
PINK_NOW, PINK_BEFORE = 0.5362, 0.115926


def pink_filter(white: np.ndarray) -> np.ndarray:
    poles, gains = np.array(PINK_POLES).T
    state = np.zeros(len(poles))
    out = np.empty(len(white))
    last = 0.0
    for i, w in enumerate(white):
        state = poles * state + gains * w
        out[i] = state.sum() + last + PINK_NOW * w
        last = PINK_BEFORE * w
    return out


def _scaled(x: np.ndarray, rms: float) -> np.ndarray:
    return x * (rms / np.sqrt(np.mean(x * x)))


def pink_noise(spark: SparkSession, duration_s: float, rate: int, rms: float, seed: int) -> DataFrame:
    """Filtered seeded noise scaled to an exact root mean square."""
    return _from_array(spark, _scaled(pink_filter(np.random.default_rng(seed).standard_normal(round(duration_s * rate))), rms), rate)


def coloured_noise(spark: SparkSession, duration_s: float, rate: int, rms: float, seed: int, alpha: float = 1.0) -> DataFrame:
    """Noise whose power falls as frequency to the power ``alpha``, shaped in the frequency domain."""
    n = round(duration_s * rate)
    bins = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    bins[1:] *= np.arange(1, len(bins)) ** (-alpha / 2)
    bins[0] = 0
    return _from_array(spark, _scaled(np.fft.irfft(bins, n), rms), rate)


def mains_hum(spark: SparkSession, duration_s: float, rate: int, rms: float, base_hz: float = 50.0, harmonics: int = 3) -> DataFrame:
    """Harmonics with falling amplitude, scaled to the root mean square of whole periods."""
    parts = [(base_hz * k, 0.0, 1.0 / k, 0.0) for k in range(1, harmonics + 1)]
    level = np.sqrt(sum(a * a / 2 for _, _, a, _ in parts))
    return damped_sum(spark, [(f, d, a * rms / level, p) for f, d, a, p in parts], duration_s, rate)


def clipped(signal: DataFrame, threshold: float, soft: bool = False) -> DataFrame:
    x = F.col("x")
    return signal.withColumn("x", threshold * F.tanh(x / threshold) if soft else F.greatest(F.least(x, F.lit(threshold)), F.lit(-threshold)))


def with_offset(signal: DataFrame, offset: float) -> DataFrame:
    return signal.withColumn("x", F.col("x") + offset)


def mixed(signal: DataFrame, noise: DataFrame, signal_gain: float = 1.0, noise_gain: float = 1.0) -> DataFrame:
    return signal.join(noise.select("n", F.col("x").alias("y")), "n").select("n", "t_s", (signal_gain * F.col("x") + noise_gain * F.col("y")).alias("x"))


def drifting(spark: SparkSession, start_hz: float, drift_hz_per_s: float, tau_s: float, duration_s: float, rate: int, amplitude: float = 1.0) -> DataFrame:
    """A decaying sine whose frequency moves; the phase is the running sum of the frequency."""
    t = _times(spark, duration_s, rate).withColumn("f", start_hz + drift_hz_per_s * F.col("t_s"))
    turn = F.sum(2 * np.pi * F.col("f") / rate).over(Window.partitionBy(F.lit(0)).orderBy("n"))  # one recording
    return t.select("n", "t_s", (amplitude * F.exp(-F.col("t_s") / tau_s) * F.sin(turn)).alias("x"))


def truth(components: DataFrame) -> DataFrame:
    """Q = π f τ and bandwidth 1/(π τ) of (scenario, component_id, f0, tau_s)."""
    return components.select("*", (F.pi() * F.col("f0") * F.col("tau_s")).alias("q"), (1 / (F.pi() * F.col("tau_s"))).alias("bandwidth_hz"))


# ---- validation scenarios -----------------------------------------------------------

#: For each scenario its components (id, frequency, amplitude, decay time or none), 8 s long.
SCENARIOS: dict[str, tuple[tuple[str, float, float, float | None], ...]] = {
    "single_ideal": (("mode_500", 500.0, 1.0, 2.0),),
    "multiple_isolated": (("mode_250", 250.0, 0.8, 3.0), ("mode_500", 500.0, 0.7, 2.0), ("mode_900", 900.0, 0.6, 1.2)),
    "near_modes_resolved": (("near_a", 500.0, 0.8, 2.0), ("near_b", 540.0, 0.7, 2.1)),
    "near_modes_marginal": (("near_a", 500.0, 0.8, 2.0), ("near_b", 503.0, 0.7, 2.1)),
    "near_modes_unidentifiable": (("near_a", 500.0, 0.8, 2.0), ("near_b", 500.4, 0.7, 2.1)),
    "beating": (("beat_a", 500.0, 0.7, 4.0), ("beat_b", 502.0, 0.7, 4.0)),
    "linear_drift": (("drift_500", 500.0, 0.9, 2.0),),
    "frequency_crossing": (("cross_a", 490.0, 0.7, 3.0), ("cross_b", 510.0, 0.7, 3.0)),
    "emergence_disappearance": (("persistent", 500.0, 0.8, 2.0), ("emerging", 750.0, 0.7, 1.5), ("disappearing", 300.0, 0.7, 1.5)),
    "apparent_split_merge": (("split_parent", 500.0, 0.8, 2.0), ("split_child_a", 497.0, 0.5, 2.0), ("split_child_b", 503.0, 0.5, 2.0)),
    "energy_exchange": (("exchange_a", 500.0, 1.0, 4.0), ("exchange_b", 700.0, 1.0, 4.0)),
    "no_energy_exchange": (("decay_a", 500.0, 0.8, 1.5), ("decay_b", 700.0, 0.7, 2.0)),
    "noise": (("noisy_mode", 500.0, 1.0, 2.0),),
    "mains_hum": (("mode_500", 500.0, 0.9, 2.0), ("mains_60", 60.0, 0.1, None)),
    "clipping": (("clipped_mode", 500.0, 1.2, 2.0),),
    "short_duration": (("long_tau_short_window", 500.0, 0.9, 5.0),),
    "sampling_resolution": (("resolution_mode", 500.0, 0.9, 2.0),),
}
#: Drift in Hz per s, phase, share of the duration at which a component begins or ends, envelope points
#: (share of the duration, amplitude), components that are not to be found, and pairs that exchange energy or do not.
DRIFTS = {"drift_500": 2.0, "cross_a": 5.0, "cross_b": -5.0}
PHASES = {"beat_b": 0.2}
BEGINS, ENDS = {"emerging": 0.35}, {"disappearing": 0.55}
ENVELOPES = {"exchange_a": ((0.0, 1.0), (1.0, 0.25)), "exchange_b": ((0.0, 0.15), (0.35, 0.2), (1.0, 0.95))}
HIDDEN = ("mains_60",)
EXCHANGING = {"energy_exchange": (("exchange_a", "exchange_b"),)}
NOT_EXCHANGING = {"beating": (("beat_a", "beat_b"),), "no_energy_exchange": (("decay_a", "decay_b"),)}
EXCHANGE_LAG = 0.20


def scenario_components(spark: SparkSession, names: tuple[str, ...] = tuple(SCENARIOS)) -> DataFrame:
    """scenario, component_id, f0, amplitude, tau_s, drift, phase, begins, ends, detectable."""
    rows = [(n, c, f, a, tau, DRIFTS.get(c, 0.0), PHASES.get(c, 0.0), BEGINS.get(c, 0.0), ENDS.get(c, 1.0), c not in HIDDEN) for n in names for c, f, a, tau in SCENARIOS[n]]
    return spark.createDataFrame(rows, "scenario string, component_id string, f0 double, amplitude double, tau_s double, drift double, phase double, begins double, ends double, detectable boolean")


def _envelope(points: tuple[tuple[float, float], ...], share: Column) -> Column:
    """Straight lines between points."""
    out = F.lit(points[-1][1])
    for (a, x), (b, y) in reversed(list(zip(points, points[1:]))):
        out = F.when(share <= b, x + (y - x) * (share - a) / (b - a)).otherwise(out)
    return out


def component_waves(components: DataFrame, duration_s: float, rate: int, envelopes: dict[str, tuple[tuple[float, float], ...]] | None = None) -> DataFrame:
    """scenario, component_id, n, t_s, f_hz, envelope, x: every component's samples; no sample depends on another one.

    components: as of ``scenario_components``, of any number; a missing tau_s does not decay.  The phase is
    2π (f t + drift t² / 2), so a drift needs no running sum.
    """
    both = components.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(round(duration_s * rate) - 1).cast("long")))).withColumn("t_s", F.col("n") / rate)
    share, c = F.col("t_s") / duration_s, F.col("t_s")
    fall = F.when(F.col("tau_s").isNull(), F.lit(1.0)).otherwise(F.exp(-(c - F.col("begins") * duration_s) / F.col("tau_s")))
    for name, points in (envelopes or {}).items():
        fall = F.when(F.col("component_id") == name, _envelope(points, share)).otherwise(fall)
    level = F.when((share >= F.col("begins")) & (share <= F.col("ends")), F.col("amplitude") * fall).otherwise(0.0)
    turn = 2 * np.pi * (F.col("f0") * c + F.col("drift") * c * c / 2) + F.col("phase")
    return both.select("scenario", "component_id", "n", "t_s", (F.col("f0") + F.col("drift") * c).alias("f_hz"), level.alias("envelope"), (level * F.sin(turn)).alias("x"))


def scenario_waves(spark: SparkSession, names: tuple[str, ...], duration_s: float, rate: int) -> DataFrame:
    """``component_waves`` of the named scenarios."""
    return component_waves(scenario_components(spark, names), duration_s, rate, ENVELOPES)


def summed(waves: DataFrame) -> DataFrame:
    """scenario, n, t_s, x: the sum of each scenario's components."""
    return waves.groupBy("scenario", "n", "t_s").agg(F.sum(F.round("x", 12)).alias("x"))


def with_noise(recs: DataFrame, snr_db: float | None = None, sigma: float | None = None, seed: int = 0, colour: str = "white") -> DataFrame:
    """``recs`` (recording_id, samples and others) with seeded noise of an exact level on top, and its root mean square as noise_rms.

    The level is that of the signal's root mean square less ``snr_db``, or ``sigma``.  colour: white or pink.  A recording's
    noise comes from the seed and its id, so no recording depends on another; silent or empty ones stay as they are where the level is relative.
    """
    if (snr_db is None) == (sigma is None):
        raise ValueError("either snr_db or sigma")

    def run(batches):
        for batch in batches:
            made, levels = [], []
            for name, samples in zip(batch.column("__name").to_pylist(), batch.column("samples").to_pylist(), strict=True):
                x = np.array(samples if samples is not None else [], float)
                level = float(sigma) if snr_db is None else float(np.sqrt((x * x).mean()) * 10 ** (-snr_db / 20)) if len(x) else 0.0
                if len(x) and level > 0:
                    noise = np.random.default_rng([seed, name & (2**63 - 1)]).standard_normal(len(x))
                    x = x + _scaled(pink_filter(noise) if colour == "pink" else noise, level)
                made.append(None if samples is None else x)
                levels.append(level)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "__name"} | {"samples": pa.array(made, pa.list_(pa.float64())), "noise_rms": pa.array(levels)}
            yield pa.RecordBatch.from_pydict(columns)

    kept = recs.withColumn("samples", F.col("samples").cast("array<double>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", noise_rms double"
    return kept.withColumn("__name", F.xxhash64("recording_id")).mapInArrow(run, schema)


def scenario_signals(spark: SparkSession, names: tuple[str, ...], duration_s: float, rate: int, noise_rms: float = 0.02, clip_quantile: float = 0.95, seed: int = 7) -> DataFrame:
    """scenario, n, t_s, x: the sum of the components, with noise for "noise" and clipped at a quantile for "clipping"."""
    total = summed(scenario_waves(spark, names, duration_s, rate))
    if "noise" in names:
        noisy = white_noise(spark, duration_s, rate, noise_rms, seed).select("n", F.col("x").alias("y"))
        total = total.join(noisy, "n").withColumn("x", F.when(F.col("scenario") == "noise", F.col("x") + F.col("y")).otherwise(F.col("x"))).drop("y")
    if "clipping" in names:
        limit = total.filter("scenario = 'clipping'").agg(F.percentile(F.abs("x"), F.lit(clip_quantile)).alias("limit"))
        total = total.join(F.broadcast(limit)).withColumn("x", F.when(F.col("scenario") == "clipping", F.greatest(F.least("x", "limit"), -F.col("limit"))).otherwise(F.col("x"))).drop("limit")  # one row
    return total
