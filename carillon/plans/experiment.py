"""The whole analysis of an experiment as one graph of lazy tables.

Nothing runs until a table is asked for; tables that several later ones need are written to
the folder given and read back, so a rerun with the same recordings, settings and version takes
up what is there; without a folder they are held by Spark until ``release``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import VERSION
from ..operators import association, comparison, diagnosis, modal, regimes, spectrum, stft, temporal, tracking, within
from ..operators.export import fingerprint

#: Stages in order, each with those it needs.
STAGES = {
    "load": (),
    "temporal": ("load",),
    "excitation": ("temporal",),
    "spectrum": ("load",),
    "peaks": ("spectrum",),
    "descriptors": ("spectrum", "peaks"),
    "stft": ("load",),
    "frame_peaks": ("stft",),
    "time_resolved": ("stft",),
    "tracking": ("frame_peaks",),
    "track_features": ("tracking",),
    "preimpact": ("tracking", "temporal"),
    "candidates": ("track_features", "preimpact"),
    "within_condition": ("candidates",),
    "cross_condition": ("candidates",),
    "chains": ("candidates", "cross_condition"),
    "hypotheses": ("chains",),
    "parameters": ("hypotheses",),
    "quality_factors": ("parameters",),
    "comparison": ("excitation", "descriptors", "frame_peaks", "time_resolved"),
    "regimes": ("comparison",),
}


@dataclass(frozen=True)
class Settings:
    """Defaults of every stage."""

    rate: int = 48000
    frame: int = 1024
    hop: int = 256
    window: str = "hann"
    peak_height: float | None = None
    peak_prominence: float | None = None
    track_tolerance: float = 0.05
    track_max_gap: int = 1
    track_min_length: int = 2
    minimum_observations: int = 2
    gate_hz: float = 2.0
    maximum_cost: float = 1.0
    ambiguity: float = 0.1
    labels: int = 5
    #: Seconds before and after an impact in which a track's level is taken.
    pre_window: tuple[float, float] = (-1.0, 0.0)
    post_window: tuple[float, float] = (0.0, 0.3)
    rise_db: float = 6.0
    #: Weights of the ten costs of a pair of neighbouring conditions, and of the five inside a condition.
    pair_weights: dict[str, float] = field(default_factory=lambda: {"frequency": 1.0, "tau": 0.25, "frequency_stability": 0.25, "impact_evidence": 0.1})
    within_weights: dict[str, float] = field(default_factory=lambda: {"frequency": 1.0, "impact_evidence": 0.1})

    def fingerprint(self) -> str:
        return fingerprint(self)


@dataclass
class Analysis:
    """Tables by stage; each is built on first use."""

    recordings: DataFrame
    settings: Settings
    folder: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Rows by stage, as counted while its table was written.
    counts: dict[str, int] = field(default_factory=dict)
    _identity: dict[str, str] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.recordings.sparkSession

    def table(self, stage: str) -> DataFrame:
        if stage not in STAGES:
            raise KeyError(f"no such stage: {stage}")
        if stage not in self.tables:
            made = _BUILD[stage](self)
            if stage in _SHARED:
                made = self._kept(stage, made) if self.folder else made.persist()
            self.tables[stage] = made
        return self.tables[stage]

    def identity(self) -> dict[str, str]:
        """What the tables depend on: version, settings and the recordings' content, whatever their order."""
        if self._identity is None:
            named = sorted(self.recordings.columns)
            one, two = (F.sum(F.xxhash64(F.lit(seed), *named).cast("decimal(38,0)")).cast("string") for seed in (1, 2))
            held = self.recordings.agg(F.count("*").alias("n"), one.alias("one"), two.alias("two")).first()
            self._identity = {
                "version": VERSION,
                "settings_fingerprint": self.settings.fingerprint(),
                "recordings_fingerprint": fingerprint({"columns": [list(t) for t in sorted(self.recordings.dtypes)], "rows": held.n, "sums": [held.one, held.two]}),
            }
        return self._identity

    def _kept(self, stage: str, made: DataFrame) -> DataFrame:
        path = f"{self.folder}/{fingerprint(self.identity())[:16]}/{stage}"
        if stage_problems(self.spark, path, self.identity()):
            seen = Observation(f"{stage}-{uuid.uuid4().hex}")
            made.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            self.counts[stage] = int(seen.get.get("rows", 0))
            note = self.spark.createDataFrame([(json.dumps(self.identity() | {"rows": self.counts[stage]}, sort_keys=True),)], "value string")
            note.coalesce(1).write.mode("overwrite").text(f"{path}.identity")
        else:
            self.counts[stage] = json.loads(self.spark.read.text(f"{path}.identity").first()[0]).get("rows", 0)
        return self.spark.read.schema(made.schema).parquet(path)

    def release(self) -> None:
        """Gives up the tables that Spark holds."""
        for stage in _SHARED & set(self.tables):
            self.tables[stage].unpersist()
        self.tables.clear()

    def count(self, stage: str) -> int:
        """Rows of a stage; one that has been written is not read again."""
        table = self.table(stage)
        if stage not in self.counts:
            seen = Observation(f"{stage}-{uuid.uuid4().hex}")
            table.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            self.counts[stage] = int(seen.get.get("rows", 0))
        return self.counts[stage]

    def summary(self) -> DataFrame:
        """Row counts of the stages that end in a result."""
        rows = [(s, self.count(s)) for s in ("load", "peaks", "candidates", "chains", "hypotheses", "parameters", "quality_factors")]
        return self.spark.createDataFrame(rows, "stage string, row_count long")

    def run(self, stages: Iterable[str] | None = None) -> DataFrame:
        """Build the stages (all, or those named with what they need) in order, and tell how each ended.

        status: success, insufficient_data (no rows), failed (with the error) or skipped (something it needs has failed).
        One stage that fails takes none with it but those that need it.
        """
        wanted = set(STAGES) if stages is None else set()
        todo = [] if stages is None else list(stages)
        while todo:
            s = todo.pop()
            if s not in STAGES:
                raise KeyError(f"no such stage: {s}")
            if s not in wanted:
                wanted.add(s)
                todo += STAGES[s]
        ends: dict[str, str] = {}
        rows = []
        for i, (s, need) in enumerate(STAGES.items()):
            if s not in wanted:
                continue
            lost = [n for n in need if ends[n] in ("failed", "skipped")]
            n, why, began = None, None, time.time()
            if lost:
                ends[s], why = "skipped", f"needs {','.join(lost)}"
            else:
                try:
                    n = self.count(s)
                    ends[s] = "success" if n else "insufficient_data"
                except Exception as e:  # the error is the stage's result
                    ends[s], why = "failed", str(e).splitlines()[0][:300]
                    self.tables.pop(s, None)
            rows.append((i, s, ",".join(need), ends[s], n, why, round(time.time() - began, 3)))
        return self.spark.createDataFrame(rows, "position int, stage string, dependency_stages string, status string, row_count long, error string, seconds double")

    def stages(self) -> DataFrame:
        """Every stage with what it needs and whether it has been built."""
        rows = [(i, s, ",".join(need), s in self.tables) for i, (s, need) in enumerate(STAGES.items())]
        return self.spark.createDataFrame(rows, "position int, stage string, dependency_stages string, built boolean")

    def provenance(self) -> str:
        return json.dumps({"settings": asdict(self.settings), **self.identity(), "stages": list(STAGES)}, sort_keys=True)


def stage_problems(spark: SparkSession, path: str, expected: dict[str, str]) -> list[str]:
    """Why a stage's table at ``path`` can't be taken up: not there, not whole, or made from something else."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in (f"{path}/_SUCCESS", f"{path}.identity/_SUCCESS"):
        mark = jvm.org.apache.hadoop.fs.Path(name)
        if not mark.getFileSystem(conf).exists(mark):
            return ["stage_not_complete"]
    found = json.loads(spark.read.text(f"{path}.identity").first()[0])
    return [f"{k}_mismatch" for k in expected if found.get(k) != expected[k]]


def _samples(a: Analysis) -> DataFrame:
    return a.recordings.select("recording_id", "label_idx", F.posexplode("samples").alias("n", "x")).select("recording_id", "label_idx", F.col("n").cast("long").alias("n"), (F.col("n") / a.settings.rate).alias("t_s"), "x")


def _descriptors(a: Analysis) -> DataFrame:
    power = spectrum.powers(a.table("spectrum"))
    peaks = a.table("peaks")
    m = spectrum.moments(power).join(spectrum.rolloffs(power), "recording_id").join(spectrum.occupied_band(power).select("recording_id", "bandwidth_hz", "occupied_fraction"), "recording_id")
    low, high = F.min(F.when(F.col("f_hz") > 0, F.col("f_hz"))), F.max("f_hz")
    octaves = peaks.groupBy("recording_id").agg(F.when(high > low, F.count("*") / F.log2(high / low)).alias("density_per_octave"))
    m = m.join(octaves, "recording_id", "left")
    return m.join(spectrum.peak_spacing(peaks), "recording_id", "left").join(spectrum.tonal_residual(power, peaks, 2 * a.settings.rate / a.settings.frame), "recording_id", "left")


def _features(a: Analysis) -> DataFrame:
    points = a.table("tracking")
    keys = tracking.BY
    f = tracking.frequency_fit(points).select(*keys, F.col("rmse_hz").alias("fit_rmse_hz"))
    sure = points.groupBy(*keys).agg(
        F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_fraction"), F.avg(F.col("near_threshold").cast("double")).alias("near_threshold_fraction"), F.min("margin").alias("assignment_margin")
    )
    d = tracking.amplitude_fit(points).select(*keys, "tau_s", F.col("r_squared").alias("amplitude_r_squared"))
    return tracking.track_features(points).join(f, keys).join(d, keys).join(sure, keys)


def _preimpact(a: Analysis) -> DataFrame:
    """Each track's level before and after its recording's impact, and whether that excited it."""
    hits = a.table("temporal").select("recording_id", (F.col("impact_n") / a.settings.rate).alias("hit_s"))
    return tracking.preimpact(a.table("tracking"), hits, a.settings.pre_window, a.settings.post_window, a.settings.rise_db)


def _candidates(a: Analysis) -> DataFrame:
    feats = a.table("track_features")
    chosen = tracking.select_candidates(tracking.candidate_criteria(feats, {"minimum_observation_count": ("observation_count", ">=", float(a.settings.minimum_observations))}))
    return (
        chosen.join(feats, tracking.BY)
        .join(a.table("preimpact").select(*tracking.BY, "classification", "impact_excited"), tracking.BY, "left")
        .join(a.recordings.select("recording_id", "label_idx"), "recording_id")
        .select(
            "label_idx", F.col("recording_id").cast("string").alias("recording_id"), F.xxhash64("recording_id", "candidate_id").alias("candidate_id"), "track_id", F.col("frequency_median").alias("frequency_hz"), "accepted", "tau_s",
            F.col("relative_stability").alias("stability"), F.col("amplitude_r_squared").alias("r_squared"), "coverage", "impact_excited", "classification",
            "drift_hz", F.col("fit_rmse_hz").alias("rmse_hz"), "ambiguous_fraction", "near_threshold_fraction", "assignment_margin",
        )
    )


def _accepted(a: Analysis) -> DataFrame:
    return a.table("candidates").filter("accepted")


def _within(a: Analysis) -> DataFrame:
    """Clusters of each condition's repeats."""
    limits = within.Limits({"absolute_frequency_gate": a.settings.gate_hz}, a.settings.within_weights, a.settings.maximum_cost, a.settings.ambiguity)
    return within.members(within.associate(_accepted(a), limits, listed=False))


def _across(a: Analysis) -> DataFrame:
    """One-to-one matches of neighbouring conditions by all ten costs."""
    limits = {"absolute_frequency_gate": a.settings.gate_hz, "cost_above_threshold": a.settings.maximum_cost}
    pairs = diagnosis.diagnosed_pairs(_accepted(a), limits, a.settings.pair_weights, a.settings.gate_hz)
    return diagnosis.assign_diagnosed(pairs, a.settings.maximum_cost, a.settings.ambiguity)


def _nodes(a: Analysis) -> DataFrame:
    extra = _accepted(a).select("candidate_id", "tau_s", "coverage", "impact_excited")
    return association.chains(_accepted(a), a.table("cross_condition"), a.settings.labels).join(extra, "candidate_id")


#: Names of condition metrics and the columns of a recording's descriptors and excitation that they are.
GLOBAL_METRICS = {
    "global_total_spectral_energy": "total", "global_spectral_centroid_hz": "centroid", "global_spectral_spread_hz": "spread", "global_spectral_rolloff_50_hz": "rolloff_50", "global_spectral_rolloff_85_hz": "rolloff_85",
    "global_spectral_rolloff_95_hz": "rolloff_95", "global_spectral_flatness": "flatness", "global_spectral_entropy": "entropy", "global_spectral_crest_factor": "crest", "global_significant_peak_count": "peak_count",
    "global_peak_density_per_hz": "density_per_hz", "global_peak_density_per_octave": "density_per_octave", "global_median_peak_spacing_hz": "median_spacing_hz", "global_tonal_energy_fraction": "tonal_fraction",
    "global_occupied_bandwidth_hz": "bandwidth_hz", "global_occupied_frequency_fraction": "occupied_fraction",
}
EXCITATION_METRICS = {
    "excitation_peak_absolute_amplitude": "peak_absolute", "excitation_rms_amplitude": "rms", "excitation_signal_energy": "energy", "excitation_equivalent_level_dbfs": "level_dbfs", "excitation_crest_factor": "crest",
    "excitation_impulse_duration_s": "impulse_duration_s", "excitation_attack_duration_s": "attack_s",
}
#: Metrics whose value in a condition is the mean: shares of its recordings.
SHARES = ("excitation_clipped_recording_fraction", "excitation_near_clipped_recording_fraction")


def _background(a: Analysis) -> DataFrame:
    """Root mean square of each recording's samples before its impact."""
    hits = a.table("temporal").select("recording_id", "impact_n")
    return _samples(a).join(hits, "recording_id").filter("n < impact_n").groupBy("recording_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("background"))


def _metrics(a: Analysis) -> DataFrame:
    """recording_id, label_idx, metric, value: all metrics of a condition by recording, in one row a recording until the end."""
    number = lambda c: F.col(c).cast("double")
    wide = a.table("descriptors").select("recording_id", *(number(c).alias(n) for n, c in GLOBAL_METRICS.items()), (1 - F.col("tonal_fraction")).alias("global_residual_energy_fraction"))
    share = lambda c: (F.col(c) / F.col("n_samples")).alias
    loud = a.table("excitation").join(_background(a), "recording_id", "left").select(
        "recording_id", *(number(c).alias(n) for n, c in EXCITATION_METRICS.items()), F.when((F.col("rms") > 0) & (F.col("background") > 0), 20 * F.log10(F.col("rms") / F.col("background"))).alias("excitation_signal_to_background_db"),
        (F.col("clipped") > 0).cast("double").alias(SHARES[0]), (F.col("near_clipped") > 0).cast("double").alias(SHARES[1]),
        share("clipped")("excitation_clipped_sample_fraction"), share("near_clipped")("excitation_near_clipping_sample_fraction"),
    )
    both = wide.join(loud, "recording_id", "left").join(_over_time(a), "recording_id", "left").join(a.recordings.select("recording_id", "label_idx"), "recording_id")
    return both.unpivot(["recording_id", "label_idx"], [c for c in both.columns if c not in ("recording_id", "label_idx")], "metric", "value")


def _frames(a: Analysis) -> DataFrame:
    """Descriptors of every frame with its peaks and the energy near them."""
    key = F.struct("recording_id", "frame").alias("recording_id")
    bins, found = a.table("stft"), a.table("frame_peaks")
    power = bins.select(key, "f_hz", (F.col("mag") * F.col("mag")).alias("p"))
    near = spectrum.tonal_residual(power, found.select(key, "f_hz"), 2 * a.settings.rate / a.settings.frame)
    near = near.select("recording_id.recording_id", "recording_id.frame", "tonal_fraction")
    top = bins.groupBy("recording_id", "frame").agg(F.max("mag").alias("top"))
    wide = bins.join(top, ["recording_id", "frame"]).filter("mag >= 0.1 * top").groupBy("recording_id", "frame").agg((F.max("f_hz") - F.min("f_hz")).alias("occupied_hz"))
    counts = found.groupBy("recording_id", "frame").agg(F.count("*").alias("peaks"))
    keys = ["recording_id", "frame"]
    out = a.table("time_resolved").join(near, keys, "left").join(counts, keys, "left").join(wide, keys, "left")
    return out.withColumn("peaks", F.coalesce(F.col("peaks"), F.lit(0)).cast("double")).withColumn("density", F.col("peaks") / (a.settings.rate / 2))


def _over_time(a: Analysis) -> DataFrame:
    """recording_id and, one column each, medians over the thirds of its frames, their differences, and courses over all, from one aggregation."""
    all_of = Window.partitionBy("recording_id")
    t0, t1 = F.min("t_s").over(all_of), F.max("t_s").over(all_of)
    f = _frames(a).withColumn("at", F.when(t1 > t0, (F.col("t_s") - t0) / (t1 - t0)))
    at = F.col("at")
    regions = {"early": at < 1 / 3, "middle": (at >= 1 / 3) & (at < 2 / 3), "late": at >= 2 / 3}
    #: Names of regional metrics and of courses, and the columns they are of.
    regional = {
        "spectral_flatness": F.col("flatness"), "spectral_entropy": F.col("entropy"), "tonal_energy_fraction": F.col("tonal_fraction"), "residual_energy_fraction": 1 - F.col("tonal_fraction"),
        "peak_density_per_hz": F.col("density"), "significant_peak_count": F.col("peaks"), "occupied_bandwidth_hz": F.col("occupied_hz"),
    }
    courses = regional | {"energy_db": 10 * F.log10(F.col("energy")), "spectral_centroid_hz": F.col("centroid_hz"), "spectral_spread_hz": F.col("spread_hz")}
    valid = lambda place, c: F.median(F.when(place & F.col("valid"), c))
    pairs = (("middle", "early"), ("late", "early"), ("late", "middle"))
    steps = f.filter("valid").select("recording_id", F.lit("flatness").alias("metric"), F.col("frame").alias("n"), "t_s", F.col("flatness").alias("value"))
    changes = stft.change_points(steps, threshold=0.15).groupBy("recording_id").agg(F.count("*").cast("double").alias("time_change_point_count"))
    m = f.groupBy("recording_id").agg(
        *(valid(place, c).alias(f"{region}_{n}") for region, place in regions.items() for n, c in regional.items()),
        *(F.regr_slope(F.when(F.col("valid"), c), F.col("t_s")).alias(f"time_{n}_slope_per_s") for n, c in courses.items()), F.avg(F.col("valid").cast("double")).alias("time_temporal_coverage_fraction"),
    )
    m = m.select("*", *((F.col(f"{x}_{n}") - F.col(f"{y}_{n}")).alias(f"region_{x}_minus_{y}_{n}") for x, y in pairs for n in regional))
    return m.join(changes, "recording_id", "left").fillna(0.0, ["time_change_point_count"])


def _condition_values(a: Analysis) -> DataFrame:
    """label_idx, metric, value: each metric's median, how many repeats there are and the largest variation within the condition."""
    value = F.when(F.col("metric").isin(*SHARES), F.col("mean")).otherwise(F.col("median"))
    one = lambda metric, value: F.struct(metric.alias("metric"), value.cast("double").alias("value"))
    # in one grouping: Spark does not find a held table again where it is joined or united with itself
    c = a.table("comparison").groupBy("label_idx").agg(F.collect_list(one(F.col("metric"), value)).alias("own"), F.max("used").alias("used"), F.max("variation").alias("variation"))
    more = F.array(one(F.lit("valid_repeat_count"), F.col("used")), one(F.lit("within_condition_coefficient_of_variation"), F.col("variation")))
    return c.select("label_idx", F.explode(F.concat("own", more)).alias("m")).select("label_idx", "m.metric", "m.value")


def _parameters(a: Analysis) -> DataFrame:
    nodes = a.table("chains")
    # of a geometric mean the deviation of the logarithm is the relative one
    spread = modal.decay(nodes).select("chain_id", (F.col("tau_s") * F.ln(F.col("upper_s") / F.col("tau_s"))).alias("tau_u"))
    return modal.parameter_status(a.table("hypotheses"), modal.locations(nodes), modal.decay(nodes)).join(modal.uncertainties(nodes).select("chain_id", F.col("conservative_hz").alias("frequency_u")), "chain_id", "left").join(spread, "chain_id", "left")


_BUILD: dict[str, Callable[[Analysis], DataFrame]] = {
    "load": lambda a: a.recordings,
    "temporal": lambda a: temporal.impact(_samples(a)),
    "excitation": lambda a: temporal.excitation(_samples(a), a.table("temporal"), a.settings.rate),
    "spectrum": lambda a: spectrum.spectrum_bins(a.recordings, a.settings.rate, a.settings.window),
    "peaks": lambda a: spectrum.peaks(a.table("spectrum"), a.settings.peak_height, a.settings.peak_prominence),
    "descriptors": _descriptors,
    "stft": lambda a: stft.stft_bins(a.recordings, a.settings.rate, a.settings.frame, a.settings.hop, a.settings.window),
    "frame_peaks": lambda a: stft.frame_peaks(a.table("stft"), a.settings.peak_height),
    "time_resolved": lambda a: stft.frame_descriptors(a.table("stft")),
    "tracking": lambda a: tracking.track_peaks(a.table("frame_peaks").withColumn("f_hz", F.coalesce("refined_hz", "f_hz")), a.settings.track_tolerance, a.settings.track_max_gap, a.settings.track_min_length),
    "track_features": _features,
    "preimpact": _preimpact,
    "candidates": _candidates,
    "within_condition": _within,
    "cross_condition": _across,
    "chains": _nodes,
    "hypotheses": lambda a: modal.hypotheses(modal.evidence(a.table("chains"), a.settings.labels)),
    "parameters": _parameters,
    "quality_factors": lambda a: modal.q_from_decay(a.table("parameters")),
    "comparison": lambda a: comparison.aggregate(_metrics(a)),
    "regimes": lambda a: regimes.describe(regimes.score(regimes.evaluate(_condition_values(a)))),
}
#: Stages whose rows several others read.
_SHARED = {"spectrum", "peaks", "stft", "frame_peaks", "tracking", "candidates", "cross_condition", "chains", "comparison"}


def analyze(recordings: DataFrame, settings: Settings | None = None, folder: str | None = None) -> Analysis:
    """recordings: recording_id, label_idx, samples."""
    return Analysis(recordings, settings or Settings(), folder)
