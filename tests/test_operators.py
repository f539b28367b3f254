"""Operators on small made-up inputs: edges, missing values, independence of order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from carillon.functions import dbfs, frequency_change, frequency_distance, le_tol, track_unit
from carillon.operators import association, energy, modal, spectrum, stft, temporal, tracking
from carillon.sources import experiment, synthetic, wav
from carillon.streaming import framed_levels


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.first()


def recs(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "recording_id long, samples array<double>")


def long_form(spark, *rows):
    return recs(spark, *rows).select("recording_id", F.posexplode("samples").alias("n", "x")).withColumn("t_s", F.col("n") / 8)


def test_scalar_helpers(spark):
    d = spark.createDataFrame([(1.0, 1.0 + 1e-13, 0.0, "DB", None)], "a double, b double, z double, u string, m double")
    r = d.select(
        le_tol(F.col("b"), F.col("a")).alias("le"), dbfs(F.col("z")).alias("silence"), track_unit(F.col("u")).alias("unit"), frequency_change(F.col("a"), F.col("m"), 0.5).alias("change"), frequency_distance(F.lit(2.0), F.lit(1.0), "cents").alias("cents")
    ).first()
    assert r.le and r.silence == float("-inf") and r.unit == "dbfs" and r.change == "indeterminate" and r.cents == 1200
    with pytest.raises(Exception, match="unknown amplitude unit"):
        d.select(track_unit(F.lit("furlong"))).collect()


def test_silence_keeps_missing_values(spark):
    sig = long_form(spark, [0] * 16, [0.5, -0.5] * 8)
    m = {r.recording_id: r for r in temporal.recording_metrics(sig).collect()}
    assert m[0].crest is None and m[0].peak_dbfs == float("-inf") and m[1].crest == pytest.approx(1)
    t = {r.recording_id: r for r in temporal.temporal_metrics(sig, 8).collect()}
    assert t[0].dynamic_range_db == float("-inf") and t[1].dynamic_range_db == pytest.approx(0)


def test_moving_envelopes_match_numpy(spark):
    x = np.array([1.0, 2, -4, 7, 0, 3, -1])
    for w in (1, 4, 7):
        got = [r.envelope for r in temporal.moving_rms(long_form(spark, x), w).orderBy("n").collect()]
        assert got == pytest.approx(np.sqrt(np.convolve(x * x, np.ones(w) / w, "same")))


def test_impact_and_transient(spark):
    x = [0.001, -0.001] * 10 + [0.0, 0.2, 1.0, 0.6, 0.3] + [0.01] * 15
    sig = long_form(spark, x)
    hit = temporal.impact(sig).first()
    assert (hit.impact_n, hit.peak_n) == (21, 22) and 0 < hit.confidence <= 1
    assert temporal.transient_end(sig, temporal.impact(sig), hold=4).first().transient_end_n == 25


def test_longest_run(spark):
    flags = long_form(spark, [1, 1, 0, 1, 1, 1, 0], [0, 0]).withColumn("on", F.col("x") == 1)
    assert {r.recording_id: r.longest_run for r in temporal.longest_run(flags, "on").collect()} == {0: 3, 1: 0}


def test_spectrum_of_known_sine_and_stft(spark):
    rows = synthetic.pure_sine(spark, 64.0, 1.0, 1024, 0.7).orderBy("n").toPandas()
    r = recs(spark, rows.x)
    top = spectrum.dominant_bin(spectrum.spectrum_bins(r, 1024)).first()
    assert top.f_hz == 64 and top.mag == pytest.approx(0.7, rel=1e-5)
    frames = stft.stft_bins(r, 1024, 256, 128)
    assert frames.select("frame").distinct().count() == 7
    assert stft.stft_bins(r, 1024, 300, 300, pad_end=True).select("frame").distinct().count() == 4


def test_tracks_follow_two_lines(spark):
    rows = [(0, f, f / 10, 48.0 + 0.1 * (f % 3), 1.0) for f in range(20)] + [(0, f, f / 10, 96.0, 0.5) for f in range(20) if f not in (7, 8)]
    points = tracking.track_peaks(spark.createDataFrame(rows, "recording_id long, frame long, t_s double, f_hz double, mag double"), max_gap=2)
    feats = tracking.track_features(points).orderBy("track_id").collect()
    assert [f.observation_count for f in feats] == [20, 18] and feats[1].longest_gap == 2
    fit = tracking.frequency_fit(points).orderBy("track_id").collect()
    assert fit[1].r_squared is None and fit[1].slope_hz_per_s == pytest.approx(0)


def test_decay_time_is_recovered(spark):
    rows = [(0, 0, i, i / 100, 100.0, float(np.exp(-i / 100 / 2.0))) for i in range(50)]
    points = spark.createDataFrame(rows, "recording_id long, track_id long, frame long, t_s double, frequency_hz double, amplitude double")
    assert tracking.amplitude_fit(points).first().tau_s == pytest.approx(2.0, rel=1e-9)
    q = modal.q_from_decay(spark.createDataFrame([(500.0, 2.0, 0.0, 0.0)], "frequency_hz double, tau_s double, frequency_u double, tau_u double")).first()
    assert q.q_decay == pytest.approx(np.pi * 1000, rel=1e-12)


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 20, 60).round(2), rng.uniform(0, 20, 60).round(2)
    left = spark.createDataFrame([(0, i, float(f)) for i, f in enumerate(a)], "g int, id long, f double")
    right = spark.createDataFrame([(0, i, float(f)) for i, f in enumerate(b)], "g int, id long, f double")
    got = {(r.l_id, r.r_id) for r in association.band_join(left, right, ["g"], "f", 0.5).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 0.5 + 1e-12}


def test_clusters_of_repeats(spark):
    rows = [(0, "A", i, f) for i, f in enumerate([100.0, 200.0, 300.0])] + [(0, "B", i, f) for i, f in enumerate([100.4, 199.5, 450.0])]
    refs = spark.createDataFrame(rows, "label_idx int, recording_id string, candidate_id long, frequency_hz double")
    members = association.cluster_condition(refs).toPandas()
    sets = {tuple(sorted(g.frequency_hz)) for _, g in members.groupby("cluster_id")}
    assert sets == {(100.0, 100.4), (199.5, 200.0), (300.0,), (450.0,)}


def test_matches_split_conflicts_and_keep_ids(spark):
    rows = [(0, "A", 1, 100.0), (0, "A", 2, 100.6), (1, "B", 3, 100.5), (1, "B", 4, 101.0), (1, "B", 5, 300.0)]
    refs = spark.createDataFrame([(*r, None, None) for r in rows], "label_idx int, recording_id string, candidate_id long, frequency_hz double, tau_s double, stability double")
    found = association.matches(association.pair_costs(refs, 2.0))
    assert {(r.lower_candidate_id, r.higher_candidate_id) for r in found.collect()} == {(1, 3), (2, 4)}
    nodes = association.chains(refs, found)
    assert nodes.count() == 5 and nodes.select("chain_id").distinct().count() == 3


def test_conserved_pair_energy_and_opposed_trends(spark):
    t = np.arange(21) * 0.05
    x = 1 - 0.6 * t
    y = np.sqrt(1 - x * x)
    rows = [("a", float(s), float(v)) for s, v in zip(t, x)] + [("b", float(s), float(v)) for s, v in zip(t, y)]
    s = spark.createDataFrame(rows, "source_id string, t_s double, a double").withColumn("n", F.lit(0)).withColumn("energy", F.col("a") * F.col("a"))
    pair = spark.createDataFrame([("a", "b")], "source_a string, source_b string")
    al = energy.align(s, pair)
    assert energy.pair_energy(al).first().relative_range == pytest.approx(0, abs=1e-9)
    assert energy.trends(al).first().opposed


def test_wav_round_trip_and_failures(spark, tmp_path):
    x = np.array([[0.0, 0.5, -1.0, 0.25], [0.0, 0.25, -0.5, 0.125]])
    for bits, fl in ((8, False), (16, False), (24, False), (32, False), (32, True), (64, True)):
        (tmp_path / f"s{bits}{fl}.wav").write_bytes(wav.encode(x, 8000, bits, fl))
    (tmp_path / "bad.wav").write_bytes(b"no wav")
    got = wav.read_wav(spark, str(tmp_path))
    assert got.filter("failure IS NOT NULL").count() == 1
    for r in got.filter("failure IS NULL").collect():
        assert r.samples == pytest.approx(x[r.channel], abs=1 / 128) and r.sample_rate_hz == 8000
    m = wav.channel_metrics(got).filter("channel = 0").collect()
    assert all(v.clipping and v.peak == pytest.approx(1.0) for v in m)
    cut = wav.select_and_trim(got, 1, -1, 0.000125, 0.000375).filter("subtype = 'DOUBLE'").first()
    assert cut.samples == [-0.25, 0.5]


def test_configuration(tmp_path):
    p = tmp_path / "e.toml"
    p.write_text('[experiment]\nname = "x"\n[pipeline]\na = 1\n')
    assert experiment.merged(experiment.load_configuration(str(p)), {"pipeline": {"b": 2}})["pipeline"] == {"a": 1, "b": 2}
    assert experiment.recording_spec("mf:2=/x/y.wav") == ("mf", "2", "/x/y.wav")
    p.write_text("[other]\n")
    with pytest.raises(ValueError, match="unknown sections"):
        experiment.load_configuration(str(p))


def test_stream_frames_equal_the_table(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "k", float(i)) for i in range(50)]
    table = spark.createDataFrame(rows, "event_id long, s string, event_type string, value double").select("event_id", F.col("s").cast("timestamp").alias("ts"), "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = framed_levels(stream).writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("levels").collect())) == sorted(map(tuple, framed_levels(table).collect()))


def test_experiment_from_wav_files(spark, tmp_path, capsys):
    from carillon import cli, report
    from carillon.plans.experiment import STAGES

    rate, t = 4096, np.arange(4096) / 4096
    args = []
    for k, label in enumerate(("pp", "p", "mf", "f", "ff")):
        x = 0.1 * (k + 1) * (np.exp(-t / 0.6) * np.sin(2 * np.pi * 500.3 * t) + 0.3 * np.exp(-t / 0.4) * np.sin(2 * np.pi * 1210 * t))
        (tmp_path / f"{label}.wav").write_bytes(wav.encode(x, rate, 16))
        args.append(f"{label}={tmp_path}/{label}.wav")
    (tmp_path / "c.toml").write_text("[pipeline]\nframe = 256\nhop = 128\npeak_height = 0.004\n")
    common = [*args, "--config", f"{tmp_path}/c.toml", "--folder", f"{tmp_path}/kept"]
    assert cli.run(["analyze", *common]) == 0
    counts = __import__("json").loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts["load"] == 5 and counts["candidates"] >= 10 and counts["chains"] >= 10 and counts["hypotheses"] >= 2
    assert cli.run(["report", *common, "--out", f"{tmp_path}/r.md"]) == 0
    text = (tmp_path / "r.md").read_text()
    assert report.problems(text) == [] and "## Hypotheses" in text
    assert cli.run(["analyze", f"mf={tmp_path}/none.wav"]) == 3 and cli.run(["analyze", "loud=x.wav"]) == 2
    assert cli.run(["inspect"]) == 0 and cli.run(["version"]) == 0 and len(STAGES) == 21


def test_stages_are_counted_as_they_are_written_and_failures_stay_where_they_are(spark, tmp_path, monkeypatch):
    from carillon.plans import experiment as graph

    t = np.arange(4096) / 4096
    silent = np.where(t < 0.25, 0.0005, 1.0)
    tones = lambda g: g * silent * np.exp(-np.maximum(t - 0.25, 0) / 0.5) * (np.sin(2 * np.pi * 500 * t) + 0.3 * np.sin(2 * np.pi * 1210 * t))
    rows = [(i, i // 2, tones(0.1 * (i + 1)).tolist()) for i in range(4)]
    recs = spark.createDataFrame(rows, "recording_id long, label_idx int, samples array<double>")
    settings = graph.Settings(rate=4096, frame=256, hop=128, peak_height=0.002)
    a = graph.analyze(recs, settings, f"{tmp_path}/kept")
    ends = {r.stage: r for r in a.run(["quality_factors"]).collect()}
    assert {r.status for r in ends.values()} == {"success"} and "comparison" not in ends and ends["load"].row_count == 4
    for stage in ("candidates", "chains", "parameters"):
        assert ends[stage].row_count == a.table(stage).count() > 0
    excited = {r.impact_excited for r in a.table("candidates").collect()}
    assert True in excited and a.table("parameters").filter("tau_u IS NOT NULL").count() > 0 and a.table("quality_factors").filter("q_decay_u IS NOT NULL").count() > 0
    again = graph.analyze(recs, settings, f"{tmp_path}/kept")
    assert again.count("candidates") == ends["candidates"].row_count
    monkeypatch.setitem(graph._BUILD, "chains", lambda a: (_ for _ in ()).throw(ValueError("no chains today")))
    ends = {r.stage: r for r in graph.analyze(recs, settings, f"{tmp_path}/other").run().collect()}
    assert (ends["chains"].status, ends["chains"].error) == ("failed", "no chains today") and ends["hypotheses"].status == ends["quality_factors"].status == "skipped"
    assert ends["regimes"].status == "success" and ends["hypotheses"].error == "needs chains"


def test_synthetic_validation_passes(spark):
    from carillon import cli

    assert [f["status"] for f in cli.validate(spark)] == ["passed", "passed"]


def test_analyses_in_one_folder_do_not_take_up_each_others_tables(spark, tmp_path):
    from carillon.plans.experiment import Settings, analyze, stage_problems

    def tone(f0):
        sig = synthetic.pure_sine(spark, f0, 1.0, 1024)
        return sig.groupBy(F.lit(0).cast("long").alias("recording_id"), F.lit(0).alias("label_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s.x).alias("samples"))

    settings = Settings(rate=1024, frame=256, hop=128)
    for f0 in (50.0, 120.0, 50.0):
        a = analyze(tone(f0), settings, f"{tmp_path}/run")
        top = a.table("spectrum").orderBy(F.desc("mag")).first()
        assert top.f_hz == f0
    path = next(str(p) for p in (tmp_path / "run").glob("*/spectrum"))
    assert stage_problems(spark, path, a.identity() | {"version": "other"})[0] in ("version_mismatch", "recordings_fingerprint_mismatch")
    assert stage_problems(spark, path + "x", a.identity()) == ["stage_not_complete"]


def test_an_analysis_sees_how_a_sound_changes(spark):
    """Noise that turns into a tone: flatness falls from the first third to the last."""
    import numpy as np

    from carillon.plans.experiment import Settings, _over_time, analyze

    rng = np.random.default_rng(2)
    t = np.arange(8192) / 4096
    x = np.where(t < 0.8, rng.normal(size=len(t)), np.sin(2 * np.pi * 300 * t) + 0.001 * rng.normal(size=len(t)))
    rows = [(i, 0, (x * g).tolist()) for i, g in enumerate((1.0, 0.5))]
    a = analyze(spark.createDataFrame(rows, "recording_id long, label_idx int, samples array<double>"), Settings(rate=4096, frame=512, hop=256, peak_height=0.05))
    m = _over_time(a).collect()
    assert len(m) == 2 and all(r.region_late_minus_early_spectral_flatness < -0.15 and r.time_change_point_count >= 1 and r.late_tonal_energy_fraction > 0.9 and r.time_temporal_coverage_fraction == 1.0 for r in m)
    assert a.table("regimes").first().course == "broadband_to_tonal"
    from carillon.functions import METRIC_NAMES, recognised_metric

    named = a.table("comparison").withColumn("known", recognised_metric(F.col("metric")))
    assert named.filter("NOT known").count() == 0 and {r.metric for r in named.collect()} >= set(METRIC_NAMES)
    assert named.filter("metric = 'global_spectral_rolloff_95_hz' AND median > 0").count() == 1 and named.filter("metric = 'time_spectral_flatness_slope_per_s' AND median < 0").count() == 1
    a.release()


def test_reports_and_configurations(tmp_path):
    from carillon import report

    assert report.problems("A Confirmed physical mode; causality demonstrated.") == ["forbidden claim: confirmed physical mode", "forbidden claim: causality demonstrated"]
    config = {"experiment": {"name": "x", "take": 2, "on": True}, "recordings": [{"path": "a.wav", "label": "pp"}, {"path": "b.wav", "gain": 0.5}], "pipeline": {"bands": [1, 2.5]}}
    for end in ("json", "toml"):
        experiment.write_configuration(f"{tmp_path}/c.{end}", config)
        assert experiment.load_configuration(f"{tmp_path}/c.{end}") == config
    assert json.loads(experiment.serialised(config)) == config


def test_scenarios_and_their_recovery(spark):
    from carillon.operators import validation

    parts = synthetic.scenario_components(spark)
    assert parts.select("scenario").distinct().count() == 17
    found = [("single_ideal", 0, 500.5, True), ("single_ideal", 1, 900.0, True), ("multiple_isolated", 0, 250.1, True), ("multiple_isolated", 1, 499.0, False), ("mains_hum", 0, 500.0, True)]
    got = {r.scenario: r for r in validation.candidate_recovery(parts, spark.createDataFrame(found, "scenario string, candidate_id long, frequency_hz double, accepted boolean")).collect()}
    assert (got["single_ideal"].matched_count, got["single_ideal"].false_count, got["single_ideal"].passed) == (1, 1, False)
    assert (got["multiple_isolated"].missed_count, got["multiple_isolated"].rejected_expected_count) == (1, 1)
    assert got["mains_hum"].passed and not got["noise"].passed
    sig = synthetic.scenario_signals(spark, ("noise", "clipping", "single_ideal"), 0.25, 2048).groupBy("scenario").agg(F.max(F.abs("x")).alias("top"), F.count("*").alias("n")).collect()
    top = {r.scenario: r.top for r in sig}
    assert all(r.n == 512 for r in sig) and top["clipping"] < 1.19 and top["single_ideal"] <= 1.0
    wave = {r.n: r.envelope for r in synthetic.scenario_waves(spark, ("emergence_disappearance",), 1.0, 100).filter("component_id = 'emerging'").collect()}
    assert wave[34] == 0 and wave[35] == pytest.approx(0.7) and wave[99] < wave[35]


def test_pair_diagnosis_reasons_and_missing_values(spark):
    from carillon.operators import diagnosis

    names = "label_idx int, recording_id string, candidate_id long, frequency_hz double, stability double, drift_hz double, rmse_hz double, tau_s double, r_squared double, ambiguous_fraction double, near_threshold_fraction double, assignment_margin double, impact_excited boolean"
    rows = [
        (0, "a", 1, 100.0, 0.1, 0.0, 0.0, 1.0, 0.9, 0.2, 0.0, 0.5, True),
        (1, "b", 2, 101.0, 0.3, 0.0, 0.0, 2.0, 0.9, None, 0.1, 0.5, False),
        (1, "b", 3, 102.5, None, None, None, None, None, None, None, None, None),
    ]
    refs = spark.createDataFrame(rows, names)
    gate = {"absolute_frequency_gate": 2.0}
    weights = {"frequency_stability": 1.0, "tau": 0.5, "ambiguity": 1.0, "near_threshold": 1.0, "impact_evidence": 0.25}
    got = {r.higher_candidate_id: r for r in diagnosis.diagnose(refs, gate, weights, 4.0).collect()}
    assert abs(got[2].cost - (0.5 + 0.2 + 0.5 + 0.2 + 0.1 + 0.25)) < 1e-12 and got[2].reason is None and got[2].admissible
    assert got[3].reason == "absolute_frequency_gate" and got[3].impact_evidence_cost == 0 and got[3].tau_change is None
    why = lambda **kw: {r.higher_candidate_id: r.reason for r in diagnosis.diagnose(refs, kw.pop("limits", {"absolute_frequency_gate": 3.0}), weights, 4.0, **kw).collect()}
    assert why() == {2: None, 3: None} and why(need_tau=True) == {2: None, 3: "missing_tau"}
    assert why(need_evidence=True)[3] == "missing_preimpact_evidence" and why(need_impact=True)[2] == "impact_excitation_required"
    assert why(limits=gate | {"tau_gate": 0.5})[2] == "tau_gate" and why(limits=gate | {"maximum_ambiguous_fraction": 0.5})[2] == "missing_tracking_evidence"
    assert why(limits=gate | {"minimum_assignment_margin": 0.6})[2] == "minimum_assignment_margin" and why(limits=gate | {"cost_above_threshold": 1.0})[2] == "cost_above_threshold"
    assert diagnosis.diagnose(refs.limit(0), gate, weights, 4.0).count() == 0
