"""Assignment, crossings, smoothing and permutations against brute force."""

import itertools
import random

import numpy as np
import pytest

from carillon.operators import assignment, association, diagnosis, energy, kernels, modal, stft, within


def best(pairs):
    """Most pairs, then least cost, over all ways."""
    rows = sorted({r for r, _ in pairs})
    found = (0, 0.0)
    for columns in itertools.product(*[[None, *(c for r2, c in pairs if r2 == r)] for r in rows]):
        used = [c for c in columns if c is not None]
        if len(set(used)) == len(used):
            found = min(found, (-len(used), sum(pairs[r, c] for r, c in zip(rows, columns, strict=True) if c is not None)))
    return found


def test_sparse_assignment_is_best_and_certified():
    rng = random.Random(3)
    for _ in range(150):
        pairs = {(rng.randrange(5), rng.randrange(5)): round(rng.random(), rng.choice([1, 3])) for _ in range(rng.randint(1, 12))}
        rows = {r: i for i, r in enumerate(sorted({r for r, _ in pairs}))}
        columns = {c: i for i, c in enumerate(sorted({c for _, c in pairs}))}
        r, c, cost = np.array([rows[a] for a, _ in pairs]), np.array([columns[b] for _, b in pairs]), np.array(list(pairs.values()))
        match, u, v, left_out = kernels.sparse_assign(r, c, cost)
        got = {(i, int(j)) for i, j in enumerate(match) if j >= 0}
        total = sum(x for a, b, x in zip(r, c, cost, strict=True) if (a, b) in got)
        assert (-len(got), pytest.approx(total)) == best(pairs)
        slack = cost - u[r] - v[c]
        assert slack.min() > -1e-9 and all(abs(s) < 1e-9 for a, b, s in zip(r, c, slack, strict=True) if (a, b) in got)
        assert all(u[i] == pytest.approx(left_out) for i in range(len(match)) if match[i] < 0) and all(v[j] == 0 for j in range(len(v)) if j not in match)


SCHEMA = "experiment_id string, label_idx int, recording_id string, candidate_id long, frequency_hz double, tau_s double, stability double, drift_hz double, rmse_hz double, r_squared double, ambiguous_fraction double, near_threshold_fraction double, assignment_margin double, impact_excited boolean"


def test_experiments_in_one_table_are_matched_apart(spark):
    rng = random.Random(1)
    one = [(label, f"r{label}", k, 100 + 40 * rng.random(), 1 + rng.random(), rng.random(), *[rng.random() for _ in range(6)], rng.random() < 0.5) for label in range(3) for k in range(25)]
    weights = {"frequency": 1.0, "tau": 0.2, "frequency_stability": 0.2, "impact_evidence": 0.1}
    results = []
    for names in (["a"], ["b"], ["a", "b"]):
        shift = {"a": 0.0, "b": 0.37}  # the second experiment is the first, moved, so the two would compete
        rows = [(n, *r[:3], r[3] + shift[n], *r[4:]) for n in names for r in one]
        refs = spark.createDataFrame(rows, SCHEMA)
        pairs = diagnosis.diagnosed_pairs(refs, {"absolute_frequency_gate": 3.0, "cost_above_threshold": 1.5}, weights, 4.0).cache()
        found = diagnosis.assign_diagnosed(pairs, 1.5)
        results.append({(r.experiment_id, r.pair, r.lower_candidate_id, r.higher_candidate_id) for r in found.collect()})
        nodes = assignment.assign_nodes(pairs)
        assert all(r.not_below_prices and r.tight_if_matched for r in assignment.pair_certificate(pairs, nodes).collect())
        assert all(r.in_bounds and r.at_bound_if_left_out and r.one_mate for r in assignment.node_certificate(nodes).collect())
        chains = association.chains(refs, found)
        assert chains.count() == len(rows) and chains.groupBy("chain_id").agg({"experiment_id": "approx_count_distinct"}).filter("`approx_count_distinct(experiment_id)` > 1").count() == 0
    assert results[2] == results[0] | results[1] and len(results[0]) == len(results[1]) > 20


def test_crossings_equal_a_walk(spark):
    rng = np.random.default_rng(0)
    rows, targets = [], []
    for rec in range(30):
        mag = rng.integers(0, 9, rng.integers(1, 60)).astype(float)
        rows += [(rec, k, 0.5 * k, float(m)) for k, m in enumerate(mag)]
        targets += [(rec, float(t)) for t in rng.uniform(-2, 32, 4).round(1)]
    bins, want = spark.createDataFrame(rows, "recording_id long, k long, f_hz double, mag double"), {}
    for rec, t in targets:
        f, m = (np.array([r[i] for r in rows if r[0] == rec]) for i in (2, 3))
        tops = [k for k in range(1, len(m) - 1) if m[k] > m[k - 1] and m[k] > m[k + 1]]
        if not tops:
            continue
        p = min(tops, key=lambda k: (abs(f[k] - t), -m[k], k))
        cut, ends = m[p] * 10**-0.15, []
        for step in (-1, 1):
            k = p
            while 0 <= k < len(m) and m[k] > cut:
                k += step
            ends.append(f[k] + (cut - m[k]) / (m[k - step] - m[k]) * (f[k - step] - f[k]) if 0 <= k < len(m) else None)
        want[rec, t] = (f[p], *ends)
    got = {(r.recording_id, r.target_hz): (r.peak_hz, r.low_hz, r.high_hz) for r in modal.bandwidths(bins, spark.createDataFrame(targets + [(99, 1.0)], "recording_id long, target_hz double")).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == tuple(pytest.approx(v) if v is not None else None for v in values)


@pytest.mark.parametrize("radius", [0, 1, 3, 40])
def test_sliding_median_over_chunks(spark, radius):
    rng = np.random.default_rng(radius)
    rows = [(rec, "m", n, 0.1 * n, float(v)) for rec in (1, 2) for n, v in enumerate(rng.integers(0, 6, 50 * rec))]
    df = spark.createDataFrame(rows, "recording_id long, metric string, n long, t_s double, value double").repartition(3)
    got = {(r.recording_id, r.n): r.value for r in stft.smooth(df, radius, "median", chunk=7).collect()}
    for rec in (1, 2):
        x = [r[4] for r in rows if r[0] == rec]
        assert [got[rec, n] for n in range(len(x))] == [np.median(x[max(0, n - radius) : n + radius + 1]) for n in range(len(x))]
    assert len(got) == len(rows)


def test_plateaus_count_at_their_end_and_permutations_count_themselves(spark):
    a = [0, 2, 2, 1, 0, 3, 3, 3, 0, 1, 1]
    s = spark.createDataFrame([(1, n, float(n), float(v)) for n, v in enumerate(a)], "source_id long, n long, t_s double, a double")
    assert tuple(energy.modulation_period(s).first())[1:] == (5.0, 2)
    n = np.arange(40)
    pair = [(1, 2, int(i), float(np.sin(i)), float(-np.sin(i))) for i in n] + [(1, 3, int(i), float(i), 1.0) for i in n] + [(1, 4, i, float(i), float(-i)) for i in range(3)]
    got = {r.source_b: r for r in energy.block_permutation_test(spark.createDataFrame(pair, "source_a long, source_b long, n long, x double, y double"), 4, 99).collect()}
    assert got[2].observed == pytest.approx(-1) and got[2].p_value == pytest.approx(0.01)
    assert got[3].observed is None and got[3].p_value is None and got[4].p_value is None


def plain_clusters(refs, limits):
    """Recording by recording, every member and medoid compared in loops, dense assignment.  refs: (recording, candidate, f, stability, tau, r2, impact)."""
    w = limits.weights

    def compare(a, b):
        d = abs(a[2] - b[2])
        gaps = {"absolute_frequency_gate": d, "relative_frequency_gate": d / (0.5 * (a[2] + b[2])), "log_frequency_gate": abs(np.log2(a[2] / b[2]))}
        first = next(g for g in within.GATES if g in limits.gates)
        total = w.get("frequency", 0) * gaps[first] / limits.gates[first]
        for k, name, f in ((3, "frequency_stability", lambda x, y: abs(x - y)), (4, "tau", lambda x, y: abs(np.log2(x / y))), (5, "amplitude_fit_quality", lambda x, y: abs(x - y)), (6, "impact_evidence", lambda x, y: float(x != y))):
            if a[k] is not None and b[k] is not None:
                total += w.get(name, 0) * f(a[k], b[k])
        lacks = w.get("tau", 0) > 0 and None in (a[4], b[4]) and not limits.allow_missing_tau
        return total, all(gaps[g] <= limits.gates[g] for g in limits.gates) and not lacks and total <= limits.maximum_cost

    clusters, vague = [], []
    for name in sorted({r[0] for r in refs}):
        new = sorted(r for r in refs if r[0] == name)
        costs = np.full((len(clusters), len(new)), np.inf)
        for i, c in enumerate(clusters):
            middle = float(np.median([m[2] for m in c]))
            medoid = min(c, key=lambda m: (abs(m[2] - middle), m[:2]))
            for j, r in enumerate(new):
                total, fine = compare(medoid, r)
                if fine and all(compare(m, r)[1] for m in c):
                    costs[i, j] = total
        chosen = {(i, j) for i, j in kernels.assign(np.where(np.isfinite(costs), costs, 1e6)) if np.isfinite(costs[i, j])} if costs.size else set()
        for i, j in chosen:
            others = [x for x in [*np.delete(costs[i], j), *np.delete(costs[:, j], i)] if np.isfinite(x)]
            vague[i] |= bool(others) and min(others) - costs[i, j] <= limits.ambiguity_margin
            clusters[i].append(new[j])
        for j, r in enumerate(new):
            if j not in {b for _, b in chosen}:
                clusters.append([r])
                vague.append(False)
    return {(frozenset(r[:2] for r in c), v) for c, v in zip(clusters, vague, strict=True)}


@pytest.mark.parametrize(
    "limits",
    [
        within.Limits({"absolute_frequency_gate": 3.0}, maximum_cost=0.9),
        within.Limits({"relative_frequency_gate": 0.02, "log_frequency_gate": 0.03}, {"frequency": 1.0, "frequency_stability": 0.3, "tau": 0.2, "amplitude_fit_quality": 0.3, "impact_evidence": 0.2}, 1.4, allow_missing_tau=False),
        within.Limits({"absolute_frequency_gate": 4.0, "log_frequency_gate": 0.02}, {"frequency": 0.5, "tau": 0.4, "impact_evidence": 0.3}, 1.0),
    ],
)
def test_clusters_by_five_costs_equal_loops(spark, limits):
    rng = random.Random(9)
    some = lambda x: x if rng.random() < 0.8 else None
    refs = [(e, label, f"r{k:02}", c, 100 + 120 * rng.random(), some(rng.random()), some(0.5 + rng.random()), some(rng.random()), some(rng.random() < 0.5)) for e in "ab" for label in (0, 2) for k in range(9) for c in range(7)]
    df = spark.createDataFrame(refs + [("a", 0, "r00", 99, None, None, None, None, None)], "experiment_id string, label_idx int, recording_id string, candidate_id long, frequency_hz double, stability double, tau_s double, r_squared double, impact_excited boolean")
    found = within.associate(df.repartition(5), limits).cache()
    got = {}
    for r in within.members(found).collect():
        got.setdefault((r.experiment_id, r.label_idx, r.cluster_id), []).append(r)
    for e in "ab":
        for label in (0, 2):
            have = {(frozenset((m.recording_id, m.candidate_id) for m in c), c[0].ambiguous) for k, c in got.items() if k[:2] == (e, label)}
            assert have - {(frozenset({("r00", 99)}), False)} == plain_clusters([r[2:] for r in refs if r[:2] == (e, label)], limits)
    assert any(len(c) > 2 for c in got.values()) and {r.reason for r in within.compared_pairs(found).collect()} >= {None, "cluster_internal_inconsistency"}
    totals = df.groupBy("experiment_id", "label_idx").agg({"recording_id": "approx_count_distinct"}).withColumnRenamed("approx_count_distinct(recording_id)", "recordings")
    tables = within.cluster_criteria(within.members(found), totals, limits).collect()
    assert len(tables) == sum(len(c) > 1 for c in got.values()) and all(r.reproducible == (r.failed == "") for r in tables)
    assert within.alone(within.members(found), within.compared_pairs(found)).count() == sum(len(c) == 1 for c in got.values())
    assert within.associate(df.limit(0), limits).count() == 0


def test_exports_appear_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from carillon.operators import publish as p

    root = str(tmp_path / "out")
    make = lambda ids, chains: {"recordings": spark.createDataFrame([(i,) for i in ids], "recording_id long"), "candidates": spark.createDataFrame([(i, 2 * i, c) for i, c in zip(ids, chains)], "recording_id long, candidate_id long, note string")}
    assert p.current_version(spark, root) is None
    assert p.publish(make([1, 2], "ab"), root) == "v000001"
    with pytest.raises(FileExistsError):
        p.publish(make([3], "c"), root)
    assert p.publish(make([3], "c"), root, "skip") is None and p.published(spark, root, "recordings").count() == 2
    # a crash before the pointer moves, and rows without a parent: the former version stays
    monkeypatch.setattr(p, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        p.publish(make([4, 5, 6], "def"), root, "versioned")
    monkeypatch.undo()
    broken = make([7], "g") | {"recordings": make([8], "h")["recordings"]}
    with pytest.raises(ValueError, match=r"candidates\(recording_id\): 1"):
        p.publish(broken, root, "replace")
    assert p.current_version(spark, root) == "v000001" and sorted(r.note for r in p.published(spark, root, "candidates").collect()) == ["a", "b"]
    assert p.publish(make([9, 10, 11], "ijk"), root, "versioned") == "v000003"
    assert p.published(spark, root, "candidates").count() == 3 and p.published(spark, root, "candidates", "v000001").count() == 2
    assert p.publish(make([12], "l"), root, "replace") == "v000004" and "v000003" not in p.versions(spark, root) and "v000001" in p.versions(spark, root)
    assert {(r.table, r.row_count) for r in p.published_summary(spark, root).collect()} == {("recordings", 1), ("candidates", 1)}
    assert p.publication_problems(spark, root) == []
    spark.createDataFrame([(12, 24, "x")], "recording_id long, candidate_id long, note string").write.mode("overwrite").parquet(f"{root}/v000004/candidates")
    assert p.publication_problems(spark, root) == ["candidates: other content"]


def moving_peaks(recordings=3, frames=60, seed=5):
    """Crossing, fading and returning tones with stray peaks."""
    rng = random.Random(seed)
    rows = []
    for rec in range(recordings):
        tones = [(100.0 * (k + 1) + rng.uniform(-5, 5), rng.uniform(-0.6, 0.6)) for k in range(6)]
        for n in range(frames):
            if rng.random() < 0.06:
                continue
            for f, drift in tones:
                if rng.random() < 0.85:
                    rows.append((rec, n, 0.01 * n, f + drift * n + rng.uniform(-0.5, 0.5), rng.random()))
            rows += [(rec, n, 0.01 * n, rng.uniform(50, 700), rng.random()) for _ in range(rng.randint(0, 2))]
    return rows


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_long_recordings_are_tracked_as_whole_ones(spark, batch):
    from carillon.operators import tracking

    df = spark.createDataFrame(moving_peaks(), "recording_id long, frame long, t_s double, f_hz double, mag double").repartition(4)
    rules = tracking.Rules(0.02, 2, 3, (1.0, 0.2))
    want = sorted(map(tuple, tracking.track_peaks(df, 0.02, 2, 3, (1.0, 0.2)).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, tracking.track_long(df, rules).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({r[:2] for r in got}) > 15


def test_streamed_tracks_equal_whole_ones_and_late_peaks_come_out(spark, tmp_path):
    import os

    from carillon.operators import tracking
    from carillon.streaming import track_stream

    schema = "recording_id long, frame long, t_s double, f_hz double, mag double"
    rows, rules = moving_peaks(2, 40), tracking.Rules(0.02, 1, 2)
    want = sorted((str(r.recording_id), r.track_id, r.frame, r.frequency_hz, r.cost, r.margin) for r in tracking.track_peaks(spark.createDataFrame(rows, schema), 0.02, 1, 2).collect())
    # one file a batch: frames 12 and 13 come a batch late, but within what waits; frame 100 lets the last ones go; frame 2 is too late then
    takes = [lambda n: n < 9, lambda n: n == 9, lambda n: 10 <= n < 16 and n not in (12, 13), lambda n: n in (12, 13) or 16 <= n < 19, lambda n: n >= 19]
    parts = [[r for r in rows if take(r[1])] for take in takes] + [[(i, 100, 1.0, 1.0, 1.0) for i in (0, 1)], [r for r in rows if r[1] == 2]]
    os.mkdir(f"{tmp_path}/in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        name = next(f for f in os.listdir(f"{tmp_path}/{k}") if f.startswith("part-"))
        os.rename(f"{tmp_path}/{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1000 * (k + 1),) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = track_stream(stream, rules, hold=8).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    points = tracking.numbered(found.filter("NOT late AND frame < 100").withColumn("t_s", 0.01 * found["frame"]))
    assert sorted((r.recording_id, r.track_id, r.frame, r.frequency_hz, r.cost, r.margin) for r in points.collect()) == want
    assert sorted((r.recording_id, r.frequency_hz) for r in found.filter("late").collect()) == sorted((str(r[0]), r[3]) for r in rows if r[1] == 2)
