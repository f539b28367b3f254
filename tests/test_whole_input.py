"""Queries over all of their input, held against plain Python over the same tables."""

import os
from statistics import mean, median

import duckdb
import numpy as np
import pytest

from carillon import plans
from carillon.operators import association

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def by_user():
    """user_id → [(t_s, value)] in order."""
    found = {}
    for user, us, value in duckdb.sql(f"SELECT user_id, epoch_us(ts), value FROM '{SF}/events.parquet' ORDER BY user_id, ts, event_id").fetchall():
        found.setdefault(user, []).append((us, value))
    return {user: [((us - rows[0][0]) / 1e6, x) for us, x in rows] for user, rows in found.items()}


def test_smooth_covers_every_series(spark):
    got = {(x.recording_id, x.n): x.value for x in plans.QUERIES["smooth"](spark, SF).collect()}
    known = {(u, n): mean(x for _, x in rows[max(0, n - 2) : n + 3]) for u, rows in by_user().items() for n in range(len(rows))}
    assert got == pytest.approx(known, abs=1e-5)


def test_change_points_cover_every_series(spark):
    known = set()
    for user, rows in by_user().items():
        x = [v for _, v in rows]
        hit = [2 <= n <= len(x) - 2 and abs(median(x[n : n + 2]) - median(x[n - 2 : n])) >= 100 for n in range(len(x))] + [False]
        start = None
        for n, h in enumerate(hit):
            if h and start is None:
                start = n
            elif not h and start is not None:
                if n - start >= 2:
                    known.add((user, start, n - start))
                start = None
    got = {(x.recording_id, x.at, x.places) for x in plans.QUERIES["change_points"](spark, SF).collect()}
    assert got == known
    assert {u % 3 for u, _, _ in known} == {0, 1, 2}


def brute_clusters(refs, gate):
    """Sorted (label, frequencies of a cluster): each recording's best assignment by trying all, over the whole condition at once."""
    found = []
    for label in {x[0] for x in refs}:
        clusters = []
        for name in sorted({x[1] for x in refs if x[0] == label}):
            new = sorted(x[1:] for x in refs if x[:2] == (label, name))
            options = []
            for c in new:
                near = []
                for j, members in enumerate(clusters):
                    middle = median(m[2] for m in members)
                    medoid = min(members, key=lambda m: (abs(m[2] - middle), m[0], m[1]))[2]
                    if all(abs(m[2] - c[2]) <= gate for m in members):
                        near.append((j, abs(medoid - c[2]) / gate))
                options.append(near)

            def best(i, used, options=options):
                if i == len(options):
                    return (0, 0.0, ())
                n, cost, chosen = best(i + 1, used)
                top = (n, cost, (None, *chosen))
                for j, x in options[i]:
                    if j not in used:
                        n, cost, chosen = best(i + 1, used | {j})
                        top = min(top, (n - 1, cost + x, (j, *chosen)), key=lambda t: (t[0], round(t[1], 9)))
                return top

            for c, j in zip(new, best(0, frozenset())[2], strict=True):
                clusters.append([c]) if j is None else clusters[j].append(c)
        found += [(label, tuple(sorted(m[2] for m in c))) for c in clusters]
    return sorted(found)


def clusters_of(rows):
    found = {}
    for x in rows:
        found.setdefault((x.label_idx, x.cluster_id), []).append(x.frequency_hz)
    return sorted((label, tuple(sorted(f))) for (label, _), f in found.items())


def test_clusters_by_group_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    refs = [(label, name, i, float(f)) for label in (0, 1) for name in "ABCD" for i, f in enumerate(rng.uniform(0, 30, 7))]
    df = spark.createDataFrame(refs, "label_idx int, recording_id string, candidate_id long, frequency_hz double")
    assert association.gate_groups(df, 2.0).select("label_idx", "grp").distinct().count() > 2
    assert clusters_of(association.cluster_condition(df, 2.0).collect()) == brute_clusters(refs, 2.0)


def test_references_without_frequency_stand_alone(spark):
    refs = [(0, "A", 1, 5.0), (0, "A", 2, None), (0, "B", 3, 5.5), (0, "B", 4, float("nan"))]
    df = spark.createDataFrame(refs, "label_idx int, recording_id string, candidate_id long, frequency_hz double")
    rows = association.cluster_condition(df, 2.0).collect()
    found = {}
    for x in rows:
        found.setdefault(x.cluster_id, set()).add(x.candidate_id)
    assert sorted(map(sorted, found.values())) == [[1, 3], [2], [4]]


def test_condition_clusters_cover_every_accepted_reference(spark):
    sf = SF.replace("0.001", "0.01")
    refs = duckdb.sql(f"SELECT p_size % 5, p_brand, p_partkey, p_retailprice::DOUBLE FROM '{sf}/part.parquet' WHERE p_partkey % 11 <> 3").fetchall()
    known = brute_clusters(refs, 0.05)
    rows = plans.QUERIES["condition_clusters"](spark, sf).collect()
    assert len(rows) == len(refs) and clusters_of(rows) == known
    brands = {label: len({x[1] for x in refs if x[0] == label}) for label in range(5)}
    summary = plans.QUERIES["condition_cluster_summary"](spark, sf).collect()
    assert sorted((x.label_idx, x.member_count) for x in summary) == sorted((label, len(f)) for label, f in known)
    assert all(x.recordings == brands[x.label_idx] for x in summary)


def grids():
    """user_id → scaled envelope at whole days, up to the series' own end."""
    found = {}
    for user, rows in by_user().items():
        t, x = np.array(rows).T
        at = np.arange(int(t[-1] // 86400) + 1)
        found[user] = np.interp(at * 86400.0, t, x / x.max())
    return found


def test_envelope_grid_reaches_each_series_end(spark):
    known = {(u, n): a for u, g in grids().items() for n, a in enumerate(g)}
    got = {(x.source_id, x.n): x.a for x in plans.QUERIES["envelope_resample"](spark, SF).collect()}
    assert max(n for _, n in known) > 25
    assert got == pytest.approx(known, abs=1e-5)


def test_growth_and_pairs_over_the_whole_grid(spark):
    g = grids()
    growth = {x.source_id: x.growth_fraction for x in plans.QUERIES["delayed_growth"](spark, SF).collect()}
    assert growth == pytest.approx({u: (a - np.minimum.accumulate(a)).max() / a.max() for u, a in g.items()}, abs=1e-5)
    sizes = {(x.source_a, x.source_b): x.n for x in plans.QUERIES["envelope_trends"](spark, SF).collect()}
    assert sizes == {(u, v): min(len(g[u]), len(g[v])) for u in g for v in g if u < v and u // 5 == v // 5}


def test_assignment_margins_over_all_peaks(spark):
    peaks = {}
    for x in plans.QUERIES["spectral_peaks"](spark, SF).select("recording_id", "k", "f_hz").collect():
        peaks.setdefault(x.recording_id, []).append((x.k, x.f_hz))
    known = {}
    for rec, found in peaks.items():
        f = [hz for _, hz in sorted(found)]
        cost = {(u, v): abs(f[u - 1] - f[-v]) + u / 16 + v / 64 for u in range(1, len(f) + 1) for v in range(1, len(f) + 1)}
        for (u, v), c in cost.items():
            others = [x - c for (a, b), x in cost.items() if (a == u) != (b == v)]
            known[rec, u, v] = min(others) if others else None
    got = {(x.recording_id, x.row, x.col): x.margin for x in plans.QUERIES["assignment_margins"](spark, SF).collect()}
    assert max(u for _, u, _ in known) > 3
    assert got == pytest.approx(known, abs=1e-5)
