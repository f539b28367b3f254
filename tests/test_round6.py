"""Findings of round 4: each test fails on the code before it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carillon.operators import assignment, association, kernels, near_assignment, validation
from carillon.plans import QUERIES

SF = "/root/testdata/sf0.001"


def _kernels(df):
    """What the grouped kernels of a query get, as text."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapGroupsInArrow" in line]


def _refs(spark):
    """Crowded candidates of two experiments: equal frequencies, missing and odd values, some alone, some without a frequency."""
    draw = random.Random(3)
    rows = []
    for i in range(260):
        f = draw.choice([100 + draw.randrange(24) / 8, 100 + draw.random() * 3, 500 + i * 7.0, 2.5])
        f = None if i == 7 else float("nan") if i == 8 else f
        rows.append((f"x{i % 2}", i % 3, f"r{i % 4}", i, f, draw.choice([None, 0.5, 1.0, 1.7, float("nan")]), draw.choice([None, 0.0, 0.3, draw.random(), float("nan")])))
    return spark.createDataFrame(rows, "experiment_id string, label_idx int, recording_id string, candidate_id long, frequency_hz double, tau_s double, stability double")


@pytest.mark.parametrize("max_cost", [1.0, 0.6])
def test_pairs_are_certified_where_they_are_listed(spark, max_cost):
    """every pair was sent on by its group, its lower and its higher candidate."""
    assert all("lower_candidate_id" not in line for line in _kernels(QUERIES["hungarian_certificate"](spark, SF)))
    refs = _refs(spark)
    pairs = association.pair_costs(refs, 0.5).filter(F.col("cost") <= max_cost)
    nodes = near_assignment.assign_refs(refs, 0.5, max_cost=max_cost)
    assert all(r.in_bounds and r.at_bound_if_left_out and r.one_mate for r in assignment.node_certificate(nodes).collect())
    found, known = near_assignment.certificate(refs, 0.5, max_cost=max_cost), assignment.pair_certificate(pairs, assignment.assign_nodes(pairs))
    assert found.columns == known.columns
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(tuple(r) for r in known.collect()) and len(rows) > 300
    assert sorted(tuple(r) for r in assignment.pair_certificate(pairs, nodes).collect()) == rows
    assert near_assignment.certificate(refs.limit(0), 0.5).count() == 0 and near_assignment.assign_refs(refs.limit(0), 0.5).count() == 0


def test_matches_need_no_table_of_pairs(spark):
    """all admissible pairs were joined with their groups and sent to the tasks of these."""
    assert all("lower_candidate_id" not in line for line in _kernels(QUERIES["hungarian_matches"](spark, SF)))
    refs = _refs(spark)
    key = ["experiment_id", "pair", "lower_recording_id", "lower_candidate_id", "higher_recording_id", "higher_candidate_id"]
    pairs = {tuple(r[c] for c in key): r.cost for r in association.pair_costs(refs, 0.5).filter("cost <= 1").collect()}
    found, known = (x.collect() for x in (association.match_rows(near_assignment.assign_refs(refs, 0.5)), association.matches(association.pair_costs(refs, 0.5))))
    total = lambda rows: {k: (len(c), pytest.approx(sum(c))) for k in {(r.experiment_id, r.pair) for r in rows} if (c := [r.cost for r in rows if (r.experiment_id, r.pair) == k])}
    assert total(found) == total(known) and len(found) > 40
    for r in found:
        mine = tuple(r[c] for c in key)
        others = [c for k, c in pairs.items() if k != mine and k[:2] == mine[:2] and (k[2:4] == mine[2:4] or k[4:] == mine[4:])]
        assert pairs[mine] == pytest.approx(r.cost, abs=1e-12)
        assert r.margin == (pytest.approx(min(others) - r.cost, abs=1e-9) if others else None)
    again = association.match_rows(near_assignment.assign_refs(refs.orderBy(F.desc("candidate_id")), 0.5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def _nearest_first(components, tracks, limit):
    """Pairs in order of distance and ids, each component and track once, out of all pairs."""
    left, used, out = set(), set(), {}
    for apart, s, c, t in sorted((abs(f - g), s, c, t) for s, c, f in components for z, t, g in tracks if s == z and f is not None and g is not None and abs(f - g) <= limit):
        if (s, c) not in left and (s, t) not in used:
            left.add((s, c)), used.add((s, t))
            out[s, c] = (t, apart)
    return out


def test_tracks_are_matched_without_all_pairs(spark):
    """all components of a scenario were joined with all its tracks."""
    for name in ("track_matching", "candidate_recovery"):
        assert "abs((f0" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    draw = random.Random(9)
    at = lambda: draw.choice([draw.randrange(40) / 4, draw.random() * 20, 100 + draw.randrange(3) * 2.0, 1e9, None, float("nan"), float("inf")])
    components, tracks = ([(f"s{i % 3}", f"{x}{i * 7 % 90}", at()) for i in range(90)] for x in "ct")
    made = (spark.createDataFrame(rows + rows[:9], f"scenario string, {names}") for rows, names in ((components, "component_id string, f0 double"), (tracks, "track_id string, frequency_hz double")))
    found = validation.match_tracks(*made, limit_hz=2.0).distinct().collect()
    known = _nearest_first(*([(s, i, f if f is not None and abs(f) < float("inf") else None) for s, i, f in rows] for rows in (components, tracks)), 2.0)
    assert {(r.scenario, r.component_id): (r.track_id, r.apart_hz) for r in found if r.status == "matched"} == known and len(known) > 20
    assert len(found) == 90 and all((r.track_id is None) == (r.status == "missed") for r in found)


def test_nearest_pairs_are_those_of_all_pairs():
    """places so close that rounding makes them equally far among these."""
    draw = random.Random(4)
    kinds = [lambda: draw.randrange(12) / 2, lambda: draw.random() * 6, lambda: draw.choice([0.0, 1e-20, 1e-17, 1.0, 1 + 1e-15, 2.0, 3.0])]
    for trial in range(300):
        f, g = ([kinds[trial % 3]() for _ in range(draw.randrange(14))] for _ in "fg")
        i, j = kernels.nearest_pairs(np.array(f), np.array(g), 2.0)
        known = _nearest_first([("", c, x) for c, x in enumerate(f)], [("", t, x) for t, x in enumerate(g)], 2.0)
        assert {("", c): t for c, t in zip(i.tolist(), j.tolist(), strict=True)} == {k: t for k, (t, _) in known.items()}
