"""Findings of round 3: each test fails on the code before it."""

import random

from pyspark.sql import functions as F

from carillon.functions import rounded
from carillon.llm import exact_topk
from carillon.operators import association


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_blocks_are_not_sent_to_the_driver(spark):
    """the blocks' files are small, so the planner broadcast the query blocks repeated for every shard."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    found = exact_topk.exact_top_k(df, every=50, k=2, query_block=2, shard=50)
    assert "SortMergeJoin [dim" in _plan(found)
    assert found.count() == 16


def test_band_join_keeps_pairs_at_the_gate(spark):
    """1000.3 / 0.1 lies just below 10003, so its partner at 1000.4 was two buckets on."""
    left = spark.createDataFrame([(1, round(1000 + i / 10, 1)) for i in range(200)], "g int, f double")
    right = left.select("g", (F.round(F.col("f") + 0.1, 1)).alias("f"))
    got = {(r.l_f, r.r_f) for r in association.band_join(left, right, ["g"], "f", 0.1).collect()}
    a, b = [r.f for r in left.collect()], [r.f for r in right.collect()]
    assert got == {(x, y) for x in a for y in b if abs(x - y) <= 0.1 + 1e-12}


def _references(seed, n=800):
    rng = random.Random(seed)
    hz = lambda: None if rng.random() < 0.02 else rng.choice([round(100 + rng.random() * 3, 2), round(100 + rng.randrange(30) * 0.1, 1)])
    return [(rng.randrange(5), f"r{rng.randrange(3)}", i, hz(), rng.choice([None, 0.5, 1.0, 2.0, 0.7]), rng.choice([None, 0.1, 0.2, 0.3])) for i in range(n)]


REFS = "label_idx int, recording_id string, candidate_id long, frequency_hz double, tau_s double, stability double"


def test_best_partners_equal_all_pairs(spark):
    """Matches and partners without the table of pairs, dense scales, ties and pairs at the gate among them."""
    refs = spark.createDataFrame(_references(3), REFS)
    pairs = association.pair_costs(refs, 0.1)
    rows = lambda df: sorted(map(str, rounded(df, 9).collect()))
    assert rows(association.mutual_best(pairs)) == rows(association.best_matches(refs, 0.1))
    for side in ("lower", "higher"):
        assert rows(association.splits(pairs, side)) == rows(association.close_partners(refs, side, 0.1))


def test_chains_find_matches_once_and_broadcast_nothing(spark, tmp_path):
    """References are wide rows in a small file, which the planner sent to the driver."""
    spark.createDataFrame(_references(4), REFS).write.parquet(str(tmp_path / "refs"))
    refs = spark.read.parquet(str(tmp_path / "refs"))
    found = association.chains(refs, association.best_matches(refs, 0.1))
    plan = _plan(found)
    assert "Broadcast" not in plan and plan.count("FlatMapGroupsInArrow") <= 2  # before: all pairs ten times
    nodes = found.collect()
    assert sorted((n.label_idx, n.candidate_id) for n in nodes) == sorted((r.label_idx, r.candidate_id) for r in refs.collect())
    assert any(n.node_index > 1 for n in nodes)


def test_peaks_hold_a_bounded_number_of_recordings(spark):
    """a batch's recordings were all turned into Python rows at once."""
    from carillon.operators import spectrum

    assert spectrum._AT_ONCE <= 1024
    n = 2 * spectrum._AT_ONCE + 3
    recs = spark.range(n).select(F.col("id").alias("recording_id"), F.array(*(F.lit(float(i % 5) * (i % 3)) for i in range(32))).alias("samples"))
    found = spectrum.peaks(spectrum.spectrum_bins(recs.coalesce(1), 64.0, n_fft=32)).groupBy("recording_id").agg(F.count("*").alias("c")).collect()
    assert len(found) == n and len({r.c for r in found}) == 1


def test_partners_inside_a_cost_equal_all_pairs(spark):
    """pairs below a cost were listed to be counted."""
    refs = spark.createDataFrame(_references(5), REFS)
    counted = association.best_partners(refs, 0.1, within=0.6).groupBy("is_lower").agg(F.sum("inside").alias("n")).collect()
    assert {r.n for r in counted} == {association.pair_costs(refs, 0.1).filter("cost <= 0.6").count()} and len(counted) == 2


def test_hypotheses_and_locations_look_at_chains_once(spark):
    """Evidence was joined to itself, so matches and chains were made two to three times."""
    from carillon.operators import modal

    refs = spark.createDataFrame(_references(6), REFS).filter("frequency_hz IS NOT NULL")
    refs = refs.withColumn("coverage", F.when(F.col("candidate_id") % 5 != 0, F.col("candidate_id") % 3 / 3)).withColumn("impact_excited", F.col("candidate_id") % 2 == 0)
    one = refs.select("candidate_id", "tau_s", "coverage", "impact_excited")
    nodes = association.chains(refs, association.best_matches(refs, 0.1)).join(one.hint("merge"), "candidate_id")
    for found in (modal.hypotheses(modal.evidence(nodes)), modal.locations(nodes)):
        assert _plan(found).count("FlatMapGroupsInArrow") == 1
    apart = modal.weighted_median(nodes.withColumn("w", F.coalesce("coverage", F.lit(0.0))), "chain_id", "frequency_hz", "w")
    held = {r.chain_id: r.weighted_median_hz for r in modal.locations(nodes).collect()}
    assert {r.chain_id: r.weighted_median for r in apart.collect()} == {k: v for k, v in held.items() if v is not None}
    assert any(v is None for v in held.values())


def test_clusters_are_made_once_and_pairs_only_for_those_who_want_them(spark):
    """clusters were made four times over, every pair as a Python row."""
    from carillon.operators import within

    refs = spark.createDataFrame(_references(7), REFS).withColumn("impact_excited", F.col("candidate_id") % 3 == 0)
    limits = within.Limits({"absolute_frequency_gate": 0.05}, {"frequency": 1.0, "tau": 0.2, "impact_evidence": 0.3}, 1.1)
    whole, short = within.associate(refs, limits), within.associate(refs, limits, listed=False)
    rows = lambda df: sorted(map(str, rounded(df, 9).collect()))
    assert short.filter("kind = 'pair'").count() == 0 and rows(within.members(whole)) == rows(within.members(short))
    found = rows(within.alone(within.members(whole), within.compared_pairs(whole)))
    assert rows(within.alone_members(short)) == found and found
    for one in (within.alone_members(short), within.invariants(within.members(short), limits)):
        assert _plan(one).count("FlatMapGroupsInArrow") == 1 and "Broadcast" not in _plan(one)
    assert {(r.clusters, r.only_one) for r in within.invariants(within.members(short), limits).collect()} == {(1, True)}


def test_assignment_of_many_pairs_is_that_of_few():
    """rows with many columns are looked at as arrays, and get the same mates and prices, ties too."""
    import numpy as np

    from carillon.operators import kernels

    rng = np.random.default_rng(5)
    for k in range(60):
        rows, columns = (np.unique(x, return_inverse=True)[1] for x in np.argwhere(rng.random(rng.integers(2, 40, 2)) < (0.1, 0.3)[k % 2]).T)
        if not 0 < len(rows) < 16 * (rows.max() + 1):  # these go by the heap
            continue
        costs = rng.random(len(rows)) if k % 3 else rng.integers(0, 3, len(rows)) / 2
        *by_heap, left_out = kernels.sparse_assign(rows, columns, costs)
        order = np.lexsort((columns, rows))
        by_rows = kernels._dense_paths(np.searchsorted(rows[order], np.arange(rows.max() + 2)), columns[order], costs[order], int(columns.max()) + 1, left_out)
        assert all(np.array_equal(a, b) for a, b in zip(by_heap, by_rows, strict=True))
