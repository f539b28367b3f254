"""The n-gram join against brute force, with hot groups, odd rows and trees of many blocks."""

import random

import numpy as np
import pytest
from test_near_dup import brute, texts

from carillon.llm import ngram_join


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 16), (5, 80, 256)])
def test_groups_equal_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # several blocks a bucket
    rows = [(3 * i + 7, t) for i, t in enumerate(texts(width))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, node string").repartition(5)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_join(df, width, percent).collect()}
    parts, sizes = brute(rows, width, percent)
    assert got == {i: (parts[i], sizes[i]) for i, _ in rows}


def test_links_that_no_star_finds(spark, monkeypatch):
    """Chains of small steps: the ends are unlike, and most links are between nodes that are no bucket's smallest."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(70)]
    for _ in range(12):
        t = [word() for _ in range(90)]
        for _ in range(9):
            t = [*t[2:], word(), word()]
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(passage + [word() for _ in range(rng.randint(8, 40))])) for i in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    parts, _ = brute(rows, 3, 85)
    assert got == parts and len(set(parts.values())) < len(rows) - 90


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (None, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d e f"), (7, "x y z w v"), (7, "x y z w v"), (8, "X y z w v")]
    got = sorted((r.doc_id or 0, r.component_id, r.n_shingles) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (0, 7, 3), (0, 7, 3), (7, 7, 3), (7, 7, 2), (7, 7, 2), (8, 7, 2)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_join(empty).count() == 0


def sets(rng, count, n, universe):
    flat = [np.sort(rng.choice(universe, n, replace=False)) for _ in range(count)]
    return np.concatenate(flat), np.arange(count + 1) * n


def test_linked_sets_share_a_first_shingle_in_any_order():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for percent in (80, 85, 100):
        for n in (1, 5, 20, 333):
            base = rng.choice(universe, n, replace=False)
            out = int(n * (100 - percent) / (100 + percent))  # as many as may be exchanged
            other = np.concatenate([base[: n - out], rng.choice(np.setdiff1d(universe, base), out, replace=False)])
            flat, bounds = np.concatenate([np.sort(base), np.sort(other)]), np.array([0, n, 2 * n])
            for common in (np.zeros(0, np.uint64), np.sort(base[: n // 2]), np.sort(universe)):
                first, take = ngram_join.first_shingles(flat, bounds, common, percent)
                assert set(flat[:n][first[:n]]) & set(flat[n:][first[n:]]) and first.sum() == take.sum()


def test_trees_leave_no_pair_out():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    flat, bounds = sets(rng, 90, 40, universe[:60])
    p = ngram_join.points(flat, bounds)
    row = {"sizes": np.full(90, 40), "components": np.arange(90), "nodes": np.arange(90)}
    tree = ngram_join._Leaves({f"{k}_x": v.astype(np.int64).tobytes() for k, v in row.items()} | {"points_x": ngram_join._packed(p)}, "x")
    i, j, shared = ngram_join.tree_pairs(tree, None, 60)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    as_sets = [set(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for a in range(90):
        for b in range(a + 1, 90):
            both = len(as_sets[a] & as_sets[b])
            if 100 * both >= 60 * (80 - both):
                assert (a, b) in found
    assert all(s >= len(as_sets[a] & as_sets[b]) for a, b, s in zip(i.tolist(), j.tolist(), shared.tolist(), strict=True)) and len(found) < 90 * 89 / 2
