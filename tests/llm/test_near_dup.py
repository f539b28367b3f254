"""Near duplicates against brute force, with hot groups and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from carillon.llm import near_dup
from carillon.llm.graph import components


def sets_of(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) >= width:
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def brute(rows, width, percent=80):
    sets = {i: sets_of(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def texts(seed=5, hot=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(hot):  # one group of near copies at all likenesses
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    out += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(20)]) for _ in range(60)]
    out += [" ".join(base)] * 40  # exact copies
    for n in (1, 2, 3, 4, 5, 6, 9):  # small sets
        t = [word() for _ in range(n)]
        out += [" ".join(t), "  ".join(t).upper(), "\n".join(t + [word()])]
    out += [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(80)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_groups_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(near_dup, "BLOCK", 64)  # several blocks a bucket
    rows = [(3 * i + 7, t) for i, t in enumerate(texts(width))]
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width).collect()}
    parts, sizes = brute(rows, width)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (parts[i], sizes[i], parts[i] == i)


def test_rows_that_share_an_id_keep_all_their_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    a, b = [word() for _ in range(60)], [word() for _ in range(60)]
    near = lambda t, at: " ".join([*t[:at], word(), *t[at + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 30)), (3, near(b, 20)), (None, near(b, 40)), (None, " ".join(a)), (None, near(a, 10)), (7, "alone")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, component int, key int")
    got = near_dup.near_duplicates(frame, width=4)
    assert sorted(((r.doc_id or 0), r.component_id) for r in got.collect()) == [(0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]
    stands = sorted(r.doc_id for r in got.filter("first").collect())
    assert stands == [1, 1, 7]  # one text of each of the two groups, which have the same smallest id


def test_a_group_of_near_copies_and_one_outlier(spark, monkeypatch):
    """The outlier shares buckets with many copies but is like only a few of them."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 6000)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    group = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(200)] = word()
        group.append(t)
    chain = [*base[:100], *[word() for _ in range(12)], *base[112:]]
    chain2 = [*chain[:150], *[word() for _ in range(15)], *chain[165:]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate([*group, chain, chain2])]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows, 5)[0]


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t "), (None, "one two three"), (8, "ONE two three"), (9, "one two three"), (9, "one two three"), (10, "one"), (11, "One"), (12, "à b"), (13, "À b"), (14, "x" * 200000)]
    got = near_dup.near_duplicates(spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, id string"), width=4).collect()
    parts = sorted(((r.doc_id or 0, r.component_id, r.n_shingles) for r in got))
    assert parts == [(0, 8, 1), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 1), (9, 8, 1), (9, 8, 1), (10, 10, 1), (11, 10, 1), (12, 12, 1), (13, 13, 1), (14, 14, 1)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_likeness():
    rng = np.random.default_rng(1)
    for n in (6, 40, 3000):
        for share in (0.5, 0.8, 0.95):
            k = max(1, round(n * share))
            found = []
            for _ in range(40):
                both = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
                a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (n - k) // 2, dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
                true = k / (len(a) + len(b) - k)
                marks = near_dup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                found.append(float(near_dup.estimate((marks[0] == marks[1]).mean())) - true)
            assert abs(np.mean(found)) < 0.06


def test_slices_of_arrays_are_read_right():
    a = pa.array(["Ärger à la Carte", "b", "ÉTÉ x y z w", "q r s t"] * 3)
    flat, bounds = near_dup.shingle_sets(a[2:7], 2)
    for k, t in enumerate(a[2:7].to_pylist()):
        alone, _ = near_dup.shingle_sets(pa.array([t]), 2)
        assert flat[bounds[k] : bounds[k + 1]].tolist() == alone.tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[j] == 100 for j in range(100, 160)) and got[200] == 200 and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
