"""Conversation repair and Exponion clustering against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from carillon.llm import conversations, exponion

WHITE = " \t\n\x0b\x0c\r"
INF = float("inf")


# ---- conversations ------------------------------------------------------------------


def damage(rows):
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(turns, faults):
    """Every way through, one turn after the other, each state with its best (cost, audit, output)."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserts(ways):
        for _ in range(3):
            for i, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    j = step[role[0]].get(i)
                    if j is not None:
                        new = (cost + 3, audit + "I", out + ((role, ""),))
                        ways[j] = min(ways.get(j, (INF, "", ())), new)
        return ways

    ways = inserts({0: (0, "", ())})
    for (role, text), fault in zip(turns, faults, strict=True):
        more = 3 if fault == "truncated" else 0
        then = {}
        for i, (cost, audit, out) in ways.items():
            options = [(i, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                j = step.get(role[:1], {}).get(i)
                if j is not None:
                    options.append((j, (cost + more, audit + "K", out + ((role, text),))))
                for other in ("user", "assistant"):
                    j = step[other[0]].get(i)
                    if j is not None:
                        options.append((j, (cost + 3 + more, audit + "R", out + ((other, text),))))
            for j, w in options:
                then[j] = min(then.get(j, (INF, "", ())), w)
        ways = inserts(then)
    return min(ways[i] for i in (0, 3) if i in ways)


def brute(rows):
    found = {}
    convs = defaultdict(list)
    for r in damage(rows):
        convs[r[0]].append(r[1:])
    for c in {r[0] for r in rows}:
        turns = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            left = text.strip(WHITE)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "none")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, out = cheapest([r[1:] for r in turns], faults)
        found[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(turns)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


def talk(seed=3, convs=120, long=700):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t\n", None, "é. ", "Ω…", "ok. "]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            rows.append((c if c else None, rng.choice([t, t, t, 3 * t, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.random()}."))
    rows += [(10_000, t // 2, ["user", "assistant"][t % 2], f"line {t % 90}{'.' if t % 7 else ''}") for t in range(long)]  # over many segments
    rows += [(10_001, 5, "user", "The same.")] * 300  # one run of equal turns
    rows += [(10_002, t, None, " ") for t in range(40)]  # nothing stays
    rng.shuffle(rows)
    return rows


def digest_rows(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("segment", [16, conversations.SEGMENT])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    rows = talk()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, times int, kind string").repartition(5)
    whole = conversations.repair_conversations
    monkeypatch.setattr(conversations, "repair_conversations", lambda d: whole(d, segment=segment, fan_in=2))
    got = digest_rows(conversations.repair_digest(df))
    assert got == brute(rows)


def test_repaired_turns_are_sound(spark):
    rows = talk(seed=8)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repaired = conversations.repair_conversations(df, segment=32)
    by = defaultdict(list)
    for r in repaired.turns().collect():
        by[r.conv_id].append((r.part, r.seg, r.pos, r.role))
    audits = {r.conv_id: r.audit for r in repaired.summary().collect()}
    for c, audit in audits.items():
        roles = "".join(r[3][0] for r in sorted(by[c]))
        assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(audit.replace("D", ""))


def test_repair_of_nothing(spark):
    assert conversations.repair_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_products_are_associative():
    rng = random.Random(1)
    m = [conversations.turn_matrix(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(9)]
    for x, y, z in zip(m, m[1:], m[2:]):
        left, right = conversations.product(conversations.product(x, y), z), conversations.product(x, conversations.product(y, z))
        assert conversations._near(left) == conversations._near(right)


# ---- clusters -----------------------------------------------------------------------


def lloyd(rows, clusters, rounds, dim):
    kept = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    centroids = [z for _, z in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(z, c, strict=True)), k) for k, c in enumerate(centroids)) for _, z in kept]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            own = [z for (_, z), (_, j) in zip(kept, of, strict=True) if j == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i if i is not None else -1, k, d) for (i, _), (d, k) in zip(kept, assign(), strict=True)), centroids


def vectors(seed, n, dim, values):
    rng = random.Random(seed)
    rows = [(i, [rng.choice(values) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]  # equal vectors
    rows += [(3, rows[1][1]), (None, rows[2][1]), (n * 2, None), (n * 2 + 1, [None] * dim), (n * 2 + 2, [INF] * dim), (n * 2 + 3, [0.5])]
    return rows


@pytest.mark.parametrize("values", [[0.0, 0.004, -0.004, 0.008], [i / 37 - 1 for i in range(70)], [1e6, -3e6, 2.5, 0.0]])
def test_clusters_equal_brute_force(spark, values):
    rows = vectors(4, 150, 3, values)
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    found, centroids = exponion.cluster_vectors(df, clusters=12, rounds=4, dim=3)
    want, known = lloyd(rows, 12, 4, 3)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in found.collect()) == want
    assert centroids == known


def test_clusters_of_few_and_far_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    found, centroids = exponion.cluster_vectors(spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], schema))
    assert sorted((r.vec_id, r.distance) for r in found.collect()) == [(1, 0), (2, 0)] and len(centroids) == 2
    far = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1e300] * 64)], schema)
    found, _ = exponion.cluster_vectors(far, clusters=1)
    assert {r.distance for r in found.collect()} == {(1 << 63) - 1}
    assert exponion.cluster_digest(far.limit(0)).count() == 0


def test_search_looks_at_few_centroids_and_keeps_ties():
    rng = np.random.default_rng(2)
    middles = rng.integers(-4000, 4000, (60, 8))
    z = middles[rng.integers(0, 60, 3000)] + rng.integers(-30, 30, (3000, 8))
    centroids = middles.tolist() + [middles[7].tolist()]  # two equal ones: the first gets all
    nothing = np.zeros(len(z))
    space = exponion._Space(centroids, None)
    cluster, upper, lower, seen = exponion.search(space, z, np.full(len(z), -1), nothing, nothing)
    assert seen == len(z) * len(centroids) and 60 not in cluster
    moved = [[c + int(d) for c, d in zip(row, rng.integers(-9, 9, 8), strict=True)] for row in centroids]
    cluster, upper, lower, seen = exponion.search(exponion._Space(moved, centroids), z, cluster, upper, lower)
    exact = ((z[:, None] - np.array(moved)[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and seen < len(z) * 6
