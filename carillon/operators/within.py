"""Repeats of one condition clustered recording by recording: one-to-one to medoids, by five costs, every member admissible.

Conditions fall into groups between which no gate reaches; a group is one kernel's work.  For each
recording, in order of its id, the places of its candidates that a medoid reaches are found by two
binary searches for all clusters at a time, costs and the check of all members are array
expressions over those pairs alone, and the assignment is sparse.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import le_tol, ratio
from .assignment import scope_of
from .kernels import sparse_assign

_KEY = ["recording_id", "candidate_id"]
#: Names of the gates and costs, in order of precedence.
GATES = ("absolute_frequency_gate", "relative_frequency_gate", "log_frequency_gate")
COSTS = ("frequency", "frequency_stability", "tau", "amplitude_fit_quality", "impact_evidence")
_VALUES = ("frequency_hz", "stability", "tau_s", "r_squared", "impact")
_ROWS = (
    "kind string, cluster_id long, recording_id string, candidate_id long, frequency_hz double, medoid_recording_id string, medoid_candidate_id long, "
    + ", ".join(f"{c}_cost double" for c in COSTS)
    + ", cost double, reason string, selected boolean, row_margin double, column_margin double, ambiguous boolean, cluster_size long, least_cost double, compared long, vague boolean"
)
#: Pairs of a new candidate and a member that are compared at once.
_AT_ONCE = 1 << 18
_CALL = 4096  # references


@dataclass(frozen=True)
class Limits:
    """gates: any of GATES, one at least (the first scales the cost of frequency).  weights: by cost; one without is 0."""

    gates: dict[str, float]
    weights: dict[str, float] = field(default_factory=lambda: {"frequency": 1.0})
    maximum_cost: float = 1.0
    ambiguity_margin: float = 0.1
    allow_missing_tau: bool = True
    allow_missing_impact: bool = True
    minimum_repeats: int = 2
    minimum_coverage: float = 0.0
    maximum_dispersion: float | None = None


def _distances(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    return dict(zip(GATES, (np.abs(a - b), np.abs(a - b) / (0.5 * (a + b)), np.abs(np.log2(a / b))), strict=True))


def _compared(a: np.ndarray, b: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, 5) costs, their sums and the first reason against each pair ('' if none).  a and b: (pairs, 5) values."""
    away = _distances(a[:, 0], b[:, 0])
    active = [g for g in GATES if g in limits.gates]
    w = [limits.weights.get(c, 0.0) for c in COSTS]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [away[active[0]] / limits.gates[active[0]], np.abs(a[:, 1] - b[:, 1]), np.abs(np.log2(a[:, 2] / b[:, 2])), np.abs(a[:, 3] - b[:, 3]), np.where(np.isnan(a[:, 4] + b[:, 4]), np.nan, a[:, 4] != b[:, 4])]
    costs = np.stack([np.nan_to_num(p, nan=0.0) * x for p, x in zip(parts, w, strict=True)], 1)
    total = costs.sum(1)
    lacks = lambda c, allowed: np.isnan(a[:, c] + b[:, c]) & (w[c] > 0 and not allowed)
    against = [(away[g] > limits.gates[g], g) for g in active]
    against += [(lacks(2, limits.allow_missing_tau), "missing_tau"), (lacks(4, limits.allow_missing_impact), "missing_preimpact_evidence"), (total > limits.maximum_cost, "cost_above_threshold")]
    return costs, total, np.select([f for f, _ in against], [n for _, n in against], "")


def _reach(f: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of what the gates let near each frequency, a little wide."""
    low, high = np.full(len(f), -np.inf), np.full(len(f), np.inf)
    for name, g in limits.gates.items():
        if name == GATES[0]:
            one, two = f - g, f + g
        else:
            factor = (2 + g) / (2 - g) if name == GATES[1] and g < 2 else np.inf if name == GATES[1] else 2.0**g
            one, two = f / factor, f * factor
        low, high = np.maximum(low, one), np.minimum(high, two)
    return low - 1e-9 * np.abs(low), high + 1e-9 * np.abs(high)


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, one after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _consistent(clusters: list[list[int]], near: np.ndarray, new: np.ndarray, values: np.ndarray, limits: Limits) -> np.ndarray:
    """Whether every member of each cluster in ``near`` admits the candidate beside it; a bounded part at a time."""
    flat = np.array([i for c in clusters for i in c])
    size = np.array([len(c) for c in clusters])
    first, sizes = (np.cumsum(size) - size)[near], size[near]
    ends = np.cumsum(sizes)
    fine = np.ones(len(near), bool)
    i = 0
    while i < len(near):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + _AT_ONCE, "right")))
        pair = np.repeat(np.arange(i, j), sizes[i:j])
        admits = _compared(values[flat[_expanded(first[i:j], sizes[i:j])]], values[new[pair]], limits)[2] == ""
        fine[i:j] = np.bincount(pair - i, ~admits, j - i) == 0
        i = j
    return fine


@dataclass
class Pairs:
    """Pairs of a cluster's medoid and a candidate that were compared: an array a column, places in ``names``."""

    cluster: np.ndarray
    of: np.ndarray
    medoid: np.ndarray
    costs: np.ndarray
    cost: np.ndarray
    reason: np.ndarray
    selected: np.ndarray
    margins: np.ndarray
    ambiguous: np.ndarray


@dataclass
class Seen:
    """Of every candidate, on both sides of its pairs: the least cost, how many there are, and whether any is ambiguous."""

    least: np.ndarray
    compared: np.ndarray
    vague: np.ndarray

    def add(self, place: np.ndarray, cost: np.ndarray, vague: np.ndarray) -> None:
        np.minimum.at(self.least, place, cost)
        self.compared += np.bincount(place, minlength=len(self.compared))
        self.vague[place[vague]] = True


def clustered(names: list[tuple[str, int]], values: np.ndarray, limits: Limits, listed: bool = True) -> tuple[list[list[int]], list[bool], list[Pairs], Seen]:
    """Clusters of places in ``names``, which are in order, whether each was ambiguous, the pairs that were compared (none unless ``listed``), and what they tell of each candidate."""
    recordings = [n[0] for n in names]
    starts = [0, *(i for i in range(1, len(names)) if recordings[i] != recordings[i - 1]), len(names)]
    clusters: list[list[int]] = []
    unsure: list[bool] = []
    pairs: list[Pairs] = []
    seen = Seen(np.full(len(names), np.inf), np.zeros(len(names), np.int64), np.zeros(len(names), bool))
    medoids = np.zeros(0, int)
    for begin, end in zip(starts, starts[1:]):
        own = np.arange(begin, end)[np.argsort(values[begin:end, 0], kind="stable")]
        near = np.zeros(0, int)
        if len(clusters):
            low, high = _reach(values[medoids, 0], limits)
            first = np.searchsorted(values[own, 0], low, "left")
            counts = np.maximum(np.searchsorted(values[own, 0], high, "right") - first, 0)
            near = np.repeat(np.arange(len(clusters)), counts)
        taken: dict[int, int] = {}
        if len(near):
            new = own[_expanded(first, counts)]
            costs, total, reason = _compared(values[medoids[near]], values[new], limits)
            # every member of the cluster must admit the new one
            reason = np.where(_consistent(clusters, near, new, values, limits), reason, "cluster_internal_inconsistency")
            fine = np.flatnonzero(reason == "")
            chosen = np.zeros(len(near), bool)
            margins = np.full((len(near), 2), np.nan)
            if len(fine):
                rows, row_codes = np.unique(near[fine], return_inverse=True)
                columns, column_codes = np.unique(new[fine], return_inverse=True)
                match, *_ = sparse_assign(row_codes, column_codes, total[fine])
                chosen[fine] = match[row_codes] == column_codes
                rest = ~chosen[fine]
                for k, codes in enumerate((row_codes, column_codes)):
                    other = np.full(codes.max() + 1, np.inf)
                    np.minimum.at(other, codes[rest], total[fine][rest])
                    other[np.bincount(codes[rest], minlength=len(other)) == 0] = np.nan
                    margins[fine, k] = np.where(chosen[fine], other[codes] - total[fine], np.nan)
                for c, i in zip(near[chosen].tolist(), new[chosen].tolist(), strict=True):
                    taken[i] = c
            least = np.fmin(margins[:, 0], margins[:, 1])
            vague = chosen & ((least <= limits.ambiguity_margin) | np.isclose(least, limits.ambiguity_margin, rtol=1e-12, atol=1e-12))
            for c in near[vague].tolist():
                unsure[c] = True
            seen.add(new, total, vague)
            seen.add(medoids[near], total, vague)
            if listed:
                pairs.append(Pairs(near, new, medoids[near], costs, total, reason, chosen, margins, vague))
        before = len(clusters)
        for i in range(begin, end):
            if i in taken:
                clusters[taken[i]].append(i)
            else:
                clusters.append([i])
                unsure.append(False)
        moved = np.array([_medoid(names, values, clusters[c]) for c in sorted(set(taken.values()))], int)
        medoids = np.concatenate([medoids, np.array([c[0] for c in clusters[before:]], int)])
        if len(moved):
            medoids[sorted(set(taken.values()))] = moved
    return clusters, unsure, pairs, seen


def _medoid(names: list[tuple[str, int]], values: np.ndarray, members: list[int]) -> int:
    f = values[members, 0]
    middle = float(np.median(f))
    return min(members, key=lambda i: (abs(values[i, 0] - middle), names[i]))


def associate(refs: DataFrame, limits: Limits, listed: bool = True) -> DataFrame:
    """Members of clusters (kind ``member``) and compared pairs (kind ``pair``, none unless ``listed``) of every label, and experiment.

    A member has the size of its cluster and, of the pairs it was in on either side, their number, the least cost and whether any was ambiguous,
    so that only those who want the pairs, whose number grows with the square of a group, list them.  A pair is a cluster's medoid with a candidate that its gates reach; its reason says why it is not admissible.
    A reference without a positive frequency stands alone.  Cluster ids are unique within a label and rise with frequency
    groups and the order of begin; they have gaps.
    """
    from .association import gate_groups

    key = [*scope_of(refs), "label_idx"]
    held = refs.select(
        *key, F.col("recording_id").cast("string").alias("recording_id"), F.col("candidate_id").cast("long").alias("candidate_id"), F.col("frequency_hz").cast("double").alias("frequency_hz"),
        *((F.col(c).cast("double") if c in refs.columns else F.lit(None).cast("double")).alias(c) for c in _VALUES[1:4]),
        (F.col("impact_excited").cast("double") if "impact_excited" in refs.columns else F.lit(None).cast("double")).alias("impact"),
    )
    absolute = limits.gates.get(GATES[0])
    octaves = min([limits.gates.get(GATES[2], np.inf), *([np.log2((2 + g) / (2 - g))] if (g := limits.gates.get(GATES[1], 2.0)) < 2 else [])])
    if absolute is None and not np.isfinite(octaves):
        raise ValueError("a gate on frequency is needed")

    kinds = ", ".join(f"{c} {refs.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{kinds}, {_ROWS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("grp", *_KEY)])
        names = list(zip(*(table.column(c).to_pylist() for c in _KEY), strict=True))
        values = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _VALUES], 1)
        groups = table.column("grp").to_numpy(zero_copy_only=False)
        least, compared, vague = np.full(len(names), np.inf), np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        clusters: list[np.ndarray] = []
        ids: list[int] = []
        unsure: list[bool] = []
        pairs: list[Pairs] = []
        starts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(names)]
        for begin, end in zip(starts, starts[1:]):
            first, single = int(groups[begin]), ~(values[begin:end, 0] > 0)
            fine = begin + np.flatnonzero(~single)
            own: list[np.ndarray] = []
            if len(fine) > 1:
                found, vaguely, some, seen = clustered([names[i] for i in fine], values[fine], limits, listed)
                own = [fine[c] for c in found]
                unsure += vaguely
                least[fine], compared[fine], vague[fine] = seen.least, seen.compared, seen.vague
                pairs += [replace(p, cluster=first + p.cluster, of=fine[p.of], medoid=fine[p.medoid]) for p in some]
            alone = (fine if len(fine) == 1 else fine[:0]).tolist() + (begin + np.flatnonzero(single)).tolist()
            unsure += [False] * len(alone)
            own += [np.array([i]) for i in alone]
            ids += range(first, first + len(own))
            clusters += own

        def rows(kind: str, place: np.ndarray, columns: dict) -> pa.Table:
            own = table.take(place)
            known = {c: own.column(c) for c in key} | {c: own.column(c) for c in (*_KEY, "frequency_hz")} | {"kind": pa.array([kind] * len(place))} | columns
            return pa.table([known[n] if n in known else pa.nulls(len(place)) for n in arrow.names], arrow.names).cast(arrow)

        number = lambda x: pa.array(x, from_pandas=True)
        size = np.array([len(c) for c in clusters])
        place = np.concatenate(clusters)
        out = rows("member", place, {
            "cluster_id": np.repeat(np.array(ids), size), "ambiguous": np.repeat(np.array(unsure, bool), size), "cluster_size": np.repeat(size, size),
            "least_cost": number(np.where(compared[place] > 0, least[place], np.nan)), "compared": compared[place], "vague": vague[place],
        })
        if not pairs:
            return out
        p = Pairs(*(np.concatenate([getattr(x, f.name) for x in pairs]) for f in fields(Pairs)))
        medoid, reason = table.take(p.medoid), p.reason.astype(object)
        reason[reason == ""] = None
        listing = rows("pair", p.of, {
            "cluster_id": p.cluster, "medoid_recording_id": medoid.column("recording_id"), "medoid_candidate_id": medoid.column("candidate_id"), **{f"{c}_cost": number(p.costs[:, j]) for j, c in enumerate(COSTS)},
            "cost": number(p.cost), "reason": pa.array(reason, pa.string()), "selected": p.selected, "row_margin": number(p.margins[:, 0]), "column_margin": number(p.margins[:, 1]), "ambiguous": p.ambiguous,
        })
        return pa.concat_tables([out, listing])

    # without the repartition the groups would stay as the windows dealt them, a condition in a task
    if absolute is not None:
        grouped = gate_groups(held, absolute)
    else:
        scale = held.withColumn("hz", F.col("frequency_hz")).withColumn("frequency_hz", F.when(F.col("hz") > 0, F.log2("hz")))
        grouped = gate_groups(scale, float(octaves)).withColumn("frequency_hz", F.col("hz")).drop("hz")
    # groups that begin within so many references are one call: most hold a few references only
    grouped = grouped.withColumn("call", F.floor(F.col("grp") / _CALL))
    return grouped.repartition(*key, "call").groupBy(*key, "call").applyInArrow(run, schema)


def members(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'member'").select(*scope_of(found), "label_idx", "cluster_id", *_KEY, "frequency_hz", "ambiguous")


def compared_pairs(found: DataFrame) -> DataFrame:
    costs = [f"{c}_cost" for c in COSTS]
    return found.filter("kind = 'pair'").select(*scope_of(found), "label_idx", "cluster_id", "medoid_recording_id", "medoid_candidate_id", *_KEY, *costs, "cost", "reason", "selected", "row_margin", "column_margin", "ambiguous")


def cluster_criteria(rows: DataFrame, totals: DataFrame, limits: Limits) -> DataFrame:
    """Clusters of two members or more with their location, spread and five criteria.

    rows: of ``members``.  totals: label_idx (and experiment_id), recordings.  A criterion is missing where its limit is not set.
    """
    key = [*scope_of(rows), "label_idx"]
    f = "frequency_hz"
    m = rows.groupBy(*key, "cluster_id").agg(
        F.count("*").alias("member_count"), F.count_distinct("recording_id").alias("recording_count"), F.median(f).alias("frequency_median"), F.avg(f).alias("frequency_mean"), F.stddev_pop(f).alias("frequency_std"),
        F.min(f).alias("frequency_min"), F.max(f).alias("frequency_max"), (F.max(f) - F.min(f)).alias("frequency_range"), F.bool_or("ambiguous").alias("ambiguous"),
    )
    m = m.filter("member_count >= 2").join(totals, key).withColumn("repeat_coverage", F.col("recording_count") / F.col("recordings")).withColumn("dispersion", ratio(F.col("frequency_std"), F.col("frequency_median")))
    criteria: dict[str, Column] = {
        "minimum_repeat_count": F.col("member_count") >= limits.minimum_repeats, "minimum_repeat_coverage_fraction": F.col("repeat_coverage") >= limits.minimum_coverage, "unambiguous_association": ~F.col("ambiguous"),
        "internally_consistent": F.lit(True),
        "maximum_cluster_relative_frequency_dispersion": F.lit(None).cast("boolean") if limits.maximum_dispersion is None else F.col("dispersion") <= limits.maximum_dispersion,
    }
    failed = F.filter(F.array(*(F.when(~passed, F.lit(f"{name}:failed")) for name, passed in criteria.items())), lambda x: x.isNotNull())
    return m.select("*", *(passed.alias(name) for name, passed in criteria.items()), F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("reproducible"))


def alone(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """References that no other joined, why, and their least cost to what they were compared with."""
    key = [*scope_of(rows), "label_idx"]
    single = rows.groupBy(*key, "cluster_id").agg(F.count("*").alias("c")).filter("c = 1").select(*key, "cluster_id")
    sides = pairs.select(*key, *_KEY, "cost", "ambiguous").unionByName(
        pairs.select(*key, F.col("medoid_recording_id").alias("recording_id"), F.col("medoid_candidate_id").alias("candidate_id"), "cost", "ambiguous")
    )
    seen = sides.groupBy(*key, *_KEY).agg(F.min("cost").alias("minimum_cost"), F.bool_or("ambiguous").alias("vague"), F.count("*").alias("compared"))
    reason = F.when(F.coalesce("vague", F.lit(False)), "ambiguous_match").otherwise("no_compatible_cluster").alias("reason")
    return rows.join(single, [*key, "cluster_id"], "left_semi").join(seen, [*key, *_KEY], "left").select(*key, *_KEY, "frequency_hz", reason, "minimum_cost", F.coalesce("compared", F.lit(0)).alias("compared"))


def alone_members(found: DataFrame) -> DataFrame:
    """``alone`` of what ``associate`` found, listed or not, without a join."""
    key = [*scope_of(found), "label_idx"]
    reason = F.when(F.col("vague"), "ambiguous_match").otherwise("no_compatible_cluster").alias("reason")
    return found.filter("kind = 'member' AND cluster_size = 1").select(*key, *_KEY, "frequency_hz", reason, F.col("least_cost").alias("minimum_cost"), "compared")


def invariants(rows: DataFrame, limits: Limits) -> DataFrame:
    """Every member: how many clusters hold it, whether it is its recording's only one there, and whether all others are within the gates.

    Clusters have a member a recording, so windows over them are small; the rows, which are a kernel's work, are made once.
    """
    key = [*scope_of(rows), "label_idx"]
    cluster = Window.partitionBy(*key, "cluster_id")
    low, high = F.min("frequency_hz").over(cluster), F.max("frequency_hz").over(cluster)
    only = F.count("*").over(Window.partitionBy(*key, "cluster_id", "recording_id")) == 1
    held = F.count("*").over(Window.partitionBy(*key, *_KEY))
    gap = dict(zip(GATES, (F.col("b") - F.col("a"), (F.col("b") - F.col("a")) / (0.5 * (F.col("a") + F.col("b"))), F.log2(F.col("b") / F.col("a"))), strict=True))
    within = F.lit(True)
    for name, g in limits.gates.items():
        within = within & le_tol(gap[name], F.lit(g))
    r = rows.select(*key, "cluster_id", *_KEY, "frequency_hz", low.alias("a"), high.alias("b"), only.alias("only_one")).withColumn("clusters", held)
    return r.select(*key, *_KEY, "frequency_hz", "clusters", "only_one", within.alias("within_gates"))
