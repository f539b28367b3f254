"""Centroid clustering by Exponion search: exact Lloyd rounds over integer vectors.

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower
bound of that to every other.  A round moves the bounds by how far centroids went; a vector
whose upper bound stays strictly below the lower one, or below half the distance from its centroid to
the nearest other, keeps its cluster unseen.  The others scan the centroids inside a ball
around their current centroid, of twice the upper bound plus the distance to the nearest other:
by the triangle inequality the nearest and the second nearest lie in it.  Balls are prefixes of
lists of centroids sorted by distance, and they are closed, so that centroids that tie are
scanned too.  Distances that decide are exact integers; bounds are floats with slack.

A round is one pass that writes vectors with their bounds to the shared folder; the round
before is deleted then.  Sums move only by the vectors that changed cluster, so the second,
small aggregation has a row for each task, cluster and component.  The driver holds the
centroids, ``clusters`` times ``dim`` numbers, and nothing that grows with the vectors.

Defined results: vectors that are null, of another length than ``dim``, or hold a null or
non-finite component take no part; components become floor(256 * x), held within 2**60 either
way (distances beyond 64 bits are reported as the largest); null ids take part but start
clusters after all others; rows that share an id are vectors of their own; of equal vectors
that start clusters the later get none but what only they are nearest to; with fewer vectors
than clusters each starts one; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch_path, trimmed

DIM, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
_MOST = 1 << 60
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
#: Relative slack of bounds, far above what rounding loses.
_SLACK = 1e-9
_STATE = "vec_id long, z array<long>, was int, cluster int, upper double, lower double"


def whole_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, z: the vectors that take part, as integers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    within = lambda x: F.greatest(F.least(F.floor(256 * x), F.lit(float(_MOST))), F.lit(-float(_MOST))).cast("long")
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, within).alias("z"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in order: ``clusters`` rows at most."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.z for r in whole.select(mark.alias("mark"), "z").orderBy(F.asc_nulls_last("mark"), "z").limit(clusters).collect()]


class _Space:
    """The centroids with their distances: to each other, sorted, and how far each came in the last round."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        self.count, self.dim = len(centroids), len(centroids[0])
        self.own = np.array(centroids, object)
        apart = np.array([[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in centroids] for x in centroids], object)
        self.apart = np.sqrt(apart.astype(np.float64))
        self.order = np.argsort(self.apart, 1, kind="stable")
        self.sorted = np.take_along_axis(self.apart, self.order, 1)
        alone = np.full(self.count, np.inf)
        self.near = np.where(~np.eye(self.count, dtype=bool), self.apart, np.inf).min(1) if self.count > 1 else alone
        moved = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(centroids, before or centroids, strict=True)]
        self.moved = np.sqrt(np.array(moved, object).astype(np.float64)) * (1 + _SLACK)
        far = np.sort(self.moved)
        #: The farthest that any other centroid went.
        self.others = np.where(self.moved == far[-1], far[-2] if self.count > 1 else 0.0, far[-1])
        self.most = max((abs(c) for x in centroids for c in x), default=0)

    def distances(self, z: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Exact squared distances of integer rows to the named centroids."""
        bound = (float(np.abs(z).max(initial=0)) + self.most) ** 2 * self.dim
        if bound < _EXACT:
            x, c = z.astype(np.float64), self.own[columns].astype(np.float64)
            return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
        kind = np.int64 if bound < 2.0**62 else object
        x, c = z.astype(kind), self.own[columns].astype(kind)
        return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _two_nearest(space: _Space, z: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest of the centroids (ties: the smaller number), its distance, and that of the next."""
    columns = np.sort(columns)
    d = space.distances(z, columns)
    best = d.argmin(1)
    least = d[np.arange(len(d)), best]
    if len(columns) == 1:
        return columns[best], _root(least), np.full(len(d), np.inf)
    rest = d.astype(np.float64)
    rest[np.arange(len(d)), best] = np.inf
    return columns[best], _root(least), np.sqrt(rest.min(1))


def search(space: _Space, z: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower after a round, and how many distances were computed.

    The bounds given are those of the round before; a cluster of -1 is searched among all.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    fresh = np.flatnonzero(cluster < 0)
    known = np.flatnonzero(cluster >= 0)
    seen = 0
    if len(fresh):
        cluster[fresh], upper[fresh], lower[fresh] = _two_nearest(space, z[fresh], np.arange(space.count))
        upper[fresh] *= 1 + _SLACK
        lower[fresh] *= 1 - _SLACK
        seen += len(fresh) * space.count
    if len(known):
        at = cluster[known]
        upper[known] = (upper[known] + space.moved[at]) * (1 + _SLACK)
        lower[known] = np.maximum(lower[known] - space.others[at] * (1 + _SLACK), 0) * (1 - _SLACK)
        # strictly below, as a centroid just as near may have the smaller number
        open_ = known[upper[known] >= np.maximum(space.near[at] / 2 * (1 - _SLACK), lower[known])]
        for c in np.unique(cluster[open_]).tolist():
            rows = open_[cluster[open_] == c]
            upper[rows] = _root(space.distances(z[rows], np.array([c]))[:, 0]) * (1 + _SLACK)
            seen += len(rows)
            rows = rows[upper[rows] >= np.maximum(space.near[c] / 2 * (1 - _SLACK), lower[rows])]
            # how many centroids the closed ball around this centroid holds; rows with about as many go together
            inside = np.searchsorted(space.sorted[c], (2 * upper[rows] + space.near[c]) * (1 + _SLACK), "right")
            steps = 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int)
            for step in np.unique(steps).tolist():
                some = rows[steps == step]
                ball = space.order[c][: min(step, space.count)]
                cluster[some], upper[some], lower[some] = _two_nearest(space, z[some], ball)
                upper[some] *= 1 + _SLACK
                lower[some] *= 1 - _SLACK
                seen += len(some) * len(ball)
    return cluster, upper, lower, seen


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)


def _round(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            z = _rows(batch, space.dim)
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, upper, lower, _ = search(space, z, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("z"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)],
                ["vec_id", "z", "was", "cluster", "upper", "lower"],
            )

    return run


def _moves(dim: int, clusters: int):
    """Of a task's vectors that changed cluster: by cluster and component, what comes on top (-1: the count)."""

    def run(batches):
        totals = np.zeros((clusters, dim + 1), object)
        for batch in batches:
            if not len(batch):
                continue
            z = _rows(batch, dim)
            kind = np.int64 if float(np.abs(z).max(initial=0)) * len(z) < 2.0**62 else object
            z = np.concatenate([np.ones((len(z), 1), np.int64), z], 1).astype(kind)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]).tolist():
                    totals[c] += sign * z[of == c].sum(0).astype(object)
        c, at = np.nonzero(totals)
        values = [Decimal(int(x)) for x in totals[c, at]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at - 1, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["cluster", "at", "total"])

    return run


def _measured(space: _Space):
    """The exact squared distance of every vector to its centroid."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            z, of = _rows(batch, space.dim), batch.column("cluster").to_numpy(zero_copy_only=False)
            exact = np.zeros(len(z), object)
            for c in np.unique(of).tolist():
                exact[of == c] = space.distances(z[of == c], np.array([c]))[:, 0]
            values = pa.array([min(int(x), _LONG) for x in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), values], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids after ``rounds``."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dim)
    centroids = first_centroids(whole, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    state = whole.select("vec_id", "z", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    sums = np.zeros((len(centroids), dim + 1), object)
    before, path = None, None
    for turn in range(rounds + 1):
        space = _Space(centroids, before)
        written = scratch_path(spark, f"exponion-{turn}")
        state.select("vec_id", "z", "cluster", "upper", "lower").mapInArrow(trimmed(_round(space)), _STATE).write.option("compression", "zstd").parquet(written)
        state = spark.read.schema(_STATE).parquet(written)
        if path:
            delete(spark, path)  # nothing reads the round before
        path = written
        if turn == rounds:
            break
        moved = state.filter("was <> cluster").mapInArrow(trimmed(_moves(dim, len(centroids))), "cluster int, at int, total decimal(38,0)")
        for r in moved.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():  # clusters * (dim + 1) rows at most
            sums[r["cluster"], r["at"] + 1] += int(r["total"])
        before = centroids
        centroids = [[int(t) // int(s[0]) for t in s[1:]] if s[0] else list(c) for s, c in zip(sums, centroids, strict=True)]
    return state.mapInArrow(trimmed(_measured(_Space(centroids, None))), "vec_id long, cluster int, distance long"), centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found, centroids = cluster_vectors(vectors)
    within = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a cluster
    whole = min(sum(within.values()), _LONG)
    named = [(c, min(t, _LONG), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in within.items()]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_in_sql() -> str:
    """Assignments a0, a1, ... and centroids c0, c1, ... as common table expressions."""
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT turn, vec_id, z, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (
    SELECT turn, vec_id, z.z, c.k, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (z.z[i] - c.z[i]) * (z.z[i] - c.z[i])))::BIGINT AS d FROM z, c{i} c
  ) GROUP BY turn, vec_id, z
)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.z, c.z) AS z FROM c{i} c LEFT JOIN (
    SELECT k, list(q ORDER BY place)::BIGINT[] AS z FROM (SELECT k, place, (s - ((s % n) + n) % n) // n AS q FROM (
      SELECT k, t.i AS place, sum(z[t.i])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, {DIM + 1})) AS t(i) GROUP BY k, t.i
    )) GROUP BY k
  ) m ON m.k = c.k
)""")
    return ",\n".join(parts)


CLUSTER_SQL = f"""
WITH z AS MATERIALIZED (
  SELECT row_number() OVER () AS turn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, z) - 1)::INTEGER AS k, z FROM z
  QUALIFY k < {CLUSTERS}
), {_rounds_in_sql()}
SELECT vec_id, a.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.z, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k
"""
