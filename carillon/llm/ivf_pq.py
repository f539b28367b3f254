"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals' subspaces are fitted on the driver over
a bounded sample; every row is then assigned and encoded where it lies.  A list is held in
blocks of bounded size, so a list that many equal vectors share is many blocks.  A query
goes to its nearest lists; there asymmetric distance tables give approximate distances.  A
row's own quantisation error, kept beside its code, bounds its true distance on both sides, so
every row of a block that may be among the ``k`` nearest is reranked by its exact distance,
however many there are, and ``k`` of each block are merged as a tree.  Nothing that the probed
lists hold is lost, near copies with equal codes included.  The number of lists grows with the
table; how many are probed is measured against brute force within the sample, whose neighbours
are farther apart than those of the whole table, so the share found there is a low estimate.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id or of another dimension than the index (the most frequent
one, the smaller of equally frequent ones); ties go to the smaller vec_id; of repeated rows
each is a candidate, those with the query's own id are not; of rows that share a query's id the
least vector, element by element, asks; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed
from .vectors import in_turn, matrix, spread, top, usable

#: Rows that the index is fitted on at most: those with the smallest hash of their id and values.
SAMPLE_ROWS = 16_384
#: Lists: the square root of the number of rows, within these bounds.
FEWEST_LISTS, MOST_LISTS = 64, 1024
#: The share of true neighbours in the sample that the probed lists must hold.
RECALL = 0.97
SUBSPACES, CODES = 16, 256
LIST_BLOCK, QUERY_BLOCK = 4096, 512


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dim)
    books: tuple[np.ndarray, ...]  # per subspace (codes, width)
    cuts: tuple[int, ...]

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([_nearest(rest[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(_squared(q, self.centroids), 1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray, place: int) -> np.ndarray:
        """(queries, subspaces, codes): squared distances from each query's residual to each code word."""
        rest = q - self.centroids[place]
        out = np.full((len(q), len(self.books), CODES), np.inf)
        for s, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out[:, s, : len(book)] = _squared(rest[:, a:b], book)
        return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[i : i + 4096], y).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty centre moves to the row farthest from its own."""
    rng = np.random.RandomState(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            far = np.argsort(-((x - centres[near]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def fit_index(sample: np.ndarray, lists: int = FEWEST_LISTS, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = 8) -> Index:
    x = np.asarray(sample, np.float64)
    dim = x.shape[1]
    centroids = _k_means(x, lists, rounds, 1)
    rest = x - centroids[_nearest(x, centroids)]
    parts = min(subspaces, dim)
    cuts = tuple(int(round(i * dim / parts)) for i in range(parts + 1))
    books = tuple(_k_means(rest[:, a:b], codes, rounds, 2 + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return Index(centroids, books, cuts)


def _assign(index: Index):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), index.dim)
            lists = index.assign(x)
            codes = index.encode(x, lists) if len(x) else np.zeros((0, len(index.books)), np.uint8)
            coded = np.concatenate([book[codes[:, s]] for s, book in enumerate(index.books)], 1) + index.centroids[lists]
            error = np.sqrt(((x - coded) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(1)],
                ["vec_id", "list", "codes", "error", "v"],
            )

    return run


def _pack_list(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").combine_chunks().to_numpy()
    order = np.argsort(ids, kind="stable")
    codes = table.column("codes").combine_chunks().to_pylist()
    column = table.column("v").combine_chunks()
    values = matrix(column, len(column[0]))[order]
    return pa.table({
        "list": pa.array([key[0].as_py()], pa.int32()),
        "block": pa.array([key[1].as_py()], pa.int64()),
        "ids": [ids[order].tobytes()],
        "codes": [b"".join(codes[i] for i in order)],
        "errors": [table.column("error").combine_chunks().to_numpy()[order].tobytes()],
        "values": [np.ascontiguousarray(values).tobytes()],
    })


def _probe(index: Index, probes: int):
    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1), index.dim)
            near = index.probes(q, probes)
            ids = np.repeat(batch.column(0).to_numpy(), near.shape[1])
            rows = np.repeat(np.arange(len(q)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], ["query_id", "v", "list"])

    return run


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    column = table.column("v").combine_chunks()
    q = matrix(column, len(column[0]))
    return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "q_ids": [table.column("query_id").combine_chunks().to_numpy().tobytes()], "q_values": [np.ascontiguousarray(q).tobytes()]})


def _nearest_of_block(q: np.ndarray, x: np.ndarray, far: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of ``x`` nearest to ``q`` (ties by place) and their exact distances.

    far: approximate distances; the true ones are within ``error`` of them.
    """
    slack = 1e-9 * (1 + float(far.max(initial=0)))
    if len(x) > k:
        reach = np.partition(far + error, k - 1)[k - 1]
        some = np.flatnonzero(far - error <= reach + slack)
    else:
        some = np.arange(len(x))
    rest = x[some] - q
    exact = np.sqrt((rest * rest).sum(1))
    best = np.argsort(exact, kind="stable")[:k]
    return some[best], exact[best]


def _scan(index: Index, k: int, parts: int):
    """For every query of a block the ``k`` nearest rows of a list's block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qi, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["q_values"], np.float64).reshape(len(qi), index.dim)
                x = np.frombuffer(row["values"], np.float64).reshape(len(ids), index.dim)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), len(index.books))
                errors = np.frombuffer(row["errors"], np.float64)
                queries, found, scores = [], [], []
                for a in range(0, len(qi), 64):
                    tables = index.tables(q[a : a + 64], row["list"])
                    distance = np.zeros((tables.shape[0], len(ids)))
                    for s in range(codes.shape[1]):
                        distance += tables[:, s, codes[:, s]]
                    distance = np.sqrt(distance)
                    for i, line in enumerate(distance):
                        others = np.flatnonzero(ids != qi[a + i])
                        if len(others) < len(ids):
                            best, score = _nearest_of_block(q[a + i], x[others], line[others], errors[others], k)
                            best = others[best]
                        else:
                            best, score = _nearest_of_block(q[a + i], x, line, errors, k)
                        queries.append(np.full(len(best), qi[a + i]))
                        found.append(ids[best])
                        scores.append(score)
                part = (row["list"] * 7919 + row["block"]) % parts
                columns = [pa.array(np.concatenate(c)) for c in (queries, found, scores)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), part))], ["query_id", "vec_id", "score", "part"])

    return run


def needed_probes(index: Index, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Nearest lists that hold the share ``recall`` of the ``k`` true neighbours of some sample rows."""
    q = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    lists = index.assign(sample)
    ranks: list[np.ndarray] = []
    for row in q:
        distance = ((sample - sample[row]) ** 2).sum(1)
        distance[row] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(len(index.centroids), int)
        place[index.probes(sample[row : row + 1], len(place))[0]] = np.arange(len(place))
        ranks.append(place[lists[near]])
    every = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    return int(every[int(np.ceil(recall * len(every))) - 1]) + 1 if len(every) else 1


def index_sample(fine: DataFrame, dim: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    picked = fine.select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(rows)
    return matrix(picked.select("v").toArrow().column("v").combine_chunks(), dim)


def nearest_neighbours(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    lists: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    fine = usable(vectors, nonzero=True)
    common = fine.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = common["dim"], common["count"]
    fine = fine.filter(F.col("dim") == dim).select("vec_id", "v")
    sample = index_sample(fine, dim, sample_rows)
    index = fit_index(sample, lists or min(max(int(rows**0.5), FEWEST_LISTS), MOST_LISTS))
    probes = needed_probes(index, sample, k, recall)

    coded = materialise(fine.mapInArrow(trimmed(_assign(index)), "vec_id long, list int, codes binary, error double, v array<double>"), "ivf-codes")
    sizes = coded.groupBy("list").agg(F.count("*").alias("n"))
    blocks = in_turn(coded).join(sizes, "list").withColumn("block", spread(F.col("n"), LIST_BLOCK, "turn")).select("list", "block", "vec_id", "codes", "error", "v")
    packed = blocks.groupBy("list", "block").applyInArrow(_pack_list, "list int, block long, ids binary, codes binary, errors binary, values binary")
    packed = materialise(packed, "ivf-lists")

    queries = fine.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.mapInArrow(_probe(index, probes), "query_id long, v array<double>, list int")
    asked = materialise(asked, "ivf-probes")
    askers = asked.groupBy("list").agg(F.count("*").alias("n"))
    groups = asked.join(askers, "list").withColumn("block", spread(F.col("n"), QUERY_BLOCK, "query_id")).select("list", "block", "query_id", "v")
    groups = materialise(groups.groupBy("list", "block").applyInArrow(_pack_queries, "list int, q_ids binary, q_values binary"), "ivf-queries")

    parts = min(4096, max(1, rows // LIST_BLOCK))
    near = groups.join(packed, "list").mapInArrow(trimmed(_scan(index, k, parts)), "query_id long, vec_id long, score double, part long")
    return top(near, k, [F.col("score")], parts=parts)
