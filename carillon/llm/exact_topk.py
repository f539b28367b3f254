"""Exact top-k by inner product of quantised vectors, in tiles.

Queries and candidates are cut into blocks of bounded size, one matrix a row.  Every query
block meets every candidate block of the same dimension once; a tile is one matrix product
with a partial selection per query, and the tiles' lists are merged as a tree.  The query
set is stated, blocks are bounded, and no row meets another outside a tile.

Defined results: components become floor(256 * x); vectors that are null or hold null or
non-finite components take no part, nor do rows without an id; vectors of another dimension
are no candidates; ties go to the smaller vec_id; of repeated rows each is a candidate,
those with the query's own id are not; a query's id with several vectors asks with each of them
and gets the best of all its answers; an empty table gives no rows; other columns, whatever their
names, are ignored; products are exact up to 64 bits (beyond, they are
ranked exactly and reported as the nearest 64-bit integer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed
from .vectors import in_turn, matrix, spread, top, usable

QUERY_BLOCK, SHARD = 1024, 8192
_EXACT = float(1 << 53)
#: Beyond any product of two vectors of doubles.
_DIGITS = 640
_WIDE = 10 ** (_DIGITS - 1)


def _blob(ids: pa.Array, rows: np.ndarray) -> dict:
    return {"ids": ids.to_numpy().tobytes(), "values": np.ascontiguousarray(rows).tobytes()}


def _to_block(key: tuple, table: pa.Table) -> pa.Table:
    """One row for each group: its ids and its quantised matrix."""
    dim, block = (k.as_py() for k in key)
    column = table.column("v").combine_chunks()
    rows = np.floor(256.0 * matrix(column, dim)) if dim else np.zeros((len(column), 0))
    blob = _blob(table.column("vec_id").combine_chunks(), rows)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "ids": [blob["ids"]], "values": [blob["values"]]})


def as_blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """dim, block, ids, values: every dimension's vectors in blocks numbered from 0 without order.

    Spread by ``turn`` where there is one, so that equal rows are not one block.
    """
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    by = ["turn"] if "turn" in vectors.columns else ["vec_id", "v"]
    numbered = vectors.join(sizes, "dim").withColumn("block", spread(F.col("n"), rows, *by))
    blocks = numbered.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(_to_block, "dim int, block long, ids binary, values binary")
    return materialise(blocks, name)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(q).dot(whole(c).T) if q.shape[1] else np.zeros((len(q), len(c)), object)


def _tile(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["q_values"], np.float64).reshape(len(qi), dim)
                c = np.frombuffer(row["values"], np.float64).reshape(len(ci), dim)
                order = np.argsort(ci, kind="stable")  # then the first of equal scores has the smallest id
                ci, c = ci[order], c[order]
                queries, found, scores = [], [], []
                for a in range(0, len(qi), 128):
                    part = _products(q[a : a + 128], c)
                    for i in range(len(part)):
                        line = part[i]
                        others = np.flatnonzero(ci != qi[a + i])
                        own = line[others]
                        if len(own) > k and own.dtype != object:
                            least = np.partition(own, len(own) - k)[len(own) - k]
                            others = others[own >= least]
                            own = line[others]
                        best = sorted(range(len(own)), key=lambda j: (-own[j], j))[:k] if own.dtype == object else np.argsort(-own, kind="stable")[:k]
                        for j in best:
                            queries.append(qi[a + i])
                            found.append(ci[others[j]])
                            scores.append(int(own[j]))
                clipped = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
                # text that sorts as the exact scores do, the highest first
                exact = [str(_WIDE - s).zfill(_DIGITS) if abs(s) >= (1 << 63) - 1 else None for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries, pa.int64()), pa.array(found, pa.int64()), pa.array(clipped, pa.int64()), pa.array(exact, pa.string()), pa.array([row["block"]] * len(found), pa.int64())],
                    ["query_id", "vec_id", "score", "exact", "part"],
                )

    return run


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by ``every``."""
    fine = usable(vectors)
    shards = as_blocks(in_turn(fine), shard, "shards")
    asked = as_blocks(fine.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), query_block, "query-blocks")
    counts = shards.groupBy("dim").agg((F.max("block") + 1).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    # a block is one wide row and files of blocks are small for what they hold: by their size the planner would send
    # the repeated query blocks to the driver
    tiles = (
        asked.join(F.broadcast(counts), "dim")
        .select("dim", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
        .join(shards.hint("merge"), ["dim", "block"])
        .select("dim", "block", "q_ids", "q_values", "ids", "values")
    )
    partial = tiles.mapInArrow(trimmed(_tile(k)), "query_id long, vec_id long, score long, exact string, part long")
    return top(partial, k, [F.bitwise_not("score"), F.col("exact")], parts=int(most))


TOP_SQL = """
WITH fine AS (
  SELECT row_number() OVER () AS turn, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (
  SELECT turn, vec_id, len(e) AS dim, list_transform(e, lambda x: floor(256 * x)::BIGINT) AS z FROM fine
), asked AS (SELECT DISTINCT vec_id, dim, z FROM whole WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN q.dim = 0 THEN 0 ELSE list_sum(list_transform(range(1, q.dim + 1), lambda i: q.z[i] * c.z[i])) END::BIGINT AS score, c.turn
  FROM asked q JOIN whole c ON q.dim = c.dim AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, turn))::INTEGER AS "rank", vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, turn) <= 5
"""
