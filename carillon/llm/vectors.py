"""Vectors as bounded blocks of rows: one matrix a row, for work in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, value: str = "embedding", nonzero: bool = False) -> DataFrame:
    """vec_id, v (array of doubles), dim: vectors without nulls and non-finite components."""
    v = F.col(value).cast("array<double>")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if nonzero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` elements, as (rows, dim)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def in_turn(scanned: DataFrame) -> DataFrame:
    """Adds ``turn``, a number for each row, equal rows included.

    For what a scan gives without a shuffle, whose partitions come out alike when a lost task runs again.
    """
    return scanned.withColumn("turn", F.monotonically_increasing_id())


def spread(count: Column, rows: int, *by: str) -> Column:
    """A block number for each row, about ``rows`` rows a block; a row run again gets the same one."""
    return F.pmod(F.xxhash64(*by), F.greatest(F.ceil(count / rows), F.lit(1)))


def top(rows: DataFrame, k: int, best: list[Column], fan_in: int = 64, parts: int = 1, salt: str = "part") -> DataFrame:
    """query_id, rank, vec_id, score of each query's first ``k`` rows by ``best``, merged as a tree.

    rows: query_id, vec_id, score and ``salt``, a number below ``parts``; every level keeps ``k`` rows of
    each group of ``fan_in`` neighbours.
    """
    order = F.struct(*[b.alias(f"k{i}") for i, b in enumerate(best)], F.col("vec_id"), F.col("score"))
    level = rows.select("query_id", F.col(salt).alias("part"), order.alias("entry"))
    while True:
        parts = -(-parts // fan_in)
        level = (
            level.groupBy("query_id", F.floor(F.col("part") / fan_in).alias("part"))
            .agg(F.slice(F.array_sort(F.collect_list("entry")), 1, k).alias("entries"))
            .select("query_id", "part", F.posexplode("entries").alias("rank", "entry"))
        )
        if parts <= 1:
            return level.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), F.col("entry.score").alias("score"))
        level = level.select("query_id", "part", "entry")
