"""Connected components of an edge table, on the cluster throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(pairs: DataFrame) -> bool:
    """Whether every node names one smaller node, which names none: then nothing is left to do."""
    twice = pairs.groupBy("u").agg(F.count("*").alias("c"), F.max(F.col("u") > F.col("v")).alias("below"))
    inner = pairs.filter("u <> v").select(F.col("v").alias("u")).join(twice.filter("below"), "u", "left_semi")
    return not twice.filter("c > 1").select("u").unionByName(inner).take(1)


def components(edges: DataFrame, name: str = "components", look: bool = False) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges(a long, b long)``.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    A node with many neighbours costs one partial minimum and a join that adaptive execution
    splits.  Self-loops and repeated edges do no harm.  look: after each round, whether stars are all that is left,
    which saves the round that would find nothing new.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while not (look and _stars(pairs)):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        lowest = materialise(lowest, name)
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialise(large.unionByName(pairs.filter("u = v")).distinct(), name)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = materialise(small.filter("u <> v").unionByName(pairs.filter("u = v")).distinct(), name)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ends = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends).groupBy("node").agg(F.min("component").alias("component"))
