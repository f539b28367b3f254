"""One-to-one assignment of candidates over sparse admissible pairs, with prices that prove it optimal.

As many pairs as possible are matched, at the least total cost.  Only candidates that compete are
assigned together: admissible pairs fall into groups of overlapping frequency spans, inside one
experiment and one pair of labels.  A group is solved over its edges alone: shortest augmenting paths
with prices, that stop at the nearest free partner, so memory is that of the edges and a path looks at what it crosses.

The prices certify the result without a second solver: no pair costs less than the sum of its two
prices, matched pairs cost exactly that, candidates left out on the lower side have the price of
being left out, and those on the higher side a price of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .kernels import sparse_assign

_NODES = (
    "side string, recording_id string, candidate_id long, hz double, price double, left_out double, mate_recording_id string, mate_candidate_id long, mate_hz double, cost double, "
    "row_margin double, column_margin double"
)


def scope_of(df: DataFrame) -> list[str]:
    """The columns that keep experiments apart, where a table has them."""
    return [c for c in ("experiment_id",) if c in df.columns]


def competing(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``grp``: the frequency where the run of overlapping spans begins that a pair lies in.

    Runs are chained by whole hertz first, so an ordered window has a row at most for each place of the scale.
    """
    key = [*scope_of(pairs), "pair"]
    low, high = F.least("lower_hz", "higher_hz"), F.greatest("lower_hz", "higher_hz")
    span = pairs.select(*key, low.alias("a"), high.alias("b")).distinct().withColumn("place", F.floor("a")).withColumn("stop", F.floor("b"))
    touched = span.groupBy(*key, "place").agg(F.max("stop").alias("stop"))
    by_place = Window.partitionBy(*key).orderBy("place")
    far = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    touched = touched.withColumn("fresh", F.when(far.isNull() | (F.col("place") > far), F.col("place"))).select(*key, "place", F.last("fresh", ignorenulls=True).over(by_place).alias("run"))
    span = span.join(touched, [*key, "place"])
    # inside a run spans that overlap are one group
    w = Window.partitionBy(*key, "run").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    span = span.withColumn("begin", F.when(reach.isNull() | (F.col("a") > reach), F.col("a"))).withColumn("grp", F.last("begin", ignorenulls=True).over(w))
    return pairs.withColumn("a", low).withColumn("b", high).join(span.select(*key, "a", "b", "grp"), [*key, "a", "b"]).drop("a", "b")


def _coded(table: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each row's candidate on that side, and the candidates' recordings and ids in the order of their codes."""
    recordings = table.column(f"{side}_recording_id").combine_chunks().fill_null("None").dictionary_encode()
    names, ids = np.array(recordings.dictionary.to_pylist(), object), recordings.indices.to_numpy()
    by_name = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    known, candidate = np.unique(table.column(f"{side}_candidate_id").to_numpy(), return_inverse=True)
    both, codes = np.unique(place[ids] * len(known) + candidate, return_inverse=True)
    return codes, names[by_name][both // len(known)], known[both % len(known)]


def assign_nodes(pairs: DataFrame) -> DataFrame:
    """Every candidate of ``pairs`` with its price, its mate if it has one, and the margins of that match.

    pairs: pair, lower_ and higher_ recording_id, candidate_id and hz, cost (0 or more), and experiment_id or not.
    A group's pairs are arrays throughout.
    """
    key = [*scope_of(pairs), "pair"]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in key)
    schema = StructType.fromDDL(f"{kinds}, {_NODES}")
    arrow = to_arrow_schema(schema)

    def solve(table: pa.Table) -> pa.Table:
        codes, recordings, candidates, hz = {}, {}, {}, {}
        for side in ("lower", "higher"):
            codes[side], recordings[side], candidates[side] = _coded(table, side)
            hz[side] = np.empty(len(candidates[side]))
            hz[side][codes[side]] = table.column(f"{side}_hz").to_numpy()
        costs = table.column("cost").to_numpy()
        match, u, v, left_out = sparse_assign(codes["lower"], codes["higher"], costs)
        chosen = match[codes["lower"]] == codes["higher"]
        mate = {side: np.full(len(hz[side]), -1) for side in codes}
        least = {side: np.full(len(hz[side]), np.inf) for side in codes}  # of the pairs that are not chosen
        own = np.empty(len(match))
        own[codes["lower"][chosen]] = costs[chosen]
        for side, far in (("lower", "higher"), ("higher", "lower")):
            mate[side][codes[side][chosen]] = codes[far][chosen]
            np.minimum.at(least[side], codes[side][~chosen], costs[~chosen])
        parts = []
        for side, far, prices in (("lower", "higher", u), ("higher", "lower", v)):
            n, free = len(prices), mate[side] < 0
            pair = {side: np.arange(n), far: np.where(free, 0, mate[side])}
            cost = own[pair["lower"]]
            columns = {c: pa.repeat(table.column(c)[0], n) for c in key} | {"side": pa.repeat(side, n), "recording_id": pa.array(recordings[side], pa.string()), "candidate_id": candidates[side], "hz": hz[side], "price": prices, "left_out": np.full(n, left_out)}
            columns |= {"mate_recording_id": pa.array(recordings[far][pair[far]], pa.string(), mask=free), "mate_candidate_id": pa.array(candidates[far][pair[far]], mask=free), "mate_hz": pa.array(hz[far][pair[far]], mask=free), "cost": pa.array(cost, mask=free)}
            for name, of in (("row_margin", "lower"), ("column_margin", "higher")):
                other = least[of][pair[of]]
                columns[name] = pa.array(other - cost, mask=free | np.isinf(other))
            parts.append(pa.table([columns[c] if isinstance(columns[c], (pa.Array, pa.ChunkedArray)) else pa.array(columns[c]) for c in arrow.names], arrow.names).cast(arrow))
        return pa.concat_tables(parts)

    sides = [F.col(f"{side}_{c}").cast(kind).alias(f"{side}_{c}") for side in ("lower", "higher") for c, kind in (("recording_id", "string"), ("candidate_id", "long"), ("hz", "double"))]
    return competing(pairs.select(*key, *sides, F.col("cost").cast("double").alias("cost"))).groupBy(*key, "grp").applyInArrow(solve, schema)


def matched(nodes: DataFrame) -> DataFrame:
    """The matches of ``assign_nodes``, one row each, by the columns of its pairs."""
    names = [("recording_id", "lower_recording_id"), ("candidate_id", "lower_candidate_id"), ("mate_recording_id", "higher_recording_id"), ("mate_candidate_id", "higher_candidate_id"), ("hz", "lower_hz"), ("mate_hz", "higher_hz")]
    pairs = nodes.filter("side = 'lower' AND mate_candidate_id IS NOT NULL")
    # least() leaves out what is missing
    return pairs.select(*scope_of(nodes), "pair", *(F.col(a).alias(b) for a, b in names), "cost", "row_margin", "column_margin", F.least("row_margin", "column_margin").alias("margin"))


def pair_certificate(pairs: DataFrame, nodes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Every admissible pair: whether it costs no less than its prices, and exactly that if it is matched."""
    key = [*scope_of(pairs), "pair"]
    for side in ("lower", "higher"):
        own = nodes.filter(F.col("side") == side)
        mate = [F.col("mate_recording_id").alias("m_recording"), F.col("mate_candidate_id").alias("m_candidate")] if side == "lower" else []
        own = own.select(*key, F.col("recording_id").alias(f"{side}_recording_id"), F.col("candidate_id").alias(f"{side}_candidate_id"), F.col("price").alias(f"{side}_price"), *mate)
        pairs = pairs.join(own, [*key, f"{side}_recording_id", f"{side}_candidate_id"])
    slack = F.col("cost") - F.col("lower_price") - F.col("higher_price")
    taken = F.coalesce((F.col("m_recording") == F.col("higher_recording_id")) & (F.col("m_candidate") == F.col("higher_candidate_id")), F.lit(False))
    return pairs.select(
        *key, "lower_recording_id", "lower_candidate_id", "higher_recording_id", "higher_candidate_id", "cost",
        (slack >= -tolerance).alias("not_below_prices"), (~taken | (F.abs(slack) <= tolerance)).alias("tight_if_matched"),
    )


def node_certificate(nodes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Every candidate: whether its price is in bounds, and at its bound if it is left out; and whether its mate names it."""
    lower, free = F.col("side") == "lower", F.col("mate_candidate_id").isNull()
    bound = F.when(lower, F.col("left_out")).otherwise(0.0)
    key = [*scope_of(nodes), "pair"]
    back = nodes.select(*key, F.when(lower, "higher").otherwise("lower").alias("side"), F.col("mate_recording_id").alias("recording_id"), F.col("mate_candidate_id").alias("candidate_id"))
    back = back.filter("candidate_id IS NOT NULL").groupBy(*key, "side", "recording_id", "candidate_id").agg(F.count("*").alias("named"))
    return nodes.join(back, [*key, "side", "recording_id", "candidate_id"], "left").select(
        *key, "side", "recording_id", "candidate_id",
        (F.col("price") <= bound + tolerance).alias("in_bounds"), (~free | (F.abs(F.col("price") - bound) <= tolerance)).alias("at_bound_if_left_out"),
        (F.coalesce("named", F.lit(0)) == F.when(free, 0).otherwise(1)).alias("one_mate"),
    )
