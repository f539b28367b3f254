"""MinHash near-dedup on HyperMinHash registers.

A document is its set of distinct word shingles.  Its hash values are dealt to registers by
their leading bits; a register holds the least value in compressed form: how many leading
zeros it has, and the mantissa bits behind the first one.  Empty registers borrow from
another register in a fixed random order, so that bands of registers agree with the
likelihood of J to the power of a band's width whatever the size of the set.

1. Equal sets are one class; a class goes on as one node.
2. Nodes meet in the buckets of banded registers.  A bucket is never paired out: each node
   is compared with one node: of the smallest nodes of its buckets the one that it meets most
   often.  If the collision-corrected estimate from all registers allows it, the pair is
   verified on the full sets of shingles.
3. What that leaves apart is searched again: buckets whose nodes lie in different components
   are cut into blocks of bounded rows and bytes, and blocks of one bucket are compared with
   each other in matrices.  A component with many nodes in a bucket has blocks of its own,
   which never meet each other; small ones share blocks.  A pair is taken up in the first band
   that it shares, if it is in different components and its estimate is not clearly below the
   threshold; the full sets decide, and only links that join two components leave the task.

With 42 bands of 6 registers a pair at similarity 0.8 shares no bucket with likelihood 3e-6.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; fewer
words than a shingle make one shingle of the whole sequence; texts without words and null
texts are empty, linked with nothing, and components of their own; every row is linked by its
own text, of any length as a whole, also where rows share an id; a null id is larger than every other (component_id is
null where no other is reached); of a component's rows that share its smallest id all are
kept, and one text of them is ``first``; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty, trimmed
from .graph import components
from .tokens import text_groups

REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
BANDS, WIDTH = 42, 6
#: Standard deviations by which an estimate may fall short and still be verified.
SLACK = 5.0
BLOCK = 256
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
_NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- sets of shingles ---------------------------------------------------------------


def _plain(texts: pa.Array) -> pa.Array:
    """Strings with A-Z lower-cased and every ASCII white space a space: byte by byte, as no other character holds those bytes."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    changed = table[np.frombuffer(data, np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(changed)], offset=texts.offset)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin (and end)."""
    words = pc.split_pattern(_plain(texts), " ")
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    offsets -= offsets[0]
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    solid = np.fromiter((w != "" for w in distinct), bool, len(distinct))[at] if len(at) else np.zeros(0, bool)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    values = hashes[at[solid]] if len(at) else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(solid)])[offsets]
    counts = np.diff(ends)
    primes = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (2**64 - 1) | 1) for i in range(width)]
    rolled = np.zeros(max(len(values) - width + 1, 0), np.uint64)
    for i, p in enumerate(primes):
        rolled += values[i : i + len(rolled)] * p
    rolled = _mix(rolled)
    sets: list[np.ndarray] = []
    for start, n in zip(ends[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            part = values[start : start + n]
            salted = np.concatenate([np.array([0xD6E8FEB86659FD93 * n & (2**64 - 1)], np.uint64), part * np.array(primes[:n], np.uint64)])
            sets.append(_mix(salted.sum(keepdims=True)))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


# ---- registers ----------------------------------------------------------------------


def _lending_order() -> np.ndarray:
    """Row a: the register that each register borrows from at its a-th try."""
    rng = np.random.RandomState(20240229)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], 1)


_LENDERS = _lending_order()


def registers(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) compressed registers of non-empty sorted sets."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = (flat >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    cell = owner * REGISTERS + place
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    low = flat[first] << np.uint64(REGISTER_BITS) | np.uint64(1 << (REGISTER_BITS - 1))  # never 0
    # leading zeros from the exponent of a float that is not rounded up
    top = (low >> np.uint64(11)).astype(np.float64)
    zeros = 53 - np.frexp(top)[1]
    tail = low << np.minimum(zeros + 1, 63).astype(np.uint64)
    code = np.minimum(zeros, 63).astype(np.uint16) << np.uint16(MANTISSA) | (tail >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    out = np.zeros(n * REGISTERS, np.uint16)
    full = np.zeros(n * REGISTERS, bool)
    out[cell[first]] = code
    full[cell[first]] = True
    out, full = out.reshape(n, REGISTERS), full.reshape(n, REGISTERS)
    own = full.copy()
    rows = np.flatnonzero(~full.all(1))
    for lenders in _LENDERS:
        if not len(rows):
            break
        lent = ~full[rows] & own[rows][:, lenders]
        part = out[rows]
        part[lent] = out[rows][:, lenders][lent]
        out[rows] = part
        full[rows] |= lent
        rows = rows[~full[rows].all(1)]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys of the compressed registers of each band."""
    parts = signatures[:, : BANDS * WIDTH].astype(np.uint64).reshape(len(signatures), BANDS, WIDTH)
    keys = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signatures), BANDS)).copy()
    for i in range(WIDTH):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def _chance() -> float:
    """Likelihood that two registers of unrelated sets agree: equal zeros and equal mantissas."""
    return sum(4.0 ** -(z + 1) for z in range(40)) / (1 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, with chance collisions taken off."""
    c = _chance()
    return np.maximum((equal - c) / (1 - c), 0)


def estimate_floor(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5


# ---- kernels ------------------------------------------------------------------------


def _digest_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(k) for k in range(3))
            for i, j in text_groups(texts, 4_000_000):
                flat, bounds = shingle_sets(texts[i:j], width)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                signatures: list[bytes | None] = [None] * (j - i)
                if len(some):
                    kept = np.concatenate([[0], np.cumsum(sizes[some])])
                    one[some] = np.add.reduceat(_mix(flat), kept[:-1])
                    two[some] = np.add.reduceat(_mix(flat + np.uint64(0x2545F4914F6CDD1D)), kept[:-1])
                    for a in range(0, len(some), 512):
                        b = min(a + 512, len(some))
                        made = registers(flat[kept[a] : kept[b]], kept[a : b + 1] - kept[a])
                        for k, row in zip(some[a:b].tolist(), made, strict=True):
                            signatures[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], keys[i:j], pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(signatures, pa.binary())],
                    ["id", "text_key", "n", "s1", "s2", "registers"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(batches):
    for batch in batches:
        if not len(batch):
            continue
        keys = band_keys(_matrix(batch.column(1)))
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _estimates(batches):
    for batch in batches:
        if not len(batch):
            continue
        equal = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate(equal))], ["a", "b", "likeness"])


def _link_blocks(floor: float, width: int, percent: int):
    """Confirmed links between two blocks of a bucket, as few as join what they join.

    A pair is looked at in the first band that it shares, only if its estimate allows a link and
    its nodes are not joined yet; then the full sets decide.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = row["x"]
                same_block = row["y"] is None
                members = x if same_block else x + row["y"]
                marks = np.stack([np.frombuffer(m["registers"], np.uint16) for m in members])
                keys = band_keys(marks)
                own = int((keys[0] == row["key"]).argmax())
                parent = {m["component"]: m["component"] for m in members}

                def root(c, parent=parent):
                    while parent[c] != c:
                        parent[c] = parent[parent[c]]
                        c = parent[c]
                    return c

                pairs = []
                for i in range(len(x)):
                    after = i + 1 if same_block else len(x)
                    likeness = estimate((marks[after:] == marks[i]).mean(1))
                    fresh = ~(keys[after:, :own] == keys[i, :own]).any(1)
                    pairs += [(-likeness[j], i, after + int(j)) for j in np.flatnonzero((likeness >= floor) & fresh)]
                apart = sorted(p for p in pairs if members[p[1]]["component"] != members[p[2]]["component"])
                if not apart:
                    continue
                flat, bounds = shingle_sets(pa.array([m["text"] for m in members], pa.string()), width)
                found = []
                for _, i, j in apart:
                    one, two = root(members[i]["component"]), root(members[j]["component"])
                    if one == two:
                        continue
                    u, v = flat[bounds[i] : bounds[i + 1]], flat[bounds[j] : bounds[j + 1]]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        parent[max(one, two)] = min(one, two)
                        found.append((members[i]["node"], members[j]["node"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            n = len(batch)
            keep = np.zeros(n, bool)
            step = 200
            for i in range(0, n, step):
                j = min(n, i + step)
                fa, ba = shingle_sets(batch.column(2)[i:j], width)
                fb, bb = shingle_sets(batch.column(3)[i:j], width)
                for k in range(j - i):
                    x, y = fa[ba[k] : ba[k + 1]], fb[bb[k] : bb[k + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def text_key() -> Column:
    """A hash of ``text`` that tells apart the texts of rows that share an id."""
    return F.xxhash64(text_or_empty())


# ---- the operator -------------------------------------------------------------------


def _blocks(placed: DataFrame, signs: DataFrame, held: DataFrame) -> DataFrame:
    """key, x, y: pairs of blocks of each bucket, y null where x is to be compared within itself."""
    sized = placed.join(held.select("node", F.octet_length("text").alias("bytes")), "node")
    # a component with a block's worth of nodes (or bytes) in a bucket is a group by itself, the others are one
    owns = sized.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    owns = owns.withColumn("part", F.when((F.col("rows") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES), F.col("component")))
    owns = materialise(owns, "near-owns")
    groups = owns.groupBy("key", "part").agg(
        F.greatest(F.ceil(F.sum("rows") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    groups = materialise(groups, "near-groups")
    filled = (
        placed.join(owns.select("key", "component", "part"), ["key", "component"])
        .join(groups.withColumnRenamed("part", "p").withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("part").eqNullSafe(F.col("p")))
        .select("key", "part", "node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        .join(signs, "node")
        .join(held, "node")
        .groupBy("key", "part", "block")
        .agg(F.collect_list(F.struct("node", "component", "registers", "text")).alias("members"))
    )
    filled = materialise(filled, "near-blocks")

    def every(column: str):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    one, two = groups.toDF("key", "px", "nx"), groups.toDF("key", "py", "ny")
    # different components' groups, and the shared group with every component's
    across = one.join(two, "key").filter((F.col("px") < F.col("py")) | (F.col("px").isNull() & F.col("py").isNotNull()))
    across = across.withColumn("bx", every("nx")).withColumn("by", every("ny"))
    inside = one.filter("px IS NULL").withColumn("bx", every("nx")).withColumn("by", F.explode(F.sequence(F.col("bx"), F.col("nx") - 1)))
    wanted = across.select("key", "px", "bx", "py", "by").unionByName(inside.select("key", "px", "bx", F.lit(None).cast("long").alias("py"), "by"))
    same = F.col("px").eqNullSafe(F.col("py")) & (F.col("bx") == F.col("by"))
    left = filled.toDF("key", "px_", "bx", "x")
    right = filled.toDF("key", "py_", "by", "y")
    return (
        wanted.join(left, ["key", "bx"])
        .filter(F.col("px").eqNullSafe(F.col("px_")))
        .withColumn("same", same)
        .join(right, ["key", "by"])
        .filter(F.col("py").eqNullSafe(F.col("py_")))
        .select("key", "x", F.when(~F.col("same"), F.col("y")).alias("y"))
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, first for every row of ``docs(doc_id, text)``.

    width: words in a shingle.  percent: least similarity of a link, in hundredths.
    kept: whether the row's id is its component's smallest.  text_key: ``text_key()`` of its text.
    first: whether id and text_key are those of the row that stands for the component.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text_key().alias("text_key"), text_or_empty().alias("text"))
    sets = materialise(rows.mapInArrow(trimmed(_digest_sets(width)), "id long, text_key long, n long, s1 long, s2 long, registers binary"), "near-sets")
    classes = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "text_key")).alias("least_row"), F.first("registers").alias("registers"))
    # written at once, so the number stays
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    bands = classes.select("node", "registers").mapInArrow(_bands, "key long, node long")
    buckets = bands.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    buckets = materialise(buckets.select("key", "least"), "near-buckets")
    members = materialise(bands.join(buckets, "key").select("key", "node", "least"), "near-members")

    signs = classes.select("node", "registers")
    # of the smallest nodes of its buckets each node takes the one that it meets most often
    met = members.filter("node <> least").groupBy("least", "node").agg(F.count("*").alias("times"))
    stars = met.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("times", (-F.col("least")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), "b")
    likely = (
        stars.join(signs.toDF("b", "rb"), "b")
        .join(signs.toDF("a", "ra"), "a")
        .select("a", "b", "ra", "rb")
        .mapInArrow(_estimates, "a long, b long, likeness double")
    )
    floor = estimate_floor(percent / 100)
    first = materialise(likely.filter(F.col("likeness") >= floor).select("a", "b"), "near-stars")

    # texts of nodes that share a bucket with another; a node's own text is that of the row that stands for it
    inside = members.select("node").distinct()
    wanted = classes.join(inside, "node", "left_semi").select("node", F.col("least_row.id").alias("id"), F.col("least_row.text_key").alias("text_key"))
    held = materialise(rows.join(wanted, ["id", "text_key"]).groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    links = materialise(
        first.join(held.toDF("b", "tb"), "b").join(held.toDF("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(trimmed(_confirm(width, percent)), "a long, b long"),
        "near-links",
    )
    joined = components(links, "near-components")
    placed = materialise(
        members.join(joined.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("component")),
        "near-placed",
    )
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    tiles = _blocks(materialise(placed.join(apart, "key"), "near-apart"), signs, held)
    later = materialise(tiles.mapInArrow(trimmed(_link_blocks(floor, width, percent)), "a long, b long"), "near-later")
    final = components(links.unionByName(later), "near-final")
    named = materialise(
        classes.join(final, "node", "left").select("s1", "s2", "least_row", F.coalesce("component", "node").alias("component")),
        "near-named",
    )
    least = named.groupBy("component").agg(F.min("least_row").alias("least_of_all"))
    named = materialise(named.join(least, "component").select("s1", "s2", "least_of_all"), "near-nodes")
    found = sets.select("id", "text_key", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("least_of_all.id")).otherwise(F.col("id"))
    return found.select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(_NO_ID)).alias("component_id"),
        (F.col("id") == component).alias("kept"),
        "text_key",
        F.when(F.col("n") > 0, F.col("least_of_all") == F.struct("id", "text_key")).otherwise(F.lit(True)).alias("first"),
    )


#: For 4-word shingles at 80 hundredths.
LINK_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM cut
), classes AS (
  SELECT min(doc_id) AS node, any_value(s) AS s, len(any_value(s)) AS n, list_sort(s) AS k FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), grams AS (SELECT node, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, seen) AS (
  SELECT node, node FROM classes
  UNION
  SELECT edges.b, reach.seen FROM reach JOIN edges ON edges.a = reach.node WHERE reach.seen < edges.b
), least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(least.component, sets.doc_id) AS component_id, coalesce(least.component, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.k = list_sort(sets.s) LEFT JOIN least ON least.node = classes.node
"""
