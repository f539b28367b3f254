"""N-gram Jaccard join by a count-vector R-tree.

A document is its set of distinct word shingles.  Shingles are hashed to groups; how many of a
set's fall in each is a point.  Two sets share at most the sum of the smaller counts, so a
rectangle of points shares at most the sum of the smaller upper corners with another: what is
bounded below the threshold is never looked at.

1. Equal sets are one class; a class goes on as one node.
2. Points near each other are brought together without a loss: with a link, two sets share
   a shingle among the first ``n - ceil(t * n) + 1`` of each, in any order of all shingles.
   The order is common ones last, then by hash; which are common is counted over all texts, and
   has no effect on results.  The nodes with a shingle among their first are its bucket; buckets of
   the same nodes are one.
3. Each node is verified against one node, of the smallest nodes of its buckets the one that it
   meets most often, if its point allows a link.
4. Buckets whose nodes lie in different components are R-trees: packed by size and leading
   coordinates into blocks, blocks into leaves.  Pairs of blocks whose rectangles allow a
   link go on, in tasks of their own, to pairs of leaves and pairs of points.  A component with a
   block's worth of nodes in a bucket has blocks of its own, which never meet each other.
5. Of the surviving pairs first a spanning forest by block is verified on the full sets, then all between
   components that are still apart.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; fewer
words than a shingle make one shingle of the whole sequence; texts without words and null
texts are empty, linked with nothing, and components of their own; a text of any length is
one set; every row is linked by its own text, also where rows share an id; a null id is larger than every
other (component_id is null where no other is reached); an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_dup
from .common import materialise, text_or_empty, trimmed
from .graph import components
from .near_dup import _NO_ID, _confirm, _mix, shingle_sets, text_key
from .tokens import text_groups

#: Coordinates of a point; points of a block and of a leaf at most.
GROUPS, BLOCK, LEAF = 256, 256, 16
#: Share of documents from which a shingle is common, fewest of a batch, and how many common ones are known at most (8 bytes each).
COMMON, FEWEST, MOST_COMMON = 0.001, 8, 1 << 18
#: Coordinates that pack points into blocks.
_LEADING = 6


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


# ---- points and buckets -------------------------------------------------------------


def _frequent(width: int, share: float):
    """Shingles that a share of a batch's documents have: of those that a share of all have, each is in some batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_groups(batch.column(0), 32_000_000):
                flat, _ = shingle_sets(batch.column(0)[i:j], width)
                tokens, docs = np.unique(flat, return_counts=True)
                often = docs >= max(FEWEST, share * (j - i))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(docs[often])], ["token", "docs"])

    return run


def common_shingles(texts: DataFrame, width: int, share: float = COMMON, most: int = MOST_COMMON) -> np.ndarray:
    """The sorted hashes of common shingles, the most frequent ``most`` at most: only an order, so what is left out costs time and no result."""
    counted = texts.mapInArrow(trimmed(_frequent(width, share)), "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))
    found = counted.orderBy(F.desc("docs"), "token").limit(most).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def points(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, GROUPS) counts."""
    n = len(bounds) - 1
    group = np.repeat(np.arange(n), np.diff(bounds)) * GROUPS + (_mix(flat) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(group, minlength=n * GROUPS).reshape(n, GROUPS)


def _packed(counts: np.ndarray) -> bytes:
    """The smallest unsigned type that holds them; the length tells which."""
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // GROUPS])


def first_shingles(flat: np.ndarray, bounds: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which elements of the sorted sets are among the first of their set, and how many each set has."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(flat), bool)
    if len(common) and len(flat):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        late = common[at] == flat
    before = np.concatenate([[0], np.cumsum(~late)])
    early = before[:-1] - before[bounds[:-1]][owner]  # of the set's own that are not common, so many come before
    place = np.where(late, (before[bounds[1:]] - before[bounds[:-1]])[owner] + np.arange(len(flat)) - bounds[:-1][owner] - early, early)
    take = np.where(n > 0, _prefix(n, percent), 0)
    return place < take[owner], take


def _digest_sets(width: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(k) for k in range(3))
            for i, j in text_groups(texts, 4_000_000):
                flat, bounds = shingle_sets(texts[i:j], width)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(some):
                    one[some] = np.add.reduceat(_mix(flat), bounds[:-1][some])
                    two[some] = np.add.reduceat(_mix(flat + np.uint64(0x2545F4914F6CDD1D)), bounds[:-1][some])
                first, take = first_shingles(flat, bounds, common.value, percent)
                counts = [_packed(p) for a in range(0, j - i, 4096) for p in points(flat[bounds[a] : bounds[min(a + 4096, j - i)]], bounds[a : min(a + 4096, j - i) + 1] - bounds[a])]
                starts = pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j], keys[i:j], pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(counts, pa.binary()),
                        pa.ListArray.from_arrays(starts, pa.array(flat[first].view(np.int64))),
                    ],
                    ["id", "text_key", "n", "s1", "s2", "point", "keys"],
                )

    return run


# ---- the tree -----------------------------------------------------------------------


def _may_link(shared, x, y, percent: int):
    """Whether sets of x and y elements (or more) can be linked with so many in common."""
    return shared * (100 + percent) >= percent * (x + y)


def _sized(x_low, x_high, y_low, y_high, percent: int):
    return (100 * y_high >= percent * x_low) & (100 * x_high >= percent * y_low)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates, of every row of x with every row of y."""
    return np.stack([np.minimum(row, y).sum(1, dtype=np.int64) for row in x]) if len(x) else np.zeros((0, len(y)), np.int64)


def _stack(data: list[bytes]) -> np.ndarray:
    rows = [_unpacked(d) for d in data]
    return np.stack(rows).astype(max((r.dtype for r in rows), key=lambda t: t.itemsize))


def _allowed(percent: int):
    """The pairs whose points allow a link."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = _stack(batch.column("pa").to_pylist()), _stack(batch.column("pb").to_pylist())
            shared = np.minimum(x, y).sum(1, dtype=np.int64)
            keep = pa.array(_may_link(shared, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _pack_blocks(batches):
    """Blocks with their members, which come in the tree's order, and their rectangles' upper corners."""
    for batch in batches:
        if not len(batch):
            continue
        members = batch.column("members")
        bounds = members.offsets.to_numpy().astype(np.int64)
        flat = members.flatten()
        bounds -= bounds[0]
        p = _stack(flat.field("point").to_pylist())
        node, component, n = (flat.field(c).to_numpy() for c in ("node", "component", "n"))
        starts = bounds[:-1]
        corners = np.maximum.reduceat(p, starts, 0)
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("part"), pa.array(np.minimum.reduceat(n, starts)), pa.array(np.maximum.reduceat(n, starts)), pa.array([c.tobytes() for c in corners], pa.binary()),
                cut(node), cut(component), cut(n), cut(p),
            ],
            ["key", "part", "low", "high", "corner", "nodes", "components", "sizes", "points"],
        )


_BLOCK = "key long, part long, low long, high long, corner binary, nodes binary, components binary, sizes binary, points binary"


def _matrix(points_: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(points_, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(points_) // (rows * GROUPS)]).reshape(rows, GROUPS)


class _Leaves:
    def __init__(self, row: dict, end: str) -> None:
        self.nodes, self.components, self.sizes = (np.frombuffer(row[f"{c}_{end}"], np.int64) for c in ("nodes", "components", "sizes"))
        self.points = _matrix(row[f"points_{end}"], len(self.nodes))
        starts = np.arange(0, len(self.nodes), LEAF)
        self.corner = np.maximum.reduceat(self.points, starts, 0)
        self.low, self.high = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        self.leaf = np.arange(len(self.nodes)) // LEAF


def tree_pairs(x: _Leaves, y: _Leaves | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in x, places in y, shared at most) of the pairs of different components that may be linked; without y those inside x."""
    inside, y = y is None, x if y is None else y
    leaves = _may_link(_shared(x.corner, y.corner), x.low[:, None], y.low[None, :], percent) & _sized(x.low[:, None], x.high[:, None], y.low[None, :], y.high[None, :], percent)
    if inside:
        leaves &= np.arange(len(leaves))[:, None] <= np.arange(len(leaves))[None, :]
    found = []
    for leaf in np.flatnonzero(leaves.any(1)).tolist():
        mine = np.flatnonzero(x.leaf == leaf)
        others = np.flatnonzero(leaves[leaf][y.leaf])
        shared = _shared(x.points[mine], y.points[others])
        a, b = x.sizes[mine][:, None], y.sizes[others][None, :]
        keep = _may_link(shared, a, b, percent) & _sized(a, a, b, b, percent) & (x.components[mine][:, None] != y.components[others][None, :])
        if inside:
            keep &= mine[:, None] < others[None, :]
        i, j = np.nonzero(keep)
        found.append((mine[i], others[j], shared[i, j]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _forest(one: np.ndarray, two: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the pairs of components, in order, those that join what is not joined yet."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    kept = []
    for k in order.tolist():
        x, y = root(int(one[k])), root(int(two[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def _few(batch: pa.RecordBatch, percent: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, nodes, nodes): what single leaves leave, all leaves of a batch at a time."""
    sizes_of = np.array([len(x) // 8 for x in batch.column("nodes_x").to_pylist()])
    for m in np.unique(sizes_of[sizes_of <= LEAF]).tolist():
        rows = np.flatnonzero(sizes_of == m)
        part = batch.take(pa.array(rows))
        nodes, components, sizes = (np.frombuffer(b"".join(part.column(f"{c}_x").to_pylist()), np.int64).reshape(-1, m) for c in ("nodes", "components", "sizes"))
        i, j = np.triu_indices(m, 1)
        keep = (components[:, i] != components[:, j]) & _sized(sizes[:, i], sizes[:, i], sizes[:, j], sizes[:, j], percent)
        row, pair = np.nonzero(keep)
        points_ = part.column("points_x").to_pylist()
        for a in range(0, len(row), 4096):
            r, k = row[a : a + 4096], pair[a : a + 4096]
            known = {x: _matrix(points_[x], m) for x in np.unique(r).tolist()}
            x = np.stack([known[t][i[u]] for t, u in zip(r.tolist(), k.tolist(), strict=True)])
            y = np.stack([known[t][j[u]] for t, u in zip(r.tolist(), k.tolist(), strict=True)])
            fine = _may_link(np.minimum(x, y).sum(1, dtype=np.int64), sizes[r, i[k]], sizes[r, j[k]], percent)
            r, k = r[fine], k[fine]
            if forest and len(r):
                ends = np.flatnonzero(np.diff(r, append=-1)) + 1  # a leaf's pairs stand together
                kept = [a + _forest(components[r[a], i[k[a:b]]], components[r[a], j[k[a:b]]], np.arange(b - a)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                r, k = r[np.concatenate(kept)], k[np.concatenate(kept)]
            yield rows[r], nodes[r, i[k]], nodes[r, j[k]]


def _join_blocks(percent: int, inside: bool, forest: bool):
    """key, a, b: what the trees of a block, or of two, leave."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = list(_few(batch, percent, forest)) if inside else []
            rows = np.arange(len(batch))
            if inside:
                rows = rows[np.array([len(x) // 8 for x in batch.column("nodes_x").to_pylist()]) > LEAF]
            for at in rows.tolist():
                row = batch.slice(at, 1).to_pylist()[0]
                x, y = _Leaves(row, "x"), None if inside else _Leaves(row, "y")
                i, j, shared = tree_pairs(x, y, percent)
                y = y or x
                if forest and len(i):
                    likeness = shared / (x.sizes[i] + y.sizes[j] - np.minimum(shared, np.minimum(x.sizes[i], y.sizes[j])))
                    kept = _forest(x.components[i], y.components[j], np.argsort(-likeness, kind="stable"))
                    i, j = i[kept], j[kept]
                found.append((np.full(len(i), at), x.nodes[i], y.nodes[j]))
            if found:
                at, a, b = (np.concatenate(f) for f in zip(*found, strict=True))
                keys = batch.column("key_x").take(pa.array(at.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])

    return run


def _rectangles(percent: int):
    """The pairs of blocks whose rectangles allow a link."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = _stack(batch.column("corner_x").to_pylist()), _stack(batch.column("corner_y").to_pylist())
            keep = pa.array(_may_link(np.minimum(x, y).sum(1, dtype=np.int64), batch.column("low_x").to_numpy(), batch.column("low_y").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("block_x").filter(keep), batch.column("block_y").filter(keep)], ["block_x", "block_y"])

    return run


def _cell(percent: int) -> Column:
    """Size and leading coordinates of a point, coarsely."""
    slot = F.floor(F.log(F.col("n")) / np.log(100 / percent))
    width = F.octet_length("point") / GROUPS
    above = F.lit(0)
    for g in range(_LEADING):
        # the lowest byte of the coordinate is enough to spread points
        byte = F.conv(F.hex(F.substring("point", (g * width + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        above = above * 2 + (byte * GROUPS > F.col("n")).cast("int")
    return (slot * (1 << _LEADING) + above).cast("long")


def _surviving(placed: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """key, a, b: pairs of nodes in different components that share a bucket and that its tree leaves."""
    owns = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    apart = owns.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    owns = materialise(owns.join(apart, "key").withColumn("part", F.when(F.col("rows") >= BLOCK, F.col("component"))), "join-owns")
    groups = owns.groupBy("key", "part").agg(F.sum("rows").alias("rows"))
    spots = (
        placed.join(owns.select("key", "component", "part"), ["key", "component"])
        .join(groups.select(F.col("key").alias("k"), F.col("part").alias("p"), F.col("rows").alias("total")), (F.col("key") == F.col("k")) & F.col("part").eqNullSafe(F.col("p")))
        .select("key", "part", "node", "component", "total")
    )
    spots = materialise(spots, "join-spots")
    # what fits a block is one; the rest is packed by size and leading coordinates, and what is alike in them is salted
    large = spots.filter(F.col("total") > BLOCK).join(nodes, "node").select("key", "part", "node", "component", _cell(percent).alias("cell"))
    cells = large.groupBy("key", "part", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).toDF("k", "p", "c", "blocks")
    same = (F.col("key") == F.col("k")) & F.col("part").eqNullSafe(F.col("p")) & (F.col("cell") == F.col("c"))
    large = large.join(cells, same).select("key", "part", "node", "component", "cell", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("salt"))
    zero = F.lit(0).cast("long")
    small = spots.filter(F.col("total") <= BLOCK).select("key", "part", "node", "component", zero.alias("cell"), zero.alias("salt"))
    filled = small.unionByName(large).join(nodes, "node").groupBy("key", "part", "cell", "salt").agg(F.array_sort(F.collect_list(F.struct("n", "point", "node", "component"))).alias("members"))
    blocks = filled.select("key", "part", "members").mapInArrow(trimmed(_pack_blocks), _BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "join-blocks")  # written at once, so the number stays

    def side(end: str, *columns: str) -> DataFrame:
        return blocks.select(*(F.col(c).alias(f"{c}_{end}") for c in columns))

    members = ("block", "nodes", "components", "sizes", "points")
    schema = "key long, a long, b long"
    inner = blocks.filter("part IS NULL").select(*(F.col(c).alias(f"{c}_x") for c in ("key", *members[1:]))).mapInArrow(trimmed(_join_blocks(percent, True, forest)), schema)
    several = blocks.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("key_x"))
    corners = ("key", "part", "block", "low", "high", "corner")
    pairs = side("x", *corners).join(several, "key_x", "left_semi").join(side("y", *corners), F.col("key_x") == F.col("key_y"))
    pairs = pairs.filter((F.col("block_x") < F.col("block_y")) & ~F.coalesce(F.col("part_x") == F.col("part_y"), F.lit(False)))
    pairs = pairs.filter(_sized(F.col("low_x"), F.col("high_x"), F.col("low_y"), F.col("high_y"), percent))
    wanted = pairs.select("block_x", "block_y", "low_x", "low_y", "corner_x", "corner_y").mapInArrow(_rectangles(percent), "block_x long, block_y long")
    across = wanted.join(side("x", "key", *members), "block_x").join(side("y", *members), "block_y").drop("block_x", "block_y").mapInArrow(trimmed(_join_blocks(percent, False, forest)), schema)
    return inner.unionByName(across)


def _verified(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    with_texts = pairs.join(held.toDF("b", "tb"), "b").join(held.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return with_texts.mapInArrow(trimmed(_confirm(width, percent)), "a long, b long")


def _placed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """key, node, component; joined: node, c for the nodes that are in a component with others."""
    return materialise(members.join(joined, "node", "left").select("key", "node", F.coalesce("c", "node").alias("component")), "join-placed")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``.

    width: words in a shingle.  percent: least similarity of a link, in hundredths.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text_key().alias("text_key"), text_or_empty().alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(rows.select("text"), width))
    sets = rows.mapInArrow(trimmed(_digest_sets(width, percent, common)), "id long, text_key long, n long, s1 long, s2 long, point binary, keys array<long>")
    sets = materialise(sets, "join-sets")
    whole = F.min(F.struct("id", "text_key", "n", "point", "keys"))
    classes = sets.filter("n > 0").groupBy("s1", "s2").agg(whole.alias("w"))
    classes = classes.select("s1", "s2", F.struct("w.id", "w.text_key").alias("least_row"), "w.n", "w.point", "w.keys", F.monotonically_increasing_id().alias("node"))
    classes = materialise(classes, "join-classes")  # written at once, so the number stays
    nodes = classes.select("node", "n", "point")

    spots = classes.select("node", F.explode("keys").alias("key"))
    marks = [F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")]
    buckets = spots.groupBy("key").agg(*marks).filter("least < most")
    # buckets of the same nodes are one: shingles of one passage, or of near copies
    buckets = buckets.groupBy("least", "most", "c", "mark").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "least", "weight")
    members = materialise(spots.join(materialise(buckets, "join-buckets"), "key").select("key", "node", "least", "weight"), "join-members")
    met = members.filter("node <> least").groupBy("least", "node").agg(F.sum("weight").alias("times"))
    stars = met.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("times", (-F.col("least")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), "b")
    likely = stars.join(nodes.toDF("b", "nb", "pb"), "b").join(nodes.toDF("a", "na", "pa"), "a").mapInArrow(_allowed(percent), "a long, b long")

    # texts of nodes that share a bucket with another; a node's own text is that of the row that stands for it
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least_row.id").alias("id"), F.col("least_row.text_key").alias("text_key"))
    held = materialise(rows.join(wanted, ["id", "text_key"]).groupBy("node").agg(F.first("text").alias("text")), "join-texts")

    asked = materialise(likely, "join-stars")
    links = materialise(_verified(asked, held, width, percent), "join-links")
    held_in = members.select("key", "node")
    for forest in (True, False):
        if forest:
            # each node has one link to a smaller node: two steps along them tell most of what is joined
            step = links.select(F.col("b").alias("node"), F.col("a").alias("c"))
            joined = step.join(step.toDF("c", "further"), "c", "left").select("node", F.coalesce("further", "c").alias("c"))
        else:
            joined = components(links, "join-components", look=True).withColumnRenamed("component", "c")
        left = materialise(_surviving(_placed(held_in, joined), nodes, percent, forest), "join-left")
        survivors = materialise(left.select("a", "b").distinct().join(asked, ["a", "b"], "left_anti"), "join-survivors")
        links = materialise(links.unionByName(_verified(survivors, held, width, percent)), "join-links")
        asked = asked.unionByName(survivors)
        # components only grow, so a bucket that has left nothing will leave nothing
        held_in = held_in.join(left.select("key").distinct(), "key", "left_semi")

    named = classes.join(components(links, "join-final", look=True), "node", "left").select("s1", "s2", "least_row", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "join-named")
    least = named.groupBy("component").agg(F.min("least_row.id").alias("component_id"))
    found = sets.select("id", "n", "s1", "s2").join(named.join(least, "component").select("s1", "s2", "component_id"), ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(_NO_ID)).alias("component_id"))


#: For 4-word shingles at 85 hundredths: the links of near_dup at another threshold, without its last column.
JOIN_SQL = near_dup.LINK_SQL.replace(">= 80 *", ">= 85 *").replace(", coalesce(least.component, sets.doc_id) = sets.doc_id AS kept", "")
