"""Conversation structure repair by a min-plus matrix scan.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials: four states, start,
behind a system turn, behind a user turn, behind an assistant turn.  Every turn is a 4x4
matrix whose element (i, j) is the cheapest way from state i to state j over that turn, as
(cost, audit), the audit being the edits' initials; the closure over inserted turns is
multiplied to both sides, which is idempotent.  Products take the least cost, then the ASCII-least
audit.  Audits of equal cost are never prefixes of one another (each more letter costs), so
the least of two concatenations is that of the least parts and the product is associative.

Turns are sorted by conversation over all partitions; equal turns are one row with a count.
In a task, conversations are reduced as trees in numpy, all of a batch at a time.  A
conversation that a partition's edge or a batch's size cuts is left as segments of
bounded rows: matrix, figures and turns.  Their matrices are reduced as a tree over the cluster, the
audit is dealt out to the segments, and each segment edits its own turns.

Defined results: a null role or text is one space; a null conv_id is a conversation like others; turns
go by number (nulls first), then role and text; the initial of an empty role is none, and such
a turn, like one of any other role, fits nowhere unless it gets a new role or goes; a turn's first fault
counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation),
truncated (the last other character is none of ``.!?``); a long text is looked at as a whole;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Turns (and characters, about) of a segment at most, and segments or parts reduced together.
SEGMENT, SEGMENT_CHARS, FAN_IN = 8192, 16 << 20, 64
_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 50
_INITIALS = "sua"
#: State behind a turn of each initial, by the state before it; missing where it does not fit.
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_SOUND = (0, 3)

_FIGURES = "n long, blank long, duplicate long, truncated long, illegal long, numbers long, low long, high long, first_turn long, last_turn long, first_initial string, last_initial string"
_PARTS = (
    f"conv_id long, part int, seg long, whole boolean, {_FIGURES}, cost long, audit string, costs array<long>, audits array<string>, "
    "turns array<struct<place:int,edit:string,role:string,text:string>>"
)
_LEVEL = f"conv_id long, part int, seg long, {_FIGURES}, costs array<long>, audits array<string>"
_TURNS = "array<struct<edit:string,role:string,text:string>>"
_TURN_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


# ---- matrices -----------------------------------------------------------------------


def product(x: list, y: list) -> list:
    """Min-plus product of 4x4 matrices of (cost, audit)."""
    return [[min((x[i][k][0] + y[k][j][0], x[i][k][1] + y[k][j][1]) for k in range(4)) for j in range(4)] for i in range(4)]


def _far_matrix() -> list:
    return [[(_FAR, "")] * 4 for _ in range(4)]


def _closure() -> list:
    """The cheapest inserts from each state to each."""
    one = _far_matrix()
    for i in range(4):
        one[i][i] = (0, "")
        for initial in "ua":
            if i in _STEPS[initial]:
                one[i][_STEPS[initial][i]] = (INSERT, "I")
    many = product(one, one)
    return product(many, many)


def turn_matrix(initial: str, forced: bool, truncated: bool) -> list:
    """Keep, rerole or delete one turn, with inserts on both sides.  forced: it must go."""
    edit = _far_matrix()
    more = TRUNCATED if truncated else 0
    for i in range(4):
        edit[i][i] = (DELETE, "D")
        if not forced:
            for cost, letter, initials in ((more, "K", initial), (REROLE + more, "R", "ua")):
                for to in initials:
                    j = _STEPS.get(to, {}).get(i)
                    if j is not None:
                        edit[i][j] = min(edit[i][j], (cost, letter))
    return product(product(_closure(), edit), _closure())


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Costs and audits of each kind of turn: 3 * initial (s, u, a, other) + (sound, truncated, forced)."""
    kinds = [turn_matrix(i, fault == 2, fault == 1) for i in (*_INITIALS, "") for fault in range(3)]
    costs = np.array([[[min(e[0], _FAR) for e in row] for row in m] for m in kinds], np.int64)
    audits = np.array([[["" if e[0] >= _FAR else e[1] for e in row] for row in m] for m in kinds]).astype("S")
    return costs, audits


_COSTS, _AUDITS = _tables()


def _products(xc: np.ndarray, xa: np.ndarray, yc: np.ndarray, ya: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``product`` of many matrices at a time."""
    cost = audit = None
    for k in range(4):
        c = xc[:, :, k, None] + yc[:, k, None, :]
        a = np.strings.add(xa[:, :, k, None], ya[:, k, None, :])
        if cost is None:
            cost, audit = c, a
        else:
            better = (c < cost) | ((c == cost) & (a < audit))
            cost, audit = np.where(better, c, cost), np.where(better, a, audit)
    cost = np.minimum(cost, _FAR)
    audit[cost >= _FAR] = b""
    return cost, audit.astype(f"S{max(int(np.strings.str_len(audit).max()), 1)}")


def reduced(kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The product of each run of ``counts`` turns, by trees that all runs climb together."""
    groups = len(counts)
    costs, audits = np.zeros((groups, 4, 4), np.int64), [None] * groups
    c, a, left, who = _COSTS[kinds], _AUDITS[kinds], counts.astype(np.int64), np.arange(groups)
    while len(who):
        starts = np.concatenate([[0], np.cumsum(left)])
        done = np.flatnonzero(left == 1)
        for g in done.tolist():
            costs[who[g]], audits[who[g]] = c[starts[g]], a[starts[g]]
        stay = np.flatnonzero(left > 1)
        left, starts, who = left[stay], starts[:-1][stay], who[stay]
        if not len(who):
            break
        halves = (left + 1) // 2
        within = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
        first = np.repeat(starts, halves) + 2 * within
        two = 2 * within + 1 < np.repeat(left, halves)
        pc, pa_ = _products(c[first[two]], a[first[two]], c[first[two] + 1], a[first[two] + 1])
        nc, na = c[first], a[first].astype(f"S{max(a.dtype.itemsize, pa_.dtype.itemsize)}")
        nc[two], na[two] = pc, pa_
        c, a, left = nc, na, halves
    return costs, audits


def verdict(costs, audits) -> tuple[int, str]:
    """The cheapest way from the start to a sound end."""
    return min((int(costs[0][j]), audits[0][j]) for j in _SOUND)


def edited(audit: str, kept: dict[int, tuple[str, str]], made: int = 0, odd: bool | None = None) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what stays.

    kept: role and text of turns by their place (those that must go may be missing).  made: turns
    that the part of the audit before this one has left.  odd: whether the whole audit leaves an odd number,
    which is so if and only if a system turn comes first.
    """
    if odd is None:
        odd = (len(audit) - audit.count("D")) % 2 == 1
    out, place = [], 0
    for letter in audit:
        if letter != "D":
            role = "user" if (made - odd) % 2 == 0 else "assistant"
            if letter == "K":
                out.append(("K", *kept[place]))
            else:
                out.append((letter, role, kept[place][1] if letter == "R" else ""))
            made += 1
        if letter != "I":
            place += 1
    return out


# ---- sorted turns to conversations and segments ---------------------------------------


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _pieces(rows: list[dict], segment: int) -> Iterator[tuple[list[int], list[dict | None], list[tuple]]]:
    """Runs of equal turns as pieces of at most ``segment`` turns: kinds, the turn of each place, and (place, role, text) of what need not go."""
    kinds, turns, kept, chars = [], [], [], 0
    for r in rows:
        base = 3 * (_INITIALS.find(r["initial"]) if r["initial"] in _INITIALS and r["initial"] else 3)
        left, first = r["times"], True
        while left:
            if len(kinds) >= segment or chars >= SEGMENT_CHARS:
                yield kinds, turns, kept
                kinds, turns, kept, chars = [], [], [], 0
            if first and not (r["blank"] or r["again"]):
                kept.append((len(kinds), r["role"], r["text"]))
                chars += len(r["text"])
                kinds.append(base + (1 if r["truncated"] else 0))
                turns.append(r)
                left -= 1
            else:
                n = min(left, segment - len(kinds))
                kinds += [base + 2] * n
                turns += [r] * n
                left -= n
            first = False
    if kinds:
        yield kinds, turns, kept


def _figures(kinds: list[int], turns: list[dict]) -> dict:
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    blank = sum(t["blank"] for t in turns)
    forced = sum(k % 3 == 2 for k in kinds)
    return {
        "n": len(kinds), "blank": blank, "duplicate": forced - blank, "truncated": sum(k % 3 == 1 for k in kinds),
        "illegal": sum(not _legal(x["initial"], y["initial"]) for x, y in zip(turns, turns[1:])),
        "numbers": len(set(numbers)), "low": min(numbers, default=None), "high": max(numbers, default=None),
        "first_turn": turns[0]["turn"], "last_turn": turns[-1]["turn"], "first_initial": turns[0]["initial"], "last_initial": turns[-1]["initial"],
    }


def _joined(x: dict, y: dict) -> dict:
    """Figures of two neighbouring segments together."""
    out = {k: x[k] + y[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "numbers")}
    out["illegal"] += not _legal(x["last_initial"], y["first_initial"])
    out["numbers"] -= x["last_turn"] is not None and x["last_turn"] == y["first_turn"]
    out["low"] = x["low"] if y["low"] is None else y["low"] if x["low"] is None else min(x["low"], y["low"])
    out["high"] = x["high"] if y["high"] is None else y["high"] if x["high"] is None else max(x["high"], y["high"])
    return out | {"first_turn": x["first_turn"], "first_initial": x["first_initial"], "last_turn": y["last_turn"], "last_initial": y["last_initial"]}


def _scan(schema: pa.Schema, segment: int):
    """The sorted turns of a partition: conversations that end inside it, edited, and segments of those that may not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        missing = object()
        first = cut = missing  # the partition's first conversation, and one that has been cut
        held: list[dict] = []

        def emit(groups: list[list[dict]], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seg
            pieces = []
            for i, rows in enumerate(groups):
                own = list(_pieces(rows, segment))
                key = rows[0]["conv_id"]
                open_ = len(own) > 1 or key in (first, cut) or last and i == len(groups) - 1
                pieces += [(key, not open_, *p) for p in own]
            if not pieces:
                return
            costs, audits = reduced(np.concatenate([np.array(p[2]) for p in pieces]), np.array([len(p[2]) for p in pieces]))
            out = []
            for (key, whole, kinds, turns, kept), c, a in zip(pieces, costs, audits, strict=True):
                a = [[x.decode() for x in row] for row in a]
                row = {"conv_id": key, "part": part, "seg": seg, "whole": whole} | _figures(kinds, turns)
                seg += 1
                if whole:
                    row["cost"], row["audit"] = verdict(c, a)
                    row["turns"] = [{"edit": e, "role": r, "text": t} for e, r, t in edited(row["audit"], {p: (r, t) for p, r, t in kept})]
                else:
                    row["costs"], row["audits"] = c.ravel().tolist(), sum(a, [])
                    row["turns"] = [{"place": p, "role": r, "text": t} for p, r, t in kept]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            groups: list[list[dict]] = [held] if held else []
            for row in batch.to_pylist():
                if first is missing:
                    first = row["conv_id"]
                if groups and groups[-1][0]["conv_id"] == row["conv_id"]:
                    groups[-1].append(row)
                else:
                    groups.append([row])
            held = groups.pop() if groups else []
            yield from emit(groups, False)
            if sum(r["times"] for r in held) >= segment or sum(len(r["text"]) for r in held) >= SEGMENT_CHARS:
                cut = held[0]["conv_id"]
                yield from emit([held], True)
                held = []
        if held:
            yield from emit([held], True)

    return run


def _combine(schema: pa.Schema):
    """Neighbouring segments as one."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))
        levels = [(r, [[(r["costs"][4 * i + j], r["audits"][4 * i + j]) for j in range(4)] for i in range(4)]) for r in rows]
        while len(levels) > 1:
            pairs = [(_joined(x[0], y[0]), _near(product(x[1], y[1]))) for x, y in zip(levels[::2], levels[1::2])]
            levels = pairs + levels[len(pairs) * 2 :]
        figures, matrix = levels[0]
        flat = [e for row in matrix for e in row]
        out = {k: v for k, v in figures.items() if k not in ("conv_id", "part", "seg", "costs", "audits", "__group")}
        out |= {"conv_id": rows[0]["conv_id"], "part": rows[0]["__group"], "seg": 0, "costs": [e[0] for e in flat], "audits": [e[1] for e in flat]}
        return pa.Table.from_pylist([out], schema)

    return run


def _near(matrix: list) -> list:
    return [[e if e[0] < _FAR else (_FAR, "") for e in row] for row in matrix]


def _deal(table: pa.Table) -> pa.Table:
    """A conversation's audit cut at its segments' edges; the inserts between two go with the later one."""
    rows = table.to_pylist()
    audit = next(r["audit"] for r in rows if r["audit"] is not None)
    letters = np.frombuffer(audit.encode(), np.uint8)
    turns = np.flatnonzero(letters != ord("I"))
    left = np.concatenate([[0], np.cumsum(letters != ord("D"))])
    segments = sorted((r for r in rows if r["audit"] is None), key=lambda r: (r["part"], r["seg"]))
    out, at, start = [], 0, 0
    for i, s in enumerate(segments):
        at += s["n"]
        stop = len(audit) if i == len(segments) - 1 else int(turns[at - 1]) + 1
        out.append({"part": s["part"], "seg": s["seg"], "slice": audit[start:stop], "made": int(left[start]), "odd": bool(left[-1] % 2)})
        start = stop
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("slice", pa.string()), ("made", pa.int64()), ("odd", pa.bool_())]))


def _edit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = []
        for r in batch.to_pylist():
            made = edited(r["slice"], {t["place"]: (t["role"], t["text"]) for t in r["turns"]}, r["made"], r["odd"])
            turns.append([{"edit": e, "role": role, "text": text} for e, role, text in made])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seg")), pa.array(turns, _TURN_TYPE)], ["conv_id", "part", "seg", "turns"])


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


# ---- the operator -------------------------------------------------------------------


@dataclass
class Repaired:
    """whole: a row a conversation, with its ``turns`` behind the repair.  long: those that were cut, without turns;
    long_turns: (conv_id, part, seg, turns), in order of part and seg."""

    whole: DataFrame
    long: DataFrame
    long_turns: DataFrame

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self.whole.drop("turns").unionByName(self.long)

    def turns(self) -> DataFrame:
        """conv_id, part, seg, pos, edit, role, text: the repaired turns, in order of part, seg and pos."""
        both = self.whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seg"), "turns").unionByName(self.long_turns)
        return both.select("conv_id", "part", "seg", F.posexplode("turns").alias("pos", "t")).select("conv_id", "part", "seg", "pos", "t.edit", "t.role", "t.text")


def _summary() -> list[Column]:
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)).cast("long").alias("gaps")
    return [F.col("conv_id"), gaps, *map(F.col, ("blank", "duplicate", "truncated", "illegal", "cost", "audit"))]


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias(column)


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT, fan_in: int = FAN_IN) -> Repaired:
    """The cheapest repair of every conversation of ``conversations(conv_id, turn, role, text)``.

    segment: turns of a segment at most.  fan_in: partitions whose segments are reduced together.

    A column ``times``, if ``conversations`` is made by ``damaged``, counts a row several times.
    """
    spark = conversations.sparkSession
    times = F.col("times") if "times" in conversations.columns and conversations.schema["times"].metadata.get("carillon") else F.lit(1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role"), _or_space("text"), times.cast("long").alias("times"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    key = F.md5(F.concat("role", F.lit("\0"), "text"))
    # role and text that come at several turns of a conversation; written, so that Spark knows their size
    seen = rows.groupBy(F.col("conv_id").alias("c"), key.alias("key")).agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
    seen = materialise(seen.filter("earliest <> latest").select("c", "key", "earliest"), "conversation-repeats")
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("own", key)
    stripped = F.rtrim(F.col("text"), F.lit(_SPACES))
    told = runs.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("own") == F.col("key")), "left").select(
        "conv_id", "turn", "role", "text", "times", F.coalesce(place > F.col("earliest"), F.lit(False)).alias("again"), (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"), F.substring("role", 1, 1).alias("initial"),
    )
    # dealt by the beginnings of role and text, as the bounds of ranges go through the driver; a text only where its role is whole
    begins = F.when(F.length("role") < 32, F.substring("text", 1, 32)).otherwise("")
    told = told.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), begins).sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = materialise(told.mapInArrow(trimmed(_scan(_arrow(spark, _PARTS), segment)), _PARTS), "conversation-parts")

    whole = parts.filter("whole").select(*_summary(), F.expr("transform(turns, t -> struct(t.edit, t.role, t.text))").cast(_TURNS).alias("turns"))
    segments = parts.filter("NOT whole")
    level = segments.select(*(c.split()[0] for c in _LEVEL.split(", ")))
    combine = _combine(_arrow(spark, _LEVEL))
    group, many = F.col("part"), 1 + (level.agg(F.max("part")).first()[0] or 0)
    while True:
        level = level.withColumn("__group", group.cast("int")).groupBy("conv_id", "__group").applyInArrow(combine, _LEVEL)
        if many <= 1:
            break
        level = materialise(level, "conversation-level")
        group, many = F.floor(F.col("part") / fan_in), -(-many // fan_in)
    ways = [F.struct(F.element_at("costs", j + 1).alias("cost"), F.element_at("audits", j + 1).alias("audit")) for j in _SOUND]
    long = materialise(level.withColumn("best", F.least(*ways)).select("*", "best.cost", "best.audit").select(*_summary()), "conversation-long")
    heads = long.select("conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("seg"), F.lit(None).cast("long").alias("n"), "audit")
    edges = segments.select("conv_id", "part", "seg", "n", F.lit(None).cast("string").alias("audit"))
    slices = heads.unionByName(edges).groupBy("conv_id").applyInArrow(_deal, "part int, seg long, slice string, made long, odd boolean")
    dealt = segments.select("conv_id", "part", "seg", "turns").join(slices, ["part", "seg"])
    return Repaired(whole, long, dealt.mapInArrow(trimmed(_edit_segments), f"conv_id long, part int, seg long, turns {_TURNS}"))


# ---- damage and digest --------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with known faults, by crc32 of ``conv_id:turn``; ``times`` is 2 for a row that is repeated."""
    kind = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", _or_space("role"), _or_space("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times", metadata={"carillon": "times"})
    )


def _hash_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation whose segments come in order; holds no text longer than a batch."""
    own, state, begun = None, None, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != own:
                if state is not None:
                    yield done()
                own, state, begun = r["conv_id"], hashlib.sha256(), False
            for t in r["turns"]:
                state.update(("\n" if begun else "").encode() + f"{t['role']}:{t['text']}".encode())
                begun = True
    if state is not None:
        yield done()


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the figures of its damaged turns and the hash of their repair."""
    repaired = repair_conversations(damaged(conversations))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.whole.select("*", F.sha2(lines, 256).alias("repaired_sha256")).drop("turns")
    # a hash goes through all of a conversation in order, by nature in one task, but as a stream
    hashes = repaired.long_turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_hash_long, "conv_id long, repaired_sha256 string")
    long = repaired.long.join(hashes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    found = whole.unionByName(long)
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_CRC = (
    f"xor(4294967295::BIGINT, list_reduce(list_transform(string_split({_KEY}, ''), lambda x: ascii(x)::BIGINT), "
    "lambda a, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(a, b)), 4294967295::BIGINT)) % 20"
)


def _costs(value: str, more: str, letter: str) -> str:
    """A way, written as nine digits of cost and the audit, with one edit more."""
    return f"lpad((left({value}, 9)::BIGINT + {more})::VARCHAR, 9, '0') || substr({value}, 10) || '{letter}'"


def _step() -> str:
    """The ways to the four states behind a turn x = [initial, fault]; a state that is not reached is null."""
    over = f"(CASE WHEN x[2] = 'truncated' THEN {TRUNCATED} ELSE 0 END)"
    ways: list[list[str]] = [[_costs(f"a[{i + 1}]", str(DELETE), "D")] for i in range(4)]
    for initial, steps in _STEPS.items():
        for i, j in steps.items():
            keep = f"CASE WHEN x[1] = '{initial}' AND x[2] <> 'forced' THEN {_costs(f'a[{i + 1}]', over, 'K')} END"
            ways[j].append(keep)
            if initial != "s":
                ways[j].append(f"CASE WHEN x[2] <> 'forced' THEN {_costs(f'a[{i + 1}]', f'{REROLE} + {over}', 'R')} END")
    return "[" + ", ".join(f"least({', '.join(w)}, NULL)" for w in ways) + "]"


def _inserted(w: str) -> str:
    """The ways w with inserts behind them: to a user turn from anywhere but there, then to an assistant turn."""
    user = f"least({w}[3], {', '.join(_costs(f'{w}[{i}]', str(INSERT), 'I') for i in (1, 2, 4))})"
    return f"list_transform([{user}], lambda u: [{w}[1], {w}[2], u, least({w}[4], {_costs('u', str(INSERT), 'I')})])[1]"


REPAIR_SQL = f"""
WITH hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS kind FROM conversations
), after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM after
), told AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS two
  FROM placed
), conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pos > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal,
    list([initial, CASE WHEN fault IN ('blank', 'duplicate') THEN 'forced' ELSE fault END] ORDER BY pos) AS xs
  FROM told GROUP BY conv_id
), ways AS (
  SELECT *, list_reduce(xs, lambda a, x: list_transform([{_step()}], lambda w: {_inserted('w')})[1],
    ['000000000', NULL, '{INSERT:09d}I', '{2 * INSERT:09d}II']) AS w FROM conv
), best AS (
  SELECT *, left(least(w[1], w[4]), 9)::BIGINT AS cost, substr(least(w[1], w[4]), 10) AS audit FROM ways
), letters AS (
  SELECT conv_id, audit, t.i AS p, substr(audit, t.i, 1) AS letter FROM best, unnest(range(1, len(audit) + 1)) AS t(i)
), counted AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS pos, count(*) FILTER (WHERE letter <> 'D') OVER w - 1 - len(replace(audit, 'D', '')) % 2 AS made
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
), lines AS (
  SELECT c.conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN made % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t
  FROM counted c JOIN told ON c.conv_id IS NOT DISTINCT FROM told.conv_id AND greatest(c.pos, 1) = told.pos WHERE letter <> 'D' GROUP BY c.conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON i.conv_id IS NOT DISTINCT FROM l.conv_id
"""
