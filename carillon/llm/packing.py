"""Hierarchical multi-length packing of tokenised documents.

Each document's ids are cut into full windows of the longest tier; what remains is routed
to the shortest tier that holds it.  Tiers are packed from long to short: every remainder
opens a window, the gap behind it is filled with whole shorter documents (largest that
fits first) and, at the end, with a cut piece of one, so that the window is exactly full.
A remainder that no filler is left for is cut at the next tier and its rest goes down.
Below the shortest tier the rests are laid end to end and cut at that tier, and a task's
last few ids into powers of two, so every sequence is a power of two long and none is
padded.  Sequences of one tier are dealt to step groups that hold equally many ids, in
serpentine order of attention cost (the sum of squared piece lengths), so that the steps
cost about the same.

Packing is done inside each task over buffers of a bounded number of ids: nothing is
shuffled, a hot source or a long document changes nothing, and a lost task repeats alone.

Defined results: a null text is an empty one (its end id alone); null or repeated doc_ids
are packed row by row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .token_files import with_end
from .tokens import encoder, text_groups

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long, attention_cost long"
TIERS = (2048, 1024, 512, 256, 128)
BUFFER_IDS = 1 << 20
Piece = tuple[int, int, int]  # document, start, length


class _Pool:
    """Remainders by length, for the largest that is not longer than a gap."""

    def __init__(self):
        self.sizes: list[int] = []
        self.of: dict[int, list[Piece]] = defaultdict(list)

    def add(self, piece: Piece) -> None:
        size = piece[2]
        if not self.of[size]:
            bisect.insort(self.sizes, size)
        self.of[size].append(piece)

    def _take(self, at: int) -> Piece:
        size = self.sizes[at]
        piece = self.of[size].pop()
        if not self.of[size]:
            del self.sizes[at]
        return piece

    def fitting(self, gap: int) -> Piece | None:
        at = bisect.bisect_right(self.sizes, gap) - 1
        return self._take(at) if at >= 0 else None

    def above(self, gap: int) -> Piece | None:
        """The shortest that is longer than the gap."""
        at = bisect.bisect_right(self.sizes, gap)
        return self._take(at) if at < len(self.sizes) else None

    def total(self) -> int:
        return sum(s * len(self.of[s]) for s in self.sizes)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces (document, start, length), each a power of two long, and what is left.

    With ``last`` nothing is left; otherwise pieces of less than the shortest tier in all.
    """
    longest, shortest = tiers[0], tiers[-1]
    sequences: list[list[Piece]] = []
    pools = {t: _Pool() for t in tiers}

    def route(piece: Piece) -> None:
        pools[min(t for t in tiers if t >= piece[2])].add(piece)

    for doc, n in enumerate(lengths):
        full = n // longest
        sequences += [[(doc, k * longest, longest)] for k in range(full)]
        if n % longest:
            route((doc, full * longest, n % longest))
    for level, tier in enumerate(tiers[:-1]):
        shorter = tiers[level + 1 :]
        spare = sum(pools[t].total() for t in shorter)
        while (piece := pools[tier].fitting(tier)) is not None:
            gap = tier - piece[2]
            if gap > spare:  # no filler: a full window of the next tier, the rest goes down
                doc, start, n = piece
                sequences.append([(doc, start, tier // 2)])
                if n > tier // 2:
                    route((doc, start + tier // 2, n - tier // 2))
                    spare += n - tier // 2
                continue
            window = [piece]
            spare -= gap
            while gap:
                found = next((p for t in shorter if (p := pools[t].fitting(gap)) is not None), None)
                if found is None:
                    doc, start, n = next(p for t in reversed(shorter) if (p := pools[t].above(gap)) is not None)
                    found = (doc, start, gap)
                    route((doc, start + gap, n - gap))
                window.append(found)
                gap -= found[2]
            sequences.append(window)
    rest: list[Piece] = []
    held = 0
    pool = pools[shortest]
    while (piece := pool.fitting(shortest)) is not None:
        doc, start, n = piece
        while held + n >= shortest:
            sequences.append([*rest, (doc, start, shortest - held)])
            start, n, rest, held = start + shortest - held, n - (shortest - held), [], 0
        if n:
            rest.append((doc, start, n))
            held += n
    if not last:
        return sequences, rest
    while held:
        want = 1 << (held.bit_length() - 1)
        window, need = [], want
        while need:
            doc, start, n = rest.pop(0)
            window.append((doc, start, min(n, need)))
            if n > need:
                rest.insert(0, (doc, start + need, n - need))
            need -= min(n, need)
        sequences.append(window)
        held -= want
    return sequences, []


def step_groups(sequences: list[list[Piece]], step_ids: int, longest: int) -> tuple[list[int], list[int]]:
    """For each sequence its group and its attention cost.

    A group holds sequences of one length, ``step_ids`` ids in all; a length's last group may hold less.
    """
    costs = [sum(n * n for _, _, n in s) for s in sequences]
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sequences):
        by_length[sum(n for _, _, n in s)].append(i)
    groups, made = [0] * len(sequences), 0
    for length in sorted(by_length, reverse=True):
        members = sorted(by_length[length], key=lambda i: (-costs[i], i))
        count = -(-len(members) * length // step_ids)
        for k, i in enumerate(members):
            lap, at = divmod(k, count)
            groups[i] = made + (at if lap % 2 == 0 else count - 1 - at)
        made += count
    return groups, costs


def _pack_batches(path: str, end_id: int, tiers: tuple[int, ...], step_ids: int, buffer_ids: int):
    def run(batches):
        coder = encoder(path)
        base = TaskContext.get().partitionId() << 36
        made, steps = 0, 0
        docs: list[tuple[object, int, int, np.ndarray]] = []  # id, ids, start of what is held, those ids
        held = 0

        def flush(last: bool):
            nonlocal docs, held, made, steps
            sequences, rest = pack([len(d[3]) for d in docs], tiers, last)
            if not sequences:
                return None
            groups, costs = step_groups(sequences, step_ids, tiers[0])
            columns: list[list] = [[] for _ in range(10)]
            for k, sequence in enumerate(sequences):
                offset, total = 0, sum(n for _, _, n in sequence)
                for doc, start, n in sequence:
                    name, size, before, ids = docs[doc]
                    row = (name, before + start, n, zlib.crc32(ids[start : start + n].tobytes()), size, base + made + k, offset, total, base + steps + groups[k], costs[k])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += n
            made += len(sequences)
            steps += max(groups) + 1
            docs = [(docs[d][0], docs[d][1], docs[d][2] + s, docs[d][3][s : s + n]) for d, s, n in rest]
            held = sum(n for _, _, n in rest)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i, j in text_groups(texts):
                flat, offsets = with_end(coder.encode(texts[i:j]), end_id)
                flat = flat.astype("<u4", copy=False)
                for name, a, b in zip(names[i:j].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    docs.append((name, b - a, 0, flat[a:b]))
                    held += b - a
                if held >= buffer_ids and (out := flush(False)) is not None:
                    yield out
        if docs and (out := flush(True)) is not None:
            yield out

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_ids: int = 1 << 17,
    buffer_ids: int = BUFFER_IDS,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; sequence_id and step_group are unique over the whole table.

    tiers: powers of two from long to short, each half of the one before.
    step_ids: ids in one step group.
    """
    if any(a != 2 * b for a, b in zip(tiers, tiers[1:])) or tiers[-1] & (tiers[-1] - 1):
        raise ValueError("tiers must be powers of two, each half of the one before")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(trimmed(_pack_batches(tokenizer_path, end_id, tiers, step_ids, buffer_ids)), SCHEMA)
