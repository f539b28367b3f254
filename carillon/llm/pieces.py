"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

A batch's distinct words are laid end to end.  Their suffixes, as far as a piece can reach,
are sorted; every piece of the vocabulary finds the range of suffixes that begin with it by
binary search, and each suffix of a range is an edge of the lattice (position, length,
rank).  The edges, sorted by position, are relaxed by rank: of all neighbouring symbols
whose union is an edge the best-ranked (of equal ones the leftmost) become one symbol, until
no union is an edge.  That is the library's own merge order; a shortest-path relaxation
would give a unigram model's segmentation, which this vocabulary does not have.  Symbols
without a piece are spelt in byte pieces.

Defined results: a null text is an empty one and has no ids; texts are taken as they are
but for the space sign (the model normalises nothing else); repeated rows are handled one by
one; a text of any length is encoded whole, by its words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .tokens import WordEncoder, text_groups

SPACE = "▁"
#: Characters that are indexed at a time.
INDEXED = 400_000
#: Longer words are relaxed one by one with a heap.
LONG_WORD = 48
_NONE = np.int32(2**31 - 1)


class PieceEncoder(WordEncoder):
    """Encodes words through a suffix array of their batch; caches like WordEncoder."""

    by_rule = False
    kind = "piece"
    added = ""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.spelling = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.bytes = {int(self.spelling[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in ids if model.is_control(i)}
        self.unknown = model.unk_id()
        self.ids = {self.spelling[i]: i for i in plain}
        scores = np.array([model.get_score(i) for i in plain])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.rank = dict(zip((self.spelling[i] for i in plain), rank.tolist(), strict=True))
        self.merged = [p for p in self.rank if len(p) > 1]
        self.reach = max(map(len, self.merged), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.merged):
            raise ValueError("a piece of this model crosses the start of a word")
        self.start(keep_space=True)

    def _heads(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The first word has a space put before it too; an empty text has no word."""
        some = pc.not_equal(words, "")
        ids, own = self._of(words.filter(some), spaced=True)
        counts = np.zeros(len(words), np.int64)
        counts[some.to_numpy(zero_copy_only=False)] = own
        return ids, counts

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spelt = [w.replace(" ", SPACE) for w in words.to_pylist()]
        cut = [self._segments(w) if len(w) > INDEXED else [w] for w in spelt]
        parts = [p for c in cut for p in c]
        found: list[bytes] = []
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) < INDEXED):
                size += len(parts[j]) + 1
                j += 1
            found += self._relax(parts[i:j])
            i = j
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        first = np.cumsum([0, *map(len, cut)])[:-1]
        return np.frombuffer(b"".join(found), np.uint32), np.add.reduceat(sizes, first) if len(sizes) else sizes

    def _segments(self, word: str) -> list[str]:
        """A long word cut wherever no piece reaches across: nothing is merged over such a place.

        Edges are looked for in overlapping windows, so only a bit for each character is held.
        """
        crossed = np.zeros(len(word) + 1, bool)
        for start in range(0, len(word), INDEXED):
            a = max(0, start - self.reach)
            text = word[a : start + INDEXED + self.reach].replace("\0", "\ufffe")
            spots, lengths, _ = self._edges(text + "\0")
            over = np.zeros(len(text) + 2, np.int64)
            np.add.at(over, spots + 1, 1)
            np.add.at(over, spots + lengths, -1)
            crossed[a : a + len(text)] |= np.cumsum(over)[: len(text)] > 0
        places = [0, *(np.flatnonzero(~crossed[1 : len(word)]) + 1).tolist(), len(word)]
        out, begin = [], 0
        for here, after in zip(places[1:], [*places[2:], None]):  # as long as fits, so few
            if after is None or after - begin > INDEXED // 4:
                out.append(word[begin:here])
                begin = here
        return out

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (ascending), lengths and ranks of all pieces of two characters or more in ``text``."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, codes = np.unique(points, return_inverse=True)  # words end in \0, which gets code 0
        wide = len(alphabet) > 250
        unit = ">u2" if wide else np.uint8
        code_of = {chr(c): i for i, c in enumerate(alphabet.tolist())}
        padded = np.concatenate([codes, np.zeros(self.reach, codes.dtype)]).astype(unit)
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.reach)[: len(codes)])
        keys = keys.view(f"S{keys.shape[1] * keys.dtype.itemsize}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        pieces = [p for p in self.merged if all(c in code_of for c in p)]
        low = np.zeros((len(pieces), self.reach), unit)
        high = np.full((len(pieces), self.reach), np.iinfo(np.dtype(unit)).max, unit)
        for n, p in enumerate(pieces):
            low[n, : len(p)] = high[n, : len(p)] = [code_of[c] for c in p]
        as_keys = lambda a: a.view(keys.dtype).ravel()
        first = np.searchsorted(keys, as_keys(low), "left") if pieces else np.zeros(0, int)
        last = np.searchsorted(keys, as_keys(high), "right") if pieces else np.zeros(0, int)
        counts = last - first
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        spots = order[np.repeat(first - (ends - counts), counts) + np.arange(total)]
        lengths = np.repeat(np.array([len(p) for p in pieces], np.int64), counts)
        ranks = np.repeat(np.array([self.rank[p] for p in pieces], np.int32), counts)
        by_place = np.argsort(spots, kind="stable")
        return spots[by_place], lengths[by_place], ranks[by_place]

    def _relax(self, words: list[str]) -> list[bytes]:
        text = "\0".join(w.replace("\0", "\ufffe") for w in words) + "\0"
        spots, lengths, ranks = self._edges(text)
        lattice = np.full((len(text), self.reach + 1), _NONE)
        lattice[spots, lengths] = ranks
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        cuts: list[list[int]] = [[]] * len(words)
        for longest in (4, 8, 12, 16, 24, LONG_WORD):
            shortest = {4: 0, 8: 4, 12: 8, 16: 12, 24: 16, LONG_WORD: 24}[longest]
            rows = np.flatnonzero((sizes > shortest) & (sizes <= longest))
            if len(rows):
                for r, ends in zip(rows.tolist(), self._relax_rows(lattice, starts[rows], sizes[rows], longest), strict=True):
                    cuts[r] = ends
        for r in np.flatnonzero(sizes > LONG_WORD).tolist():
            cuts[r] = self._relax_long(lattice, int(starts[r]), int(sizes[r]))
        out = []
        for word, ends in zip(words, cuts, strict=True):
            ids, a = [], 0
            for b in ends:
                piece = word[a:b]
                one = self.ids.get(piece)
                if one is not None:
                    ids.append(one)
                elif self.bytes:
                    ids += [self.bytes[v] for v in piece.encode("utf-8")]
                else:
                    ids.append(self.unknown)
                a = b
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def _relax_rows(self, lattice: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> list[list[int]]:
        """All words at once, one merge of each word a round.  Column i: the symbol that begins at i, or none."""
        n = len(starts)
        column = np.arange(width)
        alive = column[None] < sizes[:, None]
        end = np.where(alive, column + 1, 0)  # where the symbol that begins here ends
        before = np.where(alive, column - 1, -1)  # where the symbol before this one begins

        def union(rows: np.ndarray, left: np.ndarray) -> np.ndarray:
            """Rank of the symbol at ``left`` joined with the next one."""
            middle = end[rows, left]
            inside = middle < sizes[rows]
            stop = np.where(inside, end[rows, np.minimum(middle, width - 1)], 0)
            span = stop - left
            fits = inside & (span > 0) & (span <= self.reach)
            return np.where(fits, lattice[np.where(fits, starts[rows] + left, 0), np.where(fits, span, 0)], _NONE)

        every = np.repeat(np.arange(n), width).reshape(n, width)
        best = np.where(alive, union(every.ravel(), np.tile(column, n)).reshape(n, width), _NONE)
        rows = np.arange(n)
        while len(rows):
            at = best[rows].argmin(1)
            go = best[rows, at] != _NONE
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            middle = end[rows, at]
            stop = end[rows, middle]
            end[rows, at] = stop
            alive[rows, middle] = False
            best[rows, middle] = _NONE
            after = stop < sizes[rows]
            before[rows[after], stop[after]] = at[after]
            best[rows, at] = union(rows, at)
            prior = before[rows, at]
            has = prior >= 0
            best[rows[has], prior[has]] = union(rows[has], prior[has])
        return [e[a].tolist() for e, a in zip(end, alive, strict=True)]

    def _relax_long(self, lattice: np.ndarray, start: int, size: int) -> list[int]:
        end = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        alive = [True] * size
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            middle = end[left]
            if middle < size and end[middle] - left <= self.reach:
                rank = int(lattice[start + left, end[middle] - left])
                if rank != _NONE:
                    heapq.heappush(heap, (rank, left, middle, end[middle]))

        for i in range(size):
            offer(i)
        while heap:
            _, left, middle, stop = heapq.heappop(heap)
            if not (alive[left] and end[left] == middle and middle < size and alive[middle] and end[middle] == stop):
                continue
            end[left] = stop
            alive[middle] = False
            if stop < size:
                before[stop] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [e for e, a in zip(end, alive, strict=True) if a]

    def decode(self, ids: list[int]) -> str:
        parts: list[bytes] = []
        for i in ids:
            if i in self.byte_of:
                parts.append(bytes([self.byte_of[i]]))
            elif i not in self.silent:
                parts.append(" ⁇ ".encode() if i == self.unknown else self.spelling[i].replace(SPACE, " ").encode())
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches):
        coder = piece_encoder(path)
        for batch in batches:
            for i, j in text_groups(batch.column(1), 4_000_000):
                ids = coder.encode(batch.column(1)[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(_encode(model_path)), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches):
        coder = piece_encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(ids: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of ``ids(doc_id, ids)``."""
    full = ids.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return full.mapInArrow(trimmed(_decode(model_path)), "doc_id long, text string")


def _digest(path: str):
    def run(batches):
        coder = piece_encoder(path)
        for batch in batches:
            for i, j in text_groups(batch.column(1), 4_000_000):
                texts = batch.column(1)[i:j]
                ids = coder.encode(texts)
                offsets = ids.offsets.to_numpy()
                flat = ids.values.to_numpy()
                rows = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
                same = [coder.decode(r.tolist()) == t for r, t in zip(rows, texts.to_pylist(), strict=True)]
                sums = [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding the ids gives the text again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(trimmed(_digest(model_path)), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
