"""Exact whole-text encoding with the ``tokenizers`` library, by parts through a cache.

Neither supported pre-tokenizer lets a token cross from a non-space character to a
following space, so a text cut there encodes to the same ids as the whole text.  Most words
are runs of plain letters and ASCII signs, perhaps with one line end: their pre-tokens are
known by rule, so only the distinct ones that no cache holds go through the file's own merges.
Every other word goes through the whole tokenizer, as does every text that holds one of its
added tokens.  Splitting, looking up and putting together are Arrow and numpy kernels over
all words of a group at once; the cache holds two flat arrays and no object for each word.

A file of another design (other normalizer or pre-tokenizer) is used on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker a core

#: Characters of cached parts at which a worker's cache drops those of no recent use.
CACHE_CHARS = 6_000_000
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: Letters that composition leaves alone and that have one lower-case letter each, and ASCII signs.
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{400}-\x{481}"
_SIGNS = r"!-/:-@\[-`{-~"
_WORD = rf"^(?P<a>[{_LETTERS}]*)(?P<b>[{_SIGNS}]*)(?P<n>\n?)(?P<c>[{_LETTERS}]*)(?P<d>[{_SIGNS}]*)$"
_NOUGHT = re.compile("0").search
#: White space other than a word's own leading space, or no word at all.
_WHITE = re.compile(r"(?<!^)\s|^[^\S ]|^ ?$").search
#: White space before a space, or a space in front: such texts are cut by the slower rule.
_RUN = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ "

#: Fixed by the two supported kinds of file: normalizer, pre-tokenizer.
_BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_FOLDING_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ],
    },
)


def _kind(path: str) -> str:
    """"byte", "folding" or "other"."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k != "trim_offsets"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    shape = (plain(held.get("normalizer")), plain(held.get("pre_tokenizer")))
    return "byte" if shape == _BYTE_KIND else "folding" if shape == _FOLDING_KIND else "other"


def _byte_letters() -> tuple[np.ndarray, np.ndarray]:
    """For every byte the UTF-8 form of its letter in byte-level vocabularies: printable bytes stand for
    themselves as code points, the others for 256 onwards.  (256, 2) bytes and their number."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    point = dict(zip(printable, printable))
    for b in range(256):
        point.setdefault(b, 256 + len(point) - len(printable))
    forms = [chr(point[b]).encode() for b in range(256)]
    return np.array([list(f.ljust(2, b"\0")) for f in forms], np.uint8), np.array([len(f) for f in forms])


_FORM, _FORM_SIZE = _byte_letters()
_SPACE = _FORM[32].tobytes().decode()
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[9:14] = 32


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string array without nulls."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … for counts[0] numbers, then the next."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat((starts - (ends - counts)).astype(np.int64), counts)
    where += np.arange(total)
    return where


def _spaced(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" "), words, "")


class _Cache:
    """Strings and their ids, as one string array and two flat arrays."""

    def __init__(self, chars: int):
        self.chars = chars
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = np.zeros(0, bool)
        self.held = 0

    def find(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct parts, -1 for those that are not held."""
        if not len(self.keys):
            return np.full(len(parts), -1)
        at = pc.fill_null(pc.index_in(parts, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = True
        return at

    def make_room(self) -> None:
        """Beyond the bound, parts that nothing has asked for since the last time go; all, if that leaves half."""
        if self.held <= self.chars:
            return
        keep = np.flatnonzero(self.used)
        keys = self.keys.take(pa.array(keep))
        held = int(pc.sum(pc.binary_length(keys)).as_py() or 0)
        if held > self.chars // 2:
            self.clear()
            return
        counts = np.diff(self.bounds)[keep]
        self.ids = self.ids[_positions(self.bounds[keep], counts)]
        self.keys, self.held = keys, held
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.used = np.zeros(len(keep), bool)

    def add(self, parts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, parts])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.ones(len(parts), bool)])
        self.held += int(pc.sum(pc.binary_length(parts)).as_py() or 0)


class WordEncoder:
    """``encode(texts)`` gives each text's ids as a list array of unsigned 32-bit integers.

    keep_space: the tokenizer marks a word's leading space (byte-level BPE), so a word is
    encoded with it; otherwise the tokenizer drops white space and lower-cases.
    """

    #: Whether words have known pre-tokens.
    by_rule = True

    def __init__(self, path: str, cache_chars: int | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.mark_id: int | None = None
        edge = (lambda t: t.endswith("</w>")) if self.kind == "folding" else (lambda t: t.startswith(_SPACE))
        self.edge = np.array([edge(self.merges.id_to_token(i) or "") for i in range(self.merges.get_vocab_size())])
        self.start(self.kind != "folding", cache_chars)

    def start(self, keep_space: bool, cache_chars: int | None = None) -> None:
        self.keep_space = keep_space
        # a bound of its own for words that follow no rule, so that neither pushes the other out
        self.parts = _Cache(cache_chars or CACHE_CHARS)
        self.words = _Cache(cache_chars or CACHE_CHARS)

    # ---- the library ----

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of parts that are one pre-token each, by the file's merges.

        Many go through the library as one text.  Ids say where a part begins or ends: the last one
        ends a word in the folding kind; in the byte kind the first one holds the space in front, and
        a part without one gets a space of its own before it.
        """
        offsets, data = _buffers(parts)
        sizes = _FORM_SIZE[data]
        forms = _FORM[data].ravel()[np.tile(np.arange(2), len(data)) < np.repeat(sizes, 2)]
        letters = _strings(np.concatenate([[0], np.cumsum(sizes)])[offsets], forms)
        bare = np.zeros(len(parts), bool)
        if self.keep_space:
            bare = ~pc.starts_with(letters, _SPACE).to_numpy(zero_copy_only=False)
            letters = pc.if_else(pa.array(bare), pc.binary_join_element_wise(_SPACE, letters, " "), letters)
        found = []
        for i in range(0, len(letters), 20_000):  # the library's results are large
            some = letters[i : i + 20_000]
            cuts = [*range(0, len(some), 50), len(some)]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), some), " ")
            found += [np.array(x.ids, np.uint32) for x in self.merges.encode_batch_fast(joined.to_pylist(), add_special_tokens=False)]
        ids = np.concatenate(found)
        edges = np.flatnonzero(self.edge[ids])
        if not self.keep_space:
            return ids, np.diff(edges, prepend=-1)
        counts = np.diff(edges, append=len(ids))
        return np.delete(ids, edges[bare]), counts - bare

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many words go through the library as one text, with a mark between them that has one id of its own."""
        texts = words.to_pylist()
        mark, barred = ("\n", _WHITE) if self.keep_space else (" 0 ", _NOUGHT)
        plain = [i for i, w in enumerate(texts) if barred(w) is None]
        if self.mark_id is None:
            (self.mark_id,) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            groups = [part[j : j + 100] for j in range(0, len(part), 100)]
            for group, x in zip(groups, self.tokenizer.encode_batch_fast([mark.join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, np.uint32)
                ends = np.flatnonzero(ids == self.mark_id)
                for k, a, b in zip(group, [0, *(ends + 1)], [*ends, len(ids)], strict=True):
                    found[k] = ids[a:b]
        inside = set(plain)
        odd = [k for k in range(len(texts)) if k not in inside]
        for i in range(0, len(odd), 4000):
            part = odd[i : i + 4000]
            for k, x in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = np.array(x.ids, np.uint32)
        counts = np.array([len(x) for x in found], int)
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), counts

    # ---- words ----

    def _known(self, strings: pa.Array, cache: _Cache, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of every string among the distinct ones, starts and counts of those in the cache's ids)."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary
        cache.make_room()
        at = cache.find(distinct)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            at[missing] = len(cache.keys) + np.arange(len(missing))
            cache.add(fresh, *encode(fresh))
        return coded.indices.to_numpy(zero_copy_only=False), cache.bounds[:-1][at], np.diff(cache.bounds)[at]

    def _of(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; ``spaced``: a space is in front of each."""
        n = len(words)
        rule, pieces = np.zeros(n, bool), []
        if self.by_rule and n:
            cut = pc.extract_regex(words, pattern=_WORD)
            fields = [pc.struct_field(cut, k) for k in "abncd"]
            sizes = [pc.fill_null(pc.binary_length(f), 0).to_numpy(zero_copy_only=False) for f in fields]
            a, b, line, c, d = (s > 0 for s in sizes)
            # behind signs letters begin a pre-token of their own, but for an apostrophe's
            apart = ~pc.fill_null(pc.match_substring(fields[1], "'"), True).to_numpy(zero_copy_only=False)
            rule = cut.is_valid().to_numpy(zero_copy_only=False) & (a | b) & np.where(line, c, ~c | (b & apart))
        by, odd = np.flatnonzero(rule), np.flatnonzero(~rule)
        counts = np.zeros((n, 5), np.int64)
        starts = np.zeros((n, 5), np.int64)
        if len(by):
            take = pa.array(by)
            parts = [pc.fill_null(f.take(take), "") for f in fields]
            first = pc.if_else(pa.array(a[by]), parts[0], parts[1])
            second = pc.if_else(pa.array(a[by]), parts[1], pa.scalar(""))
            letters = [first, second, parts[2], parts[3], parts[4]]
            if not self.keep_space:
                letters = [pc.utf8_lower(p) for p in letters]
            elif spaced:
                letters[0] = _spaced(letters[0])
            full = [pc.greater(pc.binary_length(p), 0).to_numpy(zero_copy_only=False) for p in letters]
            strings = pa.concat_arrays([p.filter(pa.array(f)) for p, f in zip(letters, full, strict=True)])
            where, begin, count = self._known(strings, self.parts, self._encode_parts)
            done = 0
            for k, f in enumerate(full):
                own = where[done : done + int(f.sum())]
                done += len(own)
                starts[by[f], k], counts[by[f], k] = begin[own], count[own]
        pieces.append(self.parts.ids)
        if len(odd):
            strings = words.take(pa.array(odd))
            where, begin, count = self._known(_spaced(strings) if spaced and self.keep_space else strings, self.words, self._encode_words)
            starts[odd, 0], counts[odd, 0] = len(pieces[0]) + begin[where], count[where]
        pieces.append(self.words.ids)
        store = np.concatenate(pieces) if len(odd) else pieces[0]
        return store[_positions(starts.ravel(), counts.ravel())], counts.sum(1)

    def _whole(self, texts: pa.Array) -> pa.ListArray:
        coded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return pa.array([x.ids for x in coded], pa.list_(pa.uint32()))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """texts: strings without nulls."""
        texts = texts.cast(pa.string())
        if not len(texts):
            return pa.array([], pa.list_(pa.uint32()))
        if self.kind == "other":
            return self._whole(texts)
        marked = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else pa.array(np.zeros(len(texts), bool))
        if not pc.any(marked).as_py():
            return self._by_words(texts)
        plain = pc.invert(marked)
        order = np.concatenate([pc.indices_nonzero(plain).to_numpy(), pc.indices_nonzero(marked).to_numpy()])
        rest = texts.filter(plain)
        made = [self._by_words(rest)] if len(rest) else []
        return pa.concat_arrays([*made, self._whole(texts.filter(marked))]).take(pa.array(np.argsort(order)))

    def _by_words(self, texts: pa.Array) -> pa.ListArray:
        if not self.keep_space:
            offsets, data = _buffers(texts)
            return self._gather(pc.split_pattern(_strings(offsets, _TO_SPACE[data]), " "))
        runs = pc.match_substring_regex(texts, _RUN)
        if not pc.any(runs).as_py():
            return self._gather(pc.split_pattern(texts, " "))
        even = pc.invert(runs)
        order = np.concatenate([pc.indices_nonzero(even).to_numpy(), pc.indices_nonzero(runs).to_numpy()])
        cut = [_BEFORE_SPACE.split(t) for t in texts.filter(runs).to_pylist()]
        words = pa.concat_arrays([
            pc.split_pattern(texts.filter(even), " "),
            pa.array([[p[i > 0 :] for i, p in enumerate(parts)] for parts in cut], pa.list_(pa.string())),
        ])
        return self._gather(words).take(pa.array(np.argsort(order)))

    def _heads(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of first words, which have no space in front."""
        return self._of(words, spaced=False)

    def _gather(self, words: pa.ListArray) -> pa.ListArray:
        coded = words.flatten().dictionary_encode()
        starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        store, sizes = self._of(coded.dictionary, spaced=True)
        if self.keep_space:
            first = starts[:-1]
            heads = pc.take(coded.dictionary, pa.array(at[first])).dictionary_encode()
            own, own_sizes = self._heads(heads.dictionary)
            at[first] = len(sizes) + heads.indices.to_numpy(zero_copy_only=False)
            store, sizes = np.concatenate([store, own]), np.concatenate([sizes, own_sizes])
        begin = np.cumsum(sizes) - sizes
        counts = sizes[at]
        per_word = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(per_word[starts], pa.int32()), pa.array(store[_positions(begin[at], counts)]))


@lru_cache(maxsize=4)
def encoder(path: str, cache_chars: int | None = None) -> WordEncoder:
    """One encoder for each file and Python worker."""
    return WordEncoder(path, cache_chars=cache_chars)


def text_groups(texts: pa.Array, chars: int = 8_000_000):
    """Yield (start, stop) of runs of rows that hold about so many bytes."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + chars, "right")))
        yield start, stop
        start = stop
