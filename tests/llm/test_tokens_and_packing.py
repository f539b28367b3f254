"""Tokenised outputs against whole-text encoding and exact round trips."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from carillon.llm import packing, pieces, token_files
from carillon.llm.registry import tokenizer_file
from carillon.llm.tokens import WordEncoder, text_groups

ODD = ["", " ", "  a", "a  b", "a\n b", "a \n b ", "it's a's., b,, <|endoftext|>", "hi <|endoftext|> there", "<|startoftext|>", "<|EndOfText|> x", "aİİ_ İ! İ. aİ", "\u0958! \u0958.", "rock'n'roll-x (see.\nThe \nx.\n\ny", "ſ! Ÿ. Ǆ, ÀÉ.\nß; ŉ.", "a.b c,d'e x-'s e.g.\nfoo's", "\n\n a\r\n  b\t c ", " lead", "trail ", "ΑΣ ΣΑΣ, Σ.", "́ a ́b", "日本語 テキスト 🙂", "x" * 5000, "a\x1c b", "². ²a, 12. y_ .a", " wide   space"]
FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.fixture(scope="module", params=FILES)
def path(request):
    return tokenizer_file(FILES[request.param])


library = lru_cache(Tokenizer.from_file)
own_encoder = lru_cache(WordEncoder)
piece_library = lru_cache(lambda path: SentencePieceProcessor(model_file=path))
own_pieces = lru_cache(pieces.PieceEncoder)


def whole(path, texts):
    """The library on the file as it is, on whole texts."""
    return [x.ids for x in library(path).encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(path):
    assert WordEncoder(path).kind != "other"
    assert WordEncoder(path).encode(pa.array(ODD)).to_pylist() == whole(path, ODD)
    assert WordEncoder(path).encode(pa.array(["", *ODD, "end"])[1:-1]).to_pylist() == whole(path, ODD)


def test_ten_thousand_random_texts(path):
    rng = np.random.RandomState(5)
    alphabet = [*"aabbeeiionrst    ..,,''-\n\n", *"İıŞĞÇÖÜéñ_1230()#/Σσςß", "\u0301", "\u0307", "<|endoftext|>", "<|startoftext|>", "\t", "  ", "日", "🙂", "\u0958", "'s", "'ll", "ABC", "Ω", "Ы", "\r\n", "\xa0"]
    texts = ["".join(alphabet[i] for i in rng.randint(0, len(alphabet), rng.randint(0, 30))) for _ in range(10_000)]
    coder = WordEncoder(path, cache_chars=20_000)
    got = [ids for i in range(0, len(texts), 2500) for ids in coder.encode(pa.array(texts[i : i + 2500])).to_pylist()]
    wanted = whole(path, texts)
    assert [t for t, a, b in zip(texts, got, wanted, strict=True) if a != b] == []


def test_unknown_kinds_of_file_are_used_on_whole_texts(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(tokenizer_file(FILES["byte"]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(f"{tmp_path}/other.json")
    coder = WordEncoder(f"{tmp_path}/other.json")
    assert coder.kind == "other" and coder.encode(pa.array(ODD)).to_pylist() == whole(f"{tmp_path}/other.json", ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ZKH.,'s10é\n\t _-̱̀"), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    for name in FILES.values():
        assert own_encoder(tokenizer_file(name)).encode(pa.array(texts)).to_pylist() == whole(tokenizer_file(name), texts)


def test_cache_turns_over(path):
    coder = WordEncoder(path, cache_chars=400)
    for i in range(8):
        texts = [f"word{'abcdefgh'[i]}s other{'xyz' * j}, again x{j}." for j in range(20)]
        assert coder.encode(pa.array(texts)).to_pylist() == whole(path, texts)
    assert coder.parts.held < 4000


def test_groups_cover_all_rows():
    a = pa.array(["a" * n for n in (5, 50, 1, 1, 1, 200, 3)])
    spans = list(text_groups(a, 10))
    assert [s for s, _ in spans] == [0] + [e for _, e in spans][:-1] and spans[-1][1] == 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_packing_covers_every_id_once_without_padding(lengths):
    sequences, rest = packing.pack(lengths)
    assert rest == []
    seen: dict[int, list] = {}
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert total <= 2048 and total & (total - 1) == 0
        for d, a, n in s:
            seen.setdefault(d, []).append((a, a + n))
    for d, n in enumerate(lengths):
        spans = sorted(seen[d])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    groups, _ = packing.step_groups(sequences, 1 << 13, 2048)
    held: dict[int, set] = {}
    for g, s in zip(groups, sequences, strict=True):
        held.setdefault(g, set()).add(sum(n for _, _, n in s))
    assert all(len(v) == 1 for v in held.values())


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


ROWS = [(3, "b b", "x", 1), (1, None, None, None), (2, "", None, 2), (3, "b b", "x", 1), (None, "null id", None, None), (9, "long " * 3000, None, None), (-5, "first.", None, None)]


def test_packed_pieces_hold_the_ids(spark):
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack_documents(docs(spark, ROWS), path).toPandas()
    ids = {i: np.array(whole(path, [t or ""])[0] + [1], "<u4") for i, t, *_ in ROWS}
    assert got.length.sum() == sum(len(ids[i]) for i, *_ in ROWS)
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[int(r.start) : int(r.start + r.length)].tobytes())
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
    assert packing.pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_read_back(spark, tmp_path, encoding):
    path = tokenizer_file("byte_bpe_50k.json")
    out = f"{tmp_path}/{encoding}"
    token_files.write_token_files(docs(spark, ROWS), path, out, encoding=encoding, page_rows=2)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    at = 0
    for r, (_, text, *_) in zip(got, ordered, strict=True):
        assert r.ids == whole(path, [text or ""])[0] + [0] and (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in token_files.token_digest(spark, out).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert token_files.read_token_files(spark, out, [9]).count() == 1


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(docs(spark, []), tokenizer_file("byte_bpe_50k.json"), f"{tmp_path}/none")
    assert token_files.token_digest(spark, f"{tmp_path}/none").count() == 0


PIECES = [t for t in ODD if "<|" not in t] + ["it's <s> a </s> <0x41> ▁▁a ▁b a▁b", "aaa " * 50 + "a" * 300, "        indented    code", "é" * 60, "€uro ﬁ ｆ"]


def test_long_words_are_cut_where_no_piece_reaches_across(monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 300)
    path = tokenizer_file("piece_bpe_32k.model")
    lib, own = SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    rng = np.random.RandomState(3)
    texts = ["".join("abcdeionth.,é日"[i] for i in rng.randint(0, 14, n)) for n in (299, 301, 900, 5000)] + ["a" * 2000, "ab" * 700 + "é" * 500]
    assert all(len(own._segments(t)) > 1 for t in texts[1:4])
    assert own.encode(pa.array(texts)).to_pylist() == lib.encode(texts)


def test_pieces_equal_the_library(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    lib, own = SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    assert own.encode(pa.array(PIECES)).to_pylist() == lib.encode(PIECES)
    for t in PIECES:
        ids = lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*PIECES, None])], "doc_id long, text string")
    coded = pieces.encode_pieces(rows, path)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(coded, path).collect()}
    assert back[len(PIECES)] == "" and all(back[i] == t for i, t in enumerate(PIECES) if "▁" not in t)


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("abcdeion th  .,'\né"), max_size=80))
def test_any_text_as_pieces(text):
    path = tokenizer_file("piece_bpe_32k.model")
    lib, own = piece_library(path), own_pieces(path)
    assert own.encode(pa.array([text])).to_pylist() == [lib.encode(text)]
    assert own.decode(lib.encode(text)) == text
