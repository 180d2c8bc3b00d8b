"""Operators 1, 3 and 9 against the tokenizer libraries."""

import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm import packing, pieces, token_counts

STRINGS = ["", "a", " ", "Hello  world\n\n x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|startoftext|>x", "it's WE'LL don't", "x" * 3000, "ﬁ ﬀ ² ½ ٣", "Σίσυφος ΣΑΣ İ", "é é", "  \x1c\x85", "日本語 😀👍🏽", "  \t\n ", "▁▁ a▁", "\x00�", " " * 100 + "z", "straße STRASSE", "a_b-c__d", "1234.5678", "x;\r\n\r a\r", "\t\ta\n ▁b"]
TEXT = st.text(st.one_of(st.sampled_from("abehinorst ABE'\n,.19<|>_é"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def counter():
    path = token_counts.vocabulary_path()
    return token_counts.Counter(path, token_counts.prove_whole(path)), Tokenizer.from_file(path)


@pytest.mark.parametrize("text", STRINGS)
def test_count(counter, text):
    assert counter[0].count(text)[0] == len(counter[1].encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_count_of_any_text(counter, text):
    assert counter[0].count(text)[0] == len(counter[1].encode(text, add_special_tokens=False).ids)


def test_proved_strings_are_single_tokens(counter):
    own, library = counter
    sample = sorted(own.whole)[::97]
    assert len(own.whole) > 45_000
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sample)


def test_count_column(spark, odd_docs, odd_rows, no_docs, counter):
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_docs).collect())
    n = [(len((t or "").encode()), len(counter[1].encode(t or "", add_special_tokens=False).ids)) for _, t in odd_rows]
    assert got == sorted((a, b, b > 1024) for a, b in n)
    assert token_counts.token_counts(no_docs).count() == 0


@pytest.fixture(scope="module")
def piece_model():
    import sentencepiece

    path = public.path(pieces.VOCABULARY)
    return pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def split(coded):
    n, flat = coded
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_pieces(piece_model):
    own, library = piece_model
    coded = own.encode_all(STRINGS)
    assert split(coded) == library.encode(STRINGS)
    assert own.decode_all(*coded) == library.decode(library.encode(STRINGS))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_pieces_of_any_text(piece_model, texts):
    assert split(piece_model[0].encode_all(texts)) == piece_model[1].encode(texts)


def test_pieces_after_the_table_was_emptied(piece_model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    texts = ["one two three four", "two three five six", "one one"]
    for _ in range(2):
        assert split(piece_model[0].encode_all(texts)) == piece_model[1].encode(texts)


def test_piece_columns(spark, odd_docs, odd_rows, no_docs, tiny, piece_model):
    coded = pieces.encode(odd_docs, ["doc_id", "score"])
    got = sorted(tuple(r.ids) for r in coded.collect())
    assert got == sorted(tuple(piece_model[1].encode(t or "")) for _, t in odd_rows)
    back = sorted(r.decoded for r in pieces.decode(coded, ["doc_id"]).collect())
    assert back == sorted(t or "" for _, t in odd_rows)
    assert pieces.encode(no_docs, ["doc_id"]).count() == 0
    assert all(r.round_trip for r in pieces.op3_sentencepiece(spark, tiny).collect())


def test_word_ids():
    path = token_counts.vocabulary_path(packing.VOCABULARY)
    own, library = packing.WordIds(path), Tokenizer.from_file(path)
    for text in STRINGS:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def any_text(text):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids

    any_text()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows(sizes):
    found = packing.windows(np.array(sizes), 100)
    assert sorted(k for w in found for k in w) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in w) <= 100 for w in found)


def test_differencing_is_balanced():
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    sums = [sizes[w].sum() for w in packing.difference(sizes, 50)]
    assert len(sums) == 50 and max(sums) - min(sums) <= 20


def check_packing(rows, ids, capacity):
    at, windows = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= capacity
    return len(windows)


def test_pack_columns(spark, odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(token_counts.vocabulary_path(packing.VOCABULARY))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in odd_rows}
    check_packing(packing.with_digest(packing.pack(odd_docs, capacity=64, block=4)).collect(), ids, 64)
    assert packing.pack(no_docs).count() == 0


def test_pack_query(spark, tiny):
    library = Tokenizer.from_file(token_counts.vocabulary_path(packing.VOCABULARY))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs}
    n = check_packing(packing.op9_packing(spark, tiny).collect(), ids, 4096)
    assert n <= 1.1 * sum(map(len, ids.values())) / 4096 + 1
