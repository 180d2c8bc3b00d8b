import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import suffix_dedup as sd
from quernel.llm.suffixes import equal_prefixes, suffix_array
from tests.llm import brute


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70))
def test_suffix_array(values):
    t = np.array(values, np.int64)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: values[i:])


def test_suffix_array_of_large_values():
    t = np.random.default_rng(1).integers(0, 5_000_000, 3000)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_equal_prefixes():
    t = np.frombuffer(b"abcabcabd", np.uint8).astype(np.int64)
    order = suffix_array(t)
    order = order[order + 3 <= len(t)]
    groups = dict(zip(order.tolist(), equal_prefixes(t, order, 3).tolist()))
    assert groups[0] == groups[3] != groups[6]


def texts(seed: int) -> dict[int, str | None]:
    """Repeats of all lengths about the limit, at ends and inside, whole copies, periodic and long texts, many sides of one passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé ") for _ in range(r.randint(2, 9)))
    noise = lambda n: (" ".join(word() for _ in range(n)))[:n]
    shared = [noise(1200) for _ in range(3)]
    docs: dict[int, str | None] = {0: None, 1: "", 2: "x" * 399, 3: "x" * 400, 4: "y" * 401, 5: "ab" * 700, 6: "ab" * 700, 7: noise(900)}
    docs[8] = docs[7]
    for k in range(9, 60):
        p = r.choice(shared).encode()[: 1200]
        at, n = r.randint(0, 700), r.choice([380, 398, 399, 400, 401, 402, 430, 463, 464, 500, 700])
        part = p[at : at + n].decode("utf-8", "ignore")
        docs[k] = r.choice([noise(300) + part + noise(300), part + noise(200), noise(200) + part, part, noise(50) + part + noise(20) + part])
    return docs


@pytest.mark.parametrize("length", [400, 200])
@pytest.mark.parametrize("hot", [sd.HOT, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, seed, hot, length, monkeypatch):
    monkeypatch.setattr(sd.repeated_starts, "__defaults__", (length, hot))
    docs = texts(seed)
    got = sd.cut_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), length).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert found == brute.removed(docs, length)
    assert {r.doc_id: (r.n_passages, r.passage_bytes) for r in got} == brute.passages(docs, sd.PASSAGE, sd.PASSAGE_WORDS)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        gone = b"".join(raw[a:b] for a, b in zip(r.spans[::2], r.spans[1::2]))
        assert len(gone) == r.n_removed


def test_drop_repeats_by_words(spark):
    docs = texts(3)
    got = {r.doc_id: r.text for r in sd.drop_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 200, 51).collect()}
    spans = brute.spans(docs, 200)
    for i, t in docs.items():
        raw = (t or "").encode()
        gone = [(a, b) for a, b in spans[i] if len(brute.WORD.findall(raw[a:b].decode("utf-8", "replace"))) >= 51]
        kept, at = b"", 0
        for a, b in gone:
            kept, at = kept + raw[at:a], b
        assert got[i] == (t if t is None else (kept + raw[at:]).decode("utf-8", "ignore"))


def test_short_strings_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        sd.repeated_starts(no_docs, 100)


def test_rows_without_id_take_part(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(None, text), (None, text[100:800]), (4, "z" * 50 + text[200:700])]
    got = sorted((x.n_bytes, x.n_removed) for x in sd.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(550, 500), (700, 700), (900, 700)]


def test_a_text_above_16_mib_meets_short_ones():
    """One string has one anchor, whatever the size of the text it stands in."""
    r = np.random.default_rng(4)
    part = r.integers(0, 256, 700, dtype=np.uint8)
    long = r.integers(0, 256, (1 << 24) + 5000, dtype=np.uint8)
    at = (1 << 24) + 1234
    long[at : at + 700] = part

    def anchors(data, low, high):
        start, kind = sd.ranges(data)
        inside = (start >= low) & (start + sd.LENGTH + sd.SIDE <= high)
        return {(int(s) - low, int(k)) for s, k in zip(start[inside], kind[inside])}

    alone = anchors(part, 0, 700)
    assert alone and alone == anchors(long, at, at + 700)


def test_hot_core_equals_brute(spark):
    """One passage in many documents, each with its own surroundings: more sides than are gathered."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(430)
    docs = {k: noise(80) + passage + noise(80) for k in range(60)}
    rows = sd.repeated_starts(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), hot=10)
    starts: dict[int, set] = {}
    for x in rows.collect():
        starts.setdefault(x.doc_id, set()).update(s for s in range(max(0, x["first"]), x["last"] + 1) if s + 400 <= 590)
    seen = Counter(t[s : s + 400] for t in docs.values() for s in range(len(t) - 399))
    assert starts == {k: {s for s in range(len(t) - 399) if seen[t[s : s + 400]] > 1} for k, t in docs.items()}
    assert all(set(range(80, 111)) <= s for s in starts.values())


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op5_suffix_dedup(spark, tiny).collect()}
    assert got == brute.removed(docs)


def test_drop_repeats_carries_columns(spark, odd_docs):
    out = sd.drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == odd_docs.count()
    assert rows[0].text is None and rows[7].text == "" and rows[3].text == "word" and rows[3].component_id == 7
