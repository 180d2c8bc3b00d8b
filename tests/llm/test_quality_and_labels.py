"""Operators 2, 4, 8 and 10."""

from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import language_id, quality_crf, quality_rules, toxicity
from quernel.llm.common import crc_part, held_out
from tests.conftest import DATA
from tests.llm import brute

SMALL = f"{DATA}/sf0.01"


def accuracy(rows, truth):
    hit = [truth[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in truth]
    return sum(hit) / len(hit)


@pytest.fixture(scope="module")
def truth():
    rows = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    return {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}


def test_held_out_parts(spark):
    got = spark.range(500).select("id", held_out("id", 4, 2).alias("h")).collect()
    assert all(r.h == (crc_part(r.id, 4) == 2) for r in got)


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = language_id.op2_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    hit = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(hit) / len(hit) > 0.97


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    learned = {"xx": np.array([97, 98], np.int64), "yy": np.array([99], np.int64)}
    got = {r.doc_id: r for r in language_id.identify(odd_docs, learned).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 9, 11))
    assert got[10].lang_pred == "xx"
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}
    assert language_id.identify(no_docs, learned).count() == 0
    assert language_id.profiles(no_docs, "lang", "text") == {}


def test_out_of_place_distance():
    assert language_id.ranked(np.array([5, 5, 5, 2, 2, 9, 7]), 3).tolist() == [5, 2, 7]
    assert sorted(language_id.gram_codes("A1a").tolist()) == sorted([97, 97, 32 << 21 | 97, 97 << 21 | 32, 32 << 21 | 97, 97 << 21 | 32, 32 << 42 | 97 << 21 | 32, 32 << 42 | 97 << 21 | 32])


def plain_grams(text):
    """Letter n-grams of 1 to 3, words padded by a blank, as (code points, count)."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " "
    grams = [c for c in line if c != " "] + [line[k : k + 2] for k in range(len(line) - 1)] + [line[k : k + 3] for k in range(len(line) - 2) if line[k + 1] != " "]
    return Counter(grams) if words else Counter()


def plain_code(gram):
    return sum(ord(c) << 21 * (len(gram) - 1 - k) for k, c in enumerate(gram))


def plain_ranks(counts, top):
    return sorted((plain_code(g) for g in counts), key=lambda c: (-by_code(counts)[c], c))[:top]


def by_code(counts, kept={}):
    if kept.get("of") is not counts:
        kept.update(of=counts, codes={plain_code(g): n for g, n in counts.items()})
    return kept["codes"]


def test_distances_equal_brute_force(spark, monkeypatch):
    """Profiles, out-of-place distance and choice, by definition; equal under 1 and 50 partitions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) between 1 and 3000").limit(120)
    rows = docs.collect()
    held = held_out("doc_id", 4, 2)
    learned = [language_id.profiles(language_id.training_rows(docs.repartition(n), "doc_id", "lang", held), "lang", "text") for n in (1, 50)]
    counts = {}
    for r in rows:
        if r.lang is not None and crc_part(r.doc_id, 4) != 2:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    want = {lang: plain_ranks(c, language_id.PROFILE) for lang, c in counts.items()}
    for got in learned:
        assert {k: v.tolist() for k, v in got.items()} == want
    found = {r.doc_id: r for r in language_id.identify(docs, learned[0]).collect()}
    for r in rows:
        own = plain_ranks(plain_grams(r.text), language_id.PROFILE)
        if not own:
            assert found[r.doc_id].lang_pred == "und"
            continue
        far = {}
        for lang in sorted(want):
            place = {c: k for k, c in enumerate(want[lang])}
            far[lang] = sum(abs(place[c] - k) if c in place else language_id.PROFILE for k, c in enumerate(own)) / (language_id.PROFILE * len(own))
        assert found[r.doc_id].lang_pred == min(far, key=far.get)
        assert np.isclose(found[r.doc_id].distance, min(far.values()))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.training_rows(docs, "doc_id", "lang", F.lit(False))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes = [3, 1, 5, 4]
    unary, link = rng.normal(size=(sum(sizes), 2)), rng.normal(size=(2, 2))
    p, links, z = quality_crf.Chains(sizes).marginals(unary, link)
    want_links, at = np.zeros((2, 2)), 0
    for n in sizes:
        paths = list(product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(unary[at + k, y] for k, y in enumerate(path)) + sum(link[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        weight /= weight.sum()
        for k in range(n):
            assert np.isclose(p[at + k, 1], sum(w for w, path in zip(weight, paths) if path[k]))
        for w, path in zip(weight, paths):
            for a, b in zip(path, path[1:]):
                want_links[a, b] += w
        at += n
    assert np.allclose(links, want_links) and len(z) == 4


def test_quality_query(spark, truth):
    rows = quality_crf.op4_quality_crf(spark, SMALL).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert accuracy(rows, truth[0]) > 0.93


GOOD_LINE = "A plain sentence of ordinary words stands here, and it ends well."
BAD_LINE = "$$$ ### @@ 1234 || %% ## && 99 ** $$"


@pytest.fixture(scope="module")
def line_model():
    """Documents of several lines with a label each; a third of a bad document's lines look good."""
    rng = np.random.default_rng(2)
    docs = []
    for k in range(300):
        y = int(k % 3 > 0)
        lines = [GOOD_LINE[: rng.integers(30, 66)] if y or rng.random() < 0.3 else BAD_LINE[: rng.integers(15, 36)] for _ in range(rng.integers(1, 9))]
        docs.append((quality_crf.line_figures("\n".join(lines))[0], y))
    return quality_crf.fit_crf(docs)


def test_lines_of_one_text_get_labels_of_their_own(line_model):
    text = "\n".join([GOOD_LINE] * 4 + [BAD_LINE] * 4 + [GOOD_LINE] * 3)
    good, share, _, _ = quality_crf.score_lines([text], line_model)
    inner = [0, 1, 2, 9, 10]  # a line beside a change may go with its neighbour
    assert (good[inner] > 0.5).all() and (good[4:8] < 0.5).all()
    assert np.isclose(share.sum(), 1) and np.allclose(share * sum(map(len, text.split("\n"))), [len(x) for x in text.split("\n")])


def test_score_is_the_mean_of_lines_by_length(line_model):
    texts = ["\n".join([GOOD_LINE] * 8 + [BAD_LINE] * 2), "\n".join([GOOD_LINE] * 2 + [BAD_LINE] * 8), "", "\n\n"]
    scores, n, bad = quality_crf.score_texts(texts, line_model)
    good, _, of, _ = quality_crf.score_lines(texts, line_model)
    assert scores[0] > 0.5 > scores[1] and n.tolist() == [10, 10, 1, 3] and 0 < bad[0] < 5 < bad[1]
    for k, text in enumerate(texts):
        sizes = np.array([len(x) for x in text.split("\n")], float)
        assert np.isclose(scores[k], np.average(good[of == k], weights=sizes if sizes.sum() else None))


def test_fit_obeys_its_constraints(line_model):
    bad, good = "\n".join([BAD_LINE] * 5), "\n".join([GOOD_LINE] * 5)
    s = quality_crf.score_texts([bad, good], line_model)[0]
    assert s[0] < 0.25 and s[1] > 0.75


def test_text_of_very_many_lines(line_model):
    s, n, _ = quality_crf.score_texts([(GOOD_LINE[:30] + "\n") * 200_000], line_model)
    assert n.tolist() == [200_001] and 0.5 < s[0] <= 1


def test_longest_texts_are_not_in_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, GOOD_LINE), (2, BAD_LINE), (3, GOOD_LINE * 50)], "doc_id long, text string")
    marks = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality_crf, "TRAIN_CHARS", 500)
    assert quality_crf.fit(docs, marks, F.lit(False)) is None
    assert {r.score for r in quality_crf.score(docs, None).collect()} == {0.5}


def test_quality_of_odd_documents(spark, odd_docs, no_docs, no_labels):
    none = quality_crf.fit(odd_docs, no_labels, F.lit(False))
    assert none is None and {r.score for r in quality_crf.score(odd_docs, none).collect()} == {0.5}
    marks = spark.createDataFrame([(5, 1), (9, 0), (7, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality_crf.fit(odd_docs, marks, F.lit(False))
    rows = quality_crf.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.score(no_docs, model).count() == 0
    assert quality_crf.keep_good(odd_docs, model, 0.0).columns == odd_docs.columns


def test_ftrl_follows_its_formulas():
    m = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    for at, y in [([0, 2], 1), ([1, 2], 0), ([0], 1), ([0, 1, 3], 0), ([2, 3], 1)] * 5:
        m.learn(np.array(at), y)
        at = [*at, 4]
        w = {k: 0.0 if abs(z[k]) <= (0.1 if k < 4 else 0) else -(z[k] - np.sign(z[k]) * (0.1 if k < 4 else 0)) / ((1 + np.sqrt(n[k])) / 0.5 + 0.2) for k in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for k in at:
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / 0.5 * w[k]
            n[k] += g * g
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_toxicity_query(spark, truth):
    rows = toxicity.op8_toxicity(spark, SMALL).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert accuracy(rows, truth[1]) > 0.88
    clean = [r for r in rows if r.held_out and truth[1].get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs, no_labels):
    none = toxicity.fit(odd_docs, no_labels, F.lit(False))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    marks = spark.createDataFrame([(5, 0), (7, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, toxicity.fit(odd_docs, marks, F.lit(False))).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, none).count() == 0


def test_word_table_is_emptied(monkeypatch):
    before = toxicity.slots("one two three two").tolist()
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 1)
    toxicity.slots("a b c d e f")
    assert toxicity.slots("one two three two").tolist() == before


def test_rules_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in quality_rules.op10_quality_rules(spark, tiny).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_figures(docs[r.doc_id])
        assert r.rules_failed.split(",") == (brute.repetition(docs[r.doc_id], quality_rules) or [""])
        assert r.kept == (not r.base_failed and not r.rules_failed)


def test_every_rule_rejects_some_text(spark):
    """Of the texts that pass the base rules, each kind of coverage rejects some, and nearly all good ones stay."""
    got = quality_rules.op10_quality_rules(spark, "/root/testdata/sf0.1").filter("not base_failed").select("doc_id", "kept", "rules_failed")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = got.collect()
    n = Counter(rule for r in rows for rule in r.rules_failed.split(",") if rule)
    assert {*(f"dup{k}" for k in quality_rules.DUPLICATED), "lines"} <= set(n) and {"top2", "top3", "top4"} & set(n)
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert sum(good) / len(good) > 0.99


def test_each_rule_alone():
    """A text made for each rule fails it; just below the limit it doesn't."""
    fresh = iter(range(10**6))
    new = lambda n: [f"w{next(fresh):05d}" for _ in range(n)]
    for n, limit in quality_rules.DUPLICATED.items():
        gram = new(n)
        for share, hit in ((limit + 0.03, True), (limit - 0.03, False)):
            words = gram + new(round(2 * n / share) - 2 * n) + gram
            assert (f"dup{n}" in quality_rules.measure(" ".join(words))[9]) == hit
    for n, limit in quality_rules.MOST_FREQUENT.items():
        gram = new(n)
        for share, hit in ((limit + 0.03, True), (limit - 0.03, False)):
            words, times = [], 12
            for _ in range(times):
                words += gram + new(round(n / share) - n)
            exact = n * times / len(words)
            assert (f"top{n}" in quality_rules.measure(" ".join(words))[9]) == (exact > limit)
            assert (exact > limit) == hit
    line = " ".join(new(3))
    for more, hit in ((10, True), (60, False)):
        assert ("lines" in quality_rules.measure("\n".join([line, line, " ".join(new(more))]))[9]) == hit
    assert quality_rules.measure("$$$$ #### " * 3 + " ".join(new(60)))[9] == []


def test_rules_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = sorted(tuple(r)[1:6] for r in quality_rules.quality_rules(odd_docs).collect())
    assert got == sorted(brute.base_figures(t)[:5] for _, t in odd_rows)
    assert quality_rules.quality_rules(no_docs).count() == 0
    assert quality_rules.keep_passing(odd_docs).columns == odd_docs.columns


def test_repetition_coverage():
    """Shares equal a direct count of the characters inside repeated windows."""
    text = " ".join(f"w{k % 37}" if k < 90 else f"v{k}" for k in range(200))
    words = text.split()
    most = 0.0
    for n in quality_rules.DUPLICATED:
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(n)}
        most = max(most, sum(len(words[k]) for k in hit) / sum(map(len, words)))
    got = quality_rules.measure(text)
    assert np.isclose(got[5], most)
    assert quality_rules.measure("one line of words here\n" * 40)[-1]
    assert not quality_rules.measure(" ".join(f"w{k}" for k in range(100)))[-1]
