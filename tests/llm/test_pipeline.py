"""Each stage of the pipeline on its own input, against plain versions."""

import re

import pytest

import corpus_pipeline as cp
from quernel.llm import quality_crf, quality_rules, suffix_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """(name, input, output) of every stage, written and read again in between."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = {}
    for k, (name, f) in enumerate(cp.STAGES):
        path = str(at / str(k))
        f(spark, docs, tiny).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes, name


def test_classifier(spark, tiny, stages):
    before, after = stages["quality classifier"]
    scored = {r.doc_id: r.predicted for r in quality_crf.op4_quality_crf(spark, tiny).collect()}
    assert set(texts(after)) == {i for i in texts(before) if scored[i]}


def test_rules(stages):
    before, after = stages["quality rules"]
    assert set(texts(after)) == {i for i, t in texts(before).items() if quality_rules.verdict(t) and not brute.base_figures(t)[-1]}


def test_near(stages):
    before, after = stages["near duplicates"]
    assert set(texts(after)) == {i for i, r in brute.near(texts(before)).items() if r[2]}


def test_suffixes(stages):
    before, after = stages["suffix dedup"]
    docs, got = texts(before), texts(after)
    assert set(got) == set(docs)
    cut = 0
    for i, found in brute.spans(docs, suffix_dedup.PASSAGE).items():
        raw = (docs[i] or "").encode()
        gone = {k for a, b in found if len(re.findall(rb"[^\x20\x09-\x0D]+", raw[a:b])) >= 51 for k in range(a, b)}
        cut += bool(gone)
        assert got[i] == bytes(c for k, c in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
    assert cut
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == set(texts(before))


def test_run(spark, tiny, stages):
    assert sorted(map(tuple, cp.run(spark, tiny).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, stages["packing"][1].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_odd_documents(spark, odd_docs, no_docs, tiny):
    for docs in (odd_docs, no_docs):
        for name, f in cp.STAGES:
            out = f(spark, docs, tiny)
            assert name == "packing" or out.columns == docs.columns
            out.count()
    kept = cp.near_dedup(spark, odd_docs, tiny).collect()
    assert sum(r.doc_id is None for r in kept) == 1
    assert {r.doc_id for r in kept} == {None, *range(12)} - {6}
