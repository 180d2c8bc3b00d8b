import random

import numpy as np
import pytest

from quernel.llm import near_duplicates as nd
from quernel.llm.common import components, local_roots
from tests.llm import brute


def texts(seed: int) -> dict[int, str | None]:
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "One", 4: "one", 5: "a b", 6: "A\tB", 7: "b a", 8: "a b c", 9: "x" * 3}
    bases = [[r.choice(words) for _ in range(r.choice([20, 60, 200]))] for _ in range(6)]
    for k in range(10, 160):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = r.choice(words).upper()
        docs[k] = r.choice([" ", "\n", " \t "]).join(w)
    return docs


@pytest.mark.parametrize("block", [nd.BLOCK_SHINGLES, 400])
def test_components(spark, block):
    docs = texts(3)
    got = nd.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), block_shingles=block)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.near(docs)


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.op6_near_duplicates(spark, tiny).collect()}
    assert got == brute.near(docs)


def test_missed_tables_bound():
    """Sets of similarity 0.85 share a table key in practically every draw."""
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 340, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])), np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        same = nd.bands(a) == nd.bands(b)
        missed += not (same[: nd.TABLES].any() and same[nd.TABLES :].any())
    assert missed == 0


def test_shingle_sets_by_hash_equal_sets():
    docs = list(texts(4).values())
    assert [len(s) for s in nd.shingle_sets([t or "" for t in docs])] == [len(brute.shingles(t)) for t in docs]
    one, two = nd.shingle_sets(["A b  c d", "a B\nc D"])
    assert one.tolist() == two.tolist()


def test_odd_documents(spark, odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    from tests.llm.conftest import ROWS

    assert got == brute.near({i: t for i, t in ROWS if i is not None})
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    assert nd.near_duplicates(no_docs).count() == 0


def test_components_on_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    root = dict(zip(*map(np.ndarray.tolist, local_roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges])))))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(7), "graph").collect()}
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert got == {n: root.get(n, n) for n in linked}
