"""Index, search, files, command line and front end on small corpora."""

import json

import pytest
from pyspark.sql import functions as F

from quernel import api, catalog, cli
from quernel.operators import index as ix
from quernel.operators import ingest, pages, search, stats
from quernel.sources import corpus as co
from quernel.sources import index_store
from quernel.streaming import ingest as stream

TWO = [("Test Article", "Hello world test", "http://test/1", "test", "Test"), ("Another Article", "Another test hello", "http://test/2", "test", None)]


@pytest.fixture
def corpus_file(tmp_path):
    lines = [json.dumps({"title": t, "text": x, "url": u, "source": s, "category": c}, ensure_ascii=False) for t, x, u, s, c in TWO]
    path = tmp_path / "corpus.json"
    path.write_text("\n".join([lines[0], "", "no object", json.dumps({"title": "", "text": None}), lines[1]]) + "\n", encoding="utf-8")
    return str(path)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_build_search_save_load(spark, corpus_file, tmp_path):
    built = ix.build(co.read_ndjson(spark, corpus_file))
    index_store.save(built, str(tmp_path / "ix"))
    for index in (built, index_store.load(spark, str(tmp_path / "ix"))):
        assert index.docs.count() == 2
        assert ids(search.term_lookup(index, "hello")) == [0, 1]
        assert ids(search.term_lookup(index, "World!")) == [0]
        assert ids(search.term_lookup(index, "19")) == []
        assert ids(search.search(index, "!world")) == [1]
        assert ids(search.search(index, "")) == []
    lists = {r.term: (r.doc_ids, r.df) for r in ix.posting_lists(built).collect()}
    assert lists["hello"] == ([0, 1], 2) and lists["world"] == ([0], 1)


def test_load_refuses_other_formats(spark, tmp_path):
    spark.createDataFrame([("other", 1, 0, 0)], "format string, version int, n_terms long, n_docs long").write.json(str(tmp_path / "meta"))
    with pytest.raises(ValueError):
        index_store.load(spark, str(tmp_path))


def test_stored_index_filters_by_term(spark, corpus_file, tmp_path):
    index_store.save(ix.build(co.read_ndjson(spark, corpus_file)), str(tmp_path / "ix"))
    plan = index_store.load(spark, str(tmp_path / "ix")).lookup(["hello"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [hello])]" in plan or "EqualTo(term,hello)" in plan


def test_posting_arrays(spark):
    df = spark.createDataFrame([([1, 3, 5, 7, 9], [3, 5, 11]), ([1, 2, 3], [4, 5, 6]), ([], [1, 2, 3]), ([1, 3, 5], [2, 3, 6])], "a array<long>, b array<long>")
    rows = df.select(ix.intersect(F.col("a"), F.col("b")).alias("i"), ix.union(F.col("a"), F.col("b")).alias("u"), ix.negate(F.col("a"), F.lit(4)).alias("n"), ix.negate(F.col("a"), F.lit(0)).alias("z")).collect()
    assert [r.i for r in rows] == [[3, 5], [], [], [3]]
    assert [r.u for r in rows] == [[1, 3, 5, 7, 9, 11], [1, 2, 3, 4, 5, 6], [1, 2, 3], [1, 2, 3, 5, 6]]
    assert [r.n for r in rows] == [[0, 2], [0], [0, 1, 2, 3], [0, 2]]
    assert all(r.z == [] for r in rows)


def test_negation_over_gaps_and_empty_texts(spark, tmp_path):
    rows = [(3, "que"), (5, "the end"), (8, ""), (9, None), (40, "und")]
    spark.createDataFrame([(i, x, "en", "s") for i, x in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_ids for r in catalog.queries()["posting_negate_array"](spark, str(tmp_path)).collect()] == ["3,40"]


def test_limit_and_pages(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit("word").alias("text"))
    index = ix.build(docs)
    hits = search.search(index, "word")
    assert ids(search.first(index, hits, 3)) == [0, 1, 2]
    assert ids(search.page(index, hits, 3, 50)) == list(range(100, 120))
    assert search.overflow(hits, 50).first() == (120, 50, 70)
    for wrong in (lambda: search.first(index, hits, -1), lambda: search.page(index, hits, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_one_shuffle_per_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.lit("").alias("title"), "text")
    plan = search.search(ix.build(docs), "the && (und || que) && !les")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan


def letters(k):
    out = ""
    for _ in range(4):
        out, k = out + "bcdfghjklmnpqrstvw"[k % 18], k // 18
    return out


def test_queries_of_ten_thousand_words(spark, tmp_path):
    words = [letters(k) for k in range(10_000)]
    docs = spark.createDataFrame([(0, "", " ".join(words)), (1, "", " ".join(words[:-1])), (2, "", words[7]), (3, "", "zzzz")], "doc_id long, title string, text string")
    index_store.save(ix.build(docs), str(tmp_path / "ix"))
    index = index_store.load(spark, str(tmp_path / "ix"))
    for join, want in ((" ", [0]), (" && ", [0]), (" || ", [0, 1, 2]), (" — ", [0])):
        assert ids(search.search(index, join.join(words), 1)) == want
    assert ids(search.search(index, "!(" + " || ".join(words) + ")", 1)) == [3]
    assert ids(search.search(index, " ".join(words[:-1]) + " && !" + words[-1], 1)) == [1]
    assert sorted(tuple(r) for r in search.batch(index, {"a": " ".join(words), "b": words[7]}, 1).collect()) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_posting_blocks(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 40, 3).select(F.col("id").alias("doc_id"), F.lit("").alias("title"), F.lit("same words").alias("text"))
    monkeypatch.setattr(ix, "BLOCK", 8)
    built = ix.build(docs)
    blocks = ix.posting_blocks(built).filter("term = 'word'").orderBy("block").collect()
    assert [r.block for r in blocks] == [0, 1, 2, 3, 4] and max(len(r.doc_ids) for r in blocks) <= 8
    index_store.save(built, str(tmp_path / "ix"))
    stored = index_store.load(spark, str(tmp_path / "ix"))
    for index in (built, stored):
        lists = {r.term: (r.doc_ids, r.df) for r in ix.posting_lists(index).collect()}
        assert lists["word"] == (list(range(0, 40, 3)), 14)
        assert {r.term: r.df for r in ix.document_frequency(index).collect()} == {t: 14 for t in lists}
    assert index_store.describe(spark, str(tmp_path / "ix")).first()[2:] == (2, 14)


def test_frequencies_shuffle_counts_only(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.lit("").alias("title"), "text")
    plan = ix.document_frequency(ix.build(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count(1)" in plan


def test_zipf_fit_in_pieces(spark, monkeypatch):
    freq = spark.createDataFrame([(f"t{k}", 1 + 90 // (k + 1)) for k in range(95)], "term string, freq long")
    whole = stats.zipf_fit(freq).first()
    monkeypatch.setattr(stats, "PIECE", 7)
    parts = stats.zipf_fit(freq).first()
    assert whole.n == parts.n == 95
    assert all(abs(whole[k] - parts[k]) < 1e-9 for k in ("alpha", "c", "r2"))


def test_rows_without_url(spark):
    rows = spark.createDataFrame([(3, None), (1, None), (2, "a"), (4, "a"), (5, "b")], "seq int, url string")
    assert sorted(r.seq for r in ingest.first_per_url(rows, ["seq"]).collect()) == [1, 2, 5]
    known = spark.createDataFrame([(None, 0), ("b", 0)], "url string, seq int")
    assert [tuple(r) for r in ingest.new_urls(rows, known, ["seq"]).collect()] == [(2, "a")]
    assert sorted(r.seq for r in ingest.new_urls(rows, known.filter("url is not null"), ["seq"]).collect()) == [1, 2]


def test_repeated_urls_in_streams(spark, tmp_path):
    pages_of = [(i, "u" if i % 3 else None if i else "v") for i in reversed(range(12))]
    spark.createDataFrame(pages_of, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("incremental_dedupe_stream", "incremental_dedupe_table"):
        rows = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert sorted((r.page_id, r.url or "") for r in rows) == [(0, "v"), (1, "u"), (3, "")]


def test_url_known_by_a_later_page(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (4, "a"), (6, "b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalog.queries()["new_urls_against_table"](spark, str(tmp_path)).collect()] == [(2, "b", 2)]


def test_first_of_a_url_over_runs(spark, tmp_path):
    at = {k: f"{tmp_path}/{k}" for k in ("in", "out", "state")}
    for rows in ([(5, "a"), (4, "a"), (9, None)], [(3, "a"), (8, None), (7, "b"), (6, "b")], [(1, "b"), (2, "c")]):
        df = spark.createDataFrame(rows, "n long, url string")
        df.coalesce(1).write.mode("append").parquet(at["in"])
        stream.ingest_once(stream.read_stream(spark, at["in"], df.schema, files_per_batch=1), at["out"], at["state"], order=["n"])
    got = spark.read.option("recursiveFileLookup", True).parquet(at["out"]).collect()
    assert sorted((r.n, r.url or "") for r in got) == [(2, "c"), (4, "a"), (6, "b"), (9, "")]


def test_small_inputs_only_are_spread(spark):
    from quernel.sources.layout import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many


def test_words_of_one_stem(spark):
    docs = spark.createDataFrame([(0, "", "run runs running"), (1, "", "runs")], "doc_id long, title string, text string")
    index = ix.build(docs)
    assert [(r.term, r.doc_ids, r.df) for r in ix.posting_lists(index).collect()] == [("run", [0, 1], 2)]
    assert index.pairs().count() == 2 and ix.top_terms(index).first() == ("run", 2)
    assert ids(search.term_lookup(index, "running")) == [0, 1]


def test_corpus_files(spark, corpus_file, tmp_path):
    docs = co.import_corpus(spark, corpus_file, str(tmp_path / "table"))
    assert docs.count() == 2
    assert co.export_to_share(docs, str(tmp_path / "share")) == 2
    back = co.read_ndjson(spark, str(tmp_path / "share")).orderBy("url").collect()
    assert [(r.title, r.category) for r in back] == [("Test Article", "Test"), ("Another Article", None)]
    (tmp_path / "q.txt").write_text("hello\n\nworld\n")
    assert list(co.batch_queries(spark, str(tmp_path / "q.txt")).values()) == ["hello", "world"]


def test_numbered_over_many_partitions(spark):
    df = co.numbered(spark.range(0, 1000, 1, 7).filter("id % 3 > 0"), "n")
    assert [(r.n, r.id) for r in df.orderBy("n").collect()] == list(enumerate(i for i in range(1000) if i % 3))
    assert co.numbered(spark.range(0), "n").columns == ["n", "id"]


def test_command_line(spark, corpus_file, tmp_path, capsys):
    out = str(tmp_path / "ix")
    assert cli.main(["index", "--input", corpus_file, "--output", out, "--stats"]) == 0
    assert "documents: 2" in capsys.readouterr().out
    assert cli.main(["search", "--index", out, "--query", "hello", "--limit", "1"]) == 0
    said = capsys.readouterr().out
    assert "Found: 2 documents" in said and "1. Test Article" in said and "[Test]" in said and "... and 1 more" in said
    assert cli.main(["search", "--index", out, "--batch"], stdin=["hello\n", "\n", "nothing\n"]) == 0
    assert capsys.readouterr().out.count("---") == 2
    assert cli.main(["search", "--index", out], stdin=["world\n", "quit\n", "hello\n"]) == 0
    assert capsys.readouterr().out.count("Found") == 1
    assert cli.main(["search", "--index", str(tmp_path / "none"), "--query", "x"]) == 1
    assert cli.main(["stats", "--input", corpus_file]) == 0
    assert '"total_docs":2' in capsys.readouterr().out
    assert cli.main(["zipf", "--input", corpus_file, "--output", str(tmp_path / "z")]) == 0
    assert "1\ttest\t3" in capsys.readouterr().out
    for wrong in (["search", "--limit", "-1"], ["search", "--limit", "x"], ["index", "--what"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


def test_front_end(spark, corpus_file):
    index = ix.build(co.read_ndjson(spark, corpus_file))
    assert api.api_search(index, "hello", 1) == {"total": 2, "documents": [{"title": "Test Article", "url": "http://test/1", "category": "Test"}]}
    assert api.api_search(index, " ")["documents"] == []
    assert api.search_page(index, "hello", 2, 1)["documents"][0]["title"] == "Another Article"
    assert api.api_stats(index.docs) == {"total_docs": 2, "sources": 1, "categories": 2}
    assert "error" in api.api_stats(index.docs.drop("source"))


def test_zipf_edge_cases(spark):
    flat = spark.createDataFrame([("aa", 2), ("bb", 2)], "term string, freq long")
    assert stats.zipf_fit(flat).first().r2 is None
    none = flat.filter("freq > 9")
    assert stats.frequency_stats(none).first().unique_words == 0
    assert stats.corpus_stats(spark.createDataFrame([], "text string, source string")).first().total_docs == 0
    ranks = stats.ranked(spark.createDataFrame([("bb", 5), ("aa", 5), ("cc", 7), ("dd", 1)], "term string, freq long"))
    assert {r.term: r.rank for r in ranks.collect()} == {"cc": 1, "aa": 2, "bb": 3, "dd": 4}


def test_ingest_rules(spark):
    rows = [("rmj", "t", "x" * 100), ("rmj", "t", "x" * 99), ("bigenc", "t", "x" * 149), ("bigenc", "t", "x" * 150), ("rmj", "", "x" * 200), ("rmj", None, "x" * 200), ("rmj", "t", None)]
    docs = spark.createDataFrame(rows, "source string, title string, text string")
    assert ingest.content_filter(docs).count() == 3
    assert ingest.content_filter(docs, by_source=True).count() == 2
    before, after = spark.createDataFrame([("a", 5)], "source string, n long"), spark.createDataFrame([("a", 9), ("b", 2)], "source string, n long")
    growth = ingest.source_growth(before, after)
    assert {r.source: (r.added, r.blocked) for r in ingest.blocked_sources(growth).collect()} == {"a": (4, False), "b": (2, True)}


def test_entities_without_semicolon(spark):
    rows = [(i, f"<title>a {mark}</title><h1>b {mark}</h1><p>c {mark}</p>") for i, mark in enumerate(["&quot", "&amp", "&lt", "&quo"])]
    got = sorted((r.page_id, r.title, r.h1, *r.paragraphs) for r in pages.parsed(spark.createDataFrame(rows, "page_id long, html string")).collect())
    assert got == [(i, f"a {c}", f"b {c}", f"c {c}") for i, c in enumerate(['"', "&", "<", "&quo"])]


def test_malformed_pages(spark):
    html = '<p>a<b>x</p><p>c<br><p>d</div><script>var s = "</p><p>no";</script><a href="?q=1&amp;r=2">l</a><p>&eacute;'
    rows = spark.createDataFrame([(1, "http://a/b", html), (2, None, None), (3, "http://a/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.parsed(rows).collect()}
    assert got[1].paragraphs == ["a", "c", "d", "é"] and got[1].links == ["?q=1&r=2"]
    assert got[2].paragraphs == [] and got[3].title is None


def test_keyed_store_of_many_keys(spark):
    from quernel.functions import maps

    rows = spark.range(20_000).select(F.concat(F.lit("key_"), (F.col("id") % 10_000)).alias("k"), "id")
    store = maps.last_wins(rows, "k", ["id"])
    assert store.count() == 10_000 and store.filter("k = 'key_7'").first().id == 10_007


def test_latest_documents(spark):
    rows = spark.createDataFrame([("a", "x", "t1", "2021"), ("b", "", "t2", "2025"), ("c", "yy", "t3", "2023")], "source string, text string, title string, crawled_at string")
    assert [r.title for r in stats.latest_with_text(rows, 2).collect()] == ["t3", "t1"]
    assert ingest.stamped(rows).first().crawled_at.startswith("20")


def test_counts_of_the_smallest_tables(spark, tiny):
    """Counts known beforehand for these tables."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.lit("").alias("title"), "text")
    index = ix.build(docs)
    assert ix.document_frequency(index).agg(F.count("*"), F.sum("df")).first() == (17_211, 45_472)
    assert [tuple(r) for r in ix.top_terms(index, 5).collect()] == [("in", 136), ("en", 126), ("the", 124), ("and", 116), ("to", 115)]
    known = {"the": 124, "!the": 76, "the && que": 2, "und || que": 65, "!the && (und || que)": 60, "(the || und) && les": 1, "and && !with": 33, "keit && !the": 24, "nder tion": 17, "the, que": 124}
    got = {r.qid: r.total for r in search.batch_totals(index, {q: q for q in known}).collect()}
    assert got == known
