"""Every registered query of the library and its SQL twin.

documents stand for a corpus: text, an empty title, lang as category, source, no URL. What the tables
lack (Russian text, URLs of the nine sites, missing fields) comes as small inline tables, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import maps
from quernel.functions import sql as sql_functions
from quernel.functions import text as tx
from quernel.operators import index as ix
from quernel.operators import ingest, pages, search, stats
from quernel.operators.sites import category_of, link_kind
from quernel.plans.compile import CONSISTENT
from quernel.sources import corpus as co
from quernel.sources import index_store
from quernel.sources.workdir import work_dir
from quernel.streaming import ingest as stream

RUSSIAN_DOCS = [
    (0, "Кардиология сердце", "Статья о болезнях сердца и кардиологии. Лечение сердечной недостаточности.", "Кардиология"),
    (1, "Неврология мозг", "Статья о болезнях нервной системы и неврологии. Лечение головной боли.", "Неврология"),
    (2, "Кардиология аритмия", "Статья об аритмии и её лечении. Кардиология и сердце.", "Кардиология"),
    (3, "Терапия общая", "Общие вопросы терапии. Диагностика и лечение.", "Терапия"),
    (4, "Педиатрия дети", "Детские болезни и педиатрия. Лечение детей.", "Педиатрия"),
]
MORE_WORDS = "мать синдром статья лечение лечени ость пользующий говоривший имя ём ёлка running walked happiness happy falling falls seeing freed need boxes this ies cement nation general generally day say by y classes passes глаголing xё aё абвness я ая".split()

#: qid -> query, and its hits by the rules (ids), over RUSSIAN_DOCS; read off by hand from the stems.
RUSSIAN_QUERIES = {
    "term": ("лечение", []),
    "and": ("статья && лечение", []),
    "or": ("сердце || мозг", [0, 1, 2]),
    "and_not": ("статья && !детей", []),
    "unknown": ("несуществующеесловоqwerty", []),
    "quoted": ("«лечение»", [0, 1, 2, 3, 4]),
    "open_and": ("лечение &&", [0, 1, 2, 3, 4]),
    "not": ("!сердце", [1, 3, 4]),
    "not_and": ("!сердце && мозг", [1]),
    "not_group": ("!(сердце || мозг)", [3, 4]),
    "not_not": ("!!мозг", [1]),
    "implicit": ("сердце мозг", []),
    "precedence": ("сердце || мозг && детей", [0, 2]),
    "group": ("(сердце || мозг) && детей", []),
    "comma": ("сердце, мозг", [0, 2]),
    "digits": ("сердце 19 мозг", [0, 2]),
    "bar": ("сердце | мозг", [0, 2]),
    "closed": ("мозг) сердце", [1]),
    "dash": ("сердце — мозг", []),
    "unclosed": ("(сердце || мозг", []),
    "doubled": ("сердце || && мозг", []),
    "hyphen": ("мозг-сердце", [1]),
    "glued": ("мозг19", [1]),
    "number": ("19", []),
    "bang": ("сердце!мозг", [0, 2]),
    "only_bang": ("!", []),
    "empty_group": ("()", []),
    "ill": ("болезнях", [0, 1, 4]),
}

#: site, absolute URL, kind (None: not followed), category
URL_CASES = [
    ("journaldoctor", "https://journaldoctor.ru/catalog/therapy/x-2021/", "article", None),
    ("journaldoctor", "https://journaldoctor.ru/files/a.PDF", None, None),
    ("journaldoctor", "https://example.org/a", None, None),
    ("bnews", "https://b-news.media/science/new-drug", "article", "science"),
    ("bnews", "https://b-news.media/techno/", "list", "techno"),
    ("bnews", "https://b-news.media/tag/x/y", None, "unknown"),
    ("bnews", "https://b-news.media/", None, "unknown"),
    ("rmj", "https://www.rmj.ru/articles/kardiologiya/", "list", "kardiologiya"),
    ("rmj", "https://www.rmj.ru/articles/kardiologiya/slug-1/", "article", "kardiologiya"),
    ("rmj", "https://www.rmj.ru/articles/kardiologiya/slug-1/more/", None, "kardiologiya"),
    ("rmj", "https://www.rmj.ru/archive/", None, None),
    ("wikipedia", "https://ru.wikipedia.org/wiki/%D0%9A%D0%B0%D1%82%D0%B5%D0%B3%D0%BE%D1%80%D0%B8%D1%8F:X", "list", None),
    ("wikipedia", "https://ru.wikipedia.org/wiki/%D0%A4%D0%B0%D0%B9%D0%BB:X.jpg", None, None),
    ("wikipedia", "https://ru.wikipedia.org/wiki/C++", "article", None),
    ("ruwiki", "https://ru.ruwiki.ru/wiki/Категория:Медицина", "list", None),
    ("ruwiki", "https://ru.ruwiki.ru/wiki/Категория:Рувики:Избранные", None, None),
    ("ruwiki", "https://ru.ruwiki.ru/wiki/Сердце", "article", None),
    ("probolezny", "https://probolezny.ru/angina/", "article", None),
    ("probolezny", "https://probolezny.ru/doctor/5/", None, None),
    ("probolezny", "https://probolezny.ru/", None, None),
    ("takzdorovo", "https://www.takzdorovo.ru/stati/?rubrika=son", "list", None),
    ("takzdorovo", "https://www.takzdorovo.ru/stati/son/", "article", None),
    ("takzdorovo", "https://www.takzdorovo.ru/stati/", None, None),
    ("takzdorovo", "https://www.takzdorovo.ru/stati/page2/", None, None),
    ("clinickrasnodar", "https://site.example/articles/a/b/", "article", None),
    ("clinickrasnodar", "https://site.example/articles/a/", "list", None),
    ("clinickrasnodar", "https://site.example/articles/", None, None),
    ("bigenc", "https://bigenc.ru/c/serdce", "article", "unknown"),
    ("bigenc", "https://bigenc.ru/t/genetics", None, "Генетика"),
    ("bigenc", "https://bigenc.ru/t/medicine?x=/t/biology", None, "Биология"),
]

JOIN_CASES = [
    ("https://a.example/x/y?q=1#z", "b", "https://a.example/x/b"),
    ("https://a.example/x/y", "/b/c?d=e", "https://a.example/b/c?d=e"),
    ("https://a.example/x/y", "../b", "https://a.example/b"),
    ("https://a.example/x/y/", "./b/../c/", "https://a.example/x/y/c/"),
    ("https://a.example", "b", "https://a.example/b"),
    ("https://a.example/x", "//c.example/d", "https://c.example/d"),
    ("https://a.example/x", "http://d.example/", "http://d.example/"),
    ("https://a.example/x/y", "?p=2", "https://a.example/x/y?p=2"),
    ("https://a.example/x/y?p=1", "#top", "https://a.example/x/y?p=1#top"),
    ("https://a.example/x/y", "", "https://a.example/x/y"),
    ("https://a.example/x/y", "mailto:me@a.example", "mailto:me@a.example"),
]

CLEAN_CASES = [
    (1, "  a\n\tb  ", "a b"),
    (2, "сердце[12] бьётся[править | править код] [3]", "сердце бьётся "),
    (3, "x [a1] [12a]", "x [a1] [12a]"),
    (4, "", ""),
]

YEAR_CASES = [(1, "https://e.example/2021/05", "10 мая 2019", "2021"), (2, "https://e.example/a", "10 мая 2019", "2019"), (3, "https://e.example/1999", "в 1920x", None), (4, None, "120345", "2034")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text", F.lit("").alias("url"), F.col("lang").alias("category"), "source")


def russian(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, x, f"http://test/{i + 1}", c, "test") for i, t, x, c in RUSSIAN_DOCS], "doc_id long, title string, text string, url string, category string, source string")


def quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") v({names}))"


# ---- SQL twins -------------------------------------------------------------------------------------

_RU = "|".join(tx.RUSSIAN_ENDINGS)
_EN = "|".join(tx.ENGLISH_SUFFIXES)
_UNDOUBLE = "CASE WHEN length({y}) > 1 AND right({y}, 1) = left(right({y}, 2), 1) AND regexp_matches({y}, '[a-z]$') THEN left({y}, length({y}) - 1) ELSE {y} END"


def stem_ctes(vocabulary: str) -> str:
    """CTEs that end in stems(w, stem), for a vocabulary(w)."""
    ed, ing = _UNDOUBLE.format(y="left(x, length(x) - 2)"), _UNDOUBLE.format(y="left(x, length(x) - 3)")
    return f"""
    voc AS ({vocabulary}),
    s0 AS (SELECT w, CASE WHEN regexp_matches(w, '^[а-яё]') THEN 'r' WHEN strlen(w) < 3 THEN 'k' ELSE 'e' END AS k FROM voc),
    s1 AS (SELECT w, k, CASE WHEN k = 'r' THEN regexp_replace(w, '^(.{{2,}}?)(?:{_RU})$', '\\1') WHEN k = 'k' THEN w
        WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' AND strlen(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS x FROM s0),
    s2 AS (SELECT w, k, CASE WHEN k <> 'e' THEN x WHEN x LIKE '%eed' THEN CASE WHEN strlen(x) > 4 THEN left(x, length(x) - 2) ELSE x END
        WHEN x LIKE '%ed' AND strlen(x) > 4 THEN {ed} WHEN x LIKE '%ing' AND strlen(x) > 5 THEN {ing} ELSE x END AS x FROM s1),
    s3 AS (SELECT w, k, CASE WHEN k = 'e' AND x LIKE '%y' AND strlen(x) > 2 AND NOT regexp_matches(x, '[aeiou]y$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM s2),
    stems AS (SELECT w, CASE WHEN k = 'e' THEN regexp_replace(x, '^([a-z][а-яё]|.{{3,}}?)(?:{_EN})$', '\\1') ELSE x END AS stem FROM s3)"""


_TOKENS = "tokens AS (SELECT doc_id, lower(unnest(regexp_extract_all(' ' || coalesce(text, ''), '[A-Za-zА-Яа-яЁё]+'))) AS w FROM documents)"
PAIRS = f"WITH {_TOKENS}, {stem_ctes('SELECT DISTINCT w FROM tokens')}, pairs AS (SELECT DISTINCT stem AS term, doc_id FROM tokens JOIN stems USING (w))"
WORDS = "WITH words AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[а-яёa-z]+')) AS term FROM documents), freq AS (SELECT term, count(*) AS freq FROM words WHERE length(term) >= 2 GROUP BY term)"
_POINTS = WORDS + ", points AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM freq), fit AS (SELECT count(*) AS n, -regr_slope(ln(freq), ln(rank)) AS alpha, exp(regr_intercept(ln(freq), ln(rank))) AS c, regr_r2(ln(freq), ln(rank)) AS r2 FROM points)"


def unescaped(x: str) -> str:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{mark}', '{char}')"
    return x


_PARSED = f"""parsed AS (SELECT page_id, url, {unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {unescaped("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")} AS h1,
    list_filter(regexp_extract_all(html, '<p[^>]*>([^<]*)', 1), lambda x : x <> '') AS raw, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS links FROM pages)"""


def has(term: str) -> str:
    return f"(SELECT doc_id FROM pairs WHERE term = '{term}')"


_ALL = "(SELECT doc_id FROM documents WHERE coalesce(text, '') <> '')"

#: query key -> (query, stem passes or None for the default, SQL of its hits over pairs)
BOOLEAN = {
    "bool_and": ("the && que", None, f"{has('the')} INTERSECT {has('que')}"),
    "bool_or": ("und || que", None, f"{has('und')} UNION {has('que')}"),
    "bool_not": ("!the", None, f"{_ALL} EXCEPT {has('the')}"),
    "bool_and_not": ("and && !with", None, f"{has('and')} EXCEPT {has('with')}"),
    "bool_nested": ("!the && (und || que)", None, f"({has('und')} UNION {has('que')}) EXCEPT {has('the')}"),
    "bool_group": ("the && (und || que)", None, f"{has('the')} INTERSECT ({has('und')} UNION {has('que')})"),
    "implicit_and": ("the que", None, f"{has('the')} INTERSECT {has('que')}"),
    "double_negation": ("!!the", None, has("the")),
    "fallback_bad_syntax": ("the — que", None, f"{has('the')} INTERSECT {has('que')}"),
    "fallback_drops_not": ("!the &&", None, has("the")),
    "trailing_ignored": ("the, que", None, has("the")),
    "hyphen_first_token": ("the-que", None, has("the")),
    "digits_only_empty": ("123", None, "(SELECT doc_id FROM documents WHERE false)"),
    "double_stem_compat": ("thesing || licensed", None, f"{has('the')} UNION {has('licen')}"),
    "single_stem_mode": ("thesing || licensed", CONSISTENT, f"{has('thes')} UNION {has('licens')}"),
}
BATCH = {"a": "the && que", "b": "und || que", "c": "!the", "d": "nosuchword", "e": "the — que"}
_BATCH_SQL = f"SELECT 'a' AS qid, * FROM ({has('the')} INTERSECT {has('que')}) UNION ALL SELECT 'b', * FROM ({has('und')} UNION {has('que')}) UNION ALL SELECT 'c', * FROM ({_ALL} EXCEPT {has('the')}) UNION ALL SELECT 'e', * FROM ({has('the')} INTERSECT {has('que')})"


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of a corpus, built and saved once an application and read from disk by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not index_store.exists(spark, _stored[key]):
        at = work_dir(spark, "stored-index")
        index_store.save(ix.build(corpus(spark, sf_dir)), at)
        _stored[key] = at
    return index_store.load(spark, _stored[key])


def _boolean(key: str):
    query, passes, _ = BOOLEAN[key]

    def run(spark, sf_dir):
        built = stored(spark, sf_dir)
        return search.search(built, query) if passes is None else search.search(built, query, passes)

    return run


# ---- queries that need more than one expression ------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = stored(spark, sf_dir)
    hits = search.search(built, "the && (und || que)")
    return search.with_documents(built, hits).select("doc_id", "source")


def _tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens("text")).alias("pos", "word"))


def _vocabulary(words: DataFrame) -> DataFrame:
    return tx.with_stem(words.select("word").distinct(), "word", "stem")


def _stem_ru(spark, sf_dir):
    own = russian(spark).select(F.explode(tx.tokens(tx.joined_text("title", "text"))).alias("word"))
    words = own.union(spark.createDataFrame([(w,) for w in MORE_WORDS], "word string")).distinct()
    return words.select("word", tx.stem("word").alias("stem"))


def _joined(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def _postings_list(spark, sf_dir):
    lists = ix.posting_lists(ix.build(corpus(spark, sf_dir)))
    return lists.select("term", _joined(F.col("doc_ids")).alias("doc_ids"), "df")


def _two_lists(spark, sf_dir):
    built = stored(spark, sf_dir)
    ids = lambda t: F.sort_array(F.collect_set(F.when(F.col("term") == t, F.col("doc_id"))))
    return built.lookup(["the", "que"]).agg(ids("the").alias("a"), ids("que").alias("b"))


def _intersect(spark, sf_dir):
    return _two_lists(spark, sf_dir).select(_joined(ix.intersect(F.col("a"), F.col("b"))).alias("doc_ids"))


def _union(spark, sf_dir):
    return _two_lists(spark, sf_dir).select(_joined(ix.union(F.col("a"), F.col("b"))).alias("doc_ids"))


def _negate(spark, sf_dir):
    """Against the ids that the index holds: they may have gaps, and documents without text aren't in it."""
    everything = stored(spark, sf_dir).docs.agg(F.sort_array(F.collect_set("doc_id")).alias("every"))
    return _two_lists(spark, sf_dir).crossJoin(everything).select(_joined(ix.without(F.col("every"), F.col("a"))).alias("doc_ids"))


def _with_hits(then):
    def run(spark, sf_dir):
        built = stored(spark, sf_dir)
        return then(built, search.search(built, "und || que"))

    return run


def _russian_queries(passes):
    def run(spark, sf_dir):
        built = ix.build(russian(spark))
        return search.batch(built, {k: q for k, (q, _) in RUSSIAN_QUERIES.items()}, **({} if passes is None else {"stem_passes": passes}))

    return run


def _map_upsert(spark, sf_dir):
    """Three stores, each with b set anew: what they hold then."""
    rows = spark.createDataFrame([(1, {"c": 30}, 10), (2, {"b": 5}, 7), (3, {"a": 1, "b": 2, "c": 3}, 9)], "id int, m map<string,int>, b int")
    new = rows.select("id", maps.upsert(F.col("m"), F.lit("b"), F.col("b")).alias("m"))
    return new.select("id", F.size("m").alias("n"), _joined(F.transform(maps.entries(F.col("m")), lambda e: e["value"])).alias("vals"), F.coalesce(maps.find(F.col("m"), F.when(F.col("id") == 1, "c").otherwise("b")), F.lit(0)).alias("found"), maps.contains(F.col("m"), F.lit("c")).alias("has_c"), F.array_join(maps.keys(F.col("m")), ",").alias("names"))


def _freq(spark, sf_dir):
    return stats.term_frequency(table(spark, sf_dir, "documents"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _verdict(spark, sf_dir):
    return stats.zipf_fit(_freq(spark, sf_dir)).select(stats.verdict(F.col("alpha")).alias("verdict"))


def _corpus_stats(spark, sf_dir):
    s = stats.corpus_stats(corpus(spark, sf_dir))
    return _rounded(s.withColumn("sources", F.array_join("sources", ",")), "raw_size_mb", "text_size_mb", "avg_text_chars")


def _category_count(spark, sf_dir):
    return stats.site_stats(corpus(spark, sf_dir).withColumn("category", F.when(F.col("category") != "es", F.col("category"))))


def _repeated_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.withColumn("seq", F.col("page_id")).union(p.filter("page_id % 5 = 0").withColumn("seq", F.col("page_id") + 1_000_000))


def _stream(spark, sf_dir):
    """The file stream is run twice over one checkpoint; the second run's rows were all seen."""
    at = work_dir(spark, "stream")
    rows = _repeated_pages(spark, sf_dir).select("page_id", "url")
    rows.write.parquet(f"{at}/in")
    for again in (False, True):
        if again:
            rows.filter("page_id % 3 = 0").write.mode("append").parquet(f"{at}/in")
        stream.ingest_once(stream.read_stream(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/state", order=["page_id"])
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


def _stream_table(spark, sf_dir):
    at = work_dir(spark, "stream-table")
    rows = _repeated_pages(spark, sf_dir)
    rows.write.parquet(f"{at}/in")
    for again in (False, True):
        if again:
            rows.filter("page_id % 3 = 0").write.mode("append").parquet(f"{at}/in")
        stream.ingest_against_table(stream.read_stream(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/state", ["seq"])
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{at}/out").select("page_id", "url")


def _blocked(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    listed = docs.select("source").distinct().union(spark.createDataFrame([("silent",)], "source string"))
    return stream.monitor(docs.filter("doc_id % 50 <> 7"), docs, listed)


def _json_roundtrip(spark, sf_dir):
    at = work_dir(spark, "ndjson")
    co.write_ndjson(corpus(spark, sf_dir).drop("doc_id"), at, gzip=True)
    return co.read_ndjson(spark, at, numbers=False).select("text", "category", "source")


def _numbered(spark, sf_dir):
    at = work_dir(spark, "lines")
    lines = spark.createDataFrame([('{"title":"a","text":"x"}',), ("no object",), ('{"title":"","text":""}',), ('{"title":null,"text":"tab\\t quote\\" \\u0416"}',), ("",), ('{"text":"last\\\\"}',)], "value string")
    lines.coalesce(1).write.text(at)
    return co.read_ndjson(spark, at).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "text")


def _index_roundtrip(spark, sf_dir):
    at = work_dir(spark, "index")
    index_store.save(ix.build(corpus(spark, sf_dir)), at)
    loaded = index_store.load(spark, at)
    return search.with_documents(loaded, search.search(loaded, "the && (und || que)")).select("doc_id", "category", "source")


def _index_meta(spark, sf_dir):
    at = work_dir(spark, "index")
    index_store.save(ix.build(corpus(spark, sf_dir)), at)
    return index_store.describe(spark, at).select("n_terms", "n_docs")


def _url_rules(spark, sf_dir):
    cases = spark.createDataFrame([(s, u) for s, u, _, _ in URL_CASES], "site string, url string")
    out = None
    for site in dict.fromkeys(s for s, *_ in URL_CASES):
        part = cases.filter(F.col("site") == site).select("site", "url", link_kind(site, F.col("url")).alias("kind"), category_of(site, F.col("url")).alias("category"))
        out = part if out is None else out.union(part)
    return out


def _url_join(spark, sf_dir):
    cases = spark.createDataFrame([(b, k) for b, k, _ in JOIN_CASES], "base string, link string")
    return cases.select("base", "link", tx.url_join("base", "link").alias("url"))


def _clean(spark, sf_dir):
    cases = spark.createDataFrame([(i, x) for i, x, _ in CLEAN_CASES], "id int, raw string")
    return cases.select("id", tx.strip_citations(tx.collapse_space("raw")).alias("text"))


def _years(spark, sf_dir):
    cases = spark.createDataFrame([(i, u, d) for i, u, d, _ in YEAR_CASES], "id int, url string, date string")
    return cases.select("id", tx.year("url", "date").alias("year"))


def _sql_functions(spark, sf_dir):
    sql_functions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("quernel_documents")
    return spark.sql("SELECT term, count(*) AS df FROM (SELECT text_terms(text) AS terms FROM quernel_documents) LATERAL VIEW explode(terms) t AS term GROUP BY term ORDER BY df DESC, term LIMIT 20")


def _extracted(site):
    return lambda spark, sf_dir: pages.extract(table(spark, sf_dir, "pages"), site)


def _site_document(spark, sf_dir):
    """One page of each layout: what is extracted from it."""
    body = "слово " * 40
    page = (
        '<html><head><title>T &mdash; x</title><meta property="og:title" content="B-News — OG"><meta property="og:description" content="short"><meta name="description" content="d"></head>'
        '<body><div id="mw-content-text"><div class="mw-parser-output"><h1 id="firstHeading" class="firstHeading">Head</h1><article><p>Один [12] <b>два</b> '
        f'{body}</p><p>Второй</p></article><p>Прямой <a href="/x">внутри</a>[править код] {body}</p></div></div><span class="date">1 мая 2020</span><time datetime="2018-01-01">t</time>'
        '<div id="mw-normal-catlinks" class="mw-normal-catlinks"><a>Кат</a></div><i class="tag"> Тег </i></body></html>'
    )
    one = spark.createDataFrame([(1, "https://e.example/articles/sec/slug/", page)], "page_id long, url string, html string")
    out = None
    for site in pages.LAYOUTS:
        part = pages.extract(one, site).select("source", "title", F.length("text").alias("n_chars"), "category", "year")
        out = part if out is None else out.union(part)
    return out


_LONG = 6 * 40
#: source, title, characters of the text, category, year of the page above; read off by hand. A mark that is
#: taken out leaves the blanks on both of its sides.
SITE_DOCUMENT = [
    ("journaldoctor", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй"), "Тег", "2020"),
    ("bnews", "OG", len("Один [12] ") + _LONG - 1 + len(" Второй"), "unknown", "2018"),
    ("rmj", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй"), "sec", "2020"),
    ("wikipedia", "Head", len("Прямой внутри  ") + _LONG - 1, "Кат", None),
    ("ruwiki", "Head", len("Один  ") + _LONG - 1 + len(" Второй Прямой  ") + _LONG - 1, "Кат", None),
    ("probolezny", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй Прямой [править код] ") + _LONG - 1, "Тег", "2020"),
    ("takzdorovo", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй Прямой [править код] ") + _LONG - 1, "Тег", "2020"),
    ("clinickrasnodar", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй Прямой [править код] ") + _LONG - 1, "Тег", "2020"),
    ("bigenc", "Head", len("Один [12] ") + _LONG - 1 + len(" Второй Прямой [править код] ") + _LONG - 1, "unknown", "2020"),
]


def queries():
    docs, page = (lambda s, d: table(s, d, "documents")), (lambda s, d: table(s, d, "pages"))
    built = lambda s, d: ix.build(corpus(s, d))
    found = {
        "tokenize": _tokenize,
        "token_counts_per_doc": lambda s, d: docs(s, d).select("doc_id", F.size(tx.tokens("text")).cast("long").alias("n_tokens")),
        "stem_vocab_en": lambda s, d: _vocabulary(docs(s, d).select(F.explode(tx.tokens("text")).alias("word"))),
        "stem_vocab_ru": _stem_ru,
        "sql_functions": _sql_functions,
        "postings_exploded": lambda s, d: built(s, d).pairs(),
        "postings_list": _postings_list,
        "doc_freq_top20": lambda s, d: ix.top_terms(built(s, d), 20),
        "document_lookup": lambda s, d: stored(s, d).docs.filter("doc_id = 17").select("doc_id", "category", "source"),
        "term_lookup": lambda s, d: search.term_lookup(stored(s, d), "The"),
        "posting_intersect_array": _intersect,
        "posting_union_array": _union,
        "posting_negate_array": _negate,
        "search_flagship": flagship,
        "search_topn_with_docs": _with_hits(lambda i, h: search.first(i, h, 50).select("doc_id", "category", "source")),
        "search_page2": _with_hits(lambda i, h: search.page(i, h, 2, 50).select("doc_id", "category", "source")),
        "search_total": _with_hits(lambda i, h: search.total(h)),
        "search_overflow": _with_hits(lambda i, h: search.overflow(h, 50)),
        "batch_search": lambda s, d: search.batch(stored(s, d), BATCH),
        "batch_totals": lambda s, d: search.batch_totals(stored(s, d), BATCH),
        "russian_queries": _russian_queries(None),
        "russian_queries_consistent": _russian_queries(CONSISTENT),
        "corpus_stats": _corpus_stats,
        "distinct_sources": lambda s, d: stats.distinct_values(docs(s, d), "source"),
        "category_count_with_null": _category_count,
        "docs_per_source": lambda s, d: stats.docs_per_source(docs(s, d)),
        "count_of_source": lambda s, d: stats.count_of_source(docs(s, d), "src9"),
        "latest_docs": lambda s, d: stats.latest(table(s, d, "events"), "ts", 5, "event_id").select("event_id", "event_type"),
        "upsert_last_wins": lambda s, d: maps.last_wins(table(s, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id"),
        "map_upsert": _map_upsert,
        "zipf_tf": _freq,
        "zipf_tf_top30": lambda s, d: stats.top_frequencies(_freq(s, d), 30),
        "zipf_ranks": lambda s, d: stats.ranked(_freq(s, d)),
        "zipf_fit": lambda s, d: _rounded(stats.zipf_fit(_freq(s, d)), "alpha", "r2").withColumn("c", F.round("c", 2)),
        "zipf_freq_stats": lambda s, d: _rounded(stats.frequency_stats(_freq(s, d)), "mean_freq", "median_freq", "hapax_percent"),
        "zipf_curve": lambda s, d: stats.zipf_curve(_freq(s, d), stats.zipf_fit(_freq(s, d)), 30).withColumn("theoretical", F.round("theoretical", 2)),
        "zipf_verdict": _verdict,
        "page_titles": lambda s, d: pages.titles(page(s, d)),
        "page_paragraphs": lambda s, d: pages.paragraphs(page(s, d)),
        "page_links": lambda s, d: pages.links(page(s, d)).select("page_id", "place", "href"),
        "page_links_absolute": lambda s, d: pages.links(page(s, d)).select("page_id", "place", "url"),
        "page_year": lambda s, d: page(s, d).select("page_id", tx.year("url", "html").alias("year")),
        "page_parsed": lambda s, d: pages.parsed(page(s, d)).select("page_id", "title", "h1", F.array_join("paragraphs", "|").alias("paragraphs"), F.array_join("links", "|").alias("links")),
        "page_extract": _extracted("bigenc"),
        "page_layouts": _site_document,
        "url_rules": _url_rules,
        "url_join": _url_join,
        "clean_citations": _clean,
        "year_chain": _years,
        "ingest_filter": lambda s, d: ingest.content_filter(docs(s, d).withColumn("title", F.col("lang"))).select("doc_id"),
        "dedupe_url_first_wins": lambda s, d: ingest.first_per_url(_repeated_pages(s, d), ["seq"]),
        "new_urls_against_table": lambda s, d: ingest.new_urls(_repeated_pages(s, d), page(s, d).filter("page_id % 4 = 0"), ["seq"]),
        "incremental_dedupe_stream": _stream,
        "incremental_dedupe_table": _stream_table,
        "blocked_sources": _blocked,
        "json_roundtrip": _json_roundtrip,
        "ndjson_numbered": _numbered,
        "index_roundtrip": _index_roundtrip,
        "index_meta": _index_meta,
    }
    return found | {k: _boolean(k) for k in BOOLEAN}


def oracle_sql():
    ors = f"({has('und')} UNION {has('que')})"
    ru_text = values([(f" {t} {x}",) for _, t, x, _ in RUSSIAN_DOCS], "text")
    more = values([(w,) for w in MORE_WORDS], "w")
    ru_voc = f"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]+'))) AS w FROM {ru_text} UNION SELECT w FROM {more}"
    repeated = "rows AS (SELECT page_id, url, page_id AS seq FROM pages UNION ALL SELECT page_id, url, page_id + 1000000 FROM pages WHERE page_id % 5 = 0)"
    consistent = {"term": [0, 1, 2, 3, 4], "and": [0, 1, 2], "and_not": [0, 1, 2]}
    hits = lambda own: [(q, i) for q, (_, ids) in RUSSIAN_QUERIES.items() for i in own.get(q, ids)]
    found = {
        "tokenize": "WITH t AS (SELECT doc_id, regexp_extract_all(' ' || coalesce(text, ''), '[A-Za-zА-Яа-яЁё]+') AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, lower(unnest(l)) AS word FROM t",
        "token_counts_per_doc": "SELECT doc_id, len(regexp_extract_all(' ' || coalesce(text, ''), '[A-Za-zА-Яа-яЁё]+')) AS n_tokens FROM documents",
        "stem_vocab_en": f"WITH {_TOKENS}, {stem_ctes('SELECT DISTINCT w FROM tokens')} SELECT w AS word, stem FROM stems",
        "stem_vocab_ru": f"WITH {stem_ctes(ru_voc)} SELECT w AS word, stem FROM stems",
        "sql_functions": f"{PAIRS} SELECT term, count(*) AS df FROM pairs GROUP BY term ORDER BY df DESC, term LIMIT 20",
        "postings_exploded": f"{PAIRS} SELECT term, doc_id FROM pairs",
        "postings_list": f"{PAIRS} SELECT term, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids, count(*) AS df FROM pairs GROUP BY term",
        "doc_freq_top20": f"{PAIRS} SELECT term, count(*) AS df FROM pairs GROUP BY term ORDER BY df DESC, term LIMIT 20",
        "document_lookup": "SELECT doc_id, lang AS category, source FROM documents WHERE doc_id = 17",
        "term_lookup": f"{PAIRS} SELECT doc_id FROM pairs WHERE term = 'the'",
        "posting_intersect_array": f"{PAIRS} SELECT coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') AS doc_ids FROM ({has('the')} INTERSECT {has('que')})",
        "posting_union_array": f"{PAIRS} SELECT coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') AS doc_ids FROM ({has('the')} UNION {has('que')})",
        "posting_negate_array": f"{PAIRS} SELECT coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') AS doc_ids FROM ({_ALL} EXCEPT {has('the')})",
        "search_flagship": f"{PAIRS} SELECT doc_id, source FROM documents WHERE doc_id IN {has('the')} AND doc_id IN {ors}",
        "search_topn_with_docs": f"{PAIRS} SELECT doc_id, lang AS category, source FROM documents WHERE doc_id IN {ors} ORDER BY doc_id LIMIT 50",
        "search_page2": f"{PAIRS} SELECT doc_id, lang AS category, source FROM documents WHERE doc_id IN {ors} ORDER BY doc_id LIMIT 50 OFFSET 50",
        "search_total": f"{PAIRS} SELECT count(*) AS total FROM {ors}",
        "search_overflow": f"{PAIRS} SELECT count(*) AS total, least(count(*), 50) AS shown, greatest(count(*) - 50, 0) AS more FROM {ors}",
        "batch_search": f"{PAIRS} {_BATCH_SQL}",
        "batch_totals": f"{PAIRS}, hits AS ({_BATCH_SQL}) SELECT q.qid, count(doc_id) AS total FROM {values([(k,) for k in BATCH], 'qid')} q LEFT JOIN hits USING (qid) GROUP BY q.qid",
        "russian_queries": "SELECT * FROM " + values(hits({}), "qid, doc_id"),
        "russian_queries_consistent": "SELECT * FROM " + values(hits(consistent), "qid, doc_id"),
        "corpus_stats": "SELECT count(*) AS total_docs, round(sum(strlen(coalesce(text, '')) + strlen(coalesce(lang, '')) + strlen(coalesce(source, ''))) / 1048576.0, 6) AS raw_size_mb, round(sum(length(coalesce(text, ''))) / 1048576.0, 6) AS text_size_mb, round(avg(length(coalesce(text, ''))), 6) AS avg_text_chars, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) AS sources FROM documents",
        "distinct_sources": "SELECT DISTINCT source FROM documents",
        "category_count_with_null": "SELECT count(*) AS total_docs, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS sources, (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN lang <> 'es' THEN lang END FROM documents)) AS categories FROM documents",
        "docs_per_source": "SELECT source, count(*) AS n FROM documents GROUP BY source",
        "count_of_source": "SELECT count(*) AS n FROM documents WHERE source = 'src9'",
        "latest_docs": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
        "upsert_last_wins": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "map_upsert": "SELECT * FROM (VALUES (1, 2, '10,30', 30, true, 'b,c'), (2, 1, '7', 7, false, 'b'), (3, 3, '1,9,3', 9, true, 'a,b,c')) v(id, n, vals, found, has_c, names)",
        "zipf_tf": f"{WORDS} SELECT term, freq FROM freq",
        "zipf_tf_top30": f"{WORDS} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq AS frequency FROM freq ORDER BY freq DESC, term LIMIT 30",
        "zipf_ranks": f"{WORDS} SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM freq",
        "zipf_fit": f"{_POINTS} SELECT n, round(alpha, 6) AS alpha, round(c, 2) AS c, round(r2, 6) AS r2 FROM fit",
        "zipf_freq_stats": f"{WORDS} SELECT sum(freq)::BIGINT AS total_words, count(*) AS unique_words, max(freq) AS max_freq, min(freq) AS min_freq, round(avg(freq), 6) AS mean_freq, round(median(freq), 6) AS median_freq, count_if(freq = 1)::BIGINT AS hapax, round(100.0::DOUBLE * count_if(freq = 1) / count(*), 6) AS hapax_percent FROM freq",
        "zipf_curve": f"{_POINTS} SELECT rank, term, freq, round(c / pow(rank, alpha), 2) AS theoretical FROM points, fit ORDER BY rank LIMIT 30",
        "zipf_verdict": f"{_POINTS} SELECT CASE WHEN alpha BETWEEN 0.8 AND 1.2 THEN 'good' WHEN alpha BETWEEN 0.5 AND 1.5 THEN 'partial' ELSE 'deviates' END AS verdict FROM fit",
        "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1 FROM pages",
        "page_paragraphs": "WITH t AS (SELECT page_id, regexp_extract_all(html, '<p[^>]*>([^<]*)', 1) AS l FROM pages), r AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS raw FROM t) SELECT page_id, place, trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS text FROM r WHERE trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') <> ''",
        "page_links": "WITH t AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS href FROM t",
        "page_links_absolute": "WITH t AS (SELECT page_id, url AS base, regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages), r AS (SELECT page_id, base, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS href FROM t) SELECT page_id, place, regexp_extract(base, '^[a-z]+://[^/?#]*') || href AS url FROM r",
        "page_parsed": f"WITH {_PARSED} SELECT page_id, title, h1, {unescaped("array_to_string(raw, '|')")} AS paragraphs, array_to_string(links, '|') AS links FROM parsed",
        "page_extract": f"WITH {_PARSED}, e AS (SELECT page_id, 'bigenc' AS source, url, trim(coalesce(nullif(h1, ''), title)) AS title, trim(regexp_replace({unescaped("array_to_string(raw, ' ')")}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text, 'unknown' AS category, NULL::VARCHAR AS year FROM parsed) SELECT * FROM e WHERE title <> '' AND length(text) >= 150",
        "page_year": "SELECT page_id, coalesce(nullif(regexp_extract(url, '20\\d{2}'), ''), nullif(regexp_extract(html, '20\\d{2}'), '')) AS year FROM pages",
        "page_layouts": "SELECT * FROM " + values(SITE_DOCUMENT, "source, title, n_chars, category, year"),
        "url_rules": "SELECT * FROM " + values(URL_CASES, "site, url, kind, category"),
        "url_join": "SELECT * FROM " + values(JOIN_CASES, "base, link, url"),
        "clean_citations": "SELECT id, text FROM " + values(CLEAN_CASES, "id, raw, text"),
        "year_chain": "SELECT id, year FROM " + values(YEAR_CASES, "id, url, date, year"),
        "ingest_filter": "SELECT doc_id FROM documents WHERE coalesce(lang, '') <> '' AND coalesce(text, '') <> '' AND length(text) >= 100",
        "dedupe_url_first_wins": f"WITH {repeated} SELECT page_id, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM rows) WHERE k = 1",
        "new_urls_against_table": f"WITH {repeated} SELECT page_id, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM rows) WHERE k = 1 AND page_id % 4 <> 0",
        "incremental_dedupe_stream": "SELECT page_id, url FROM pages",
        "incremental_dedupe_table": "SELECT page_id, url FROM pages",
        "blocked_sources": "WITH a AS (SELECT source, sum(CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END)::BIGINT AS added FROM documents GROUP BY source UNION ALL SELECT 'silent', 0), b AS (SELECT source, added, added < 3 AS blocked FROM a) SELECT source, added, blocked, (SELECT bool_and(blocked) FROM b) AS all_blocked FROM b",
        "json_roundtrip": "SELECT text, lang AS category, source FROM documents WHERE coalesce(text, '') <> ''",
        "ndjson_numbered": "SELECT * FROM " + values([(0, "a", "x"), (1, "", 'tab\t quote" Ж'), (2, "", "last\\")], "doc_id, title, text"),
        "index_roundtrip": f"{PAIRS} SELECT doc_id, lang AS category, source FROM documents WHERE doc_id IN {has('the')} AND doc_id IN {ors}",
        "index_meta": f"{PAIRS} SELECT (SELECT count(DISTINCT term) FROM pairs) AS n_terms, (SELECT count(*) FROM {_ALL}) AS n_docs",
    }
    return found | {k: f"{PAIRS} SELECT doc_id FROM ({sql}) hits" for k, (_, _, sql) in BOOLEAN.items()}
