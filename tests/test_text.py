"""Tokens and stems: golden values, and the driver's rules against the native expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import local_text as lt
from quernel.functions import text as tx

TOKENS = [
    ("Hello, world! How are you?", ["hello", "world", "how", "are", "you"]),
    ("Hello Привет World Мир", ["hello", "привет", "world", "мир"]),
    ("", []),
    ("   ", []),
    ("123 456", []),
    ("Étre COVID19 Ёлка", ["tre", "covid", "ёлка"]),
    (None, []),
]
STEMS = {
    "running": "run", "runs": "run", "walking": "walk", "walked": "walk", "happiness": "happi", "happy": "happi", "a": "a", "is": "is",
    "falling": "fal", "falls": "fall", "seeing": "se", "freed": "fre", "need": "need", "boxes": "boxe", "this": "thi", "ies": "i", "cement": "cem",
    "nation": "nation", "general": "gener", "generally": "generalli", "мать": "ма", "синдром": "синдр", "статья": "стать", "стать": "ст",
    "лечение": "лечени", "лечени": "лечен", "кардиология": "кардиологи", "кардиологии": "кардиологи",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TOKENS)], "k int, t string")
    assert [r.w for r in rows.select("k", tx.tokens("t").alias("w")).orderBy("k").collect()] == [w for _, w in TOKENS]
    assert all(lt.tokens(t or "") == w for t, w in TOKENS)


def test_stem_goldens(spark):
    assert {w: lt.stem(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", tx.stem("w").alias("s")).collect()
    assert {r.w: r.s for r in rows} == STEMS
    assert lt.stem("лечение", 2) == "лечен"
    assert lt.stem("") == ""


WORDS = st.lists(st.text("abdegilnsuyzaeiouабвёейинотьщющийя", min_size=1, max_size=14), min_size=1, max_size=400)


@settings(max_examples=8, deadline=None)
@given(WORDS)
def test_driver_rules_equal_native(spark, words):
    suffixed = [w + s for w in words[:40] for s in ("ing", "ed", "eed", "ational", "ies", "ly", "ивший", "ость", "ся")]
    words = sorted(set(words + suffixed))
    rows = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select("w", tx.stem("w").alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: lt.stem(w) for w in words}


def test_vocabulary_rules_equal_native(spark, tiny):
    words = spark.read.parquet(f"{tiny}/documents.parquet").select(F.explode(tx.tokens("text")).alias("w")).distinct()
    wrong = [r.w for r in words.select("w", tx.stem("w").alias("s")).collect() if lt.stem(r.w) != r.s]
    assert not wrong


def test_counted_words(spark):
    text = "Ab a ёж Я's COVID-19 x"
    got = spark.createDataFrame([(text,)], "t string").select(tx.counted_words("t").alias("w")).first().w
    assert got == [w for w in re.findall("[а-яёa-z]+", text.lower()) if len(w) > 1]


@pytest.mark.parametrize("url,want", [("%D0%9A+a", "К+a"), ("100%", "100%"), (None, None), ("", "")])
def test_url_decoded(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(tx.url_decoded("u").alias("u")).first().u == want


def test_collapse_space_is_unicode(spark):
    assert spark.createDataFrame([(" a \n b ",)], "t string").select(tx.collapse_space("t").alias("t")).first().t == "a b"


def test_sql_functions_equal_columns(spark):
    from quernel.functions.sql import register

    register(spark)
    words = sorted({*STEMS, "xё", "generalization", "fallsed", "pyed", "ssing"})
    df = spark.createDataFrame([(words, "Running [1] сердца 2021", None)], "a array<string>, t string, n string")
    df.createOrReplaceTempView("fn_cases")
    got = spark.sql("SELECT word_stems(a) s, text_tokens(t) t, text_year(t) y, text_without_citations(t) c, text_terms(t) m, text_counted_words(n) w FROM fn_cases").first()
    want = df.select(tx.stems("a").alias("s"), tx.tokens("t").alias("t"), tx.year("t").alias("y"), tx.strip_citations("t").alias("c"), tx.terms("t").alias("m"), tx.counted_words("n").alias("w")).first()
    assert got == want
