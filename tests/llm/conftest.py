import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

ROWS = [
    (0, None),
    (1, ""),
    (2, "   \n\t "),
    (3, "word"),
    (4, "two words"),
    (5, "The quick brown fox jumps over the lazy dog.\nAnd again, the fox."),
    (6, "The quick brown fox jumps over the lazy dog.\nAnd again, the fox."),
    (7, LONG),
    (8, "日本語のテキスト 😀 <|endoftext|> é́   \x1c İSTANBUL ΣΊΣΥΦΟΣ"),
    (9, "12345 67890 !!! ### $$$"),
    (10, "a" * 5000),
    (11, "\n\n\n"),
    (None, "a row without an id, a row without an id"),
]
EXTRA = "score double, kept boolean, component_id long, r long, f long, u long, v long, at string, own string, n_chars long, lang string, source string"


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, equal rows, odd characters, and columns named as the operators name their own."""
    extra = (None, True, 7, 1, 2, 3, 4, "x", "y", None, None, "s")
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
