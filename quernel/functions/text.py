"""Text functions as native Column expressions: tokens, stems, cleaning, years, URLs.

All of them are built-in JVM expressions. A stem is computed as a chain of array transforms, one rule
step each, so every step is evaluated once per word however often the next one looks at it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-zА-Яа-яЁё]+"
COUNTED_WORD = "[а-яёa-z]+"

# The endings that stemming removes, in their order.
RUSSIAN_ENDINGS = (
    "ивший ывший ующий ающий ённый анный енный ость ести ости ами ями ому ему ого его ых их ать ять еть ить "
    "ал ял ел ил ет ит ат ят ой ый ий ая яя ов ев ей ам ям ом ем ах ях ую юю ть ся а я о е и ы у ю"
).split()
ENGLISH_SUFFIXES = "ational ization fulness ousness iveness ation ness ment able ible ence ance ful ous ive ize ise ant ent al er or ly".split()


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_text(title: Column | str, text: Column | str) -> Column:
    """title + " " + text; null counts as empty."""
    return F.concat(F.coalesce(_text(title), F.lit("")), F.lit(" "), F.coalesce(_text(text), F.lit("")))


def tokens(c: Column | str) -> Column:
    """Runs of Latin and Russian letters, in lower case, in order, repeats kept. Null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(_text(c), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def counted_words(c: Column | str) -> Column:
    """Words for frequency counts: lower case first, at least two letters, no stemming."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_text(c), F.lit(""))), F.lit(COUNTED_WORD), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= 2)


def _ends(w: Column, ending: str) -> Column:
    return F.endswith(w, F.lit(ending))


def _drop(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def is_russian(w: Column) -> Column:
    """By the first letter alone; a comparison of bytes, as every word passes here."""
    return ((w >= "а") & (w < "ѐ")) | F.startswith(w, F.lit("ё"))


def _longest_first(w: Column, endings: list[str], fits: Callable[[Column, int], Column]) -> Column:
    """w without the first ending that it has and that may go; endings of one length are tested at once."""
    out = None
    for n in sorted({len(e) for e in endings}, reverse=True):
        same = [e for e in endings if len(e) == n]
        hit = fits(w, n) & F.substring(w, -n, n).isin(same)
        out = F.when(hit, _drop(w, n)) if out is None else out.when(hit, _drop(w, n))
    return out.otherwise(w)


def _long_enough(w: Column) -> Column:
    return ~is_russian(w) & (F.octet_length(w) >= 3)


def _plural(w: Column) -> Column:
    bare = F.when(_ends(w, "sses"), _drop(w, 2)).when(_ends(w, "ies"), _drop(w, 2)).when(_ends(w, "ss"), w).when(_ends(w, "s") & (F.octet_length(w) > 3), _drop(w, 1)).otherwise(w)
    return F.when(is_russian(w), _longest_first(w, RUSSIAN_ENDINGS, lambda x, n: F.length(x) >= n + 2)).when(_long_enough(w), bare).otherwise(w)


def _past(w: Column) -> Column:
    """Marks a word that lost -ed or -ing by a trailing blank: its last letter may be doubled."""
    n = F.octet_length(w)
    cut = (
        F.when(_ends(w, "eed"), F.when(n > 4, _drop(w, 2)).otherwise(w))
        .when(_ends(w, "ed") & (n > 4), F.concat(_drop(w, 2), F.lit(" ")))
        .when(_ends(w, "ing") & (n > 5), F.concat(_drop(w, 3), F.lit(" ")))
        .otherwise(w)
    )
    return cut


def _undouble(w: Column) -> Column:
    last = F.substring(w, -2, 1)
    twice = _ends(w, " ") & (F.length(w) > 2) & last.between("a", "z") & (last == F.substring(w, -3, 1))
    return F.when(twice, _drop(w, 2)).when(_ends(w, " "), _drop(w, 1)).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(_ends(w, "y") & (F.octet_length(w) > 2) & ~F.substring(w, -2, 1).isin(*"aeiou"), F.concat(_drop(w, 1), F.lit("i"))).otherwise(w)


def _suffix(w: Column) -> Column:
    return _longest_first(w, ENGLISH_SUFFIXES, lambda x, n: F.octet_length(x) > n + 2)


def _if_english(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda p: F.struct(p["english"].alias("english"), F.when(p["english"], step(p["w"])).otherwise(p["w"]).alias("w"))


def stems(words: Column | str) -> Column:
    """One stem per word of an array of lower-case words: one Russian ending, or the English rule steps."""
    marked = F.transform(_text(words), lambda w: F.struct(_long_enough(w).alias("english"), _plural(w).alias("w")))
    for step in (_past, _undouble, _last_y, _suffix):
        marked = F.transform(marked, _if_english(step))
    return F.transform(marked, lambda p: p["w"])


def with_stem(words: DataFrame, word: str, name: str) -> DataFrame:
    """words with a column of stems: the same steps as stems(), as projections over rows, which are compiled to one loop.

    Each step stays a projection of its own, as it uses the one before more than once. The one-element explode at
    the end keeps a later filter on the stem above them: pushed below, it would repeat every step in the next.
    """
    out = words.withColumn("_english", _long_enough(F.col(word))).withColumn(name, _plural(F.col(word)))
    for step in (_past, _undouble, _last_y, _suffix):
        out = out.withColumn(name, F.when(F.col("_english"), step(F.col(name))).otherwise(F.col(name)))
    return out.select(*[c for c in words.columns if c != name], F.explode(F.array(name)).alias(name))


def stem(word: Column | str) -> Column:
    """The stem of one lower-case word."""
    return F.element_at(stems(F.array(_text(word))), 1)


def terms(c: Column | str) -> Column:
    """The distinct stems of a text."""
    return F.array_distinct(stems(F.array_distinct(tokens(c))))


def collapse_space(c: Column | str) -> Column:
    """Any run of white space, of any script, becomes one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def strip_citations(c: Column | str) -> Column:
    """Without [12] and [править ...] marks; blanks stay as they are."""
    return F.regexp_replace(F.regexp_replace(_text(c), r"\[\d+\]", ""), r"\[править[^\]]*\]", "")


def year(*sources: Column | str) -> Column:
    """The first 20xx in the first source that has one, as a string; else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_text(s), r"20\d{2}", 0), F.lit("")) for s in sources])


def url_decoded(c: Column | str) -> Column:
    """Percent-decoded; + stays, and a URL with a bad escape stays as it is."""
    c = _text(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def slashes(c: Column | str) -> Column:
    """Number of / without those at the end."""
    bare = F.regexp_replace(_text(c), "/+$", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))


def url_join(base: Column | str, link: Column | str) -> Column:
    """The absolute URL of a link on a page: absolute, //host, /path, ?query, #part and relative paths with . and .. parts."""
    base, link = _text(base), F.trim(_text(link))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    path = F.when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
    parts = F.split(F.regexp_replace(F.regexp_extract(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/", ""), "/")
    tail = F.regexp_extract(path, r"([?#].*)$", 1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(p))),
    )
    ended = F.element_at(parts, -1).isin(".", "..")
    walked = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(ended & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")), tail)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(walked)
    )
