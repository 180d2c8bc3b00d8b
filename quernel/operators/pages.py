"""From raw pages to corpus rows: titles, texts, categories, years, links. The HTML parse is the only Python here, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import html
from quernel.functions.text import collapse_space, strip_citations, url_join, year
from quernel.operators.sites import SITES, category_of, link_kind, skipped_title


@dataclass(frozen=True)
class Layout:
    """Selectors of one site. texts are joined in order where joined is true, else they are one selection; fallbacks follow while nothing was found."""

    title: list[str]
    texts: list[str]
    joined: bool = False
    fallback: tuple[str, ...] = ()
    category: str | None = None
    dates: tuple[str, ...] = ()
    citations: bool = False


_P = "article p::text, .article-content p::text, .content p::text"
# Where each site's pages keep title, text, category and date.
LAYOUTS = {
    "journaldoctor": Layout(
        ["h1::text", ".article-title::text, title::text"],
        ["#tabs-1 p::text", "#tabs-2 p::text", "#tabs-3 p::text", ".tab-content p::text", ".article-content p::text", "article p::text", ".content p::text"],
        True, ("p::text",), ".category::text, .tag::text, .rubric::text", (".date::text, .published::text, time::text",),
    ),
    "bnews": Layout(
        ['meta[property="og:title"]::attr(content)', "h1::text, h2.article-title::text", "title::text"],
        ['meta[property="og:description"]::attr(content)'], False, ('meta[name="description"]::attr(content)',), None,
        ('meta[property="article:published_time"]::attr(content)', "time::attr(datetime)", ".date::text, time::text"),
    ),
    "rmj": Layout(
        ["h1::text", 'meta[property="og:title"]::attr(content)', ".article-title::text"],
        [".article-resume p::text", ".article-abstract p::text", ".resume p::text", "#resume p::text", ".article-text p::text", ".article-content p::text", "article p::text"],
        True, ('meta[name="description"]::attr(content)', "p::text"), None, (".article-date::text, .date::text, time::text", 'meta[property="article:published_time"]::attr(content)'),
    ),
    "wikipedia": Layout(["#firstHeading span::text", "#firstHeading::text", "h1.firstHeading::text", "h1::text"], ["#mw-content-text .mw-parser-output > p ::text"], category="#mw-normal-catlinks a::text", citations=True),
    "ruwiki": Layout(["h1.firstHeading::text", "h1::text"], ["div.mw-parser-output p::text"], category="div.mw-normal-catlinks a::text", citations=True),
    "probolezny": Layout(["h1::text", "title::text"], [_P + ", .disease-content p::text, p::text"], category=".category::text, .tag::text, .specialty::text", dates=(".date::text, time::text, .published::text",)),
    "takzdorovo": Layout(["h1::text, .article-title::text", "title::text"], [_P + ", .text p::text, p::text"], category=".category::text, .tag::text, .rubric::text", dates=(".date::text, time::text",)),
    "clinickrasnodar": Layout(["h1::text, .article-title::text", "title::text"], [_P + ", .text p::text, p::text"], category=".category::text, .tag::text, .specialty::text", dates=(".date::text, time::text",)),
    "bigenc": Layout(["h1::text, .title::text", "title::text"], [_P + ", .text p::text, .entry-content p::text, p::text"], dates=(".date::text, time::text",)),
}
_BNEWS_BODY = "article p::text, .article-content p::text, .post-content p::text, .content p::text, main p::text"
_BNEWS_PREFIXES = ["B—News — ", "B-News — "]
_BNEWS_SHORT = 200


def _found(tree: html.Element, site: str) -> tuple[str | None, str, str | None, list[str]]:
    """(title, text, category, dates) as the page has them, before cleaning."""
    layout = LAYOUTS[site]
    title = html.first(tree, layout.title)
    if layout.joined:
        parts = [t for s in layout.texts for t in html.select(tree, s)]
    else:
        parts = html.select(tree, layout.texts[0])
    if site == "bnews":  # a description stands for the text unless it is short
        text = html.first(tree, [*layout.texts, *layout.fallback]) or ""
        if len(text) < _BNEWS_SHORT:
            body = [t.strip() for t in html.select(tree, _BNEWS_BODY)]
            text = " ".join(t for t in body if t) or text
        parts = [text or title or ""]
    for s in layout.fallback if not parts else ():
        parts = html.select(tree, s)
        if parts:
            break
    if not layout.joined:
        parts = [t.strip() for t in parts if t.strip()]
    category = html.first(tree, [layout.category]) if layout.category else None
    return title, " ".join(parts), category, [d for s in layout.dates if (d := html.first(tree, [s]))]


def extract(pages: DataFrame, site: str, id_col: str = "page_id") -> DataFrame:
    """(id, source, url, title, text, category, year) of pages(id, url, html) by one site's layout; pages without a title or with too short a text are left out."""
    rules = next(s for s in SITES if s.name == site)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*[_found(html.parse(h), site) for h in batch.column(2).to_pylist()])) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(got, kinds)]], names=["id", "url", "title", "text", "category", "dates"])

    id_type = pages.schema[id_col].dataType.simpleString()
    raw = pages.select(id_col, "url", "html").mapInArrow(run, f"id {id_type}, url string, title string, text string, category string, dates array<string>")
    title = F.col("title")
    if site == "bnews":
        for p in _BNEWS_PREFIXES:
            title = F.replace(title, F.lit(p), F.lit(""))
    text = collapse_space("text")
    if LAYOUTS[site].citations:
        text = strip_citations(text)
    named = F.coalesce(F.nullif(F.trim("category"), F.lit("")), category_of(site, F.col("url")), F.lit(rules.default_category))
    found = F.filter(F.transform("dates", lambda d: F.regexp_extract(d, r"20\d{2}", 0)), lambda y: y != "")
    when = F.try_element_at(found, F.lit(1))
    if site == "journaldoctor":
        when = F.coalesce(year("url"), when)
    out = raw.filter("title is not null and title <> ''").select(F.col("id").alias(id_col), F.lit(site).alias("source"), "url", F.trim(title).alias("title"), text.alias("text"), named.alias("category"), when.alias("year"))
    return out.filter((F.length("text") >= rules.least_chars) & ~skipped_title(site, F.col("title")))


def parsed(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, title, h1, paragraphs, metas, links) of each page: direct texts of paragraphs, meta contents by name or property, hrefs in order."""

    def one(page: str | None) -> tuple:
        tree = html.parse(page)
        metas = {e.attrs.get("property") or e.attrs["name"]: e.attrs.get("content", "") for e in tree.walk() if e.tag == "meta" and (e.attrs.get("property") or e.attrs.get("name"))}
        return html.first(tree, ["title::text"]), html.first(tree, ["h1::text"]), html.select(tree, "p::text"), list(metas.items()), html.select(tree, "a::attr(href)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*[one(h) for h in batch.column(1).to_pylist()])) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(got, kinds)]], names=["id", "title", "h1", "paragraphs", "metas", "links"])

    id_type = pages.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, title string, h1 string, paragraphs array<string>, metas map<string,string>, links array<string>"
    return pages.select(id_col, "html").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title, h1) by pattern alone, without a parse."""
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1).alias("h1"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, place, text): what directly follows a <p> up to the next tag, white space collapsed, empty ones left out."""
    found = F.regexp_extract_all("html", F.lit(r"<p[^>]*>([^<]*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "raw"))
    return rows.select("page_id", "place", F.trim(F.regexp_replace("raw", r"[ \t\n\r\f\x0b]+", " ")).alias("text")).filter("text <> ''")


def links(pages: DataFrame, site: str | None = None) -> DataFrame:
    """(page_id, place, href, url): every link of a page, and its absolute form; of a site, with its kind, only those that are followed."""
    found = F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(found).alias("place", "href")).select("page_id", "place", "href", url_join("base", "href").alias("url"))
    return rows if site is None else rows.withColumn("kind", link_kind(site, F.col("url"))).filter("kind is not null")
