"""What a web front end asks for: search results and statistics as plain dictionaries, from a session that keeps its index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernel.operators import search, stats
from quernel.operators.index import Index

FIELDS = ["title", "url", "category"]


def _rows(found: DataFrame) -> list[dict]:
    return [{f: r[f] for f in FIELDS} for r in found.select("doc_id", *FIELDS).orderBy("doc_id").collect()]


def api_search(index: Index, query: str | None, limit: int = search.LIMIT) -> dict:
    """{total, documents}, at most `limit` of them; a blank query gives {error, documents: []}."""
    if not (query or "").strip():
        return {"error": "empty query", "documents": []}
    hits = search.search(index, query)
    return {"total": hits.count(), "documents": _rows(search.first(index, hits, limit))}


def search_page(index: Index, query: str | None, page: int = 1, size: int = search.PAGE) -> dict:
    """One page of results with what a pager needs; a blank query has none."""
    if not (query or "").strip():
        return {"query": "", "total": 0, "page": 1, "pages": 0, "documents": []}
    hits = search.search(index, query)
    n = hits.count()
    return {"query": query, "total": n, "page": page, "pages": -(-n // size), "documents": _rows(search.page(index, hits, page, size))}


def api_stats(docs: DataFrame) -> dict:
    """{total_docs, sources, categories}, or {error}."""
    try:
        return stats.site_stats(docs).first().asDict()
    except Exception as e:  # a front end shows what went wrong instead of failing
        return {"error": str(e).splitlines()[0]}
