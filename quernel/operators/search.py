"""Boolean search over an index: one query, many at once, limits, pages and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.index import Index
from quernel.plans.compile import COMPATIBLE, Flags, folded, needs_all_documents, predicate, resolve, stems_of

LIMIT = 50
PAGE = 50
#: Most stems that get a flag column each.
WIDE = 64
#: Most rows that are handed to the join with the documents by broadcast; more are joined as Spark sees fit.
FEW = 10_000


def _flagged(index: Index, stems: list[str], everything: bool) -> tuple[DataFrame, Callable[[list[str], bool], Column]]:
    """One row per document, and how to read from it whether it has all, or any, of some stems.

    Up to WIDE stems are a flag each; more are a set of those found. With `everything`, also for documents that have none.
    """
    if not stems:
        return index.docs.select("doc_id"), lambda own, every: F.lit(every)
    names = {s: f"has_{k}" for k, s in enumerate(stems)}
    if len(stems) <= WIDE:
        flags = [F.bool_or(F.col("term") == s).alias(n) for s, n in names.items()]
        has = lambda own, every: folded([F.coalesce(F.col(names[s]), F.lit(False)) for s in own], every)
    else:
        flags = [F.collect_set("term").alias("found")]
        found = F.coalesce("found", F.array().cast("array<string>"))
        listed = lambda own: F.split(F.lit(" ".join(own)), " ")  # noqa: E731  stems are letters
        has = lambda own, every: F.size(F.array_except(listed(own), found)) == 0 if every else F.arrays_overlap(listed(own), found)
    hits = index.lookup(stems).groupBy("doc_id").agg(*flags)
    if everything:
        hits = index.docs.select("doc_id").join(hits, "doc_id", "left")
    return hits, has


def matches(index: Index, tree: Flags) -> DataFrame:
    """(doc_id) of the documents that the tree holds for."""
    stems, everything = sorted(stems_of(tree)), needs_all_documents(tree)
    if not stems and not everything:
        return index.docs.select("doc_id").filter(F.lit(False))
    rows, has = _flagged(index, stems, everything)
    return rows.filter(predicate(tree, has)).select("doc_id")


def search(index: Index, query: str, stem_passes: int = COMPATIBLE) -> DataFrame:
    """(doc_id) of the hits; a query that can't be parsed stands for all of its words."""
    return matches(index, resolve(query, stem_passes))


def term_lookup(index: Index, word: str) -> DataFrame:
    """(doc_id) of the documents with the first word of `word`, stemmed once."""
    from quernel.functions.local_text import stem, tokens

    words = tokens(word)
    return index.lookup([stem(words[0])] if words else []).select("doc_id").distinct()


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def with_documents(index: Index, hits: DataFrame) -> DataFrame:
    return hits.join(index.docs, "doc_id")


def first(index: Index, hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first `limit` hits by id with their documents; only those ids meet the documents."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    few = hits.orderBy("doc_id").limit(limit)
    return index.docs.join(F.broadcast(few) if limit <= FEW else few, "doc_id").orderBy("doc_id")


def page(index: Index, hits: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """Page `number`, from 1, of the hits by id with their documents."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1 and hold at least one row")
    few = hits.orderBy("doc_id").offset((number - 1) * size).limit(size)
    return index.docs.join(F.broadcast(few) if size <= FEW else few, "doc_id").orderBy("doc_id")


def overflow(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(total, shown, more): how many hits a limit leaves out."""
    return hits.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(limit)).alias("shown"), F.greatest(F.col("total") - limit, F.lit(0)).alias("more"))


def batch(index: Index, queries: dict[str, str], stem_passes: int = COMPATIBLE) -> DataFrame:
    """(qid, doc_id) for many queries from one scan and one aggregation; each document's flags answer them all."""
    trees = {q: resolve(text, stem_passes) for q, text in queries.items()}
    if not trees:
        return index.docs.select(F.lit("").alias("qid"), "doc_id").filter(F.lit(False))
    stems = sorted(set().union(*map(stems_of, trees.values())))
    rows, has = _flagged(index, stems, any(map(needs_all_documents, trees.values())))
    found = [F.when(predicate(t, has), F.lit(q)) for q, t in trees.items()]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("qid")).select("qid", "doc_id")


def batch_totals(index: Index, queries: dict[str, str], stem_passes: int = COMPATIBLE) -> DataFrame:
    """(qid, total), also for queries without a hit."""
    spark: SparkSession = index.docs.sparkSession
    every = spark.createDataFrame([(q,) for q in queries], "qid string")
    counts = batch(index, queries, stem_passes).groupBy("qid").agg(F.count("*").alias("n"))
    return every.join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("total"))
