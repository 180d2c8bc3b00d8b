"""The inverted index as DataFrames: documents, (term, doc_id) pairs, posting lists, frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import joined_text, tokens, with_stem
from quernel.functions.text import terms as distinct_terms
from quernel.sources.layout import spread


#: Ids of documents in one block: a term has a row for each block it occurs in, never one row for all of its documents.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Index:
    """docs(doc_id, title, url, category, source) and occurrences(term, doc_id).

    An occurrence is a different word of a document, so a pair comes again where two words share a stem;
    pairs() has each once. postings is set where the index was read from disk: (term, block, doc_ids, n), by term and block.
    """

    docs: DataFrame
    occurrences: DataFrame
    postings: DataFrame | None = None
    terms: DataFrame | None = None

    def pairs(self) -> DataFrame:
        return self.occurrences if self.postings is not None else self.occurrences.distinct()

    def lookup(self, stems: list[str]) -> DataFrame:
        """Occurrences of the given terms; the filter reaches the scan of a stored index."""
        if self.postings is not None:
            return self.postings.filter(F.col("term").isin(stems)).select("term", F.explode("doc_ids").alias("doc_id"))
        return self.occurrences.filter(F.col("term").isin(stems))


FORWARD = ["title", "url", "category", "source"]


def accepted(corpus: DataFrame) -> DataFrame:
    """Documents with a title or a text; null counts as empty."""
    empty = F.lit("")
    return corpus.filter((F.coalesce("title", empty) != empty) | (F.coalesce("text", empty) != empty))


def build(corpus: DataFrame) -> Index:
    """corpus: doc_id, title, text, and what there is of url, category, source. Words are distinct per document before any shuffle."""
    corpus = accepted(corpus)
    have = set(corpus.columns)
    docs = corpus.select("doc_id", *[(F.coalesce(c, F.lit("")) if c in have else F.lit("")).alias(c) for c in FORWARD])
    words = spread(corpus).select("doc_id", F.explode(F.array_distinct(tokens(joined_text("title", "text")))).alias("word"))
    terms = spread(corpus).select(F.explode(distinct_terms(joined_text("title", "text"))).alias("term"))
    return Index(docs, with_stem(words, "word", "term").select("term", "doc_id"), terms=terms)


def posting_blocks(index: Index) -> DataFrame:
    """(term, block, doc_ids ascending, n); one shuffle, on term and block, in which repeated occurrences fall together.

    A row holds at most BLOCK ids, and a term of all documents is spread over as many tasks as it has blocks.
    """
    if index.postings is not None:
        return index.postings
    block = F.floor(F.col("doc_id") / BLOCK)
    lists = index.occurrences.groupBy("term", block.alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    return lists.select("term", "block", "doc_ids", F.size("doc_ids").cast("long").alias("n"))


def posting_lists(index: Index) -> DataFrame:
    """(term, doc_ids ascending, df): whole lists, for terms that aren't in too many documents for one row. Stored are blocks."""
    blocks = posting_blocks(index).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("block", "doc_ids"))).alias("b"), F.sum("n").alias("df"))
    return blocks.select("term", F.flatten("b.doc_ids").alias("doc_ids"), "df")


def document_frequency(index: Index) -> DataFrame:
    """(term, df) by counts alone; no list of documents is built, and only partial counts are shuffled."""
    if index.postings is not None:
        return index.postings.groupBy("term").agg(F.sum("n").alias("df"))
    if index.terms is not None:
        return index.terms.groupBy("term").agg(F.count("*").alias("df"))
    return index.pairs().groupBy("term").agg(F.count("*").alias("df"))


def top_terms(index: Index, n: int = 20) -> DataFrame:
    """The n terms in most documents; ties in term order."""
    return document_frequency(index).orderBy(F.desc("df"), "term").limit(n)


def intersect(a: Column, b: Column) -> Column:
    """Ascending ids in both posting lists."""
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    """Ascending ids in either posting list, each once."""
    return F.array_sort(F.array_union(a, b))


def negate(a: Column, n_docs: Column) -> Column:
    """Ascending ids below n_docs that aren't in the posting list."""
    everything = F.when(n_docs > 0, F.sequence(F.lit(0).cast("long"), n_docs.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return without(everything, a)


def without(everything: Column, a: Column) -> Column:
    """Ids of the ascending list of all documents that aren't in the posting list; ids may have gaps."""
    return F.array_except(everything, a)
