"""Corpus statistics and the Zipf analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import counted_words
from quernel.sources.layout import spread

MIB = 1024 * 1024
#: Ranks in one piece of the Zipf fit.
PIECE = 1 << 16


def _length(c: str) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def corpus_stats(corpus: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row: documents, size of all string columns in MiB (bytes), size of the texts in MiB (characters), mean length, sources."""
    strings = [f.name for f in corpus.schema if f.dataType.simpleString() == "string"]
    raw = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in strings), F.lit(0))
    return corpus.agg(
        F.count("*").alias("total_docs"),
        (F.coalesce(F.sum(raw), F.lit(0)) / MIB).alias("raw_size_mb"),
        (F.coalesce(F.sum(_length(text_col)), F.lit(0)) / MIB).alias("text_size_mb"),
        F.coalesce(F.avg(_length(text_col)), F.lit(0.0)).alias("avg_text_chars"),
        F.sort_array(F.collect_set(source_col)).alias("sources"),
    )


def distinct_values(corpus: DataFrame, column: str) -> DataFrame:
    """Different values; null is one of them."""
    return corpus.select(column).distinct()


def site_stats(corpus: DataFrame) -> DataFrame:
    """(total_docs, sources, categories): a null counts as a value, so the counts are of distinct rows."""
    count = lambda c: corpus.select(c).distinct().agg(F.count("*").alias(f"n_{c}"))
    return corpus.agg(F.count("*").alias("total_docs")).crossJoin(count("source")).crossJoin(count("category")).select("total_docs", F.col("n_source").alias("sources"), F.col("n_category").alias("categories"))


def docs_per_source(corpus: DataFrame, source_col: str = "source") -> DataFrame:
    return corpus.groupBy(source_col).agg(F.count("*").alias("n"))


def count_of_source(corpus: DataFrame, source: str) -> DataFrame:
    return corpus.filter(F.col("source") == source).agg(F.count("*").alias("n"))


def latest(corpus: DataFrame, by: str, n: int = 5, tie: str | None = None) -> DataFrame:
    """The n latest rows by a column, newest first."""
    return corpus.orderBy(F.desc(by), *([F.desc(tie)] if tie else [])).limit(n)


def latest_with_text(corpus: DataFrame, n: int = 5) -> DataFrame:
    """(source, title, chars, crawled_at) of the n documents crawled last, of those that have a text."""
    rows = corpus.filter(F.coalesce("text", F.lit("")) != "").select("source", "title", F.length("text").alias("chars"), "crawled_at")
    return latest(rows, "crawled_at", n, "title")


def term_frequency(text: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, freq) of all words of at least two letters, unstemmed."""
    return spread(text).select(F.explode(counted_words(text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def top_frequencies(freq: DataFrame, n: int = 30) -> DataFrame:
    """(rank, term, frequency) of the n most frequent terms; ties in term order."""
    top = freq.orderBy(F.desc("freq"), "term").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("freq"), "term")).alias("rank"), "term", F.col("freq").alias("frequency"))


def ranked(freq: DataFrame) -> DataFrame:
    """(term, freq, rank), rank 1 for the most frequent, ties in term order.

    No window runs over all rows: half of a vocabulary may share the frequency 1. Terms are numbered among
    those of their frequency and first letters, and only the counts of such groups are summed in order.
    """
    rows = freq.filter("freq > 0").withColumn("head", F.substring("term", 1, 3))
    order = Window.orderBy(F.desc("freq"), "head").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("freq", "head").agg(F.count("*").alias("n")).select("freq", "head", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("above"))
    within = rows.withColumn("place", F.row_number().over(Window.partitionBy("freq", "head").orderBy("term")))
    return within.join(groups, ["freq", "head"]).select("term", "freq", (F.col("above") + F.col("place")).alias("rank"))


def rank_groups(freq: DataFrame) -> DataFrame:
    """(freq, n, above): how many terms have a frequency, and how many have a higher one. All that the fit needs."""
    per = freq.filter("freq > 0").groupBy("freq").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("freq", "n", above.alias("above"))


def zipf_fit(freq: DataFrame) -> DataFrame:
    """(n, alpha, c, r2): least squares of ln freq on ln rank. r2 is null where all frequencies are equal.

    Ties don't matter to the fit, so ranks are made from the counts of each frequency, without a global sort: ranges of ranks,
    in pieces of PIECE at most, are dealt out and summed where they lie.
    """
    first, end = F.col("above") + 1, F.col("above") + F.col("n")
    pieces = rank_groups(freq).select("freq", end.alias("end"), F.explode(F.sequence(first, end, F.lit(PIECE))).alias("low"))
    pieces = pieces.repartition(freq.sparkSession.sparkContext.defaultParallelism, "low")
    points = pieces.select(F.log("freq").alias("y"), F.explode(F.sequence("low", F.least(F.col("low") + (PIECE - 1), "end"))).alias("rank")).select("y", F.log("rank").alias("x"))
    fit = points.agg(F.count("*").alias("n"), (-F.regr_slope("y", "x")).alias("alpha"), F.exp(F.regr_intercept("y", "x")).alias("c"), F.regr_r2("y", "x").alias("r2"), (F.min("y") == F.max("y")).alias("flat"))
    return fit.select("n", "alpha", "c", F.when(~F.col("flat"), F.col("r2")).alias("r2"))


def zipf_curve(freq: DataFrame, fit: DataFrame, n: int | None = None) -> DataFrame:
    """(rank, term, freq, theoretical): the fitted c / rank^alpha beside each term; the fit is one row, broadcast."""
    rows = ranked(freq) if n is None else top_frequencies(freq, n).select("term", F.col("frequency").alias("freq"), "rank")
    return rows.crossJoin(F.broadcast(fit.select("alpha", "c"))).select("rank", "term", "freq", (F.col("c") / F.pow(F.col("rank").cast("double"), F.col("alpha"))).alias("theoretical"))


def frequency_stats(freq: DataFrame) -> DataFrame:
    """One row: words, distinct words, largest, smallest, mean and median frequency, words that occur once and their percentage."""
    once = F.count_if(F.col("freq") == 1)
    return freq.agg(
        F.coalesce(F.sum("freq"), F.lit(0)).alias("total_words"),
        F.count("*").alias("unique_words"),
        F.max("freq").alias("max_freq"),
        F.min("freq").alias("min_freq"),
        F.avg("freq").alias("mean_freq"),
        F.median("freq").alias("median_freq"),
        once.alias("hapax"),
        (F.lit(100.0) * once / F.nullif(F.count("*"), F.lit(0))).alias("hapax_percent"),
    )


def verdict(alpha: Column) -> Column:
    """How close an exponent is to the law's: good from 0.8 to 1.2, partial from 0.5 to 1.5, else deviates."""
    return F.when(alpha.between(0.8, 1.2), "good").when(alpha.between(0.5, 1.5), "partial").otherwise("deviates")
