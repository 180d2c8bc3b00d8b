"""What a crawled document passes before it is kept: content rules, one document per URL, counts per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.sites import SITES

LEAST_CHARS = 100


def least_chars(source: Column) -> Column:
    """The shortest text kept of a source: its own least length, but never below LEAST_CHARS."""
    out = F.lit(LEAST_CHARS)
    for s in SITES:
        if s.least_chars > LEAST_CHARS:
            out = F.when(source == s.name, F.lit(s.least_chars)).otherwise(out)
    return out


def content_filter(docs: DataFrame, by_source: bool = False) -> DataFrame:
    """Documents with a title, a text, and at least LEAST_CHARS characters of it (or what their source asks for)."""
    least = least_chars(F.col("source")) if by_source else F.lit(LEAST_CHARS)
    return docs.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "") & (F.length("text") >= least))


def stamped(docs: DataFrame) -> DataFrame:
    """docs with crawled_at, the time of this run as an ISO string."""
    return docs.withColumn("crawled_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def first_per_url(docs: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each URL in the given order; rows without a URL are one group.

    Partial minima go before the shuffle, so a group of any size, such as that without a URL, is a few rows by then.
    """
    first = docs.groupBy("url").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)).alias("row"))
    return first.select("row.*")


def new_urls(batch: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a batch whose URL isn't known yet, one per URL. No URL is a value like others: it is known once a row without one is."""
    seen = known.select(F.col("url").alias("seen_url")).distinct()
    return first_per_url(batch, order).join(seen, F.col("url").eqNullSafe(F.col("seen_url")), "left_anti")


def source_growth(before: DataFrame, after: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, before, after, added) from two (source, n) snapshots; sources without a row count as 0."""
    names = sources if sources is not None else before.select("source").union(after.select("source")).distinct()
    b, a = before.select("source", F.col("n").alias("before")), after.select("source", F.col("n").alias("after"))
    zero = F.lit(0)
    joined = names.join(b, "source", "left").join(a, "source", "left")
    return joined.select("source", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"), (F.coalesce("after", zero) - F.coalesce("before", zero)).alias("added"))


def blocked_sources(growth: DataFrame, least: int = 3) -> DataFrame:
    """(source, added, blocked): a source that added fewer than `least` documents in a cycle counts as blocked."""
    return growth.select("source", "added", (F.col("added") < least).alias("blocked"))
