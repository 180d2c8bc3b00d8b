"""A stored index: posting blocks ordered by term, documents, and a small description with a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.index import Index, posting_blocks

FORMAT, VERSION = "quernel-index", 2


def save(index: Index, path: str) -> None:
    """Range-partitioned and sorted by term, so that a filter on terms skips files and row groups."""
    posting_blocks(index).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark = index.docs.sparkSession
    n_docs, n_terms = spark.read.parquet(f"{path}/docs").count(), spark.read.parquet(f"{path}/postings").select("term").distinct().count()
    spark.createDataFrame([(FORMAT, VERSION, n_terms, n_docs)], "format string, version int, n_terms long, n_docs long").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def describe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("format string, version int, n_terms long, n_docs long").json(f"{path}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta)


def load(spark: SparkSession, path: str) -> Index:
    """The stored index; a folder of another format or version is an error, not an empty index."""
    meta = describe(spark, path).first()
    if meta is None or meta["format"] != FORMAT or meta["version"] != VERSION:
        raise ValueError(f"{path} holds no index of format {FORMAT}, version {VERSION}")
    postings = spark.read.parquet(f"{path}/postings")
    pairs = postings.select("term", F.explode("doc_ids").alias("doc_id"))
    return Index(spark.read.parquet(f"{path}/docs"), pairs, postings)
