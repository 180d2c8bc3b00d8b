"""Corpus files: newline-delimited JSON in and out, ids for documents, replacing imports, exports to share."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "url", "title", "text", "category", "year", "crawled_at")])


def numbered(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with dense numbers from 0 in the order of its rows; no shuffle of df, one row per partition is counted and broadcast.

    The input's order has to be the same each time it is read, as that of files is.
    """
    marked = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int"))
    counts = sorted(marked.groupBy("_part").count().collect())
    starts = list(zip([p for p, _ in counts], accumulate([0, *[n for _, n in counts[:-1]]])))
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(offsets), "_part").select(place.alias(name), *df.columns)


def read_ndjson(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """Documents of .json or .json.gz files, one object per line; other lines and documents without title and text are left out.

    Escapes are read as JSON has them, and a missing key is the same as null.
    """
    lines = spark.read.text(path).filter(F.col("value").startswith("{"))
    docs = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    empty = F.lit("")
    docs = docs.filter((F.coalesce("title", empty) != empty) | (F.coalesce("text", empty) != empty))
    return numbered(docs) if numbers else docs


def write_ndjson(docs: DataFrame, path: str, gzip: bool = False) -> None:
    """One object per line, UTF-8, nulls kept as null; the column _id is left out."""
    writer = docs.drop("_id").write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def import_corpus(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Replace the table at target by the documents of NDJSON files, gzipped or not."""
    read_ndjson(spark, path, numbers=False).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def export_to_share(docs: DataFrame, path: str) -> int:
    """Gzipped NDJSON and the number of documents in it."""
    write_ndjson(docs, path, gzip=True)
    return docs.sparkSession.read.text(path).count()


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """A report of few rows (a top list) as one tab-separated file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def batch_queries(spark: SparkSession, path: str) -> dict[str, str]:
    """Queries of a text file, one per line, blank lines left out; a query list is small by nature."""
    lines = numbered(spark.read.text(path), "line").filter(F.length("value") > 0).orderBy("line").collect()
    return {f"q{r.line}": r.value for r in lines}
