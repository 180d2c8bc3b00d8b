"""Incremental ingestion with Structured Streaming: one document per URL across runs, and a monitor of silent sources.

A run takes what is new since the last one (availableNow) and stops; the checkpoint holds what was seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quernel.operators.ingest import LEAST_CHARS, blocked_sources, new_urls, source_growth


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kept(docs: DataFrame) -> DataFrame:
    """The content rules, on a stream or a table."""
    return docs.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "") & (F.length("text") >= LEAST_CHARS))


def ingest_once(docs: DataFrame, target: str, checkpoint: str, key: str = "url", order: list[str] | None = None) -> StreamingQuery:
    """Append documents with a key that no run before had; the keys are kept as state, as many as there are documents.

    Without an order any row of a key may win in its first micro-batch. With one the first row wins; it is kept in state beside
    its key, and each micro-batch writes its own folder. For wide rows in order, ingest_against_table needs no state.
    """
    if order is None:
        stream = docs.dropDuplicates([key]).writeStream.format("parquet").option("path", target).outputMode("append")
    else:
        row, place = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)
        # the time is one value in a micro-batch, the same when it is run again
        rows = docs.select(F.col(key).alias("key"), row.alias("row"), place.alias("place"), F.current_timestamp().alias("at"))
        first = rows.groupBy("key").agg(F.min_by("row", "place").alias("row"), F.min("at").alias("since"), F.max("at").alias("until"))
        add = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        stream = first.filter("since = until").select("row.*").writeStream.outputMode("update").foreachBatch(add)
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_against_table(docs: DataFrame, target: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """The same without stream state: each micro-batch is compared with the URLs of the table. For URL sets too large for state.

    A micro-batch writes one folder named by its number, so a batch that is run again replaces its own rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        own = f"batch={number}"
        before = [str(s.getPath()) for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName() != own] if fs.exists(path) else []
        known = spark.read.schema(batch.schema).parquet(*before) if before else spark.createDataFrame([], batch.schema)
        new_urls(batch, known, order).write.mode("overwrite").parquet(f"{target}/{own}")

    query = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def monitor(before: DataFrame, after: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """(source, added, blocked, all_blocked) of one cycle from two corpus snapshots; every listed source appears."""
    count = lambda t: t.groupBy("source").agg(F.count("*").alias("n"))
    rows = blocked_sources(source_growth(count(before), count(after), sources), least)
    every = rows.agg(F.coalesce(F.bool_and("blocked"), F.lit(False)).alias("all_blocked"))
    return rows.crossJoin(F.broadcast(every))
