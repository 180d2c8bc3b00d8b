"""Shared helpers: Arrow batches of whole texts, written intermediates, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one call of a batch function sees; bounds its memory, not the input.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a new local one only in local mode, where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quernel-")
    return _own_dirs[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing will read it again."""
    path = getattr(df, "_written", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from `name`."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Bytes of one Arrow batch between the JVM and Python, so that long texts don't add up in either.
BATCH_BYTES = 4 << 20


def _release() -> None:
    """Give memory that a finished task freed back to the system: idle workers stay for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes. The bound is a setting of the session, read when a query runs, so it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """fn over Arrow slices of at most `rows` rows of the named columns only; whatever else df holds is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield out

    return in_arrow(df.select(*columns), run, schema)


def filter_batches(df: DataFrame, text_col: str, keep: Callable[[list[str]], np.ndarray], rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of df, all columns as they are, whose text keep() marks true."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(keep(texts_of(part.column(at))), pa.bool_()))

    return in_arrow(df, run, df.schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def held_out(doc_id: str, parts: int, part: int) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part


def crc_part(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the graph with edges (u, v), nodes that are their own smallest left out."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


#: Parts that the rows of one key are dealt to where a key may hold a large share of all rows; a set of parts is the bits of a long.
SALTS = 64


def salt(by: str) -> F.Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts_of(mask: str) -> F.Column:
    """Rows of the salts whose bits are set in the long `mask`."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftrightunsigned({mask}, s) & 1L) = 1L)"))


def least_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(of, part, least): the smallest `value` of each `key`, once for each salt that the key's values have.

    Joined on key and salt(value), so that a key with a large share of all rows is spread over SALTS parts.
    """
    whole = rows.groupBy(key).agg(F.min(value).alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    return whole.select(F.col(key).alias("of"), salts_of("mask").alias("part"), "least")


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Alternating star contraction; each round is written, so its lineage is one read. Rows never grow
    beyond the edges, nothing is gathered on one node: each star step is a minimum (partial sums first) joined
    back by node and salt, so that the centre of a large star is many parts.
    The rounds end when a round changes nothing (checked by an order-free digest of the edges); they grow with the logarithm
    of a component's size, and not to have ended after max_rounds is an error, not a result.
    """

    def contract(batches):
        for batch in batches:
            n, r = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(r)], names=["u", "v"])

    e = in_arrow(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v"), contract, "u long, v long").distinct()
    e = cut(e, name)
    here = (F.col("x") == F.col("of")) & (F.col("salt") == F.col("part"))
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of x goes to the smallest of x and its neighbours
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y"))).withColumn("salt", salt("y"))
        large = both.filter("y > x").join(least_of(both, "x", "y"), here).select(F.col("y").alias("x"), F.least("x", "least").alias("y")).distinct().withColumn("salt", salt("y"))
        # small star: every smaller neighbour of x, and x, goes to the smallest of them
        pairs = F.array(F.struct(F.col("y").alias("u"), F.col("least").alias("v")), F.struct(F.col("x").alias("u"), F.col("least").alias("v")))
        small = large.join(least_of(large, "x", "y"), here).select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct()
        new = cut(small, name)
        digest = new.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        forget(e)
        e = new
        if tuple(digest) == seen:
            break
        seen = tuple(digest)
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
