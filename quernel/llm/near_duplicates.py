"""Operator 6: MinHash near-duplicates with tensored banding.

A shingle set has two small collections of TABLES band hashes, each over ROWS minimum hashes. A table key
is a pair, one band of either collection: 2 * TABLES * ROWS minimum hashes serve TABLES ** 2 tables. Two
sets of similarity s miss all tables with probability 1 - (1 - (1 - s^ROWS)^TABLES)^2: 2.2e-5 at 0.85.

Sets that share a table key form families (connected over a hub per key). Inside a family every pair of
full sets is checked exactly, in blocks of bounded size, so no link between candidates is lost and no
pair leaves its task: a task returns only a spanning star of the links it found. Equal sets are one node.

Defined cases: null or empty text has an empty set, linked with nothing; fewer words than a shingle give
one shingle of all words; equal rows are linked; an empty table gives no row; columns other than doc_id
and text are ignored. doc_id identifies a row; a null one keeps a null component and kept false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import components, cut, documents, in_arrow, local_roots, map_batches, texts_of
from quernel.llm.hashing import Prefix, mix

SHINGLE, PERCENT = 3, 85
TABLES, ROWS = 12, 3
#: Shingles in one block of a family's sets; a task holds two blocks.
BLOCK_SHINGLES = 300_000

_U = np.uint64
_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SEEDS = mix(np.arange(1, 2 * TABLES * ROWS + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)


#: Bytes that are hashed at once; a longer text is hashed alone.
HASH_BYTES = 1 << 20


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes of its word shingles; words as [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    out, run, held = [], [], 0
    for r in raw:
        if run and held + len(r) > HASH_BYTES:
            out += sets_of(run, size)
            run, held = [], 0
        run.append(r)
        held += len(r)
    return out + sets_of(run, size) if run else out


def sets_of(raw: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    words = Prefix(data).span(starts, ends)
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    bounds = np.concatenate([[0], np.searchsorted(starts, doc_ends)])
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = mix(rolled * _U(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k])
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif n:
            h = _U(n)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    h = mix(np.array([h * _U(0xD1B54A32D192ED03) + words[k]]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands(one: np.ndarray) -> np.ndarray:
    """2 * TABLES band hashes of a set: the two collections one after the other."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(one), 4096):
        x = one[at : at + 4096]
        h = x[None, :] * _SEEDS[:, None]
        h ^= h >> _U(32)
        least = np.minimum(least, (h * _U(0x9E3779B97F4A7C15)).min(axis=1))
    groups = least.reshape(2 * TABLES, ROWS)
    h = np.arange(1, 2 * TABLES + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * _U(0xC2B2AE3D27D4EB4F) + groups[:, k])
    return h


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): set size, a 128-bit digest of the set, and its band hashes (null for an empty set)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(1)), size)
        digests = np.array([(mix(s).sum(dtype=np.uint64), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), keys], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return map_batches(docs, ["doc_id", "text"], fn, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def hub_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) come sorted; every later node of a key is joined with the key's first."""
    key, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        first = np.where(new, np.arange(len(k)), -1)
        np.maximum.accumulate(first, out=first)
        hubs = np.where(first >= 0, node[np.maximum(first, 0)], hub if hub is not None else 0)
        key, hub = k[-1], hubs[-1]
        keep = hubs != node
        if keep.any():
            e = np.unique(np.stack([node[keep], hubs[keep]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])


def links_between(sets: list[np.ndarray], ids: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of every left set with every right set: 100 * intersection >= percent * union. Counts by postings of the right side."""
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.repeat(np.arange(len(right)), sizes[right])
    values = np.concatenate([sets[k] for k in right])
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    u, v = [], []
    for x in left.tolist():
        low = np.searchsorted(values, sets[x], side="left")
        high = np.searchsorted(values, sets[x], side="right")
        n = high - low
        ends = np.cumsum(n)
        total = int(ends[-1])
        hit = owners[np.arange(total) + np.repeat(low - (ends - n), n)]
        common = np.bincount(hit, minlength=len(right))
        linked = right[100 * common >= percent * (sizes[x] + sizes[right] - common)]
        linked = linked[ids[linked] != ids[x]]
        u.append(np.full(len(linked), ids[x]))
        v.append(ids[linked])
    return np.concatenate(u), np.concatenate(v)


def verify_blocks(percent: int):
    """Rows (family, p, q, part, node, set) come sorted by the first three: check a group's links, return a spanning star of each part."""

    def finish(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        p, q = rows[0][1], rows[0][2]
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        ids = np.array([r[4] for r in rows], np.int64)
        part = np.array([r[3] for r in rows])
        every = np.arange(len(rows))
        u, v = links_between(sets, ids, every if p == q else every[part == p], every if p == q else every[part == q], percent)
        if not len(u):
            return None
        node, root = local_roots(u, v)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != group:
                    out = finish(rows)
                    if out is not None:
                        yield out
                    group, rows = row[:3], []
                rows.append(row)
        out = finish(rows)
        if out is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(signatures(docs, size), "near-signatures")
    whole = sig.filter("n_shingles > 0 and doc_id is not null")
    reps = whole.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    pair = F.flatten(F.transform(F.slice("bands", 1, TABLES), lambda x, i: F.transform(F.slice("bands", TABLES + 1, TABLES), lambda y, j: F.xxhash64(x, y, i, j))))
    keys = reps.select(F.explode(pair).alias("k"), F.col("rep").alias("node"))
    edges = in_arrow(keys.repartition("k").sortWithinPartitions("k", "node"), hub_edges, "u long, v long").distinct()
    family = cut(components(edges, "near-families"), "near-family")
    sizes = whole.select(F.col("doc_id").alias("node"), "n_shingles")
    counted = family.join(sizes, "node").groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).cast("int").alias("blocks"))
    placed = family.join(counted, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(4)), size)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())], names=["component", "node", "blocks", "part", "set"])

    texts = docs.join(placed.hint("shuffle_hash"), docs.doc_id == placed.node)
    sets = map_batches(texts, ["component", "node", "blocks", "part", "text"], fn, "component long, node long, blocks int, part int, set binary")
    blocks = sets.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "part", "node", "set").select("component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "set")
    links = in_arrow(blocks.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q"), verify_blocks(percent), "u long, v long")
    found = components(links, "near-links")
    classes = reps.select("n_shingles", "d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("c"))
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
