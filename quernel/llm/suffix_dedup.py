"""Operator 5: removal of repeated byte strings by a distributed difference-cover suffix sort.

Sorting every suffix of the corpus would shuffle many times its size, so the sort is dealt out first:

1. Every start of a string of `length` bytes has an anchor: the smallest 16-byte gram of the WINDOW grams from
   it on, the first of equal ones. It depends on the string alone, so equal strings have it at the same
   distance. Starts with one anchor, at distances of one range of RANGE, are handled together.
2. The strings at such a range of starts share a core, the bytes that are in all of them. Ranges are dealt
   out by a hash of their core; one whose core is unique is done. Ranges equal in all of their bytes (core
   and both sides) are repeated in full and need no sort.
3. What is left lies at the edge of a repeat: of each different pair of sides of a core, one is kept, as a
   text of at most RANGE - 1 bytes, the core as one symbol, and RANGE - 1 bytes. A task joins the texts of
   its cores and sorts their suffixes by difference cover: sampled triples are sorted and named, the names
   are sorted by recursion, the remaining suffixes are merged in. Neighbours in that order with an equal
   prefix, as long as a string, are repeats.
4. A core with more than HOT different sides isn't gathered: each of its ranges is divided where it stands
   into ranges of STEP, judged like the larger ones but by counts with partial sums, and only at an edge
   string by string.

Spans are then joined to their document, whose text is cut. What 1, 2 and 4 call equal agrees in two 64-bit
hashes (core and sides; core and string), so n ranges hold a wrong match with a probability below n * n / 2^128:
3e-15 for the 10^12 ranges of some 50 TB of text. The suffix order compares bytes.

Defined cases: null text is empty; texts shorter than a string are kept whole; equal rows repeat each
other; an empty table gives no row; columns other than doc_id and text are ignored, whatever their names.
doc_id identifies a row; a row without one takes part under a negative hash of its text. A text of any
length is handled alone (some 40 bytes of memory for each of its bytes).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, documents, forget, fresh, in_arrow, map_batches
from quernel.llm.hashing import BYTE_VALUES, Prefix, _powers, mix
from quernel.llm.suffixes import equal_prefixes, suffix_array

LENGTH, GRAM, WINDOW, RANGE = 400, 16, 128, 64
SIDE = RANGE - 1
#: A passage: a maximal run covered by repeated strings of PASSAGE bytes that holds PASSAGE_WORDS words or more.
#: 51 words with a blank after each are longer than 200 bytes from three letters a word on.
PASSAGE, PASSAGE_WORDS = 200, 51
#: Most different sides of one core that are gathered for one sort; symbols that one sort takes.
HOT, SORT_SYMBOLS = 500, 500_000
#: Starts that are judged together in a core with more sides than that.
STEP = 8
#: Bits of a position beside a gram's hash: texts are below 2 GiB.
PLACE_BITS = 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_U = np.uint64


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.empty((n // 8) * 8, np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(raw[k : k + (n // 8) * 8].tobytes(), "<u8")
    count = n - GRAM + 1
    h = words[:count] * _U(0x9E3779B97F4A7C15) ^ (words[8 : 8 + count] * _U(0xC2B2AE3D27D4EB4F) >> _U(3))
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def ranges(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, part): first start of each range of RANGE starts that share an anchor, and which range of its distances it is.

    Only ranges with at least one string inside the text; others of their starts may lie outside.
    """
    n = len(data)
    strings = n - length + 1
    if strings < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = _U((1 << PLACE_BITS) - 1)
    least = grams(data) & ~low | np.arange(n - GRAM + 1, dtype=np.uint64)  # equal hashes: the first, whatever its gram
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least[:strings] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], strings) - 1
    anchor = anchor[first]
    starts, parts = [], []
    for part in range(WINDOW // RANGE):
        start = anchor - part * RANGE - SIDE
        hit = (first <= start + SIDE) & (last >= start)
        starts.append(start[hit])
        parts.append(np.full(int(hit.sum()), part))
    return np.concatenate(starts), np.concatenate(parts)


MEMBER = np.dtype([("doc", "<i8"), ("start", "<i4")])


def range_rows(docs: DataFrame, length: int) -> DataFrame:
    """(r, f, n, members): core hash, hash of core and sides, and the ranges (doc_id, start as packed numbers) that have both, collapsed within a batch."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        r, f, doc, at = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or text is None:
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            start, part = ranges(data, length)
            if not len(start):
                continue
            sums = Prefix(data)
            low, high = np.maximum(start, 0), np.minimum(start + length + SIDE, len(data))
            r.append(mix(sums.span(start + SIDE, start + length) + part.astype(np.uint64)))
            f.append(mix(sums.span(low, high) ^ ((low - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))))
            at.append(start)
            doc.append(np.full(len(start), i, np.int64))
        if not r:
            return None
        r, f, doc, at = np.concatenate(r).view(np.int64), np.concatenate(f).view(np.int64), np.concatenate(doc), np.concatenate(at)
        order = np.lexsort([f, r])
        r, f, doc, at = r[order], f[order], doc[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])]))
        members = np.empty(len(r), MEMBER)
        members["doc"], members["start"] = doc, at
        ends = np.append(first, len(r))
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * MEMBER.itemsize).astype(np.int32).tobytes()), pa.py_buffer(members.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(f[first]), pa.array(np.diff(ends).astype(np.int32)), packed], names=["r", "f", "n", "members"])

    return map_batches(docs, ["doc_id", "text"], fn, "r long, f long, n int, members binary")


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (r, f). Gives (doc_id, start, r): every range that is repeated in full with r null, and, where a
    core has different sides, one range of each with its r. Nothing of a core is held but its last sides."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("r", pa.int64())])
    held = None  # [r, f, packed first row, whether rows of this f were given already]
    split = False  # whether this r has shown another f; then the held f's range is given too

    def edge(row) -> tuple[int, int, int]:
        m = np.frombuffer(row[2], MEMBER, 1)[0]
        return int(m["doc"]), int(m["start"]), row[0]

    for batch in batches:
        full, edges = [], []
        r, f, n = (batch.column(k).to_numpy() for k in range(3))
        # rows whose r is alone in this batch's neighbourhood are skipped in bulk
        lone = np.ones(len(r), bool)
        lone[1:] &= r[1:] != r[:-1]
        lone[:-1] &= r[:-1] != r[1:]
        if len(r):
            lone[[0, -1]] = False
        members = batch.column(3)
        for k in np.flatnonzero(~lone | (n > 1)).tolist():
            key, own = int(r[k]), int(f[k])
            data = members[k].as_py()
            if held is None or held[0] != key:
                held, split = [key, own, data, False], False
            elif held[1] != own:
                if not split:
                    edges.append(edge(held))
                    split = True
                held = [key, own, data, False]
                edges.append(edge(held))
            else:
                if not held[3]:
                    full.append(held[2])
                    held[3] = True
                full.append(data)
                continue
            if n[k] > 1:
                full.append(data)
                held[3] = True
        if full or edges:
            m = np.frombuffer(b"".join(full), MEMBER)
            doc = np.concatenate([m["doc"], np.array([e[0] for e in edges], np.int64)])
            start = np.concatenate([m["start"], np.array([e[1] for e in edges], np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array([None] * len(m) + [e[2] for e in edges], pa.int64())], schema=schema)


def repeats(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(doc_id, first, last) starts of repeated strings among ranges (r, doc_id, start, left, right), by their suffix order.

    A range's text is left, its core as one symbol, right; the string at its t-th start is the RANGE symbols from t on.
    """
    n = len(rows)
    r = np.array([x[0] for x in rows], np.int64)
    lefts, rights = np.array([len(x[3]) for x in rows], np.int64), np.array([len(x[4]) for x in rows], np.int64)
    sizes = lefts + rights + 2  # the core and an end mark below all bytes
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(n), sizes)
    joined = np.zeros(int(sizes.sum()), np.int64)
    raw = np.frombuffer(b"".join(x[3] + b"\0" + x[4] + b"\0" for x in rows), np.uint8)
    joined[:] = raw.astype(np.int64) + 1
    _, core = np.unique(r, return_inverse=True)
    joined[begin + lefts] = 257 + core
    joined[begin + sizes - 1] = 0
    order = suffix_array(joined)
    own = owner[order]
    place = order - begin[own]
    inside = (place <= lefts[own]) & (place + RANGE <= sizes[own] - 1)
    order, own, place = order[inside], own[inside], place[inside]
    if not len(order):
        return []
    g = equal_prefixes(joined, order, RANGE)
    doc = np.array([x[1] for x in rows], np.int64)[own]
    at = np.array([x[2] for x in rows], np.int64)[own] + SIDE - lefts[own] + place
    order = np.lexsort([at, doc, g])
    g, d, a = g[order], doc[order], at[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1])])
    g, d, a = g[new], d[new], a[new]  # one row for each place of a string
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    d, a = d[hit], a[hit]
    if not len(d):
        return []
    order = np.lexsort([a, d])
    d, a = d[order], a[order]
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1)]))
    last = np.append(at[1:], len(d)) - 1
    return list(zip(d[at].tolist(), a[at].tolist(), a[last].tolist()))


def divided(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ranges (r, doc_id, start, left, right) as ranges of STEP starts: first and last start, hash of the common part, hash of all of it, hash of each string."""
    n = batch.num_rows
    r, doc, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
    gone = SIDE - np.fromiter(map(len, left), np.int64, n)  # starts before the text
    most = np.fromiter(map(len, right), np.int64, n)  # the last start inside the text
    a = np.frombuffer(b"".join(x.rjust(SIDE, b"\0") for x in left), np.uint8).reshape(n, SIDE)
    b = np.frombuffer(b"".join(x.ljust(SIDE, b"\0") for x in right), np.uint8).reshape(n, SIDE)
    weight = _powers.get(SIDE)[0][:SIDE]
    # hashes of left[t:] and right[:t]; strings of one t are compared, so their places are the same
    before, after = np.zeros((n, RANGE), np.uint64), np.zeros((n, RANGE), np.uint64)
    before[:, :SIDE] = np.cumsum((BYTE_VALUES[a] * weight)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    after[:, 1:] = np.cumsum(BYTE_VALUES[b] * weight, axis=1, dtype=np.uint64)
    before, after = mix(before) * _U(0xD1B54A32D192ED03), mix(after)

    def pair(row: np.ndarray, low: np.ndarray, high: np.ndarray, salt: int) -> np.ndarray:
        h = (before[row, low] ^ after[row, high]) * _U(0xC2B2AE3D27D4EB4F)
        return mix(h + r[row].astype(np.uint64) + low.astype(np.uint64) * _U(salt)).view(np.int64)

    at = np.arange(0, RANGE, STEP)[None, :]
    lo, hi = np.maximum(at, gone[:, None]), np.minimum(at + STEP - 1, most[:, None])
    row, part = np.nonzero(lo <= hi)
    lo, hi, at = lo[row, part], hi[row, part], part * STEP
    size = hi - lo + 1
    ends = np.cumsum(size)
    t = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)
    strings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(pair(np.repeat(row, size), t, t, 0x9FB21C651E98DF25)))
    # the core is that of all STEP starts, also where some lie outside the text
    columns = [doc[row], (start[row] + lo).astype(np.int32), (start[row] + hi).astype(np.int32), pair(row, at + STEP - 1, at, 0x27D4EB2F165667C5), pair(row, lo, hi, 0x165667B19E3779F9)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), strings], names=PART_NAMES)


PART_NAMES = ["doc_id", "first", "last", "core", "whole", "strings"]
PARTS = "doc_id long, first int, last int, core long, whole long, strings array<long>"
SIDE_NAMES = ["r", "doc_id", "start", "left", "right"]


def spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "first", "last"])


def sort_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r, doc_id, start, left, right) come sorted by r, at most HOT of one r. Gives spans of repeated starts; whole cores are sorted together."""
    ready: list[tuple] = []
    group: list[tuple] = []
    key = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key:
                if len(group) > 1:
                    ready += group
                key, group = row[0], []
                if len(ready) * 2 * RANGE >= SORT_SYMBOLS:
                    if found := repeats(ready):
                        yield spans(found)
                    ready = []
            group.append(row)
    if len(group) > 1:
        ready += group
    if ready and (found := repeats(ready)):
        yield spans(found)


def sides(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(r, doc_id, start, left, right, many) of the ranges in edges (doc_id, start, r, many), cut from their documents."""
    wanted = edges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "r", "many")).alias("at")).withColumnRenamed("doc_id", "own")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()  # never null: only ranges of texts are wanted
            for x in at:
                s = x["start"]
                out.append((x["r"], i, s, raw[max(0, s) : s + SIDE], raw[s + length : s + length + SIDE], x["many"]))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()])], names=[*SIDE_NAMES, "many"])

    joined = docs.join(wanted.hint("shuffle_hash"), docs.doc_id == wanted.own)
    return map_batches(joined, ["doc_id", "text", "at"], fn, "r long, doc_id long, start int, left binary, right binary, many boolean")


def repeated_starts(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, first, last): ranges of positions at which a repeated string of `length` bytes starts (ranges may overlap and pass a text's ends).

    docs: doc_id (long, not null) and text. The rows are written; what they were made from is deleted.
    """
    if length < WINDOW + GRAM - 1:
        raise ValueError(f"strings must have {WINDOW + GRAM - 1} bytes at least")
    rows = in_arrow(range_rows(docs, length).repartition("r").sortWithinPartitions("r", "f"), classes, "doc_id long, start int, r long")
    found = cut(rows, "suffix-classes")
    full = found.filter("r is null").select("doc_id", F.greatest("start", F.lit(0)).alias("first"), (F.col("start") + SIDE).alias("last"))
    edges = found.filter("r is not null")
    many = edges.groupBy("r").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("r", F.lit(True).alias("many"))
    near = cut(sides(docs, edges.join(many, "r", "left"), length), "suffix-sides")
    few = near.filter("many is null").select(*SIDE_NAMES).repartition("r").sortWithinPartitions("r")
    sorted_few = in_arrow(few, sort_classes, "doc_id long, first int, last int")
    small = cut(map_batches(near.filter("many"), SIDE_NAMES, divided, PARTS), "suffix-parts")
    counts = small.groupBy("core", "whole").agg(F.count("*").alias("same"))
    kinds = counts.groupBy("core").agg(F.count("*").alias("kinds"))
    judged = small.join(counts, ["core", "whole"]).join(kinds, "core").filter("same > 1 or kinds > 1")
    single = judged.filter("same = 1").select("doc_id", "core", F.posexplode("strings").alias("k", "w"), "first").select("doc_id", "core", (F.col("first") + F.col("k")).alias("first"), "w")
    others = judged.filter("kinds > 1").select("core", F.explode("strings").alias("w")).groupBy("core", "w").agg(F.count("*").alias("c")).filter("c > 1").select("core", "w")
    out = cut(
        full.union(sorted_few)
        .union(judged.filter("same > 1").select("doc_id", "first", "last"))
        .union(single.join(others, ["core", "w"], "left_semi").select("doc_id", "first", F.col("first").alias("last"))),
        "suffix-spans",
    )
    for used in (found, near, small):
        forget(used)
    return out


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column `key`: doc_id as long, or for a row without one a negative hash of its text."""
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))


def spans_of(starts: DataFrame, key: str, at: str) -> DataFrame:
    """One row a document: its key, and its ranges as an array of structs."""
    return starts.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "length")).alias(at)).withColumnRenamed("doc_id", key)


def span_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, last, length) arrays of each row of an array<struct<first, last, length>> column; a null row has none."""
    flat = column.flatten()
    parts = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
    used = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield tuple(p[used : used + n] for p in parts)
        used += n


def runs(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """(k, 2) starts and ends of the maximal runs, in a text of n bytes, that strings starting in first..last cover."""
    last = np.minimum(last, n - length)
    ok = last >= first
    first, last = first[ok], last[ok] + length
    if not len(first):
        return np.empty((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return np.stack([first[new], end[np.append(new[1:], len(end)) - 1]], axis=1)


def without(raw: bytes, gone: np.ndarray) -> bytes:
    """raw without the runs."""
    edges = [0, *gone.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def of_words(raw: bytes, gone: np.ndarray, words: int) -> np.ndarray:
    """The runs that hold at least so many words, or parts of words."""
    return gone[[len(WORD.findall(raw, a, b)) >= words for a, b in gone.tolist()]] if words and len(gone) else gone


def drop_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs, all columns as they are, with runs of repeated strings of `length` bytes cut out of text where a run holds at
    least `words` words. A character whose bytes were cut apart goes as a whole."""
    own, of, spans_at = (fresh(docs, x) for x in ("own", "spans_of", "spans_at"))
    marked = keyed(docs, own)
    starts = repeated_starts(marked.select(F.col(own).alias("doc_id"), F.col("text").cast("string").alias("text")), length)
    spans = spans_of(starts.withColumn("length", F.lit(length)), of, spans_at)
    names, at = docs.columns, docs.columns.index("text")
    joined = marked.join(spans.hint("shuffle_hash"), F.col(own) == F.col(of), "left").select(*[F.col(f"`{c}`") for c in names], spans_at)

    def cut_text(text: str | None, span: tuple[np.ndarray, ...]) -> str | None:
        if text is None or not len(span[0]):
            return text
        raw = text.encode()
        gone = of_words(raw, runs(len(raw), span[0], span[1], length), words)
        return without(raw, gone).decode("utf-8", "ignore") if len(gone) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array([cut_text(*x) for x in zip(batch.column(at).to_pylist(), span_arrays(batch.column(len(names))))], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(joined, run, docs.schema)


def with_long_runs(starts: DataFrame, length: int, least: int) -> DataFrame:
    """(doc_id) of documents in which the ranges of strings of `length` bytes may cover `least` bytes in one run."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        far = [bool((np.diff(runs(1 << 40, *span[:2], length), axis=1) >= least).any()) for span in span_arrays(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(far, pa.bool_()))], names=["own"])

    return map_batches(spans_of(starts.withColumn("length", F.lit(length)), "own", "at"), ["own", "at"], fn, "own long")


def cut_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept, n_passages, passage_bytes): spans as [start, end) pairs in bytes, kept as
    the bytes that remain, and the passages (runs of repeated strings of `passage` bytes with at least `words` words), which stay.

    A string of `length` bytes can repeat only where shorter ones cover a run as long, so only documents with such a run are
    looked through again.
    """
    if passage > length:
        raise ValueError("a passage's strings can't be longer than those that are removed")
    marked = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")), "own")
    every = marked.select(F.col("own").alias("doc_id"), "text")
    starts = repeated_starts(every, passage).withColumn("length", F.lit(passage))
    if length > passage:
        some = every.join(with_long_runs(starts.drop("length"), passage, length).hint("shuffle_hash"), F.col("doc_id") == F.col("own"), "left_semi")
        starts = starts.union(repeated_starts(some, length).withColumn("length", F.lit(length)))
    joined = marked.join(spans_of(starts, "of", "at").hint("shuffle_hash"), F.col("own") == F.col("of"), "left")

    def one(text: str | None, first: np.ndarray, last: np.ndarray, own: np.ndarray) -> tuple:
        raw = (text or "").encode()
        whole = runs(len(raw), first[own == length], last[own == length], length)
        short = of_words(raw, runs(len(raw), first[own == passage], last[own == passage], passage), words)
        n_removed, n_passage = (int(np.diff(x, axis=1).sum()) for x in (whole, short))
        return len(raw), n_removed, len(whole), whole.ravel().tolist(), without(raw, whole), len(short), n_passage

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(zip(*[one(text, *at) for text, at in zip(batch.column(1).to_pylist(), span_arrays(batch.column(2)))]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(got, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passages", "passage_bytes"])

    return map_batches(joined, ["doc_id", "text", "at"], fn, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, n_passages long, passage_bytes long")


def op5_suffix_dedup(spark, sf_dir):
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")
