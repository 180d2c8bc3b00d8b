"""Operator 9: packing token ids into windows by multiway differencing (Karmarkar-Karp).

A document becomes its word-BPE ids and an end id. What fills whole windows is cut off; the remainders,
in pieces of at most PIECE ids, are packed block by block inside the task that tokenised them, so nothing is
shuffled and every block is bounded. In a block, each piece starts as a partition of `count` window sums; the two partitions with
the largest imbalance are merged, largest sums with smallest ones, until one is left. If a window passes
the capacity, the count rises and the block is packed anew.

Defined cases: null or empty text is the end id alone; equal rows are packed each on their own; an empty
table gives no row; columns other than the two named are ignored.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, in_arrow, texts_of
from quernel.llm.idlists import Lists, Rows, sums_of
from quernel.llm.token_counts import byte_symbols, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 2
#: Longest piece of a remainder, and how many pieces are packed together: smaller pieces leave less padding.
PIECE, BLOCK = 1024, 2048
#: Rows and bytes of text that are looked up at once; a longer text is looked up alone.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20
#: Strings between white space whose ids a worker keeps; the table is emptied when full, so it bounds memory only.
KEPT_WORDS = 300_000
#: Texts with other characters go to the library as a whole (normal forms, case and classes beyond these).
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏΑ-ΡΤ-Ωα-ρτ-ωЀ-џ]*")
#: On PLAIN texts in lower case this splits as the vocabulary's own pattern does: \p{L} is [^\W\d_], \p{N} is \d.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds:
    """Ids of texts. White space always parts words, so what stands between is looked up whole; a new one is split into words, each merged by the library's model."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.model, self.symbols = self.library.model, dict(enumerate(byte_symbols()))
        self.clear()

    def clear(self) -> None:
        self.rows, self.lists = Rows(), Lists()
        self.parts: dict[str, list[int]] = {}  # ids of what SPLIT makes of strings: marks and words beside them

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols))]

    def learn(self, new: list[str]) -> None:
        known, found, parts = self.lists.count, [], self.parts
        for chunk in new:
            if chunk.isalpha():
                found.append(self.word(chunk))
                continue
            ids: list[int] = []
            for w in SPLIT.findall(chunk):
                if (own := parts.get(w)) is None:
                    row = self.rows.get(w, known)
                    own = parts[w] = self.lists.one(row) if row < known else self.word(w)
                ids += own
            found.append(ids)
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.lists.add(n, np.fromiter(chain.from_iterable(found), np.uint16, int(n.sum())))

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.string())))
        if len(self.rows) > KEPT_WORDS:
            self.clear()
        coded = parts.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        known = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, different), np.int64, len(different))
        if len(self.rows) > known:
            collects = gc.isenabled()
            gc.disable()  # many small lists and no cycle among them: nothing to find
            try:
                self.learn(list(islice(reversed(self.rows), len(self.rows) - known))[::-1])
            finally:
                if collects:
                    gc.enable()
        n, flat = self.lists.gather(rows[coded.indices.to_numpy()])
        sizes = parts.value_lengths().to_numpy().astype(np.int64)
        own = iter(np.split(flat, np.cumsum(sums_of(n, sizes))[:-1]) if len(sizes) else [])
        return [next(own) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint16) for t, p in zip(texts, plain)]

    def ids(self, text: str) -> np.ndarray:
        return self.all_ids([text])[0]


def difference(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Members of `count` windows with near-equal sums: merge the two partitions of largest imbalance until one is left.

    A partition is its sums, largest first, and the node of each; node 0 is empty, k + 1 is size k, later ones join two.
    """
    n = len(sizes)
    joins = np.zeros((2, 2 * n + 1), np.int64)
    free = n + 1
    heap: list[tuple] = []
    for k in range(n):
        sums, nodes = np.zeros(count, np.int64), np.zeros(count, np.int64)
        sums[0], nodes[0] = sizes[k], k + 1
        heap.append((-int(sizes[k]) if count > 1 else 0, k, sums, nodes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, tie, b, y = heapq.heappop(heap)
        y = y[::-1]
        sums = a + b[::-1]
        nodes = x + y  # where one of them is empty
        both = np.flatnonzero((x > 0) & (y > 0))
        if len(both):
            new = np.arange(free, free + len(both))
            joins[0, new], joins[1, new] = x[both], y[both]
            nodes[both] = new
            free += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, nodes[order]))
    out: list[list[int]] = []
    left, right = joins.tolist()
    for node in heap[0][3].tolist() if heap else []:
        found, todo = [], [node] if node else []
        while todo:
            k = todo.pop()
            if k > n:
                todo += (left[k], right[k])
            else:
                found.append(k - 1)
        if found:
            out.append(sorted(found))
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`, their count raised until they all fit; each size is at most the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, count)
        if all(sizes[w].sum() <= capacity for w in found):
            return found
        count += 1


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch, in slices of bounded size."""
    docs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
    first, held = 0, 0
    for k, t in enumerate(texts):
        if k > first and (k - first >= SLICE_ROWS or held + len(t) > SLICE_BYTES):
            yield docs[first:k], texts[first:k]
            first, held = k, 0
        held += len(t)
    if texts:
        yield docs[first:], texts[first:]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for every piece; ids are little-endian unsigned 32-bit.

    One pass without a shuffle: a task packs its own documents, in their order. sequence_id holds the
    partition and a count within it.
    """
    path = path or vocabulary_path(VOCABULARY)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        base, next_id = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []

        def packed() -> list[tuple]:
            nonlocal next_id
            rows = []
            for members in windows(np.array([len(w[2]) for w in waiting], np.int64), capacity):
                offset = 0
                for k in members:
                    doc, start, ids, total = waiting[k]
                    rows.append((doc, start, len(ids), ids.tobytes(), total, base + next_id, offset))
                    offset += len(ids)
                next_id += 1
            waiting.clear()
            return rows

        for batch in batches:
            for docs_of, texts in sliced(batch):
                rows: list[tuple] = []
                for doc, own in zip(docs_of, words.all_ids(texts)):
                    ids = np.append(own, np.uint16(END)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        if len(ids) - start >= capacity:
                            rows.append((doc, start, capacity, ids[start : start + capacity].tobytes(), len(ids), base + next_id, 0))
                            next_id += 1
                        else:
                            waiting += [(doc, k, ids[k : k + PIECE], len(ids)) for k in range(start, len(ids), PIECE)]
                    if len(waiting) >= block:
                        rows += packed()
                if rows:
                    yield batch_of(rows)
        if waiting:
            yield batch_of(packed())

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir):
    return with_digest(pack(documents(spark, sf_dir)))
