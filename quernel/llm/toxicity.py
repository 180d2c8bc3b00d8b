"""Operator 8: toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams (with their beginnings, so that forms of one word share a weight),
bigrams and skip-bigrams (one word between), present or not. Every
coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so what is broadcast is
a short list of (slot, weight), at most SLOTS long.

Defined cases: null or empty text has no feature and scores by the bias alone; with no training rows all
scores are 0.5 and predicted is 1; repeated rows give equal rows; columns other than those
named are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, held_out, labels, map_batches, texts_of

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Beginnings of a word, in letters, that are features as the word is: forms of one word share a weight.
PREFIXES = (4, 5, 6, 7)
#: Expected number of training rows of each label at most (picked by a hash of doc_id).
TRAIN_ROWS = {1: 5000, 0: 10000}
#: Longest training text in characters; longer ones are not in the sample, so a row sent to the driver is bounded.
TRAIN_CHARS = 200_000
#: Words that a worker keeps the hash of; emptied when full.
KEPT_WORDS = 400_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 4.0, 1.0, 6

WORD = re.compile(r"[^\W_]+")


class Words:
    """Word -> row of `table`: hashes of the word and of its beginnings (PREFIXES letters, where longer), 0 for none."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(PREFIXES)), np.uint64)

    def rows(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > KEPT_WORDS:
            self.clear()
            ids = self.ids
        known = len(ids)
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        if len(ids) > known:
            while len(ids) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for w in list(islice(reversed(ids), len(ids) - known)):
                row = self.table[ids[w]]
                row[0] = zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1
                for k, n in enumerate(PREFIXES):
                    if len(w) > n:
                        row[1 + k] = zlib.crc32(b"%d " % n + w[:n].encode("utf-8", "surrogatepass")) + (k + 2 << 32)
        return at


_words = Words()
MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(text: str) -> np.ndarray:
    """The distinct slots of a text's features, ascending."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    at = _words.rows(words)
    h = _words.table[at, 0]
    one = _words.table[np.unique(at)].ravel()
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))
    skip = (h[:-2] * np.uint64(0x27D4EB2F165667C5)) ^ (h[2:] * np.uint64(0x85EBCA77C2B2AE63))
    mixed = np.concatenate([one[one > 0], two, skip]) * MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(((mixed * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; features are 0 or 1. Slot SLOTS is the bias, without L1."""

    def __init__(self, size: int = SLOTS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full(size + 1, l1), l2
        self.l1[size] = 0
        self.size = size

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.size)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[int, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) from (doc_id, slots, label), in an order given by a hash of the ids."""
    model = Ftrl()
    order = sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))
    for _ in range(epochs):
        for _, at, y in order:
            model.learn(at, y)
    w = model.weights(np.arange(SLOTS + 1))
    at = np.flatnonzero(w[:SLOTS])
    return at, w[at], float(w[SLOTS])


def training_rows(docs: DataFrame, marks: DataFrame, is_held: F.Column, label: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, y) of labelled rows outside the held-out part, thinned by a hash of doc_id to about `most` rows a label."""
    usable = marks.filter(~is_held & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    n = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, most[1] / n.get(1, 1)))).otherwise(F.lit(min(1.0, most[0] / n.get(0, 1))))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # picked is bounded by `most`


def fit(docs: DataFrame, marks: DataFrame, is_held: F.Column, label: str = "toxic", most: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([slots(t).astype(np.int32).tobytes() for t in texts_of(batch.column(1))], pa.binary()), batch.column(2)], names=["doc_id", "slots", "y"])

    got = map_batches(training_rows(docs.filter(F.length("text") <= TRAIN_CHARS), marks, is_held, label, most or TRAIN_ROWS), ["doc_id", "text", "y"], fn, "doc_id long, slots binary, y int")
    return train([(r.doc_id, np.frombuffer(r.slots, np.int32), r.y) for r in got.toLocalIterator()])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted, n_features) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(text: str) -> tuple[float, int]:
        at, w, bias = shared.value
        own = slots(text)
        if not len(at) or not len(own):
            return 1 / (1 + np.exp(-bias)), 0
        k = np.minimum(np.searchsorted(at, own), len(at) - 1)
        hit = at[k] == own
        return float(1 / (1 + np.exp(-np.clip(w[k[hit]].sum() + bias, -35, 35)))), int(hit.sum())

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "score", "predicted", "n_features"])

    return map_batches(docs.select("doc_id", "text"), ["doc_id", "text"], fn, "doc_id long, score double, predicted int, n_features long")


def op8_toxicity(spark, sf_dir):
    docs, held = documents(spark, sf_dir), held_out("doc_id", 5, 0)
    return score(docs, fit(docs, labels(spark, sf_dir), held)).select("doc_id", held.alias("held_out"), "score", "predicted", "n_features")
