"""Operator 4: document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are binned figures of the line itself and of its two
neighbours. Only documents bear labels, so the lines' labels are latent: the fit (posterior regularisation, an
EM) asks only that good lines make up at least GOOD_SHARE of a good training document's length and at most
BAD_SHARE of a bad one's, and moves the model towards the nearest line labels that obey this. Which lines of a
bad document may pass as good is left to the lines. Forward-backward gives each line's marginal probability of
being good, and a document's score is their mean weighted by line length.

Defined cases: null or empty text is one empty line; lines of a text without characters weigh the same; with
no training rows all scores are 0.5; repeated rows give equal rows; an empty table gives no row; columns other
than those named are ignored; labels, lang, source and doc_id are never features. A text of n lines takes
log2(n) rounds over its lines, so texts of very many lines don't hold a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, filter_batches, held_out, labels, map_batches, texts_of
from quernel.llm.toxicity import training_rows

#: Expected number of training documents of each label at most (picked by a hash of doc_id).
TRAIN_ROWS = {1: 4000, 0: 3000}
#: Longest training text in characters; longer ones are not in the sample.
TRAIN_CHARS = 200_000
#: Bins of a figure; steps, rate, ridge of the fit and ridge of its links.
BINS, STEPS, RATE, RIDGE, LINK_RIDGE = 8, 100, 0.1, 0.002, 0.02
#: Least share of good lines, by length, in a good training document; largest in a bad one; how fast a document's shift follows;
#: power of the labels' ratio by which the rarer bad documents count for more.
GOOD_SHARE, BAD_SHARE, SHIFT_RATE, BALANCE = 0.9, 0.1, 2.0, 0.5
FEATURES = ["length", "letters", "upper", "digits", "symbols", "points", "words", "word_length", "distinct", "doubled", "seen", "ended"]
#: Class of each code point below 0x10000: 1 lower or other letter, 2 upper letter, 4 digit, 8 one of #*$%&|<>, 16 other mark.
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        c = np.zeros(0x10000, np.uint8)
        for k in range(0x10000):
            x = chr(k)
            c[k] = 2 if x.isupper() else 1 if x.isalpha() else 4 if x.isdigit() else 8 if x in "#*$%&|<>" else 0 if x.isspace() else 16
        _classes = c
    return _classes


def line_figures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(figures, lengths): one row of FEATURES for each \\n-split line, and each line's length in characters."""
    lines = text.split("\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[np.minimum(cp, 0xFFFF)]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes

    def count(bit: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind == bit)])
        return total[ends] - total[starts]

    upper, digits, symbols, points = count(2), count(4), count(8), count(16)
    alpha = count(1) + upper
    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(lines))
    doubled = np.fromiter((sum(map(str.__eq__, w, w[1:])) for w in words), np.int64, len(lines))
    before: set[str] = set()
    seen = np.zeros(len(lines))
    ended = np.zeros(len(lines))
    for k, x in enumerate(lines):
        if n[k]:
            seen[k] = x in before
            before.add(x)
            ended[k] = words[k][-1][-1] in ".?!:;。"
    some, m = np.maximum(sizes, 1), np.maximum(n, 1)
    return np.stack([np.log1p(sizes), alpha / some, upper / np.maximum(alpha, 1), digits / some, symbols / some, points / some, np.log1p(n), alpha / m, distinct / m, doubled / m, seen, ended], axis=1), sizes


def edges_of(figures: np.ndarray) -> np.ndarray:
    """Bin edges by quantile of the figures that aren't at their most common value; (len(FEATURES), BINS - 1)."""
    out = np.full((figures.shape[1], BINS - 1), np.inf)
    for k in range(figures.shape[1]):
        x = figures[:, k]
        values, n = np.unique(x, return_counts=True)
        common = values[np.argmax(n)]
        rest = x[x != common] if n.max() > len(x) / BINS else x
        if len(rest):
            cuts = np.unique(np.concatenate([[common, np.nextafter(common, np.inf)] if n.max() > len(x) / BINS else [], np.quantile(rest, np.linspace(0, 1, BINS - 2)[1:-1])]))[: BINS - 1]
            out[k, : len(cuts)] = cuts
    return out


def binned(figures: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], figures[:, k], side="right") for k in range(len(edges))], axis=1) + np.arange(len(edges)) * BINS


def with_neighbours(bins: np.ndarray) -> np.ndarray:
    """Columns of the line, of the one before and of the one after; a bin of their own stands for none."""
    width = len(FEATURES) * BINS
    none = np.full((1, bins.shape[1]), 0) + width
    before = np.concatenate([none, bins[:-1]]) + width
    after = np.concatenate([bins[1:], none]) + 2 * width + 1
    return np.concatenate([bins, before, after], axis=1)


WEIGHTS = 3 * len(FEATURES) * BINS + 2


class Chains:
    """Documents' lines side by side, for forward-backward as products of 2 x 2 matrices, doubled round by round."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.n = int(self.sizes.sum())
        self.first = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.arange(self.n) - self.first[self.of]
        after = self.sizes[self.of] - 1 - before
        self.rounds = []
        step = 1
        while step < (int(self.sizes.max()) if len(self.sizes) else 0):
            self.rounds.append((step, np.flatnonzero(before >= step), np.flatnonzero(after >= step)))
            step *= 2
        self.inner = np.flatnonzero(before > 0)
        self.not_last = np.flatnonzero(after > 0)

    @staticmethod
    def times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(products of (2, 2, n) matrices, scaled to a largest entry of 1; log of the scales)"""
        c = a[:, :1] * b[:1] + a[:, 1:] * b[1:]
        top = np.maximum(np.maximum(c[0, 0], c[0, 1]), np.maximum(c[1, 0], c[1, 1]))
        return c / top, np.log(top)

    def marginals(self, unary: np.ndarray, link: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """unary: (lines, 2) log scores; link: (2, 2) log scores; weight: of each document, for the links. Returns (line marginals, expected links, log partition of each document)."""
        most = unary.max(axis=1)
        one = np.exp(unary - most[:, None]).T
        step = np.exp(link - link.max())[:, :, None] * one[None]
        step[:, :, self.first] = one[:, self.first]  # a first line follows no other
        front, back, scale = step.copy(), step.copy(), np.zeros(self.n)
        for d, later, earlier in self.rounds:
            front[:, :, later], more = self.times(front[:, :, later - d], front[:, :, later])
            scale[later] += scale[later - d] + more
            back[:, :, earlier], _ = self.times(back[:, :, earlier], back[:, :, earlier + d])
        forward, backward = front[0], np.ones((2, self.n))
        backward[:, self.not_last] = back[:, 0, self.not_last + 1] + back[:, 1, self.not_last + 1]
        both = forward * backward
        expected = np.zeros((2, 2))
        if len(at := self.inner):
            joint = forward[:, None, at - 1] * step[:, :, at] * backward[None, :, at]
            expected = joint @ ((1 if weight is None else weight[self.of[at]]) / joint.sum(axis=(0, 1)))
        last = self.first + self.sizes - 1
        z = np.log(forward[0, last] + forward[1, last]) + scale[last] + np.bincount(self.of, most, len(self.sizes)) + (self.sizes - 1) * link.max()
        return (both / (both[0] + both[1])).T, expected, z


def line_weights(sizes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Share of each line in its document's length; lines of a document without characters weigh the same."""
    weight = sizes.astype(float)
    weight[np.bincount(of, weight, n)[of] == 0] = 1
    return weight / np.bincount(of, weight, n)[of]


def fit_crf(docs: list[tuple[np.ndarray, int]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bin edges, emission weights of label 1 against 0, link scores) from (figures, document's label).

    Each step compares the chains with the same chains under a shift of each document's emissions, one number a document
    that its constraint asks for (0 where the model obeys it), and moves by Adam towards the latter, with a ridge.
    """
    if not docs:
        return None
    edges = edges_of(np.concatenate([f for f, _ in docs]))
    columns = np.concatenate([with_neighbours(binned(f, edges)) for f, _ in docs])
    chains = Chains([len(f) for f, _ in docs])
    share = line_weights(np.expm1(np.concatenate([f[:, 0] for f, _ in docs])), chains.of, len(docs))
    pull = share * chains.sizes[chains.of]  # 1 on the average
    y = np.array([label for _, label in docs])
    weight = np.where(y == 0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum())) ** BALANCE, 1.0)  # the rarer bad documents count for more
    aim, sign = np.where(y == 1, GOOD_SHARE, BAD_SHARE), np.where(y == 1, 1.0, -1.0)
    shift = 3 * sign
    w = np.zeros(WEIGHTS + 5)  # emissions, bias, links
    ridge = np.full(len(w), RIDGE)
    ridge[WEIGHTS + 1 :] = LINK_RIDGE
    mean, square = np.zeros_like(w), np.zeros_like(w)
    flat, wide = columns.ravel(), columns.shape[1]
    unary = np.zeros((chains.n, 2))
    for step in range(1, steps + 1):
        unary[:, 1] = np.clip(w[columns].sum(axis=1) + w[WEIGHTS], -30, 30)
        link = w[WEIGHTS + 1 :].reshape(2, 2)
        p, links, _ = chains.marginals(unary, link, weight)
        moved = unary.copy()
        moved[:, 1] += shift[chains.of] * np.minimum(pull, 3)
        q, wanted, _ = chains.marginals(moved, link, weight)
        shift += SHIFT_RATE * (aim - np.bincount(chains.of, share * q[:, 1], len(docs)))
        shift = sign * np.clip(sign * shift, 0, 12)
        off = (q[:, 1] - p[:, 1]) * weight[chains.of]
        grad = np.zeros_like(w)
        grad[:WEIGHTS] = np.bincount(flat, np.repeat(off, wide), WEIGHTS)
        grad[WEIGHTS] = off.sum()
        grad[WEIGHTS + 1 :] = (wanted - links).ravel()
        grad = grad / len(docs) - ridge * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return edges, w[: WEIGHTS + 1], w[WEIGHTS + 1 :].reshape(2, 2)


def fit(docs: DataFrame, marks: DataFrame, is_held: F.Column, label: str = "quality", most: dict[int, int] | None = None):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([line_figures(t)[0].astype(np.float32).tobytes() for t in texts_of(batch.column(1))], pa.binary()), batch.column(2)], names=["doc_id", "figures", "y"])

    got = map_batches(training_rows(docs.filter(F.length("text") <= TRAIN_CHARS), marks, is_held, label, most or TRAIN_ROWS), ["doc_id", "text", "y"], fn, "doc_id long, figures binary, y int")
    rows = sorted(((r.doc_id, bytes(r.figures), r.y) for r in got.toLocalIterator()))
    return fit_crf([(np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)).astype(float), y) for _, f, y in rows])


def score_lines(texts: list[str], model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probability that it is good, share of its text's length, text) of each line, and each text's number of lines."""
    got = [line_figures(t) for t in texts]
    sizes = [len(s) for _, s in got]
    of = np.repeat(np.arange(len(got)), sizes)
    if model is None:
        good = np.full(len(of), 0.5)
    else:
        edges, w, link = model
        columns = np.concatenate([with_neighbours(binned(f.astype(np.float32).astype(float), edges)) for f, _ in got])
        unary = np.zeros((len(of), 2))
        unary[:, 1] = np.clip(w[columns].sum(axis=1) + w[WEIGHTS], -30, 30)
        good = Chains(sizes).marginals(unary, link)[0][:, 1]
    return good, line_weights(np.concatenate([s for _, s in got]), of, len(got)), of, np.array(sizes, np.int64)


def score_texts(texts: list[str], model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of lines, lines more likely bad than good) of each text."""
    good, share, of, sizes = score_lines(texts, model)
    return np.clip(np.bincount(of, share * good, len(sizes)), 0, 1), sizes, np.bincount(of, good < 0.5, len(sizes)).astype(np.int64)


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted, n_lines, bad_lines) for every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, lines, bad = score_texts(texts_of(batch.column(1)), model)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(lines), pa.array(bad)], names=["doc_id", "score", "predicted", "n_lines", "bad_lines"])

    return map_batches(docs, ["doc_id", "text"], fn, "doc_id long, score double, predicted int, n_lines long, bad_lines long")


def keep_good(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, that score at least the threshold."""
    return filter_batches(docs, "text", lambda texts: score_texts(texts, model)[0] >= threshold)


def op4_quality_crf(spark, sf_dir):
    docs, held = documents(spark, sf_dir), held_out("doc_id", 3, 1)
    return score(docs, fit(docs, labels(spark, sf_dir), held)).select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines", "bad_lines")
