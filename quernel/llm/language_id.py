"""Operator 2: language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words padded by a
blank) by rank. A document's own ranked list is compared with each profile by out-of-place distance:
the sum of rank differences, PROFILE for an n-gram that the profile lacks. The nearest language wins.

Every n-gram of every training row is counted, so a profile doesn't depend on how the rows are dealt out.

Defined cases: null text and text without a letter are `und` with score 0; with no training rows every
document is `und`; ties between languages go to the first by name, ties between n-grams to the smaller code;
repeated rows give equal rows; an empty table gives no row; a text of any length is handled alone; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import documents, held_out, map_batches, texts_of

#: N-grams in a profile.
PROFILE = 300
#: Expected number of training documents of one language at most (they are picked by a hash of doc_id).
TRAIN_DOCS = 2000
#: Most languages: a profile of each travels with every task.
MAX_LANGUAGES = 500

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point of the first plane is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _letters


def gram_codes(text: str) -> np.ndarray:
    """One integer per n-gram occurrence: code points of 21 bits each, a blank for a word's edge."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    alpha = letters()[np.minimum(cp, 0xFFFF)]
    if (high := cp > 0xFFFF).any():
        for c in np.unique(cp[high]):
            alpha[cp == c] = chr(c).isalpha()
    if not alpha.any():
        return np.empty(0, np.int64)
    padded = np.full(len(cp) + 2, 32, np.int64)
    padded[1:-1] = np.where(alpha, cp, 32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)  # one blank between words
    s = padded[keep]
    one = s[s != 32]
    two = (s[:-1] << 21) | s[1:]
    three = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] != 32]
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    grams, n = np.unique(codes, return_counts=True)
    if len(grams) > 4 * top:  # only those that can be among the first, ties included
        least = np.partition(n, -top)[-top]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.argsort(-n, kind="stable")[:top]]


def profiles(rows: DataFrame, lang_col: str, text_col: str) -> dict[str, np.ndarray]:
    """Learn a profile for each language of the given training rows; only PROFILE rows a language reach the driver."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        out: list[tuple[list, np.ndarray, np.ndarray]] = []
        for lang in sorted(set(langs)):
            got = [gram_codes(t) for own, t in zip(langs, texts) if own == lang]
            grams, n = np.unique(np.concatenate(got), return_counts=True)
            out.append(([lang] * len(grams), grams, n))
        return pa.RecordBatch.from_arrays([pa.array([x for o in out for x in o[0]], pa.string()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64))], names=["lang", "gram", "n"])

    counts = map_batches(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), ["lang", "text"], fn, "lang string, gram long, n long", rows=1024)
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in summed.withColumn("place", place).filter(F.col("place") <= PROFILE).orderBy("lang", "place").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in found.items()}


def training_rows(docs: DataFrame, id_col: str, lang_col: str, is_held: F.Column) -> DataFrame:
    """Training rows, thinned by a hash of the id so that a language has about TRAIN_DOCS of them at most.

    One row a language reaches the driver; a column of more than MAX_LANGUAGES values is no language column and an error.
    """
    usable = docs.filter(~is_held & F.col(lang_col).isNotNull())
    counts = usable.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    share = F.lit(0.0)
    for lang, n in sorted(map(tuple, counts)):
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, TRAIN_DOCS / n))).otherwise(share)
    return usable.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000)


def identify(docs: DataFrame, found: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, distance) for every row; the profiles (PROFILE n-grams a language) travel with the task."""
    names = sorted(found)
    grams = np.unique(np.concatenate([found[n] for n in names])) if names else np.empty(0, np.int64)
    places = np.full((len(names), len(grams) + 1), -1, np.int64)
    for k, n in enumerate(names):
        places[k, np.searchsorted(grams, found[n])] = np.arange(len(found[n]))

    def one(text: str) -> tuple[str, float, float]:
        codes = gram_codes(text) if names else np.empty(0, np.int64)
        if not len(codes):
            return "und", 0.0, 1.0
        own = ranked(codes, PROFILE)
        at = np.searchsorted(grams, own)
        at[at == len(grams)] = 0
        at = np.where(grams[at] == own, at, len(grams))
        theirs = places[:, at]
        far = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own)))).sum(axis=1) / (PROFILE * len(own))
        best = int(np.argmin(far))
        others = np.delete(far, best)
        second = float(others.min()) if len(others) else 1.0
        return names[best], float(min(1.0, (second - far[best]) / second)) if second > 0 else 0.0, float(far[best])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score", "distance"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], fn, "doc_id long, lang_pred string, score double, distance double")


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = held_out("doc_id", 4, 2)
    found = profiles(training_rows(docs, "doc_id", "lang", held), "lang", "text")
    return identify(docs, found).select("doc_id", held.alias("held_out"), "lang_pred", "score", "distance")
