"""Operator 1: token counts with a whole-token shortcut.

Offline, on the driver, prove_whole() runs the merge rules over every vocabulary string and keeps those
that come out as one token. Counting then splits a text into pre-tokens; each one in the proved set
counts as one token without merging, and only the rest goes through the library's merges.

Defined cases: null or empty text has 0 tokens; a special string inside a text is one token, as the
library counts it by default; repeated rows give equal rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, map_batches, texts_of

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens whose counts a worker keeps; the table is emptied when full, so it bounds memory only.
KEPT_COUNTS = 300_000
#: Texts with other characters are counted by the library as a whole: there Unicode tables of two versions may differ.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏΑ-ΡΣ-ωЀ-џ‐-‧€一-鼀]*")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Merger:
    """The merge rules of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()

    def merge(self, parts: list[str]) -> list[str]:
        rank, none = self.rank, 1 << 30
        while len(parts) > 1:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings, as text, that the merge rules alone turn into exactly one token."""
    m = Merger(path)
    back = {c: b for b, c in enumerate(m.symbols)}
    whole = set()
    for token in m.vocab:
        if token in m.special or not all(c in back for c in token):
            continue
        try:
            text = bytes(back[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if len(m.merge(list(token))) == 1:
            whole.add(text)
    return frozenset(whole)


class Counter(dict):
    """Pre-token -> number of tokens, filled as asked for."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        import public_tokenizers

        self.whole, self.symbols = whole, byte_symbols()
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model  # the merge rules alone, without the rest of the library's way to a text
        self.library.no_truncation()
        self.library.no_padding()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, special)))

    def __missing__(self, piece: str) -> int:
        symbols = self.symbols
        n = len(self.merges.tokenize("".join([symbols[b] for b in piece.encode()])))
        if len(self) >= KEPT_COUNTS:
            self.clear()
        self[piece] = n
        return n

    def plain(self, text: str) -> tuple[int, int]:
        """Tokens of a text without special strings, and how many of them took the shortcut."""
        pieces = self.split(text)
        whole = self.whole
        rest = [p for p in pieces if p not in whole]
        short = len(pieces) - len(rest)
        return short + sum(map(self.__getitem__, rest)), short

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        if not PLAIN.fullmatch(text):
            return len(self.library.encode(text, add_special_tokens=False).ids), 0
        if "<|" not in text:
            return self.plain(text)
        specials = len(self.cut.findall(text))
        parts = [self.plain(t) for t in self.cut.split(text)]
        return specials + sum(n for n, _ in parts), sum(s for _, s in parts)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_shortcut, over_limit) for every row; one pass, no shuffle.

    The proved strings are broadcast: at most as many as the vocabulary file has entries.
    """
    path = path or vocabulary_path()
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = Counter(path, whole.value)
        texts = texts_of(batch.column(1))
        found = [counter.count(t) for t in texts]
        n = pa.array([a for a, _ in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), n, pa.array([b for _, b in found], pa.int64()), pa.array([a > limit for a, _ in found])],
            names=["doc_id", "n_bytes", "n_tokens", "n_shortcut", "over_limit"],
        )

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], fn, "doc_id long, n_bytes long, n_tokens long, n_shortcut long, over_limit boolean")


def op1_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
