"""Operator 3: SentencePiece encoding and decoding with shared prefixes.

A batch's distinct marked words are sorted and walked depth-first as a trie, one character deeper at a
time. The forward table of a word (for each prefix, the last piece of its best path) is a stack: what two
words have in common is computed once and stays on it.

The vocabulary is a BPE model, where a best path is the one that its merges give, not the one with the
largest sum of scores; plain Viterbi over scores gives other ids. So a step of the forward pass asks
instead whether a piece can follow the last piece of the path before it: of the pieces that end here
exactly one can, the one that the merges of the two, run together, leave apart. That keeps the method
(forward pass, back pointers, shared prefixes) and gives the library's ids.

Defined cases: null or empty text has no piece; a character outside the vocabulary becomes its bytes;
U+2581 inside a text is read as a blank, as the library does; repeated rows give equal rows.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, map_batches, texts_of
from quernel.llm.idlists import Lists, Rows, sums_of
from quernel.llm.token_counts import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs of pieces that a worker keeps; both are emptied when full, which bounds memory only.
KEPT_WORDS, KEPT_PAIRS = 300_000, 400_000
#: In no piece of the vocabulary; words end at them.
BREAKS = "\n\t"
#: Blanks with the letters, or with the other marks, after them: no piece holds both kinds (the model is checked for it).
WORD = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}{BREAKS}]+|{MARK}+|[{BREAKS}]")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id = {self.piece[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        if any(WORD.findall(p) != [p] for p in self.id) or n > 1 << 16:
            raise ValueError("a vocabulary of another kind")
        #: pieces that the merges give for their own characters; no other can be in a path
        self.stable = {p: i for p, i in self.id.items() if len(self.merge(p)) == 1}
        #: lengths of the pieces of three characters or more that end in the same three, longest first
        tails: dict[str, set[int]] = {}
        for p in self.stable:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: sorted(n, reverse=True) for t, n in tails.items()}
        self.blank = max(len(p) for p in self.id if not p.strip(MARK))
        self.pairs: dict[int, bool] = {}
        self.rows, self.lists = Rows(), Lists()
        self.texts = Lists(np.uint8)  # the bytes that each id stands for
        raw = [b"" if sp.is_control(i) else bytes([int(self.piece[i][3:5], 16)]) if sp.is_byte(i) else self.piece[i].replace(MARK, " ").encode() for i in range(n)]
        self.texts.add(np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8))

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by the best score, leftmost first, until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can come after piece a: their characters together merge into just these two."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        parts = self.merge(self.piece[a] + self.piece[b])
        got = self.pairs[a << 16 | b] = len(parts) == 2 and parts[0] == self.piece[a]
        return got

    def forward(self, word: str, last: list[int], ids: list[int]) -> None:
        """Extend last and ids to the whole word: last[k] is the start of the last piece of word[:k], ids[k] its id, or -1
        for a character outside the vocabulary. Longer pieces are tried first."""
        stable, pairs, tails = self.stable, self.pairs, self.tails
        for end in range(len(last), len(word) + 1):
            found, own = end - 1, stable.get(word[end - 1], -1)
            for n in tails.get(word[end - 3 : end], ()) if end > 2 else ():
                start = end - n
                if start < 0:
                    continue
                i = stable.get(word[start:end])
                if i is not None:
                    before = ids[start]
                    ok = True if before < 0 else pairs.get(before << 16 | i)
                    if ok or ok is None and self.follows(before, i):
                        found, own = start, i
                        break
            else:
                if end > 1 and (i := stable.get(word[end - 2 : end])) is not None:
                    before = ids[end - 2]
                    ok = True if before < 0 else pairs.get(before << 16 | i)
                    if ok or ok is None and self.follows(before, i):
                        found, own = end - 2, i
            last.append(found)
            ids.append(own)

    def path(self, word: str, last: list[int], ids: list[int]) -> list[int]:
        """The ids of the pieces, followed back from the word's end."""
        out: list[int] = []
        end = len(word)
        while end:
            if ids[end] >= 0:
                out.append(ids[end])
            else:
                out += [self.byte_id[b] for b in reversed(word[last[end] : end].encode())]
            end = last[end]
        return out[::-1]

    def learn(self, words: list[str]) -> None:
        """Encode new words by a depth-first walk over their sorted list, and keep them in the order given."""
        found: dict[str, list[int]] = {}
        before, last, ids = "", [0], [-1]
        for word in sorted(words):
            if word[:2] == MARK * 2:  # pieces of blanks alone have one score for all: only the merges themselves decide
                found[word] = self.after_blanks(word)
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], ids[shared + 1 :]
            self.forward(word, last, ids)
            found[word] = self.path(word, last, ids)
            before = word
        lists = [found[w] for w in words]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.lists.add(n, np.fromiter(chain.from_iterable(lists), np.uint16, int(n.sum())))

    def after_blanks(self, word: str) -> list[int]:
        """A word after two or more blanks. Its letters merge before the blanks do, as their scores are better."""
        run = len(word) - len(word.lstrip(MARK))
        tail, last, ids = word[run - 1 :], [0], [-1]
        self.forward(tail, last, ids)
        path = self.path(tail, last, ids)
        if path[0] == self.id[MARK]:  # the last blank stayed alone: it merges with the others
            return self.blanks(run) + path[1:]
        return self.blanks(run - 1) + path

    def blanks(self, n: int) -> list[int]:
        """The merges of n blanks: pairs from the left, then pairs of those, while a piece is that long."""
        whole = max(0, n - 32) // self.blank
        return [self.id[p] for p in [MARK * self.blank] * whole + self.merge(MARK * (n - whole * self.blank))]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        marked = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.rows) > KEPT_WORDS:
            self.rows, self.lists = Rows(), Lists()
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        known = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(marked)), np.int64, int(sizes.sum()))
        if len(self.rows) > known:
            self.learn(list(islice(reversed(self.rows), len(self.rows) - known))[::-1])
        n, flat = self.lists.gather(rows)
        return sums_of(n, sizes), flat

    def decode_all(self, n: np.ndarray, flat: np.ndarray) -> list[str]:
        """The text of each of the next n[k] ids, without the blank that stands before a text."""
        sizes, raw = self.texts.gather(flat)
        ends = np.cumsum(sums_of(sizes, n))
        raw, out, start = raw.tobytes(), [], 0
        for end in ends.tolist():
            text = raw[start:end].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
            start = end
        return out


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, carry: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns `carry`, n_pieces and ids (array of int) of every whole text; one pass, no shuffle."""
    path = path or vocabulary_path(VOCABULARY)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, flat = model(path).encode_all(texts_of(batch.column(len(carry))))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], names=[*carry, "n_pieces", "ids"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return map_batches(docs, [*carry, text_col], fn, f"{head}, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, carry: list[str], ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The columns `carry` and decoded, the text of every list of ids."""
    path = path or vocabulary_path(VOCABULARY)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(len(carry))
        n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = model(path).decode_all(n, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(texts, pa.string())], names=[*carry, "decoded"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*carry).schema)
    return map_batches(encoded, [*carry, ids_col], fn, f"{head}, decoded string")


def op3_sentencepiece(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    back = decode(encode(docs, ["doc_id", "n_bytes", "sha256"]), ["doc_id", "n_bytes", "sha256", "n_pieces", "ids"])
    return back.select("doc_id", "n_bytes", "n_pieces", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("sha256")).alias("round_trip"))
