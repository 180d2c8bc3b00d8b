"""Plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans(docs: dict[int, str | None], length: int) -> dict[int, list[tuple[int, int]]]:
    """doc_id -> maximal runs of bytes that repeated strings of so many bytes cover."""
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i] = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
    return out


def removed(docs: dict[int, str | None], length: int = 400) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    out = {}
    for i, found in spans(docs, length).items():
        b = (docs[i] or "").encode()
        gone = {k for x, y in found for k in range(x, y)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), len(found), hashlib.sha256(kept).hexdigest())
    return out


def passages(docs: dict[int, str | None], length: int, words: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (runs with at least so many words, their bytes)."""
    out = {}
    for i, found in spans(docs, length).items():
        b = (docs[i] or "").encode()
        some = [y - x for x, y in found if len(re.findall(rb"[^\x20\x09-\x0D]+", b[x:y])) >= words]
        out[i] = (len(some), sum(some))
    return out


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def near(docs: dict[int, str | None], percent: int = 85) -> dict[int, tuple]:
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for h in sets[i] for j in holders[h]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for h in sets[i]:
            holders[h].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def base_figures(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def repetition(text: str | None, limits) -> list[str]:
    """Names of the repetition rules that a text fails, in the order of the operator."""
    text = text or ""
    w = WORD.findall(text)
    chars = sum(map(len, w))
    lines = text.split("\n")
    out = []
    if sum(len("".join(WORD.findall(x))) for k, x in enumerate(lines) if x in lines[:k]) > limits.LINE_SHARE * chars:
        out.append("lines")
    for n in range(2, 11):
        at = defaultdict(list)
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].append(k)
        most = max(map(len, at.values()), default=0)
        if most < 2:
            continue
        if n in limits.MOST_FREQUENT and max(sum(map(len, g)) for g, v in at.items() if len(v) == most) * most / chars > limits.MOST_FREQUENT[n]:
            out.append(f"top{n}")
        if n in limits.DUPLICATED and sum(len(w[k]) for k in {k + d for v in at.values() if len(v) > 1 for k in v for d in range(n)}) / chars > limits.DUPLICATED[n]:
            out.append(f"dup{n}")
    return out
