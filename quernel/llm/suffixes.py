"""Suffix arrays by difference cover (DC3), vectorised: sort sampled triples, recurse on their names, merge the rest."""

from __future__ import annotations

import numpy as np


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, names): order of the rows by columns, and names 1.. that are equal for equal rows, in row positions."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of non-negative integers, in lexicographic order; a shorter suffix comes before its extensions."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text.astype(np.int64) + 1
    top = int(s.max()) + 1
    # a sample of two positions in three; one dummy keeps the two halves apart when n % 3 == 1
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    s = np.concatenate([s, [0]])
    a, b, c = s[sample], s[sample + 1], s[sample + 2]
    if top < 2_000_000:
        order, names = _ranked([(a * top + b) * top + c])
    else:
        order, names = _ranked([a, b, c])
    if int(names[order[-1]]) < len(sample):
        inner = suffix_array(names)
        sorted_sample = sample[inner]
    else:
        sorted_sample = sample[order]
    rank = np.zeros(n + 5, np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    sorted_rest = rest[np.argsort(s[rest] * wide + rank[rest + 1])]
    # where each remaining suffix goes among the sampled ones: those of either kind are in order of a key of their own
    first = sorted_sample[sorted_sample % 3 == 1]
    second = sorted_sample[sorted_sample % 3 == 2]
    pairs, ours = s[second] * top + s[second + 1], s[sorted_rest] * top + s[sorted_rest + 1]
    if top * top >= (1 << 62) // wide:  # pairs by their rank, so that a key fits
        known = np.unique(pairs)
        place = np.searchsorted(known, ours)
        equal = known[np.minimum(place, len(known) - 1)] == ours if len(known) else np.zeros(len(ours), bool)
        pairs, ours = 2 * np.searchsorted(known, pairs) + 1, 2 * place + equal
    low = np.searchsorted(s[first] * wide + rank[first + 1], s[sorted_rest] * wide + rank[sorted_rest + 1])
    low += np.searchsorted(pairs * wide + rank[second + 2], ours * wide + rank[sorted_rest + 2])
    out = np.empty(n, np.int64)
    at = low + np.arange(len(sorted_rest))
    out[at] = sorted_rest
    taken = np.zeros(n, bool)
    taken[at] = True
    out[~taken] = sorted_sample
    return out


def equal_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For starts in suffix order: group number of each, equal where the prefixes of `length` are equal; adjacent ones are compared."""
    same = np.zeros(len(starts), bool)
    width = 4 if not len(data) or int(data.max()) < 1 << 16 else 1  # symbols in a word
    padded = np.concatenate([data, np.zeros(length + width, data.dtype)]).astype(np.uint64)
    words = padded if width == 1 else padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    a, b = starts[:-1], starts[1:]
    hit = np.arange(len(a))
    for at in [*range(0, length - width + 1, width), max(0, length - width)] if length >= width else []:
        hit = hit[words[a[hit] + at] == words[b[hit] + at]]  # most neighbours part early
        if not len(hit):
            break
    if length < width:
        span = np.arange(length)
        hit = hit[(padded[a[:, None] + span] == padded[b[:, None] + span]).all(axis=1)] if len(a) else hit
    same[hit + 1] = True
    return np.cumsum(~same)
