"""The same tokens and stems for a few words on the driver: the terms of a query."""

from __future__ import annotations

import re

from quernel.functions.text import ENGLISH_SUFFIXES, RUSSIAN_ENDINGS, TOKEN

_TOKEN = re.compile(TOKEN)


def tokens(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def _russian(word: str) -> str:
    for ending in RUSSIAN_ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 2:
            return word[: -len(ending)]
    return word


def _english(word: str) -> str:
    size = lambda w: len(w.encode())  # noqa: E731  the guards count bytes
    if size(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and size(word) > 3:
        word = word[:-1]
    cut = 0
    if word.endswith("eed"):
        word = word[:-2] if size(word) > 4 else word
    elif word.endswith("ed") and size(word) > 4:
        cut = 2
    elif word.endswith("ing") and size(word) > 5:
        cut = 3
    if cut:
        word = word[:-cut]
        if len(word) > 1 and word[-1] == word[-2] and word[-1].isascii():
            word = word[:-1]
    if word.endswith("y") and size(word) > 2 and word[-2] not in "aeiou":
        word = word[:-1] + "i"
    for suffix in ENGLISH_SUFFIXES:
        if word.endswith(suffix) and size(word) > len(suffix) + 2:
            return word[: -len(suffix)]
    return word


def stem(word: str, passes: int = 1) -> str:
    """The stem of a lower-case word, the rules applied `passes` times."""
    for _ in range(passes):
        if word:
            word = _russian(word) if "а" <= word[0] <= "я" or word[0] == "ё" else _english(word)
    return word
