"""The Boolean query language: text to a small tree, on the driver.

    or   := and ("||" and)*
    and  := not ("&&" not | not)*        the second form where a term, "!" or "(" follows
    not  := "!" not | "(" or ")" | term

The parser reads UTF-8 bytes. Blanks and tabs separate; a term is digits, ASCII letters and two-byte
Cyrillic characters with inner hyphens. What follows a complete query is ignored; a query that can't be
parsed gives None, and the caller falls back to all of its words.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Not | And | Or


class _Failed(Exception):
    pass


def _word_byte(b: int) -> bool:
    return 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        """The next byte that is no blank or tab; 0 at the end."""
        while self.at < len(self.data) and self.data[self.at] in b" \t":
            self.at += 1
        return self.data[self.at] if self.at < len(self.data) else 0

    def take(self, mark: bytes) -> bool:
        self.peek()
        if self.data.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def any_of(self) -> Node:
        node = self.all_of()
        while self.take(b"||"):
            node = Or(node, self.all_of())
        return node

    def all_of(self) -> Node:
        node = self.factor()
        while True:
            if self.take(b"&&"):
                node = And(node, self.factor())
                continue
            b = self.peek()
            if b in b"!(" and b or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xD0:
                node = And(node, self.factor())
            else:
                return node

    def factor(self) -> Node:
        if self.take(b"!"):
            return Not(self.factor())
        if self.take(b"("):
            node = self.any_of()
            if not self.take(b")"):
                raise _Failed
            return node
        return self.term()

    def term(self) -> Node:
        self.peek()
        data, start = self.data, self.at
        while self.at < len(data):
            b = data[self.at]
            if _word_byte(b):
                self.at += 1
            elif b in (0xD0, 0xD1):
                self.at = min(self.at + 2, len(data))
            elif b == 0x2D and self.at > start and self.at + 1 < len(data) and (_word_byte(data[self.at + 1]) or data[self.at + 1] in (0xD0, 0xD1)):
                self.at += 1
            else:
                break
        if self.at == start:
            raise _Failed
        return Term(data[start : self.at].decode("utf-8", "replace"))


def parse(query: str) -> Node | None:
    """The tree of a query, or None if it is blank or can't be parsed."""
    try:
        return _Reader(query.encode("utf-8", "surrogatepass")).any_of()
    except (_Failed, RecursionError):
        return None
