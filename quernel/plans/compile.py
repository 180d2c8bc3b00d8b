"""From a query's tree to one predicate over term flags.

A query becomes an expression over "does the document have stem s". All stems of one or many queries are
looked up in a single scan of the postings and folded into one row of flags per document by one
aggregation, however deep the tree is. Only a query that also holds for a document without any of its
stems needs the table of all documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.local_text import stem, tokens
from quernel.plans.query import And, Node, Not, Or, Term, parse

#: The rules run twice over the words of a query that parses, and once over those of one that doesn't;
#: "consistent" search runs them once in both cases, as for documents.
COMPATIBLE, CONSISTENT = 2, 1


@dataclass(frozen=True)
class Has:
    stem: str


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class All:
    parts: tuple[Flags, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Flags, ...]


#: A chain of one operator is one node, so a tree is as deep as its brackets, however long the query is.
Flags = Has | Nothing | Not | All | Any


def chained(kind: type, parts: list[Flags]) -> Flags:
    """One node over the different parts; a single one stands for itself."""
    different = tuple(dict.fromkeys(parts))
    return different[0] if len(different) == 1 else kind(different)


def resolve(query: str, stem_passes: int = COMPATIBLE) -> Flags:
    """The query's tree over stems. Only the first word inside a term counts; a term without a word has no document."""
    node = parse(query)
    if node is None:
        words = tokens(query)
        return chained(All, [Has(stem(w)) for w in words]) if words else Nothing()

    def walk(n: Node) -> Flags:
        if isinstance(n, Term):
            words = tokens(n.text)
            return Has(stem(words[0], stem_passes)) if words else Nothing()
        if isinstance(n, Not):
            return Not(walk(n.of))
        kind, parts = type(n), []
        while isinstance(n, kind):  # the parser chains to the left
            parts.append(walk(n.right))
            n = n.left
        parts.append(walk(n))
        return chained(All if kind is And else Any, parts[::-1])

    return walk(node)


def stems_of(tree: Flags) -> set[str]:
    if isinstance(tree, Has):
        return {tree.stem}
    if isinstance(tree, Nothing):
        return set()
    return stems_of(tree.of) if isinstance(tree, Not) else set().union(*map(stems_of, tree.parts))


def holds(tree: Flags, has: Callable[[str], bool]) -> bool:
    if isinstance(tree, Has):
        return has(tree.stem)
    if isinstance(tree, Nothing):
        return False
    if isinstance(tree, Not):
        return not holds(tree.of, has)
    return (all if isinstance(tree, All) else any)(holds(x, has) for x in tree.parts)


def needs_all_documents(tree: Flags) -> bool:
    """Whether a document with none of the stems is a hit."""
    return holds(tree, lambda _: False)


def folded(columns: list[Column], every: bool) -> Column:
    """Their conjunction or disjunction, joined in halves: an expression over n columns is log2(n) deep."""
    if len(columns) == 1:
        return columns[0]
    left, right = folded(columns[: len(columns) // 2], every), folded(columns[len(columns) // 2 :], every)
    return left & right if every else left | right


def predicate(tree: Flags, has: Callable[[list[str], bool], Column]) -> Column:
    """The tree as a Column; has(stems, every) tells whether a document has all, or any, of some stems."""
    if isinstance(tree, Has):
        return has([tree.stem], True)
    if isinstance(tree, Nothing):
        return F.lit(False)
    if isinstance(tree, Not):
        return ~predicate(tree.of, has)
    every = isinstance(tree, All)
    stems = [x.stem for x in tree.parts if isinstance(x, Has)]
    rest = [predicate(x, has) for x in tree.parts if not isinstance(x, Has)]
    return folded(([has(stems, every)] if stems else []) + rest, every)
