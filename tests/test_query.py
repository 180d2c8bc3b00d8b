"""The query language: shapes of trees, failures, what is ignored."""

import pytest

from quernel.plans.compile import All, Any, Has, Nothing, needs_all_documents, resolve, stems_of
from quernel.plans.query import And, Not, Or, Term, parse

A, B, C = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    "query,tree",
    [
        ("hello", Term("hello")),
        ("a && b", And(A, B)),
        ("a || b", Or(A, B)),
        ("!a", Not(A)),
        ("(a || b) && c", And(Or(A, B), C)),
        ("hello world", And(Term("hello"), Term("world"))),
        ("a || b && c", Or(A, And(B, C))),
        ("a b || c", Or(And(A, B), C)),
        ("!!a", Not(Not(A))),
        ("!a b", And(Not(A), B)),
        ("a(b)", And(A, B)),
        ("a!b", And(A, Not(B))),
        ("a, b", A),
        ("a 19 b", A),
        ("a | b", A),
        ("a) b", A),
        ("a\nb", A),
        ("мозг-сердце", Term("мозг-сердце")),
        ("a-", Term("a")),
        ("19", Term("19")),
        ("ісердце", Term("ісердце")),
        ("", None),
        ("  ", None),
        ("a &&", None),
        ("a || && b", None),
        ("(a || b", None),
        ("()", None),
        ("!", None),
        ("a — b", None),
        ("«a»", None),
        ("&& a", None),
    ],
)
def test_parse(query, tree):
    assert parse(query) == tree


def test_deep_nesting_falls_back():
    assert parse("(" * 100_000 + "a") is None


def test_resolve():
    assert resolve("лечение") == Has("лечен")
    assert resolve("лечение", 1) == Has("лечени")
    assert resolve("«лечение»") == Has("лечени")
    assert resolve("19") == Nothing()
    assert resolve("?!") == Nothing()
    assert resolve("мозг-сердце") == Has("мозг")
    assert resolve("!x &&") == Has("x")
    assert stems_of(resolve("a1 || (b && !a)")) == {"a", "b"}
    assert resolve("a b c") == All((Has("a"), Has("b"), Has("c"))) and resolve("a && a") == Has("a")
    assert resolve("a || b || !c") == Any((Has("a"), Has("b"), Not(Has("c"))))


@pytest.mark.parametrize("query,needs", [("a", False), ("!a", True), ("!a && b", False), ("!a || b", True), ("!!a", False), ("!19", True)])
def test_needs_all_documents(query, needs):
    assert needs_all_documents(resolve(query)) is needs
