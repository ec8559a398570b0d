"""Boolean queries: an expression tree becomes one aggregate over the needed terms.

Every leaf is a flag of the document, made in a single pass over the occurrences of the
leaves' terms; the tree is then a Boolean column of those flags. Only a tree that holds
for a document without any of its terms (some form of NOT) meets the universe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import TextIndex
from .phrase import PhrasePlan, in_document, plan_phrase


class Expr:
    def __and__(self, other):
        return And(self, other)

    def __or__(self, other):
        return Or(self, other)

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Term(Expr):
    word: str


@dataclass(frozen=True)
class And(Expr):
    left: Expr | None
    right: Expr | None


@dataclass(frozen=True)
class Or(Expr):
    left: Expr | None
    right: Expr | None


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr | None


@dataclass(frozen=True, init=False)
class Phrase(Expr):
    words: tuple[str, ...]

    def __init__(self, *words: str):
        object.__setattr__(self, "words", tuple(words))


class _Leaves:
    """Numbers the leaves of a tree; a leaf is a term or a phrase plan, or None for the empty set."""

    def __init__(self, index: TextIndex):
        self.index, self.found = index, []

    def number(self, leaf) -> int | None:
        if leaf is None:
            return None
        if leaf not in self.found:
            self.found.append(leaf)
        return self.found.index(leaf)

    def compile(self, expr: Expr | None):
        """A function from the leaves' flags (booleans or columns) to the tree's value."""
        match expr:
            case None:
                return lambda flags: flags.false
            case Term(word):
                return self.leaf(self.index.lookup_term(word))
            case Phrase(words):
                return self.leaf(plan_phrase(words, self.index.config))
            case And(left, right):
                a, b = self.compile(left), self.compile(right)
                return lambda flags: a(flags) & b(flags)
            case Or(left, right):
                a, b = self.compile(left), self.compile(right)
                return lambda flags: a(flags) | b(flags)
            case Not(inner):
                a = self.compile(inner)
                return lambda flags: flags.negate(a(flags))
        raise TypeError(f"not a query: {expr!r}")

    def leaf(self, what):
        i = self.number(what)
        return lambda flags: flags.false if i is None else flags.values[i]


@dataclass
class _Flags:
    values: list
    false: object
    negate: object


def run_query(index: TextIndex, expr: Expr | None) -> DataFrame:
    """The ids of the documents for which the tree holds."""
    leaves = _Leaves(index)
    holds = leaves.compile(expr)
    everywhere = holds(_Flags([False] * len(leaves.found), False, lambda x: not x))
    if not leaves.found:
        return index.universe if everywhere else index.universe.where(F.lit(False))
    terms = {t for leaf in leaves.found for t in (leaf.terms if isinstance(leaf, PhrasePlan) else [leaf])}
    needed = index.occurrences.where(reduce(lambda a, b: a | b, [index.matches(t) for t in sorted(terms)]))
    flags: list[Column] = []
    for i, leaf in enumerate(leaves.found):
        if isinstance(leaf, PhrasePlan):
            flags.append(in_document(index, leaf).alias(f"leaf{i}"))
        else:
            flags.append(F.max(index.matches(leaf)).alias(f"leaf{i}"))
    found = needed.groupBy("doc_id").agg(*flags)
    value = holds(_Flags([F.coalesce(F.col(f"leaf{i}"), F.lit(False)) for i in range(len(flags))], F.lit(False), lambda c: ~c))
    if everywhere:
        found = index.universe.join(found, "doc_id", "left")
    return found.where(value).select("doc_id")
