"""Phrase search: words at fixed distances, where dropped words leave gaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import AnalyzerConfig, analyze
from .index import TextIndex


@dataclass(frozen=True)
class PhrasePlan:
    """(term, offset from the first term) of each word that counts."""

    steps: tuple[tuple[str, int], ...]

    @property
    def terms(self) -> list[str]:
        return [t for t, _ in self.steps]


def plan_phrase(words: tuple[str, ...] | list[str], config: AnalyzerConfig) -> PhrasePlan | None:
    """None if nothing can match: no word is kept, or a word's term, analysed once more as
    a lookup does, is dropped. Dropped words before the first kept one don't count."""
    steps: list[tuple[str, int]] = []
    at = 0
    for word in words:
        kept = analyze(word, config)
        if kept:
            again = analyze(kept[0], config)
            if not again:
                return None
            at = at if steps else 0
            steps.append((again[0], at))
        at += 1
    return PhrasePlan(tuple(steps)) if steps else None


def in_document(index: TextIndex, plan: PhrasePlan) -> Column:
    """An aggregate over a document's occurrences: is there a place from which every step's
    term stands at its offset?"""

    def starts_of(term: str, offset: int) -> Column:
        return F.flatten(F.collect_list(F.when(index.matches(term), F.transform("positions", lambda p: p - offset))))

    starts = [starts_of(term, offset) for term, offset in plan.steps]
    return F.size(reduce(F.array_intersect, starts)) > 0


def phrase_docs(index: TextIndex, *words: str) -> DataFrame:
    """The ids of the documents that hold the phrase."""
    plan = plan_phrase(words, index.config)
    if plan is None:
        return index.universe.where(F.lit(False))
    needed = index.occurrences.where(reduce(lambda a, b: a | b, [index.matches(t) for t in sorted(set(plan.terms))]))
    return needed.groupBy("doc_id").agg(in_document(index, plan).alias("found")).where("found").select("doc_id")
