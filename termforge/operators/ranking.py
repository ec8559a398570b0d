"""Ranking: TF-IDF, cosine in the space of the query's terms, and champion lists.

A query has few terms, so what is known of each (its multiplicity, df) is a broadcast of
as many rows. Scores are rounded to six digits and ties go to the smaller id, so that a
result doesn't depend on the order of sums."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analysis import analyze
from .index import TextIndex

DIGITS = 6
TIERS = (100, 1000, 10_000)
OVERSHOOT = 5


def query_terms(index: TextIndex, queries: list[str]) -> Counter:
    """All kept terms of all query strings, with how often each occurs."""
    return Counter(t for q in queries for t in analyze(q, index.config))


def _weights(index: TextIndex, tf: DataFrame, terms: Counter) -> DataFrame:
    """term, times, idf of the query terms that some document has."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    times = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in sorted(terms.items())], F.lit(0))
    return df.crossJoin(F.broadcast(index.n_docs())).select("term", times.alias("times"), F.ln(F.col("n") / F.col("df")).alias("idf"))


def _cells(index: TextIndex, terms: Counter) -> DataFrame:
    """doc_id, term, times, idf, weight: a row for each query term of a document."""
    tf = index.frequencies(sorted(terms))
    known = _weights(index, tf, terms)  # a row a query term
    return tf.join(F.broadcast(known), "term").withColumn("weight", (1 + F.ln("tf")) * F.col("idf"))


def _ordered(scores: DataFrame, k: int = 0) -> DataFrame:
    rounded = scores.select("doc_id", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), "doc_id")
    return rounded.limit(k) if k > 0 else rounded


def _none(index: TextIndex) -> DataFrame:
    return index.universe.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))


def rank_tfidf(index: TextIndex, docs: DataFrame, queries: list[str], k: int = 0) -> DataFrame:
    """doc_id, score > 0 of the documents in docs, best first; k <= 0: all of them."""
    terms = query_terms(index, queries)
    if not terms:
        return _none(index)
    scores = _cells(index, terms).groupBy("doc_id").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
    return _ordered(scores.where(F.col("score") > 0).join(docs, "doc_id", "left_semi"), k)


def rank_vsm(index: TextIndex, docs: DataFrame, queries: list[str], k: int = 0) -> DataFrame:
    """doc_id, score: the cosine of document and query over the query's terms alone."""
    terms = query_terms(index, queries)
    if not terms:
        return _none(index)
    cells = _cells(index, terms)
    norm = F.broadcast(_weights(index, index.frequencies(sorted(terms)), terms).agg(F.sqrt(F.sum(F.pow(F.col("times") * F.col("idf"), 2))).alias("norm")))
    sums = cells.groupBy("doc_id").agg(F.sum(F.col("times") * F.col("idf") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own"))
    scores = sums.crossJoin(norm).where((F.col("own") > 0) & (F.col("norm") > 0)).withColumn("score", F.col("dot") / (F.col("own") * F.col("norm")))
    return _ordered(scores.join(docs, "doc_id", "left_semi"), k)


def champions(index: TextIndex, most: int = TIERS[-1], terms: list[str] | None = None) -> DataFrame:
    """term, doc_id, score, rnk <= most: each term's best documents. Of all terms, frequencies are
    shuffled once, by term, where documents are counted and ranked. Of given ones, a frequent term sends
    `most` rows a task at most, as the limit on the rank is pushed below the shuffle."""
    tf = index.frequencies(terms)
    if terms is None:
        tf = tf.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("term")))
    else:
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        tf = tf.join(F.broadcast(df), "term")
    scored = tf.crossJoin(F.broadcast(index.n_docs())).select("term", "doc_id", F.round((1 + F.ln("tf")) * F.ln(F.col("n") / F.col("df")), DIGITS).alias("score"))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rnk", rank).where(F.col("rnk") <= most)


def _tier(k: int, overshoot: int, sizes: tuple[int, ...]) -> Column:
    """The first tier with enough candidates, or else the last, from the columns c0, c1, ..."""
    need = k * (overshoot if overshoot > 0 else OVERSHOOT)
    return F.coalesce(*[F.when(F.col(f"c{i}") >= need, F.lit(size)) for i, size in enumerate(sizes)], F.lit(sizes[-1]))


def tiered_search(index: TextIndex, k: int, overshoot: int, *queries: str, sizes: tuple[int, ...] = TIERS) -> DataFrame:
    """Inexact top k: candidates are the documents in the query terms' champion lists of
    the first tier that has k * overshoot of them. k <= 0: the first tier, all of it."""
    terms = query_terms(index, list(queries))
    if not terms:
        return _none(index)
    best = champions(index, sizes[-1], sorted(terms)).groupBy("doc_id").agg(F.min("rnk").alias("best"))
    counts = best.agg(*[F.count(F.when(F.col("best") <= size, 1)).alias(f"c{i}") for i, size in enumerate(sizes)])
    picked = best.crossJoin(F.broadcast(counts.select(_tier(k, overshoot, sizes).alias("tier")))).where(F.col("best") <= F.col("tier")).select("doc_id")
    return rank_tfidf(index, picked, list(queries), k)
