"""Connected components of a table of edges, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the least
of its neighbourhood; after a logarithmic number of rounds every component is a star
around its least node. Edges stay distributed; each round is written out, so lineage
stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, stored

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: each node with all its neighbours; small: with its smaller ones."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    met = both.join(least, "a")
    moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")) if large else met.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node that isn't the least of its component, with the least one.

    edges: a, b (long), in any direction; self-loops, repeats and edges with a null end are
    ignored, and so are other columns. No edges give no rows."""
    now = stored(few(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        before, now = now, stored(few(_star(_star(now, True), False)), "edges")
        discard(before)
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == mark:
            return now
        mark = said
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
