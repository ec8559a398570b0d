"""The positional inverted index as DataFrames.

An index over documents is lazy: a query's plan filters tokens to its own terms before
anything is shuffled. A saved index is postings in folders by a hash of the term, of which
an exact lookup opens one, sorted by term, so that Parquet's statistics prune within a file.
A row of it holds a term's postings of a batch of documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import AnalyzerConfig, analyze, term_blocks, term_lists, tokens

#: Folders of a saved index.
SLOTS = 16


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """occurrences: doc_id, term, positions (one or more rows for each term of a document), and
    slot if they are saved by slots; universe: the distinct ids of all indexed documents, with or without tokens;
    documents: what is indexed, if it is at hand; pairs: term and doc_id of the occurrences alone, if
    they can be read apart."""

    occurrences: DataFrame
    universe: DataFrame
    config: AnalyzerConfig
    documents: DataFrame | None = None
    pairs: DataFrame | None = None

    @classmethod
    def build(cls, documents: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> TextIndex:
        occurrences = tokens(documents, config).select("doc_id", "term", F.array("pos").alias("positions"))
        return cls(occurrences, documents.select("doc_id").distinct(), config, documents)

    @property
    def spark(self) -> SparkSession:
        return self.universe.sparkSession

    def postings(self) -> DataFrame:
        """term, doc_id, tf, positions: sorted distinct positions of each term and document."""
        if self.documents is not None:
            lists = term_lists(self.documents, self.config)
        else:
            lists = self.occurrences.groupBy("term", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
        return lists.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """term, doc_id, tf; of some exact terms only, if they are given."""
        if terms is None and self.documents is not None:
            return self.postings().drop("positions")
        of = self.occurrences
        if terms is not None:
            of = of.where(F.col("term").isin(terms))
            if self.slotted:
                of = of.where(reduce(or_, (F.col("slot") == slot_of(F.lit(t)) for t in terms), F.lit(False)))
        return of.groupBy("term", "doc_id").agg(F.sum(F.size("positions")).cast("long").alias("tf"))

    def term_stats(self) -> DataFrame:
        """term, df."""
        if self.documents is not None:
            return term_blocks(self.documents, self.config).groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
        pairs = self.occurrences.select("term", "doc_id") if self.pairs is None else self.pairs
        return pairs.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def n_docs(self) -> DataFrame:
        """One row, n: all indexed documents, also those without a kept token."""
        return self.universe.agg(F.count(F.lit(1)).alias("n"))

    def matches(self, term: str) -> Column:
        """The predicate of a looked-up term, which Parquet can prune by either way; an exact
        one also picks its folder."""
        if self.config.match == "prefix":
            return F.col("term").startswith(term)
        exact = F.col("term") == term
        return exact & (F.col("slot") == slot_of(F.lit(term))) if self.slotted else exact

    @property
    def slotted(self) -> bool:
        return "slot" in self.occurrences.columns

    def lookup_term(self, word: str) -> str | None:
        """A looked-up word is analysed, and only its first kept term counts."""
        return next(iter(analyze(word, self.config)), None)

    def lookup_postings(self, word: str) -> DataFrame:
        """doc_id, positions of a word; empty for a word that the analysis drops."""
        term = self.lookup_term(word)
        found = self.occurrences.where(F.lit(False) if term is None else self.matches(term))
        return found.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))

    def lookup(self, word: str) -> DataFrame:
        """The ids of the documents that hold a word."""
        term = self.lookup_term(word)
        return self.occurrences.where(F.lit(False) if term is None else self.matches(term)).select("doc_id").distinct()

    def merge(self, other: TextIndex) -> TextIndex:
        """Both indexes' documents; positions of a term and document are united."""
        if other.config != self.config:
            raise ValueError("indexes of different analysers don't merge")
        columns = self.occurrences.columns if self.slotted and other.slotted else ["doc_id", "term", "positions"]
        return TextIndex(self.occurrences.select(columns).unionByName(other.occurrences.select(columns)), self.universe.unionByName(other.universe).distinct(), self.config)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """postings/ and documents/. Postings go to SLOTS folders by term, each file sorted by term.
        They stay where their documents' texts were dealt to: a file holds all terms of its slot that
        its documents have, so that no postings are shuffled and a frequent term is in many files."""
        if mode == "append":
            self._fits(path)
        if self.documents is not None:
            rows = term_blocks(self.documents, self.config)
        else:
            rows = self.postings().select("term", F.array("doc_id").alias("docs"), F.array("positions").alias("positions"))
        rows.withColumn("slot", slot_of(F.col("term"))).sortWithinPartitions("slot", "term").write.mode(mode).partitionBy("slot").parquet(f"{path}/postings")
        self.universe.write.mode(mode).parquet(f"{path}/documents")

    def _fits(self, path: str) -> None:
        """Postings of other columns, of an earlier version or a stream, don't go with ours."""
        try:
            columns = self.spark.read.parquet(f"{path}/postings").columns
        except AnalysisException:  # there are none yet
            return
        if "docs" not in columns:
            raise ValueError(f"{path} has postings of another layout: save to a folder of its own and merge")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: AnalyzerConfig = AnalyzerConfig()) -> TextIndex:
        """The index that was saved, with all batches that were appended to it."""
        rows = spark.read.parquet(f"{path}/postings")
        slot, pairs = [c for c in ("slot",) if c in rows.columns], None
        if "docs" in rows.columns:
            pairs = rows.select("term", F.explode("docs").alias("doc_id"))
            rows = rows.select("term", *slot, F.explode(F.arrays_zip("docs", "positions")).alias("in")).select(F.col("in.docs").alias("doc_id"), "term", F.col("in.positions").alias("positions"), *slot)
        else:
            rows = rows.select("doc_id", "term", "positions", *slot)
        return cls(rows, spark.read.parquet(f"{path}/documents").distinct(), config, pairs=pairs)
