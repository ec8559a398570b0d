"""Text analysis: split, lower-case, drop short and stop words, stem.

Positions count every token, dropped ones included. The same rules run on the driver
for queries (analyze) and as a plan for documents (tokens)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .stemming import stem
from .stopwords import stop_words

#: Runs of letters, decimal digits and hyphens.
TOKEN = r"[\p{L}\p{Nd}\-]+"
LEAST_BYTES = 2
#: Rows of a batch that Python hands to Spark.
BATCH_ROWS = 16_384


@dataclass(frozen=True)
class AnalyzerConfig:
    """lang: english (also for an empty name), russian, or any other name for the English
    stop list without stemming. match: exact terms, or every term that begins with one."""

    lang: str = "english"
    match: str = "exact"

    def __post_init__(self):
        if self.match not in ("exact", "prefix"):
            raise ValueError(f"match is exact or prefix, not {self.match!r}")
        if not self.lang:
            object.__setattr__(self, "lang", "english")

    @property
    def stems(self) -> bool:
        return self.lang in ("english", "russian")


def _split(text: str) -> list[str]:
    out, word = [], []
    for c in text:
        if c.isalpha() or c.isdecimal() or c == "-":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


def analyze(text: str, config: AnalyzerConfig) -> list[str]:
    """The kept terms of a query string, in order."""
    stops = set(stop_words(config.lang))
    lowered = (t.lower() for t in _split(text))
    return [stem(t, config.lang) for t in lowered if len(t.encode("utf-8")) >= LEAST_BYTES and t not in stops]


def words(text: Column) -> Column:
    """All lower-case tokens of a text, by position. A whole text is lower-cased at once, unless it
    has one of the two characters whose lower case is no single letter or depends on what follows."""
    pattern = F.lit(TOKEN)
    by_token = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda t: F.lower(t))
    return F.when(text.contains("İ") | text.contains("Σ"), by_token).otherwise(F.regexp_extract_all(F.lower(text), pattern, F.lit(0)))


def _terms_of(config: AnalyzerConfig) -> Callable[[pa.Array], pa.Array]:
    """From distinct lower-case tokens to their terms, null for dropped ones."""
    stops = pa.array(stop_words(config.lang), pa.string())

    def terms(distinct: pa.Array) -> pa.Array:
        kept = pc.and_(pc.greater_equal(pc.binary_length(distinct), LEAST_BYTES), pc.invert(pc.is_in(distinct, value_set=stops)))
        if not config.stems:
            return pc.if_else(kept, distinct, pa.scalar(None, pa.string()))
        return pa.array([stem(t, config.lang) if k else None for t, k in zip(distinct.to_pylist(), kept.to_pylist())], pa.string())

    return terms


def _kept(tokens: pa.Array, terms: Callable[[pa.Array], pa.Array]) -> pa.DictionaryArray:
    """The terms of a batch's tokens; each distinct token is analysed once."""
    coded = tokens.dictionary_encode()
    of = terms(coded.dictionary.cast(pa.string())).dictionary_encode()
    return pa.DictionaryArray.from_arrays(of.indices.take(coded.indices), of.dictionary)


def term_column(tokens: Column, config: AnalyzerConfig) -> Column:
    """The terms of an array of lower-case tokens, null in a dropped one's place. Whole arrays go to
    Python, so that a batch's distinct tokens are stemmed once; nothing is shuffled."""
    terms = _terms_of(config)

    @F.arrow_udf("array<string>")
    def analysed(lists: pa.Array) -> pa.Array:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int32)
        found = _kept(lists.flatten(), terms).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), found)

    return analysed(tokens)


def tokens(documents: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """doc_id, pos, term: a row a kept token. Null text has none."""
    found = words(F.col("text"))
    if config.stems:
        return documents.select("doc_id", F.posexplode(term_column(found, config)).alias("pos", "term")).where(F.col("term").isNotNull())
    raw = documents.select("doc_id", F.posexplode(found).alias("pos", "term"))
    return raw.where((F.octet_length("term") >= LEAST_BYTES) & ~F.col("term").isin(stop_words(config.lang)))


def _grouped(ids: pa.Array, lists: pa.Array, terms: Callable[[pa.Array], pa.Array], by_term: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, term, positions of whole documents, some of which may have several rows; by term:
    term, docs, positions, the arrays having an element for each document of the term."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    docs = ids.dictionary_encode(null_encoding="encode")
    kept = _kept(lists.flatten(), terms)
    doc = np.repeat(docs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    pos = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    term = pc.fill_null(kept.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = term >= 0
    if not held.any():
        return
    n, width = len(kept.dictionary), int(pos.max()) + 1
    m = len(docs.dictionary)
    key, pos = term[held] * m + doc[held], pos[held]
    if n * m * width < 2**63:
        key, pos = np.divmod(np.sort(key * width + pos), width)
    else:
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
    key, pos = key[new], pos[new].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    offsets = pa.array(np.append(first, len(key)), pa.int32())
    term, doc = np.divmod(key[first], m)
    of, positions = docs.dictionary.take(pa.array(doc)), pa.ListArray.from_arrays(offsets, pa.array(pos))
    if by_term:
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        offsets = pa.array(np.append(first, len(term)), pa.int32())
        made = pa.RecordBatch.from_arrays([kept.dictionary.take(pa.array(term[first])), pa.ListArray.from_arrays(offsets, of), pa.ListArray.from_arrays(offsets, positions)], ["term", "docs", "positions"])
    else:
        made = pa.RecordBatch.from_arrays([of, kept.dictionary.take(pa.array(term)), positions], ["doc_id", "term", "positions"])
    for at in range(0, made.num_rows, BATCH_ROWS):
        yield made.slice(at, BATCH_ROWS)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(i) for b in batches]) for i in range(2)]


def _texts_grouped(documents: DataFrame, config: AnalyzerConfig, by_term: bool) -> DataFrame:
    """Texts are shuffled by doc_id, where rows of one document meet; their terms are not."""
    terms = _terms_of(config)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: list[pa.RecordBatch] = []  # rows of the last document so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode").indices
            last = pc.index(ids, ids[-1]).as_py()  # ids are sorted
            if not last and late and late[0].column(0)[0].as_py() != batch.column(0)[0].as_py():
                yield from _grouped(*_joined(late), terms, by_term)
                late = []
            if last:
                yield from _grouped(*_joined([*late, batch.slice(0, last)]), terms, by_term)
                late = []
            late.append(batch.slice(last))
        if late:
            yield from _grouped(*_joined(late), terms, by_term)

    docs = documents.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", words(F.col("text")).alias("words"))
    doc, positions = docs.schema["doc_id"].dataType, ArrayType(IntegerType(), False)
    if by_term:
        schema = StructType([StructField("term", StringType()), StructField("docs", ArrayType(doc)), StructField("positions", ArrayType(positions, False))])
    else:
        schema = StructType([StructField("doc_id", doc), StructField("term", StringType()), StructField("positions", positions)])
    return docs.mapInArrow(lists, schema)


def term_lists(documents: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """doc_id, term, positions: one row for each term of a document, positions sorted and distinct."""
    return _texts_grouped(documents, config, False)


def term_blocks(documents: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """term, docs, positions: the same with a row for each term of a batch of documents, none of
    which is in two batches."""
    return _texts_grouped(documents, config, True)


def snippet(text: Column, most: int = 72) -> Column:
    """The first 72 bytes of a text, less those of a character that the cut would split,
    with an ellipsis if there are more. Null text has no snippet."""
    whole = F.encode(text, "utf-8")
    # UTF-8 characters have four bytes at most; the byte after a whole one isn't 10xxxxxx.
    splits = lambda n: F.conv(F.hex(F.substring(whole, n + 1, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    end = F.coalesce(*[F.when(~splits(n), F.lit(n)) for n in range(most, max(-1, most - 4), -1)], F.lit(0))
    return F.when(F.octet_length(text) > most, F.concat(F.decode(F.substring(whole, F.lit(1), end), "utf-8"), F.lit("…"))).otherwise(text)


def show_hits(hits: DataFrame, documents: DataFrame, rows: int = 20) -> None:
    """Print hits (doc_id, and score if there is one) with their snippets, best first or by id."""
    by = [F.desc("score"), F.col("doc_id")] if "score" in hits.columns else [F.col("doc_id")]
    hits.join(documents.select("doc_id", snippet(F.col("text")).alias("snippet")), "doc_id").orderBy(*by).show(rows, truncate=False)
