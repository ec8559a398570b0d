"""LM scoring with a log-frequency Bloom filter.

Counts of single words and of word pairs are gathered from the training documents,
quantised by powers of two, and kept in a Bloom filter: an n-gram of level j is entered
as members 1 to j, so its level is read by probing 1, 2, ... until a probe fails. The
text's score is the sum of log10 of smoothed pair probabilities (Dirichlet smoothing of
pair counts towards add-one word probabilities), all of whose counts come from those
probes. The filter grows with the n-grams, every one of which it holds, in parts by hash.

Exact counts (for the base score) are kept by 64-bit word hash. Up to MOST_WORDS of them
and a filter of up to MOST_FILTER bytes are broadcast. Beyond either, parts stay where
they are: documents are dealt into buckets, each bucket asks the parts for the levels of
its n-grams and the counts of its words, and the answers are joined to it (the same
results either way).

A text's tokens are its words and one end; a pair's first word is the end at the start.
Null text is empty: one token. Null ids train and are not held out. Repeated rows count
and are scored each. With no training rows every count is 0. Other columns are ignored, and
a text is scored as a whole however long it is. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows, stored, utf8
from .tokens import Tokens

MODULUS, HELD_REMAINDER = 7, 2
BITS_PER_MEMBER, PROBES = 12, 5
#: Up to so many bytes of filter, and so many words, are broadcast.
MOST_FILTER = 96 << 20
MOST_WORDS = 8_000_000
#: Bytes of parts that are fetched at once for it.
FETCH_BYTES = 6 << 20
#: Weight of the word probabilities in a pair's smoothing, in counts.
MU = 500.0
#: Text bytes for each part of the counts, and for each bucket of documents.
PART_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
LEAST_PARTS = 64
MOST_LEVEL = 48
END = np.uint64(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def token_stream(texts: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, of the token before each, and each one's text."""
    tok = Tokens(texts)
    hashes = word_hashes(tok.vocabulary)
    n = len(tok.ids) + len(texts)
    ends = tok.offsets[1:] + np.arange(len(texts))
    is_word = np.ones(n, bool)
    is_word[ends] = False
    stream = np.full(n, END)
    stream[is_word] = hashes[tok.ids] if len(tok.ids) else hashes[:0]
    before = np.concatenate([[END], stream[:-1]]) if n else stream
    doc = np.repeat(np.arange(len(texts)), tok.lengths + 1)
    return tok, stream, before, doc


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for none."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def _member(hashes: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a part that holds a member, and its PROBES bits there: a probe of
    all of them reads memory once."""
    h = mix(hashes + np.asarray(level, np.uint64) * np.uint64(0xA0761D6478BD642F))
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32), mask


def build_part(hashes: np.ndarray, counts: np.ndarray, most_bits: int) -> tuple[bytes, int]:
    """A part's bits, and the lowest level that it stores."""
    level = np.minimum(levels(counts), MOST_LEVEL)
    floor = 1
    members = lambda f: int(np.maximum(0, level - f + 1).sum())
    while members(floor) * BITS_PER_MEMBER > most_bits and floor < MOST_LEVEL:
        floor += 1
    words = max(1, -(-members(floor) * BITS_PER_MEMBER // 64))
    bits = np.zeros(words, np.uint64)
    for j in range(floor, int(level.max(initial=0)) + 1):
        at, mask = _member(hashes[level >= j], j, words)
        order = np.argsort(at)
        at, mask = at[order], mask[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            bits[at[first]] |= np.bitwise_or.reduceat(mask, first)
    return bits.astype("<u8").tobytes(), floor


class CountFilter:
    """The parts of one order of n-grams; the part is in a hash's upper bits."""

    def __init__(self, parts: list[tuple[int, bytes, int]], n_parts: int, shapes: list[tuple[int, int, int]] | None = None):
        """shapes: part, bytes and floor of parts whose bits are put in later."""
        self.n_parts = n_parts
        self.size, self.floor, self.start = np.ones(n_parts, np.uint64), np.ones(n_parts, np.int64), np.zeros(n_parts, np.int64)
        at = 1  # parts without n-grams share an empty word
        for part, n, low in sorted([(part, len(bits), low) for part, bits, low in parts] if shapes is None else shapes):
            self.size[part], self.floor[part], self.start[part] = n // 8, low, at
            at += n // 8
        self.bits = np.zeros(at, "<u8")
        for part, bits, _ in parts:
            self.put(part, bits)

    def put(self, part: int, bits: bytes) -> None:
        at = int(self.start[part])
        self.bits[at : at + len(bits) // 8] = np.frombuffer(bits, "<u8")

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Each n-gram's level, 0 if it isn't stored."""
        out, rows = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        part = part_of(hashes, self.n_parts)
        size, start, j = self.size[part], self.start[part], self.floor[part]
        while len(rows):
            at, mask = _member(hashes, j, size)
            hit = (self.bits[at.astype(np.int64) + start] & mask) == mask
            out[rows[hit]] = j[hit]
            hit &= j < MOST_LEVEL
            rows, hashes, size, start, j = rows[hit], hashes[hit], size[hit], start[hit], j[hit] + 1
        return out


def part_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts[:0]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % MODULUS == HELD_REMAINDER, F.lit(False))


def gather(training: DataFrame, n_parts: int) -> DataFrame:
    """order, part, bits, floor, hashes, counts: the filter's parts, with the exact counts of order 1.

    Every task sums its own counts before they are dealt, by hash, to the parts.
    """

    def count(tuples: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}
        size = 0

        def deal() -> Iterator[tuple]:
            for order, pieces in held.items():
                hashes, counts = (np.concatenate(x) for x in zip(*pieces))
                pieces.clear()  # not held beside what is made from them
                hashes, counts = _summed(hashes, counts)
                part = part_of(hashes, n_parts)
                cuts = np.searchsorted(part, np.arange(n_parts + 1))
                for p in range(n_parts):
                    if (a := cuts[p]) < (b := cuts[p + 1]):
                        c = counts[a:b]
                        kind = "<u1" if c.max() < 256 else "<u8"
                        yield order, p, hashes[a:b].astype("<u8").tobytes(), kind, c.astype(kind).tobytes()

        for some in chunks(tuples, 0):
            tok, stream, before, _ = token_stream([t for (t,) in some])
            held[1].append((np.append(word_hashes(tok.vocabulary), END), np.append(np.bincount(tok.ids, minlength=len(tok.vocabulary)), len(some)).astype(np.uint32)))
            pairs, times = _summed(pair_hashes(before, stream), np.ones(len(stream), np.uint32))
            held[2].append((pairs, times.astype(np.uint32)))
            size += sum(len(x[0]) for x in (held[1][-1], held[2][-1]))
            if size > 6_000_000:
                yield from deal()
                size = 0
        if size:
            yield from deal()

    dealt = map_rows(training.select(utf8().alias("text")), count, "order int, part int, hashes binary, kind string, counts binary")

    def reduce(pdf):
        import pandas as pd

        hashes, counts = _summed(np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]]), np.concatenate([np.frombuffer(x, k).astype(np.int64) for x, k in zip(pdf["counts"], pdf["kind"])]))
        order = int(pdf["order"].iloc[0])
        bits, floor = build_part(hashes, counts, len(hashes) * MOST_LEVEL * BITS_PER_MEMBER)
        exact = order == 1
        return pd.DataFrame({"order": [order], "part": [int(pdf["part"].iloc[0])], "bits": [bits], "floor": [floor], "hashes": [hashes.tobytes() if exact else b""], "counts": [counts.astype("<i8").tobytes() if exact else b""], "kinds": [len(hashes)], "tokens": [int(counts.sum())]})

    return dealt.groupBy("order", "part").applyInPandas(reduce, "order int, part int, bits binary, floor int, hashes binary, counts binary, kinds long, tokens long")


class Model:
    """What the workers need: the corpus totals, and the filters of both orders if they are broadcast."""

    def __init__(self, filters: list[CountFilter], tokens: int, kinds: int, mu: float):
        self.filters, self.tokens, self.kinds, self.mu = filters, tokens, kinds, mu

    def levels(self, order: int, hashes: np.ndarray) -> np.ndarray:
        return self.filters[order - 1].level(hashes)

    def score(self, stream: np.ndarray, before: np.ndarray, hashes: np.ndarray, at: np.ndarray, at_before: np.ndarray, levels) -> np.ndarray:
        """log10 probability of each token; at and at_before number tokens among the distinct
        hashes; levels gives those of an order's n-grams."""
        about = level_count(levels(1, hashes))
        word = (about[at] + 1.0) / (self.tokens + self.kinds + 1.0)
        context = about[at_before]
        pair = np.minimum(level_count(levels(2, pair_hashes(before, stream))), np.minimum(context, about[at]))
        return np.log10((pair + self.mu * word) / (context + self.mu))


def score_chunk(texts: list[bytes], model: Model, lookup, levels) -> Iterator[tuple]:
    """n_tokens, n_known, base_score, score of each text; lookup gives exact counts of
    words' hashes, levels those of an order's n-grams."""
    tok, stream, before, doc = token_stream(texts)
    hashes = np.append(word_hashes(tok.vocabulary), END)
    at = np.full(len(stream), len(hashes) - 1, np.int64)
    is_word = np.ones(len(stream), bool)
    is_word[tok.offsets[1:] + np.arange(len(texts))] = False
    at[is_word] = tok.ids
    at_before = np.concatenate([[len(hashes) - 1], at[:-1]])
    exact = lookup(hashes)
    base = np.log10((exact[at] + 1.0) / (model.tokens + 1.0 * (model.kinds + 1.0)))
    own = model.score(stream, before, hashes, at, at_before, levels)
    size = len(texts)
    yield from zip(
        (tok.lengths + 1).tolist(), np.bincount(doc, exact[at] > 0, size).astype(np.int64).tolist(), np.bincount(doc, base, size).tolist(), np.bincount(doc, own, size).tolist()
    )


def fetch(parts: DataFrame, n_parts: int, tokens: int, kinds: int) -> tuple[list[CountFilter], np.ndarray, np.ndarray]:
    """The filters of both orders, the words' hashes (ascending) and their counts. Some stored
    files are fetched at a time and their parts put in place, so that the driver holds the
    model once and some FETCH_BYTES besides."""
    shapes = parts.select("order", "part", "floor", F.length("bits").alias("bits"), F.length("hashes").alias("hashes")).collect()
    filters = [CountFilter([], n_parts, [(r.part, r.bits, r.floor) for r in shapes if r.order == order]) for order in (1, 2)]
    known, exact = np.zeros(kinds, "<u8"), np.zeros(kinds, "<u4" if tokens < 1 << 32 else "<u8")
    # Parts are in order of the hash, so their arrays join into one sorted array.
    start, at = {}, 0
    for r in sorted((r for r in shapes if r.order == 1), key=lambda r: r.part):
        start[r.part] = at
        at += r.hashes // 8
    files = sorted(parts.inputFiles())
    at_once = max(1, len(files) * FETCH_BYTES // max(1, sum(r.bits + 2 * r.hashes for r in shapes)))
    for i in range(0, len(files), at_once):
        some = parts.sparkSession.read.schema(parts.schema).parquet(*files[i : i + at_once])
        # As Arrow batches, which pass through without being decoded or pickled.
        for batch in some.select("order", "part", "bits", "hashes", "counts").toArrow().to_batches():
            for order, part, bits, hashes, counts in zip(*batch.columns):
                filters[order.as_py() - 1].put(part.as_py(), bits.as_buffer())
                if order.as_py() == 1:
                    own = slice(start[part.as_py()], start[part.as_py()] + len(hashes.as_buffer()) // 8)
                    known[own], exact[own] = np.frombuffer(hashes.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")
    return filters, known, exact


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mu: float = MU, most_words: int = MOST_WORDS, most_filter: int = MOST_FILTER) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8().alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first().bytes
    n_parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    parts = stored(gather(slim.where(~F.col("held_out")), n_parts), "lm-parts", "none")
    totals = {r.order: r for r in parts.groupBy("order").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens"), F.sum(F.length("bits")).alias("bytes")).collect()}
    tokens, kinds = (totals[1].tokens, totals[1].kinds) if 1 in totals else (0, 0)
    sc = docs.sparkSession.sparkContext
    if kinds <= most_words and sum(r.bytes for r in totals.values()) <= most_filter:
        filters, known, exact = fetch(parts, n_parts, tokens, kinds)
        model, table = sc.broadcast(Model(filters, tokens, kinds, mu)), sc.broadcast((known, exact))
        del filters, known, exact

        def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
            known, exact = table.value

            def lookup(hashes: np.ndarray) -> np.ndarray:
                return _found(hashes, known, exact)

            for some in chunks(tuples, 2):
                for (k, held, _), row in zip(some, score_chunk([t[2] for t in some], model.value, lookup, model.value.levels)):
                    yield k, held, *row[:2], model.value.tokens, *row[2:]

        return map_rows(slim, rows, RESULT)
    return _score_in_buckets(slim, parts, Model([], tokens, kinds, mu), n_parts, max(1, -(-size // BUCKET_BYTES)))


def _found(hashes: np.ndarray, known: np.ndarray, exact: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, exact[at], 0)


def _in_chunks(texts) -> Iterator[list[bytes]]:
    return ([t for (t,) in some] for some in chunks(((t,) for t in texts), 0))


def _wanted(texts) -> dict[int, np.ndarray]:
    """The distinct hashes of the words (1) and of the pairs (2) of texts, ascending."""
    words, pairs = [np.array([END])], [np.zeros(0, np.uint64)]
    for some in _in_chunks(texts):
        tok, stream, before, _ = token_stream(some)
        words.append(word_hashes(tok.vocabulary))
        pairs.append(np.unique(pair_hashes(before, stream)))
    return {1: np.unique(np.concatenate(words)), 2: np.unique(np.concatenate(pairs))}


def _score_in_buckets(slim: DataFrame, parts: DataFrame, model: Model, n_parts: int, n_buckets: int) -> DataFrame:
    """For models too large to broadcast: each bucket of documents gets the levels of its own
    n-grams and the counts of its own words, in the order of their hashes."""
    import pandas as pd

    bucketed = slim.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "doc_id", F.crc32("text")), F.lit(n_buckets)).cast("int"))

    def ask(pdf):
        rows = []
        for order, hashes in _wanted(pdf["text"]).items():
            cuts = np.searchsorted(part_of(hashes, n_parts), np.arange(n_parts + 1))
            rows += [(int(pdf["bucket"].iloc[0]), order, p, hashes[cuts[p] : cuts[p + 1]].tobytes()) for p in range(n_parts) if cuts[p] < cuts[p + 1]]
        return pd.DataFrame(rows, columns=["bucket", "order", "part", "wanted"])

    def answer(asked, stock):
        out = []
        if len(asked):
            order, part = int(asked["order"].iloc[0]), int(asked["part"].iloc[0])
            held = [(part, stock["bits"].iloc[0], int(stock["floor"].iloc[0]))] if len(stock) else []
            made = CountFilter(held, n_parts)
            known, exact = (np.frombuffer(stock["hashes"].iloc[0], "<u8"), np.frombuffer(stock["counts"].iloc[0], "<i8")) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for bucket, wanted in zip(asked["bucket"], asked["wanted"]):
                w = np.frombuffer(wanted, "<u8")
                out.append((bucket, order, part, made.level(w).astype(np.uint8).tobytes(), _found(w, known, exact).astype("<i8").tobytes() if order == 1 else b""))
        return pd.DataFrame(out, columns=["bucket", "order", "part", "levels", "counts"])

    def score(texts, told):
        if not len(texts):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        wanted, told = _wanted(texts["text"]), told.sort_values(["order", "part"])
        joined = lambda order, column, kind: np.frombuffer(b"".join(told.loc[told["order"] == order, column]), kind).astype(np.int64)
        level, exact = {order: joined(order, "levels", "u1") for order in (1, 2)}, joined(1, "counts", "<i8")
        at = lambda order, hashes: np.searchsorted(wanted[order], hashes)
        rows = (r for some in _in_chunks(texts["text"]) for r in score_chunk(some, model, lambda hashes: exact[at(1, hashes)], lambda order, hashes: level[order][at(order, hashes)]))
        out = [(k, bool(h), *r[:2], model.tokens, *r[2:]) for k, h, r in zip(texts["doc_id"].astype(object).where(texts["doc_id"].notna(), None), texts["held_out"], rows)]
        frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return frame.astype({"doc_id": "Int64"})

    asked = bucketed.groupBy("bucket").applyInPandas(ask, "bucket int, order int, part int, wanted binary")
    told = asked.groupBy("order", "part").cogroup(parts.select("order", "part", "bits", "floor", "hashes", "counts").groupBy("order", "part")).applyInPandas(answer, "bucket int, order int, part int, levels binary, counts binary")
    return bucketed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(score, RESULT)
