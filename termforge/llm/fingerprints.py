"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest
stretch that isn't in the dictionary yet, which then takes it in. The set of phrases is
hashed and its KEPT lowest hashes are the signature; the likeness of two signatures is
the share of common hashes among the KEPT lowest of both, which estimates the Jaccard
likeness of the phrase sets, high for texts that compress well together.

fingerprint_edits() compares every text with its edited text (its last quarter replaced
by the beginning of the next document) and with the next document. Texts are shuffled
once, into as many ranges of doc_id as there are shuffle partitions; each range is sorted
and read as a stream, and the first document of the next range is sent along with it.

Null text is an empty text, whose fingerprint is the empty string; two empty fingerprints
are alike (1.0), an empty and another are not (0.0). Null ids sort last; rows of one id
follow each other by text. The table's last row is followed by its first; a single row
is followed by itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shuffle_parts, utf8

KEPT = 64
#: Accuracy of the range bounds; the sketch of doc_ids is of fixed size.
ACCURACY = 100_000


def parse(data: bytes, phrases: set[bytes], begin: int = 0, at: int | None = None) -> int:
    """Add the phrases of data[begin:] to the dictionary; returns where the unfinished
    phrase begins. `at`: the end of what is known of that phrase already."""
    end = begin + 1 if at is None else at + 1
    add = phrases.add
    n = len(data)
    while end <= n:
        phrase = data[begin:end]
        if phrase not in phrases:
            add(phrase)
            begin = end
        end += 1
    return begin


def signature(phrases: set[bytes], rest: bytes = b"") -> np.ndarray:
    """The KEPT lowest distinct hashes of the phrases and of the unfinished one."""
    hashes = np.fromiter(map(crc32, phrases), np.uint32, len(phrases))
    if rest and rest not in phrases:
        hashes = np.append(hashes, np.uint32(crc32(rest)))
    # crc32 is linear in its input; a multiplicative mix spreads the low hashes.
    mixed = hashes * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed = mixed * np.uint32(0x85EBCA77)
    if len(mixed) > 4 * KEPT:
        mixed = np.partition(mixed, 2 * KEPT)[: 2 * KEPT + 1]
    return np.unique(mixed)[:KEPT]


def fingerprint(data: bytes) -> np.ndarray:
    phrases: set[bytes] = set()
    return signature(phrases, data[parse(data, phrases) :])


def fingerprints_with_edit(head: bytes, tail: bytes, other: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of head + tail and of head + other; the head is parsed once."""
    phrases: set[bytes] = set()
    begin = parse(head, phrases)
    both = []
    for last, known in ((tail, set(phrases)), (other, phrases)):
        data = head[begin:] + last
        rest = parse(data, known, 0, len(head) - begin)
        both.append(signature(known, data[rest:]))
    return both[0], both[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the lowest of both signatures."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text, without a shuffle."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for k, data in tuples:
            yield k, text_of(fingerprint(data))

    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8()), rows, "doc_id long, fingerprint string")


def _ranges(docs: DataFrame, parts: int):
    """A column that numbers the range of doc_id, the number of ranges, and the first id of each range that has rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], ACCURACY).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    number = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(_search(cuts))
    firsts = ids.select("doc_id", number.alias("range")).groupBy("range").agg(F.min("doc_id").alias("first")).orderBy("range").collect()
    return number.cast("int"), len(cuts) + 1, [(r.range, r["first"]) for r in firsts]


def _search(cuts: list[int]):
    """The number of cuts below doc_id, by halving."""
    if not cuts:
        return F.lit(0)

    def within(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(doc_id > {cuts[mid]}L, {within(mid + 1, hi)}, {within(lo, mid)})"

    return F.expr(within(0, len(cuts)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    number, ranges, firsts = _ranges(docs, parts)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).withColumn("range", number).withColumn("borrowed", F.lit(0))
    # The first id of a range goes to the range before it as well: as many ids as ranges, whatever the input.
    follows = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    lent = slim
    if follows:
        pairs = F.broadcast(spark.createDataFrame(follows, "to int, first long"))
        heads = slim.join(pairs, slim["doc_id"].eqNullSafe(pairs["first"])).select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("borrowed"))
        lent = slim.unionByName(heads)
    ordered = lent.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "borrowed", F.col("doc_id").asc_nulls_last(), "text")

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        """Rows of a range in order; the last is a borrowed one. A row's own signature is
        made with its edit's, when the next row is seen, so near_next lags by one row."""
        held = pending = None
        for k, data, part, borrowed in tuples:
            text = data.decode("utf-8")
            if held is not None and held[2] == part:
                n = len(held[1])
                head, tail, other = held[1][: n - n // 4].encode(), held[1][n - n // 4 :].encode(), text[: n // 4].encode()
                own, edited = fingerprints_with_edit(head, tail, other)
                if pending is not None:
                    yield result(*pending, own)
                pending = (held[0], n, hashlib.sha256(head + other).hexdigest(), own, edited)
                if borrowed:
                    yield result(*pending, fingerprint(data))
                    held = pending = None
                    continue
            held = None if borrowed else (k, text, part)

    def result(k, n, sha, own, edited, following) -> tuple:
        return k, n, sha, text_of(own), text_of(edited), likeness(own, edited), likeness(own, following)

    return map_rows(ordered.select("doc_id", "text", "range", "borrowed"), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
