"""Byte-level BPE encoding and decoding.

Each batch's distinct words (matches of the split pattern) are byte arrays over
which ranked merges are folded once, against a rank map shipped to every worker
(its size is that of the vocabulary file, checked); a bounded memo then serves
the repeats. Decoding looks each id up as a binary piece and concatenates.

The fold runs in Arrow-fed Python rather than in SQL higher-order functions: a
literal map of 50,256 ranks is searched linearly by Spark's map lookup, and words
would have to be exploded, joined and regrouped through the shuffle. See README.

Null text is an empty text: 0 tokens. Long words merge through a heap, so their
cost is n log n. Extra columns are ignored, whatever their names; repeated rows give
repeated results, null keys stay null, and an empty table gives no rows. Null ids decode to
no bytes; ids that the vocabulary lacks, or bytes that aren't whole ids, are an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows

#: The rank map is sent to every worker; files beyond this are refused.
MOST_RANKS = 1_000_000
#: A task's memo is emptied beyond so many words; longer words are folded by a heap.
MEMO_WORDS = 200_000
LONG_WORD = 48
#: White space as Unicode's White_Space property has it, which differs from re's \s.
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=None)
def char_class(kind: str) -> str:
    """The inside of a re class with all code points of a general category."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(cp - 1)) if cp - 1 > start else ""))
            start = None
    return "".join(out)


def compile_pattern(pattern: str) -> re.Pattern:
    """The public split pattern for Python's re, which has neither \\p{..} nor the same \\s."""
    inside = re.sub(r"\[\^([^\]]*)\]", lambda m: "[^" + m[1].replace(r"\s", SPACE).replace(r"\p{L}", char_class("L")).replace(r"\p{N}", char_class("N")) + "]", pattern)
    return re.compile(inside.replace(r"\p{L}", f"[{char_class('L')}]").replace(r"\p{N}", f"[{char_class('N')}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks; at most {MOST_RANKS} are sent to the workers")
    return ranks


class PairTable:
    """(left id, right id) -> id of their concatenation, for every pair that has one:
    an open-addressed table with four slots a bucket, looked up by whole arrays."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(rank)
        key, value = np.array(keys, np.uint64), np.array(ids, np.int32)
        self.bits = max(8, int(len(key)).bit_length() + 1)
        while True:
            at = self._bucket(key)
            order = np.argsort(at, kind="stable")
            begins = np.searchsorted(at[order], at[order])
            slot = np.arange(len(key)) - begins
            if not len(key) or slot.max() < 4:
                break
            self.bits += 1
        self.key = np.full((1 << self.bits, 4), np.uint64(2**64 - 1))
        self.value = np.full((1 << self.bits, 4), self.NONE)
        self.key[at[order], slot], self.value[at[order], slot] = key[order], value[order]

    def _bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._bucket(key)
        return np.where(self.key[at] == key[..., None], self.value[at], self.NONE).min(axis=-1)


class Coder:
    """Encodes and decodes by one rank map."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.find = compile_pattern(pattern).findall
        self.odd_space = re.compile(f"[{SPACE.replace(' ', '', 1)}]".replace("\t-\r", "\t\x0b-\r")).search
        self.pieces = {i: p for p, i in ranks.items()}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Merge each word's neighbours of lowest rank, leftmost first, until none has a
        rank. Words of one length are folded together, a column a byte."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                out[i] = self._fold_long(w)
            else:
                by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            for lo in range(0, len(at), 20_000):
                some = at[lo : lo + 20_000]
                for i, packed in zip(some, self._fold_equal(np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(-1, n))):
                    out[i] = packed
        return out

    def _fold_equal(self, letters: np.ndarray) -> list[bytes]:
        ids = self.of_byte[letters]
        rows, done = np.arange(len(ids)), [b""] * len(ids)
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while True:
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            low = rank[np.arange(len(ids)), j] if rank.shape[1] else np.full(len(ids), PairTable.NONE)
            over = low == PairTable.NONE
            if over.any():
                width, flat = ids.shape[1] * 4, ids[over].astype("<u4").tobytes()
                for k, i in enumerate(rows[over].tolist()):
                    done[i] = flat[k * width : k * width + width]
                keep = ~over
                ids, rank, rows, j, low = ids[keep], rank[keep], rows[keep], j[keep], low[keep]
            if not len(rows):
                return done
            here = np.arange(len(ids))
            ids[here, j] = low
            width = ids.shape[1]
            ids = ids[(np.arange(width) != (j + 1)[:, None])].reshape(-1, width - 1)
            rank = rank[(np.arange(width - 1) != j[:, None])].reshape(-1, width - 2)
            if width > 2:
                before = j > 0
                rank[here[before], j[before] - 1] = self.pairs(ids[here[before], j[before] - 1], ids[here[before], j[before]])
                after = j < width - 2
                rank[here[after], j[after]] = self.pairs(ids[here[after], j[after]], ids[here[after], j[after] + 1])

    def _fold_long(self, word: bytes) -> bytes:
        ranks, n = self.ranks, len(word)
        end, left, right = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], right[i] = 1, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(word[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (h := left[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = right[i]
        return struct.pack(f"<{len(out)}I", *out)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        self.words.update(zip(new, self.fold([w.encode("utf-8") for w in new])))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A space between two characters that aren't white space always begins a match,
        so such texts are cut there and each distinct stretch is matched once; texts
        with other white space beside a space are matched whole."""
        for memo in (self.words, self.spaced):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        plain = ["  " not in t and " \n" not in t and "\n " not in t and not self.odd_space(t) for t in texts]
        cut = [t.split(" ") if p else self.find(t) for t, p in zip(texts, plain)]
        stretches: set[str] = set()
        words: set[str] = set()
        heads = [self.find(c[0]) if p else c for c, p in zip(cut, plain)]
        for c, head, p in zip(cut, heads, plain):
            words.update(head)
            if p:
                stretches.update(c[1:])
        new = [s for s in stretches if s not in self.spaced]
        found = [self.find(" " + s) for s in new]
        for f in found:
            words.update(f)
        self._learn(words)
        get = self.words.__getitem__
        self.spaced.update((s, b"".join(map(get, f))) for s, f in zip(new, found))
        spaced = self.spaced.__getitem__
        return [b"".join(map(get, head)) + (b"".join(map(spaced, c[1:])) if p else b"") for c, head, p in zip(cut, heads, plain)]

    def forget(self) -> None:
        """Empty the memo: a worker process outlives its tasks, and serves other stages."""
        self.words.clear()
        self.spaced.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        try:
            return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token {e.args[0]}") from None


def _coder(source, made: dict = {}) -> Coder:
    """One coder for each worker process and vocabulary."""
    key = source.value[0]
    if key not in made:
        made.clear()
        made[key] = Coder(read_ranks(source.value[1]), source.value[2])
    return made[key]


def _shipped(df: DataFrame, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        lines = f.read().splitlines()
    read_ranks(lines)
    key = hashlib.sha256(b"\n".join(lines) + pattern.encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((key, lines, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) of every whole text."""
    source = _shipped(docs, ranks_path, pattern)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        coder = _coder(source)
        for some in chunks(((k, t or "") for k, t in tuples), 1):
            yield from zip((k for k, _ in some), coder.encode_all([t for _, t in some]))
        coder.forget()

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), rows, f"{key} {kind}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, bytes (binary) of each row's ids."""
    source = _shipped(encoded, ranks_path, pattern)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        coder = _coder(source)
        for k, ids in tuples:
            yield k, coder.decode(ids or b"")

    kind = encoded.schema[key].dataType.simpleString()
    return map_rows(encoded.select(key, "ids"), rows, f"{key} {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again, and return the digests of both."""
    source = _shipped(docs, ranks_path, pattern)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        coder = _coder(source)
        for some in chunks(((k, t or "") for k, t in tuples), 1):
            for (k, _), ids in zip(some, coder.encode_all([t for _, t in some])):
                yield k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()
        coder.forget()

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and of the decoded bytes."""
    source = _shipped(docs, ranks_path, pattern)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        coder = _coder(source)
        for some in chunks(((t or "", k, s) for k, s, t in tuples), 0):
            for (_, k, s), ids in zip(some, coder.encode_all([t[0] for t in some])):
                yield k, s, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()
        coder.forget()

    return map_rows(docs.select(F.col("doc_id").cast("long"), "source", "text"), rows, "doc_id long, source string, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
