"""Two text classifiers on gradient-boosted trees: quality and toxicity.

Both learn from a bounded sample of labelled rows (SAMPLE_ROWS, those of the lowest
hashes), never from rows whose crc32 of the id's text is 0 modulo HELD_OUT, and score
every whole text from its own bytes alone. The sample's ids are broadcast (they are
bounded), its features are computed where the texts are, and the trees are fitted on
the driver and sent to the workers as flat arrays.

Null or empty text has the features of an empty text and is scored like any other.
Null labels and labels of unknown documents are ignored; of several labels of one id
the largest counts. A null id is not held out and never learned from. Without labels
every quality score is the constant 0.5, and every toxicity score 0. Repeated rows give repeated scores.
A text is scored as a whole however long it is, an empty table gives no rows, and columns besides
doc_id and text (of labels: doc_id and the label) are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import ROWS_AT_ONCE, chunks, give_back, map_rows, utf8
from .tokens import Tokens

SAMPLE_ROWS = 24_000
HELD_OUT = 5
SEED = 29
#: Parts of the sample for the toxicity model: what is learned from a row never flatters that row.
FOLDS = 5

Features = Callable[[list[bytes]], np.ndarray]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, y, part, text of at most `rows` labelled rows that aren't held out. part is a
    second hash, so that splits by it are even however few of the rows the first one picks."""
    pick, part = (F.xxhash64(F.lit(seed), F.col("doc_id")) for seed in (SEED, SEED + 1))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    few = told.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(pick, "doc_id").limit(rows).withColumn("part", part)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(few), "doc_id")


def fold_of(part: np.ndarray) -> np.ndarray:
    return part % FOLDS


def sample_features(chosen: DataFrame, features: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and folds of the (bounded) sample, in order of its second hash.
    features: one for all rows, or one for each fold."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for some in chunks(tuples, 3):
            fold = fold_of(np.array([t[2] for t in some])) % len(features)
            for i in np.unique(fold).tolist():
                mine = [t for t, f in zip(some, fold.tolist()) if f == i]
                for (k, y, part, _), f in zip(mine, features[i]([t[3] for t in mine])):
                    yield k, y, part, f.astype("<f8").tobytes()

    got = sorted(map_rows(chosen.select("doc_id", "y", "part", "text"), rows, "doc_id long, y double, part long, x binary").collect(), key=lambda r: (r.part, r.doc_id, r.x))
    width = len(features[0]([b""])[0])
    x = np.frombuffer(b"".join(r.x for r in got), "<f8").reshape(-1, width)
    return x, np.array([r.y for r in got]), fold_of(np.array([r.part for r in got], np.int64))


def score_all(docs: DataFrame, features: Features, model: Callable[[np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8().alias("text"))

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for some in chunks(tuples, 2):
            for (k, out, _), s in zip(some, model(features([t[2] for t in some])).tolist()):
                yield k, out, s, int(s >= threshold)

    return map_rows(held, rows, "doc_id long, held_out boolean, score double, predicted int")


# --- what both read from the bytes -------------------------------------------------

#: Classes of bytes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#%&*$@", b"\"'`", b"()[]{}<>", b"-_=+/\\:;~^")


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, chars in enumerate(CLASSES):
        table[np.frombuffer(chars, np.uint8)] = i
    return table


_TABLE = _class_table()


def byte_shares(texts: list[bytes]) -> np.ndarray:
    """Share of each class in each text, and of all other bytes."""
    counts = np.stack([np.bincount(_TABLE[np.frombuffer(t, np.uint8)], minlength=len(CLASSES) + 1) for t in texts])
    return counts / np.maximum(1, counts.sum(1, keepdims=True))


# --- quality ------------------------------------------------------------------------


def quality_features(texts: list[bytes]) -> np.ndarray:
    """Statistics of each document: lengths, shares of byte classes, repetition of words,
    pairs and lines, and how words end."""
    tok = Tokens(texts)
    n = np.maximum(1, tok.lengths)
    size = len(tok.vocabulary)
    width = np.array([len(w) for w in tok.vocabulary] + [0], np.float64)[tok.ids]
    ends = np.array([w[-1] for w in tok.vocabulary] + [0])
    odd_end = np.isin(ends, np.frombuffer(b"#%&*$@!|", np.uint8))[tok.ids]
    alpha = np.array([w.isalpha() or w[:-1].isalpha() or max(w) > 127 for w in tok.vocabulary] + [False])[tok.ids]
    pair = tok.doc.astype(np.int64) * max(1, size) + tok.ids
    words, counts = np.unique(pair, return_counts=True)
    of = (words // max(1, size)).astype(np.int64)
    distinct = np.bincount(of, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, of, counts)
    same = np.zeros(len(tok.ids))
    if len(tok.ids) > 1:
        same[1:] = (tok.ids[1:] == tok.ids[:-1]) & (tok.doc[1:] == tok.doc[:-1])
        inside = tok.doc[1:] == tok.doc[:-1]
        twos = (tok.ids[:-1].astype(np.uint64) << np.uint64(32) | tok.ids[1:].astype(np.uint64))[inside]
        mixed = (twos * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        pairs = np.unique((tok.doc[1:][inside].astype(np.uint64) << np.uint64(40)) | mixed)
        distinct_pairs = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    else:
        distinct_pairs = np.zeros(len(texts))
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], np.float64)
    again = np.array([1 - len(set(x)) / len(x) for x in lines])
    longest = np.array([max(map(len, x)) for x in lines], np.float64)
    mean = tok.per_doc(width) / n
    return np.column_stack(
        [
            np.log1p([len(t) for t in texts]),
            np.log1p(tok.lengths),
            mean,
            np.sqrt(np.maximum(0, tok.per_doc(width**2) / n - mean**2)),
            distinct / n,
            top / n,
            distinct_pairs / np.maximum(1, tok.lengths - 1),
            tok.per_doc(same) / n,
            tok.per_doc(odd_end) / n,
            tok.per_doc(alpha) / n,
            tok.per_doc(width <= 2) / n,
            np.log1p(n_lines),
            again,
            np.log1p(longest),
            byte_shares(texts),
        ]
    )


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    x, y, _ = sample_features(sample(docs, labels, "quality"), [quality_features])
    forest = gbt.fit(x, y)
    return score_all(docs, quality_features, forest.score, threshold)


# --- toxicity -----------------------------------------------------------------------

#: Insults and second-person words that the lexicon starts from.
INSULTS = "idiot idiots idiotic moron morons moronic stupid stupidity dumb loser losers trash garbage scum clown clowns pathetic worthless disgusting retard fool fools jerk creep pig filth vermin hate kill ugly liar coward".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted tuyo vosotros".split()
LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
#: A learned stem is in so many toxic documents at least, and so much likelier there.
LEAST_DOCS, LEAST_ODDS = 3, 4.0
#: Words and stems that a task holds while it counts, before it starts anew or gives them out.
HELD_WORDS, HELD_STEMS = 50_000, 200_000


def _bare(word: bytes) -> str:
    """The word's letters without what stands before and after."""
    return "".join(LETTERS.findall(word.decode("utf-8", "replace"))).lower()


def _stems(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if k <= len(word)] + [word + "$"]


def learn_lexicon(chosen: DataFrame) -> list[dict[str, float]]:
    """Stems (beginnings of words, and whole words) that tell toxic documents apart, with
    their log odds: a lexicon for each fold, learned from the other folds, and one learned
    from all. Counted where the texts are: the stems of toxic documents first, then those
    stems in the others. What the driver gets is bounded by the sample: stems of
    LEAST_DOCS of its toxic documents at least."""

    def counting(wanted: set[str] | None):
        def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
            seen: Counter = Counter()
            memo: dict[bytes, list[str]] = {}
            for text, part in tuples:
                fold = part % FOLDS
                seen[fold, ""] += 1
                stems: set[str] = set()
                for w in set(text.lower().split()):
                    if w not in memo:
                        if len(memo) >= HELD_WORDS:
                            memo.clear()
                        memo[w] = [s for s in _stems(_bare(w)) if wanted is None or s in wanted]
                    stems.update(memo[w])
                seen.update((fold, s) for s in stems)
                if len(seen) > HELD_STEMS:
                    yield from ((f, s, n) for (f, s), n in seen.items())
                    seen.clear()
            yield from ((f, s, n) for (f, s), n in seen.items())

        return rows

    def count(y: float, wanted: set[str] | None, least: int) -> dict[str, np.ndarray]:
        """Documents of each fold that hold a stem, and of all folds; those of "" are all."""
        per = map_rows(chosen.where(F.col("y") == y).select("text", "part"), counting(wanted), "fold int, stem string, docs long")
        folds = [F.coalesce(F.sum(F.when(F.col("fold") == i, F.col("docs"))), F.lit(0)).alias(f"f{i}") for i in range(FOLDS)]
        rows = per.groupBy("stem").agg(*folds, F.sum("docs").alias("docs")).where((F.col("docs") >= least) | (F.col("stem") == "")).collect()
        return {r.stem: np.array([*(r[f"f{i}"] for i in range(FOLDS)), r.docs]) for r in rows}

    none = np.zeros(FOLDS + 1, np.int64)
    toxic = count(1.0, None, LEAST_DOCS)
    n_toxic = toxic.pop("", none)
    clean = count(0.0, set(toxic), 1) if toxic else {}
    n_clean = clean.pop("", none)
    lexicons: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    others = lambda n: np.append(n[-1] - n[:-1], n[-1])  # without each fold, and of all
    all_toxic, all_clean = others(n_toxic), others(n_clean)
    for stem, k in toxic.items():
        k, c = others(k), others(clean.get(stem, none))
        odds = np.log((k + 0.5) / (all_toxic + 1) * (all_clean + 1) / (c + 0.5))
        for i in np.flatnonzero((k >= LEAST_DOCS) & (odds >= np.log(LEAST_ODDS))).tolist():
            lexicons[i][stem] = float(odds[i])
    return lexicons


class ToxicityFeatures:
    """Lexicon densities, second-person proximity, capitals, punctuation and obfuscation."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.insults, self.second = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self.memo: dict[bytes, tuple[float, float, float, float, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def known(self, w: bytes) -> tuple[float, float, float, float, float]:
        """word(), remembered for up to HELD_WORDS short words."""
        found = self.memo.get(w)
        if found is None:
            found = self.word(w)
            if len(w) <= 24:
                if len(self.memo) >= HELD_WORDS:
                    self.memo.clear()
                self.memo[w] = found
        return found

    def word(self, w: bytes) -> tuple[float, float, float, float, float]:
        bare = _bare(w)
        plain = bare in self.insults
        odds = max((self.lexicon.get(s, 0.0) for s in _stems(bare)), default=0.0)
        core = w.strip(b".,;:!?\"'()#%&*$")
        mixed = not core.isalpha() and any(97 <= c <= 122 for c in core) and any(c in b"0123456789@$!|*.-_" for c in core)
        hidden = False
        if mixed:
            seen = re.sub(rb"[^a-z]", b"", core.translate(LEET)).decode()
            hidden = not plain and (seen in self.insults or re.sub(r"(.)\1+", r"\1", seen) in self.insults)
        return float(plain), odds, float(hidden), float(bare in self.second), float(mixed)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        tok = Tokens(texts)
        n = np.maximum(1, tok.lengths)
        plain, odds, hidden, second, mixed = np.array([self.known(w) for w in tok.vocabulary] + [(0.0,) * 5]).T[:, tok.ids]
        hit = (plain > 0) | (hidden > 0) | (odds > 3)
        before = np.concatenate([[0.0], np.cumsum(second)])
        lo = np.maximum(np.arange(len(hit)) - 5, tok.offsets[:-1][tok.doc])
        hi = np.minimum(np.arange(len(hit)) + 6, tok.offsets[1:][tok.doc])
        close = hit & (before[hi] > before[lo])
        top = np.zeros((len(texts), 2))
        np.maximum.at(top[:, 0], tok.doc, odds)
        strong = tok.per_doc(odds > 3)
        return np.column_stack(
            [
                tok.per_doc(plain) / n,
                np.log1p(tok.per_doc(plain)),
                top[:, 0],
                np.log1p(strong),
                strong / n,
                tok.per_doc(odds) / n,
                np.log1p(tok.per_doc((odds > 1.5) & (odds <= 3))),
                np.log1p(tok.per_doc(hidden)),
                tok.per_doc(second) / n,
                np.log1p(tok.per_doc(close)),
                tok.per_doc(mixed) / n,
                np.log1p(tok.lengths),
                byte_shares(texts),
            ]
        )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityFeatures, Callable[[np.ndarray], np.ndarray]]:
    """Every row of the sample teaches lexicon, trees and calibration: its features come from
    the lexicon of the other folds, and the margin that calibrates from trees of the others."""
    chosen = sample(docs, labels, "toxic")
    *apart, features = map(ToxicityFeatures, learn_lexicon(chosen))
    x, y, fold = sample_features(chosen, apart)
    if not len(y):
        return features, lambda rows: np.zeros(len(rows))
    forest = gbt.fit(x, y)
    margin = np.zeros(len(y))
    for i in np.unique(fold).tolist():
        mine = fold == i
        margin[mine] = (gbt.fit(x[~mine], y[~mine]) if not mine.all() else forest).margin(x[mine])
    xs, ys = gbt.isotonic(margin, y)
    return features, lambda rows: np.interp(forest.margin(rows), xs, ys)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    features, model = toxicity_model(docs, labels)
    return score_all(docs, features, model, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold. Whole
    Arrow batches pass through; no row meets a shuffle."""
    features, model = toxicity_model(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                texts = ((None, (t or "").encode("utf-8")) for t in part.column(at).to_pylist())
                scores = np.concatenate([model(features([t for _, t in some])) for some in chunks(texts, 1)])
                yield part.filter(pa.array(scores < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
