"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct five-word shingles (A-Z lower-cased;
with fewer words, the whole sequence as one). Two sets link if 100 * intersection >=
80 * union, that is if they differ in at most (|A| + |B|) / 9 elements.

Sizes fall into bands, each 1.25 times as wide as the one before, so that linked sets
are in one band or in neighbouring ones; a set takes part in its own band's instance
and in the next one's. An instance for sizes up to r allows k = 2r / 9 differences. It
divides the feature domain into partitions, and each of them into second-level parts,
of which it enumerates subsets: a signature is what a set holds in one subset of the
parts of one partition. plan() has the numbers. For k from 5 on a partition has three
parts, whose three pairs are its subsets; (k + 1) / 2 partitions would make sure that one
of them has at most one difference, so that two of its parts agree, and `spare` more
make sure of spare + 1 such partitions. For less k one partition has k + 3 or more
parts, and all subsets without k of them are signatures.

So linked sets share signatures of spare + 1 partitions at least, and a set may drop
those of `spare` partitions, provided that all sets drop by one order: first empty
ones, by partition, then the most frequent. The last of the shared ones in that order is
dropped by neither. A signature that many sets share because they hold one passage, or
nothing, is thus mostly dropped, and no link with it.

Equal sets are one class, told apart by a 128-bit hash, and never compared. Classes that
share a signature are candidates: first each with the least class of its signature;
those that verify are joined into components. Then tasks hold the signatures whose classes
are still in different components, and propose of the pairs that sizes and sketches
(counts of hashes, whose differences can't exceed those of the sets) leave possible
only those that join two components, not all pairs of a group. If all proposals verify,
nothing is left to find; otherwise all possible pairs across the components that are
left are verified. So every link either is found or lies inside a component already.
Groups above BLOCK classes are compared block by block. Sets are compared from the
texts of the candidates alone.

Null text is an empty text: no shingles, linked with nothing, its component its own id.
A null id is a node like any other; its component is the least id it reaches, null if
none. Repeated rows are equal sets, and a text is one set however long it is. near_join()
ignores other columns, one_of_each() keeps them, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, deal, discard, few, give_back, map_rows, stored, utf8
from .components import components
from .ngram_lm import LEAST_PARTS, PART_BYTES, mix, word_hashes
from .tokens import Tokens

N = 5
#: A class's two sketches: for pairs within groups the parities of PARITIES counts of hashes and SKETCH
#: counts, for the pairs that are left FINE_SKETCH counts.
PARITIES, SKETCH, FINE_SKETCH = 1024, 64, 512
#: Classes compared at once with each other; larger groups are compared block by block.
BLOCK = 4096
#: Pairs that a task holds to tell repeats, and rows of groups that are dealt together for that.
HELD_PAIRS, TOGETHER = 2_000_000, 5_000
#: Up to so many ids (8 bytes each) are broadcast to pick candidates' texts; beyond, a shuffled join does.
MOST_IDS = 1_000_000
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    tok = Tokens(texts)
    hashes = word_hashes(tok.vocabulary)[tok.ids] if len(tok.ids) else np.zeros(0, np.uint64)
    out: list[np.ndarray] = []
    count = len(hashes) - N + 1
    if count > 0:
        h = np.zeros(count, np.uint64)
        for j, c in enumerate(_POWERS):
            h += hashes[j : j + count] * c
        h = mix(h)
    for a, b in zip(tok.offsets[:-1].tolist(), tok.offsets[1:].tolist()):
        if b - a >= N:
            out.append(np.unique(h[a : b - N + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                whole = sum((hashes[a + j] * _POWERS[j] for j in range(b - a)), np.uint64(b - a))
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_hash(s: np.ndarray) -> tuple[int, int]:
    """The set's 128-bit hash as two signed longs."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def node_of(upper: np.ndarray) -> np.ndarray:
    """40 bits of the class's hash, which stand for it in signature groups."""
    return upper.astype(np.uint64) >> np.uint64(24)


def _bands(most: int) -> np.ndarray:
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 5 // 4)))
    return np.array(bounds + [max(bounds[-1] + 1, -(-bounds[-1] * 5 // 4))], np.int64)


def plan(k: int) -> tuple[int, int, int, int]:
    """For k differences: partitions that are needed, spare ones, second-level parts of
    each, and how many of them a subset leaves out. A partition in excess of
    (k + 1) / (left out + 1), rounded up, is a spare one."""
    if k < 5:
        return 1, 0, max(7, k + 3) if k > 2 else k + 4, k
    needed = (k + 2) // 2
    return needed, -(-3 * needed // 10), 3, 1


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets; the number of the set each belongs to; and a flag: the
    number of signatures that the set may drop in this instance, and the instance (128)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if not sizes.sum():
        return none
    bounds = _bands(int(sizes.max()))
    found = [none]
    for step in (0, 1):
        band = np.searchsorted(bounds, np.maximum(1, sizes)) + step
        k = 2 * bounds[band] // 9
        for small in [k_ for k_ in range(1, 5) if (k == k_).any()] + [0]:
            which = np.flatnonzero(((k == small) if small else (k >= 5)) & (sizes > 0))
            if len(which):
                h, of, spare = _enumerated([sets[i] for i in which.tolist()], band[which], k[which])
                found.append((h, which[of], np.minimum(127, spare[of]).astype(np.uint8) | np.uint8(128 * step)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _enumerated(sets: list[np.ndarray], band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets with the same second level, each one's set, and how many more
    signatures each set may drop."""
    plans = np.array([plan(int(x)) for x in k.tolist()], np.int64)
    count, spare, parts, out = plans[:, 0] + plans[:, 1], plans[:, 1], int(plans[0, 2]), int(plans[0, 3])
    elements, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = mix(band.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(7))
    base = np.concatenate([[0], np.cumsum(count)])
    slot = ((mix(elements + seed[own]) >> np.uint64(32)) * (count * parts)[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[own] * parts
    value = mix(elements ^ np.uint64(0x2545F4914F6CDD1D))
    held = lambda weights: np.bincount(slot, weights, base[-1] * parts).reshape(-1, parts)
    low, high = held((value & np.uint64(0xFFFFFFFF)).astype(np.float64)), held((value >> np.uint64(32)).astype(np.float64))
    filled = np.bincount(slot, minlength=base[-1] * parts).reshape(-1, parts)
    of = np.repeat(np.arange(len(sets)), count)
    place = (np.arange(base[-1]) - base[of]).astype(np.uint64)
    hashes, empty = [], []
    for number, subset in enumerate(combinations(range(parts), parts - out)):
        a, b, n = (x[:, subset].sum(1) for x in (low, high, filled))
        there = place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(number * 0x9E3779B9) + n.astype(np.uint64)
        hashes.append(mix(mix(a.astype(np.uint64) + seed[of]) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + there))
        empty.append(n == 0)
    hashes, empty = np.stack(hashes, 1), np.stack(empty, 1)
    # Empty signatures go first, partition by partition, until `spare` partitions are used up.
    poor = empty.any(1)
    before = np.concatenate([[0], np.cumsum(poor)])
    keep = ~empty | (before[:-1] - before[base[of]] >= spare[of])[:, None]
    left = np.maximum(0, spare - (before[base[1:]] - before[base[:-1]]))
    return hashes[keep], np.repeat(of, keep.sum(1)), left


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, upper, lower (the class), sketch, fine: a row a document."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for some in chunks(tuples, 1):
            for (k, _), s in zip(some, shingle_sets([t for _, t in some])):
                fine = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=FINE_SKETCH)
                coarse = fine.reshape(SKETCH, -1).sum(1)
                odd = np.packbits((np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=PARITIES) & 1).astype(bool))
                yield k, len(s), *class_hash(s), odd.tobytes() + np.minimum(255, coarse).astype(np.uint8).tobytes(), np.minimum(255, fine).astype(np.uint8).tobytes()

    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8()), rows, "doc_id long, n_shingles long, upper long, lower long, sketch binary, fine binary")


def signature_groups(docs: DataFrame, n_parts: int) -> DataFrame:
    """part, signatures, nodes, flags, sizes: the signatures that several classes share,
    ascending, with their classes and the number of them."""

    def pieces(tuples: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for some in chunks(tuples, 0):
            classes: dict[tuple[int, int], np.ndarray] = {}
            for s in shingle_sets([t for (t,) in some]):
                if len(s):
                    classes.setdefault(class_hash(s), s)
            sig, whose, flag = signatures(list(classes.values()))
            node = node_of(np.array([c[0] for c in classes], np.int64))[whose]
            member = np.empty((len(sig), 6), np.uint8)
            member[:, :5], member[:, 5] = node.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], flag
            yield sig, member.view("V6").ravel()

    def group(pdf):
        import pandas as pd

        def wide(column: str) -> np.ndarray:
            raw = np.frombuffer(b"".join(pdf[column]), np.uint8).reshape(-1, 6)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :6] = raw
            return full.view("<u8").ravel()

        part = int(pdf["part"].iloc[0])
        sig, member = wide("hashes") | np.uint64((part & 0xFFFF) << 48), wide("values")  # the part's number, the flag above the node
        order = np.lexsort((member & np.uint64((1 << 40) - 1), sig))
        sig, member = sig[order], member[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])])
        sig, member = sig[fresh], member[fresh]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        size = np.repeat(size, size)
        keep = size > 1
        sig, member, size = sig[keep], member[keep], size[keep]
        row = part, sig.tobytes(), (member & np.uint64((1 << 40) - 1)).tobytes(), (member >> np.uint64(40)).astype(np.uint8).tobytes(), size.astype("<i4").tobytes()
        give_back()
        return pd.DataFrame([row], columns=["part", "signatures", "nodes", "flags", "sizes"])

    dealt = deal(docs.select(utf8()), pieces, n_parts, "V6", 6)
    return dealt.groupBy("part").applyInPandas(group, "part int, signatures binary, nodes binary, flags binary, sizes binary")


def star_pairs(groups: DataFrame) -> DataFrame:
    """a, b (nodes): each class of a signature with the least one."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for sig, node in tuples:
            sig, node = np.frombuffer(sig, "<u8"), np.frombuffer(node, "<u8").astype(np.int64)
            if len(sig):
                first = np.concatenate([[True], sig[1:] != sig[:-1]])
                least = node[first][np.cumsum(first) - 1]
                yield from map(tuple, np.unique(np.stack([least[~first], node[~first]]), axis=1).T.tolist())

    return map_rows(groups.select("signatures", "nodes"), rows, "a long, b long").distinct()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many elements sets of these sketches (a row each) differ at least: each
    element changes one count by one, and one parity."""
    odd = PARITIES // 8 if x.shape[1] == PARITIES // 8 + SKETCH else 0
    counts = np.abs(x[:, odd:].astype(np.int16) - y[:, odd:]).sum(1)
    return np.maximum(counts, np.bitwise_count(x[:, :odd] ^ y[:, :odd]).sum(1)) if odd else counts


def within_sketch(met: DataFrame) -> DataFrame:
    """a, b (classes) of the pairs whose sketches leave a link possible."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a_sketch", "b_sketch"))
            a, b, na, nb = (np.array(batch.column(c)) for c in ("a_upper", "b_upper", "a_n", "b_n"))
            ok = 9 * apart(x, y).astype(np.int64) <= na + nb
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    return met.select("a_upper", "b_upper", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long").distinct()


def members(groups: DataFrame) -> DataFrame:
    """signature, node: a row a member of each group, without those that the set may drop."""

    def run(batches):
        for batch in batches:
            for sig, node, flag, size in zip(*(c.to_pylist() for c in batch.columns)):
                sig, node, flag, size = (np.frombuffer(x, kind) for x, kind in ((sig, "<i8"), (node, "<i8"), (flag, "u1"), (size, "<i4")))
                for i in range(0, len(sig), 100_000):
                    at = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[at], node[at], (flag[at] >> 7).astype(np.int32), (flag[at] & 127).astype(np.int32), size[at])], names=["signature", "node", "instance", "spare", "size"])
        give_back()

    rows = groups.select("signatures", "nodes", "flags", "sizes").mapInArrow(run, "signature long, node long, instance int, spare int, size int")
    rank = F.row_number().over(W.partitionBy("node", "instance").orderBy(F.col("size").desc(), "signature"))
    return rows.withColumn("rank", rank).where(F.col("rank") > F.col("spare")).select("signature", "node")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b of the pairs (of classes) that link, from the classes' whole sets."""
    side = lambda x: classes.select(F.col("upper").alias(x), F.col("upper").alias(f"{x}_upper"), F.col("n").alias(f"{x}_n"), F.col("fine").alias(f"{x}_sketch"))
    pairs = stored(few(within_sketch(pairs.join(side("a"), "a").join(side("b"), "b"))), "near-close")
    wanted = pairs.select(F.col("a").alias("upper")).unionByName(pairs.select(F.col("b").alias("upper"))).distinct()
    ids = stored(classes.join(wanted, "upper", "left_semi").select("rep", "upper"), "near-ids")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    keys = ids.where(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id")).distinct()
    chosen = slim.join(F.broadcast(keys) if ids.count() <= MOST_IDS else keys, "doc_id", "left_semi").unionByName(slim.where(F.col("doc_id").isNull()))

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for some in chunks(tuples, 0):
            for s in shingle_sets([t for (t,) in some]):
                if len(s):
                    yield class_hash(s)[0], s.tobytes()

    sets = stored(map_rows(chosen.select("text"), rows, "upper long, members binary").dropDuplicates(["upper"]), "near-sets", "none")
    both = pairs.join(sets.select(F.col("upper").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("upper").alias("b"), F.col("members").alias("y")), "b")

    def compare(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, x, y in tuples:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                yield a, b

    linked = stored(few(map_rows(both.select("a", "b", "x", "y"), compare, "a long, b long").distinct()), "near-linked")
    discard(pairs, ids, sets)
    return linked


class _Joined:
    """Union-find over the labels that a task has met."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = x = p.get(y, y)
        return x

    def roots(self, labels: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(labels, return_inverse=True)
        return np.array([self.root(x) for x in distinct.tolist()], np.int64)[at]

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


class _Held:
    """A task's distinct pairs, given out at the end, or before they outgrow memory."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts += found
        self.size += sum(x.shape[1] for x in found)
        if self.size > HELD_PAIRS:
            self.parts = [np.unique(np.concatenate(self.parts, axis=1), axis=1)]
            self.size = self.parts[0].shape[1]
            if self.size > HELD_PAIRS // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            got = np.unique(np.concatenate(self.parts, axis=1), axis=1)
            for i in range(0, got.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(got[0, i : i + 100_000]), pa.array(got[1, i : i + 100_000])], names=["a", "b"])
        self.parts, self.size = [], 0


def cross_pairs(rows: DataFrame, every: bool) -> DataFrame:
    """a, b: pairs of a group in different components that sizes and sketches leave possible;
    all of them, or only those that join components which the task hasn't joined so far.

    rows: signature, upper, n, label, sketch, sorted within partitions by signature and n; a
    row's block matters only where split is 1 (a pair of blocks of a large group)."""

    def run(batches):
        rest, held, joined = None, _Held(), _Joined()
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.array(c) for c in batch.columns[:-1]]
            cols = [*now, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, PARITIES // 8 + SKETCH)]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            last = np.searchsorted(cols[0], cols[0][-1])
            rest = [c[last:] for c in cols]
            yield from held.add(pairs([c[:last] for c in cols], joined))
        if rest is not None:
            yield from held.add(pairs(rest, joined))
        yield from held.out()
        give_back()

    def pairs(cols, joined):
        key, upper, n, label, block, split, sketch = cols
        found = []
        if not every and len(key):
            label = joined.roots(label)
        left = np.arange(len(key) - 1)
        d = 1
        while len(left):
            left = left[left + d < len(key)]
            left = left[(key[left] == key[left + d]) & (4 * n[left + d] <= 5 * n[left])]  # n ascends within a group
            right = left + d
            near = (label[left] != label[right]) & ((split[left] == 0) | (block[left] != block[right]))
            i, j = left[near], right[near]
            some = []
            for c in range(0, len(i), 50_000):
                p, q = i[c : c + 50_000], j[c : c + 50_000]
                ok = 9 * apart(sketch[p], sketch[q]).astype(np.int64) <= n[p] + n[q]
                some.append(np.stack([p[ok], q[ok]]))
            some = np.concatenate(some, axis=1) if some else np.zeros((2, 0), np.int64)
            if not every and some.shape[1]:
                some = some[:, [joined.unite(x, y) for x, y in zip(label[some[0]].tolist(), label[some[1]].tolist())]]
                label = joined.roots(label)
            if some.shape[1]:
                found.append(np.stack([np.minimum(upper[some[0]], upper[some[1]]), np.maximum(upper[some[0]], upper[some[1]])]))
            d += 1
        return [np.unique(np.concatenate(found, axis=1), axis=1)] if found else []

    return rows.select("signature", "upper", "n", "label", "block", "split", "sketch").mapInArrow(run, "a long, b long").distinct()


def open_rows(all_members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups that span several components, dealt and sorted for cross_pairs."""
    told = all_members.join(labels.select("node", "label"), "node")
    open_groups = told.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where(F.col("x") != F.col("y"))
    # Groups of the same outermost components mostly repeat the same pairs, so they are dealt
    # to one task, which tells the repeats; if they are many, to several.
    weight = open_groups.groupBy("x", "y").agg((F.sum("size") / TOGETHER).cast("long").alias("shares"))
    share = F.xxhash64("x", "y", F.pmod(F.xxhash64("signature"), F.col("shares") + 1))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = open_groups.join(weight, ["x", "y"]).select("signature", blocks.alias("blocks"), share.alias("share"))
    rows = all_members.join(dealt, "signature").join(labels, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("upper"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("split", (F.col("block") != F.col("with")).cast("int")).withColumn("signature", F.when(F.col("blocks") == 1, F.col("signature")).otherwise(F.xxhash64("signature", F.least("block", "with"), F.greatest("block", "with"))))
    return rows.repartition(F.when(F.col("blocks") == 1, F.col("share")).otherwise(F.col("signature"))).sortWithinPartitions("signature", "n", "upper")


def near_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    size = docs.select(F.length(utf8()).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    n_parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    sets = stored(sets_of(docs), "near-documents")
    classes = stored(
        sets.where(F.col("n_shingles") > 0).groupBy("upper", "lower").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.max("fine").alias("fine")).withColumn("node", F.shiftrightunsigned("upper", 24)), "near-classes"
    )
    groups = stored(signature_groups(docs, n_parts), "near-groups")

    known = classes.select("node", "upper", "n", "sketch")
    side = lambda x: known.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in known.columns[1:]])
    met = star_pairs(groups).join(side("a"), "a").join(side("b"), "b").where(4 * F.greatest("a_n", "b_n") <= 5 * F.least("a_n", "b_n"))
    stars = stored(few(within_sketch(met)), "near-stars")
    linked = verified(stars, classes, docs)
    links = components(linked)
    discard(stars, linked)

    all_members = stored(members(groups), "near-members")
    discard(groups)

    def labelled(links: DataFrame) -> DataFrame:
        told = classes.join(links.select(F.col("a").alias("upper"), F.col("b").alias("label")), "upper", "left")
        return stored(told.select("node", "upper", "n", "sketch", F.coalesce("label", "upper").alias("label")), "near-labels")

    labels, touched = labelled(links), None
    for every in (False, True):
        some = labels if touched is None else labels.join(touched, "label", "left_semi")
        possible = stored(few(cross_pairs(open_rows(all_members, some), every)), "near-possible")
        more = verified(possible, classes, docs)
        found, old = more.count(), links
        if found:
            links = components(links.unionByName(more))
            discard(old)
        discard(labels)
        if every or found == possible.count():
            break
        # What a proposal that failed has kept apart: only these components can have links left.
        labels = labelled(links)
        side = lambda x: labels.select(F.col("upper").alias(x), F.col("label").alias(f"of_{x}"))
        failed = possible.join(more, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b").where(F.col("of_a") != F.col("of_b"))
        touched = stored(few(failed.select(F.explode(F.array("of_a", "of_b")).alias("label")).distinct()), "near-touched")
        discard(possible, more)
    discard(all_members)

    joined = classes.select("upper", "rep").join(links.select(F.col("a").alias("upper"), F.col("b").alias("label")), "upper", "left").select("upper", "rep", F.coalesce("label", "upper").alias("label"))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select(F.col("upper").alias("of"), "component_id")
    return sets.join(named, (F.col("upper") == F.col("of")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least id, a null id coming last,
    and of rows that share it the one stored first. Rows without words stay.

    Rows are told apart by a stored number, which stands for doc_id in the join."""
    numbered = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "near-rows")
    found = near_join(numbered.select(F.col("row").alias("doc_id"), "doc.text")).where(F.col("n_shingles") > 0).select(F.col("doc_id").alias("of"), "component_id")
    found = stored(found, "near-found")
    named = found.join(numbered.select("row", F.col("doc.doc_id").cast("long").alias("id")), F.col("of") == F.col("row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of")).alias("first")).select(F.col("first.of").alias("first"))
    gone = stored(found.join(first, F.col("of") == F.col("first"), "left_anti").select("of"), "near-gone")
    kept = numbered.join(F.broadcast(gone) if gone.count() <= MOST_IDS else gone, F.col("row") == F.col("of"), "left_anti")
    return kept.select("doc.*")
