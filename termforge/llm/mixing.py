"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words are divided into blocks of nearly equal size. Blocks are seats:
a source gets its number of seats by highest quotients q / (2k + 1), and its seats go
to its shards by highest quotients again, which gives an integer quota for each
shard. Within a shard a seeded order of its blocks decides which of them are taken
once more than the others, so that the quota is met exactly.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
all words; a target stops at max_repeats times its source's size and the excess goes
to the others by weight until none is above.

DataFrame functions only. A source's documents are dealt to about sqrt(documents)
shards by a hash of doc_id, so that neither a shard nor a source's list of shards is
large, however hot the source; texts are never shuffled, only ids and sizes.

Null or empty text has size 0 and is taken 0 times; a null source is a source of its
own; a null doc_id is hashed as a null. Repeated rows are rows of their own. An empty
table gives no rows. A text counts with all its words however long it is. Columns besides
doc_id, text and source are ignored by mix() and kept by mixed_documents(), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, few, stored

#: Words in a block, of which a shard has a whole number.
BLOCK_WORDS = 32
MAX_REPEATS = 3
SEED = 17
#: Rows into which each source's row is copied, so that a hot source's documents meet it in many tasks.
SALTS = 64
#: Whole copies are counted in integers, of which this is one copy.
COPY_BITS = 30
COPY = 1 << COPY_BITS
#: Classes of like size in each doubling, when whole copies are decided.
LENGTHS = 8


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size and the columns of `keep`; texts are read here, once."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), *keep)


def targets(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, docs, source_size, weight, target.

    A source is capped if its cap per weight is below the level that the others would
    get; in order of cap per weight, the sources before the first that keeps below
    its cap are the capped ones. One row a source, so one task can hold them.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    ranked = per.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    cap = F.col("source_size") * max_repeats
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = ranked.select("*", rest.alias("rest"), share.alias("share"), F.row_number().over(order).alias("at")).withColumn("free", F.col("weight") * F.col("rest") <= cap * F.col("share"))
    first = F.struct("at", "rest", "share")
    levelled = levelled.withColumn("first", F.min(F.when(F.col("free"), first)).over(whole))
    target = F.when(F.col("at") < F.coalesce(F.col("first.at"), F.lit(2**31 - 1)), cap.cast("double")).otherwise(F.col("weight") * F.col("first.rest") / F.col("first.share"))
    return levelled.select("source", "docs", "source_size", "weight", target.cast("double").alias("target"))


def apportion(parties: DataFrame, group: list[Column], keys: list[str], quota: str, seats: Column, most: str) -> DataFrame:
    """Sainte-Lague seats for each party of each group, as column `seats`.

    Rounding each quota gives the seats of the divisor 1; what the group then lacks
    goes to the highest next quotients and what it has too many is taken from the
    lowest last ones, which is where the divisor method ends. Quotients are listed
    only as far as they can be reached, some three a party. `most` bounds a party.
    """
    whole = W.partitionBy(*group)
    base = F.least(F.floor(F.col(quota) + 0.5).cast("long"), F.col(most))
    start = parties.withColumn("_base", base).withColumn("_lack", seats.cast("long") - F.sum("_base").over(whole))
    room = F.when(F.col("_lack") > 0, F.col(most) - F.col("_base")).otherwise(F.col("_base"))
    open_quota, open_parties = F.sum(F.when(room > 0, F.col(quota))).over(whole), F.count(F.when(room > 0, 1)).over(whole)
    # The divisor d that ends the method has |1 / d - 1| <= (lack + parties / 2) / quotas, so no party moves further than this.
    reach = F.ceil(F.col(quota) * (F.abs("_lack") + open_parties / 2) / open_quota).cast("long") + 1
    near = F.when((F.col("_lack") != 0) & (room > 0), F.least(F.abs("_lack"), room, reach)).otherwise(F.lit(0).cast("long"))
    listed = start.withColumn("_near", near).withColumn("_step", F.explode_outer(F.when(F.col("_near") > 0, F.sequence(F.lit(1).cast("long"), F.col("_near")))))
    quotient = F.when(F.col("_lack") > 0, F.col(quota) / (2 * (F.col("_base") + F.col("_step")) - 1)).otherwise(-F.col(quota) / (2 * (F.col("_base") - F.col("_step")) + 1))
    listed = listed.withColumn("_rank", F.row_number().over(whole.orderBy(F.when(F.col("_step").isNull(), 1).otherwise(0), quotient.desc(), *[F.col(k).asc_nulls_last() for k in keys], "_step")))
    won = F.sum(F.when(F.col("_step").isNotNull() & (F.col("_rank") <= F.abs("_lack")), F.signum("_lack")).otherwise(0)).cast("long")
    kept = [c for c in parties.columns if c not in keys]
    return listed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], (F.first("_base") + won).alias("seats"))


def _edge(words_before: Column, blocks: Column, total: Column) -> Column:
    """The block that holds the word at this place of a shard."""
    return F.floor(words_before * blocks / total).cast("long")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of docs."""
    return _mixed(docs, block_words, max_repeats, seed).select("doc_id", "size", "source_size", "target", "taken", "source")


def _mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of mix(), each row's shard, and the columns of `keep`."""
    sized = stored(sizes(docs, *keep), "mix-sizes")
    per = stored(targets(sized, max_repeats), "mix-targets")
    salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    with_source = sized.withColumn("_salt", F.pmod(F.shiftright(mixed, 40), F.lit(SALTS)).cast("int")).alias("d").join(salted.alias("s"), F.col("d._salt").eqNullSafe(F.col("s._salt")) & F.col("d.source").eqNullSafe(F.col("s.source")))
    dealt = with_source.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", F.pmod(mixed, F.ceil(F.sqrt(F.col("s.docs").cast("double"))).cast("long")).alias("shard"), *[f"d.{c}" for c in keep])

    # Blocks: a shard of w words has round(w / block_words) of them, 1 at least, each of w / blocks words.
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.withColumn("blocks", F.when(F.col("shard_size") > 0, F.greatest(F.lit(1).cast("long"), F.round(F.col("shard_size") / block_words).cast("long"))).otherwise(F.lit(0).cast("long")))
    shards = stored(few(shards), "mix-shards")
    sources = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    sources = sources.withColumn("quota", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("most", F.col("blocks") * max_repeats)
    all_seats = F.round(F.round(F.sum("quota").over(W.partitionBy(F.lit(1))), 6))
    seats = apportion(sources, [F.lit(1)], ["source"], "quota", all_seats, "most").select(F.col("source").alias("_source"), F.col("seats").alias("source_seats"), F.col("blocks").alias("source_blocks"))
    each = shards.join(seats, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = each.withColumn("quota", F.when(F.col("source_blocks") > 0, F.col("source_seats") * F.col("blocks") / F.col("source_blocks")).otherwise(F.lit(0.0))).withColumn("most", F.col("blocks") * max_repeats)
    quotas = apportion(each, [F.col("source")], ["source", "shard"], "quota", F.col("source_seats"), "most")

    # The blocks taken once more: those of the lowest seeded hashes, made distinct by the block's number.
    more = F.when(F.col("blocks") > 0, F.col("seats") % F.col("blocks")).otherwise(F.lit(0).cast("long"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: _block_hash(seed, b)))
    cut = F.when(more > 0, F.element_at(order, more.cast("int")))
    plan = quotas.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks", F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks")).cast("long")).otherwise(F.lit(0).cast("long")).alias("times"), cut.alias("cut")
    )
    along = W.partitionBy("source", "shard").orderBy(mixed, "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(along), F.lit(0).cast("long")))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    return joined.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, _taken(seed)).otherwise(F.lit(0).cast("long")).alias("taken"), "source", "shard", *keep)


def _block_hash(seed: int, block: Column) -> Column:
    """A hash of shard and block in the upper 40 bits, the block's number below."""
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("shard"), block)
    return F.shiftleft(F.shiftrightunsigned(h, 25), 24).bitwiseOR(block % (1 << 24))


def _taken(seed: int) -> Column:
    """Words of the row's place [begin, begin + size) by the times its blocks are taken."""
    end = F.col("begin") + F.col("size")
    # Block b covers the words from ceil(b * shard_size / blocks), which agrees with _edge().
    first, last = _edge(F.col("begin"), F.col("blocks"), F.col("shard_size")), _edge(end - 1, F.col("blocks"), F.col("shard_size"))
    starts = lambda b: F.ceil(b * F.col("shard_size") / F.col("blocks")).cast("long")
    again = lambda b: F.when(F.col("cut").isNotNull() & (_block_hash(seed, b) <= F.col("cut")), 1).otherwise(0)
    overlap = lambda b: F.greatest(F.lit(0).cast("long"), F.least(end, starts(b + 1)) - F.greatest(F.col("begin"), starts(b)))
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + (overlap(b) * again(b)).cast("long"))
    return F.col("times") * F.col("size") + extra


def _starts(lengths: Column) -> Column:
    """length and start of each of a source's lengths: where its running sum of copies
    begins, so that it ends on the number of copies that leaves the fewest words over."""

    def step(acc: Column, x: Column) -> Column:
        part, mean = x["shares"].bitwiseAND(COPY - 1), x["taken"] * F.lit(float(COPY)) / x["shares"]
        due = acc["carry"] + x["taken"] - F.shiftright(x["shares"], COPY_BITS) * mean
        up = (part > 0) & (2 * due >= mean)
        start = F.when(up, COPY - F.shiftright(part + 1, 1)).otherwise(F.shiftright(COPY - part, 1))
        return F.struct(F.when(up, due - mean).otherwise(due).alias("carry"), F.concat(acc["out"], F.array(F.struct(x["length"].alias("length"), start.cast("long").alias("start")))).alias("out"))

    none = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<length:int,start:bigint>>").alias("out"))
    return F.aggregate(F.sort_array(lengths, asc=False), none, step)["out"]


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents as the mix takes them, with the columns of docs: each row stays out or is
    repeated, in whole copies, so that its source's copied words meet what the mix takes.

    A row that is taken taken / size times gets that number of copies, rounded up or down
    by the running sum over the rows of its source and length (a class of like size). Of a
    class's two nearest numbers of copies that one is made which leaves the fewest words
    over, and these are carried to the next shorter class. So each length has its share.
    Rows without words stay out, as the mix takes nothing of them."""
    numbered = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_mix_row")), "mix-rows")
    slim = numbered.select("doc.doc_id", "doc.source", "doc.text", "_mix_row")
    share = F.when(F.col("size") > 0, F.expr(f"(taken * {COPY}L) div size")).otherwise(F.lit(0)).cast("long")
    length = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * LENGTHS)).otherwise(F.lit(-1)).cast("int")
    plan = _mixed(slim, seed=seed, keep=("_mix_row",)).where(F.col("taken") > 0)
    plan = stored(plan.select("_mix_row", "doc_id", "size", "source", "shard", "taken", length.alias("length"), share.alias("share")), "mix-shares")

    # Running sums within the rows of a source's length and shard, and over those groups.
    group = ["source", "length", "shard"]
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = plan.groupBy(*group).agg(F.sum("share").alias("shares"), F.sum("taken").alias("taken"))
    lengths = groups.groupBy("source", "length").agg(F.sum("shares").alias("shares"), F.sum("taken").alias("taken"))
    starts = lengths.groupBy("source").agg(F.collect_list(F.struct("length", "shares", "taken")).alias("all")).select("source", F.explode(_starts(F.col("all"))).alias("s")).select(F.col("source").alias("_source"), F.col("s.length").alias("_length"), F.col("s.start").alias("start"))
    groups = groups.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("length") == F.col("_length")))
    groups = groups.select("_source", "_length", F.col("shard").alias("_shard"), (F.col("start") + before(W.partitionBy("source", "length").orderBy("shard"), "shares")).alias("base"))
    placed = plan.withColumn("within", before(W.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "size", "_mix_row"), "share"))
    placed = placed.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("length") == F.col("_length")) & (F.col("shard") == F.col("_shard")))
    begin = F.col("base") + F.col("within")
    copies = (F.shiftright(begin + F.col("share"), COPY_BITS) - F.shiftright(begin, COPY_BITS)).cast("int")
    per = placed.select(F.col("_mix_row").alias("_mix_of"), copies.alias("_mix_copies")).where(F.col("_mix_copies") > 0)
    joined = numbered.join(per, F.col("_mix_row") == F.col("_mix_of"))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("doc.*")
