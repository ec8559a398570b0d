"""The registered search and key/value queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import AnalyzerConfig, snippet, tokens
from ..operators.bloom import BloomFilter, optimal_params
from ..operators.docset import DocSet, bitmap_and, bitmap_cardinality, bitmap_or
from ..operators.index import TextIndex
from ..operators.kvlog import KeyValueLog, LeveledStore
from ..operators.phrase import phrase_docs
from ..operators.query import And, Expr, Not, Or, Phrase, Term, run_query
from ..operators.ranking import TIERS, champions, rank_tfidf, rank_vsm, tiered_search
from ..sources.tables import event_log, read_table, scratch, spread

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = AnalyzerConfig("none")
PREFIX = AnalyzerConfig("none", "prefix")

NESTED = Or(And(Term("thing"), Term("thtion")), And(Term("attion"), Not(Term("erble"))))
PHRASE_AND_NOT = And(Phrase("eriner", "thanea"), Not(Term("thing")))
RANKED = ["thing attion ering"]
REPEATED = ["thing", "thing attion"]


def index_of(spark: SparkSession, sf_dir: str, config: AnalyzerConfig = PLAIN) -> TextIndex:
    return TextIndex.build(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), config)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of a Boolean query, by TF-IDF, with a snippet each."""
    index = index_of(spark, sf_dir, AnalyzerConfig("english"))
    best = rank_tfidf(index, run_query(index, NESTED), RANKED, 5)
    shown = best.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return shown.select("doc_id", "score", snippet(F.col("text")).alias("snippet")).orderBy(F.desc("score"), "doc_id")


def boolean(expr: Expr | None, config: AnalyzerConfig = PLAIN) -> Query:
    return lambda spark, sf_dir: run_query(index_of(spark, sf_dir, config), expr)


def phrase(*words: str, config: AnalyzerConfig = PLAIN) -> Query:
    return lambda spark, sf_dir: phrase_docs(index_of(spark, sf_dir, config), *words)


def over_index(make: Callable[[TextIndex], DataFrame], config: AnalyzerConfig = PLAIN) -> Query:
    return lambda spark, sf_dir: make(index_of(spark, sf_dir, config))


def analyze_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read_table(spark, sf_dir, "documents"), PLAIN)


def analyze_tokens_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read_table(spark, sf_dir, "documents"), AnalyzerConfig("english"))


def document_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), snippet(F.col("text")).alias("snippet"))


def ranked(search: Callable, expr: Expr, queries: list[str], k: int = 0) -> Query:
    return over_index(lambda index: search(index, run_query(index, expr), queries, k))


def tiered(k: int, overshoot: int = 5) -> Query:
    return over_index(lambda index: tiered_search(index, k, overshoot, *RANKED))


def champion_tier(size: int) -> Query:
    return over_index(lambda index: champions(index, size))


def docset_bitmap(merge: Callable) -> Query:
    def run(index: TextIndex) -> DataFrame:
        a, b = (DocSet(index.lookup(w), True).bitmaps() for w in ("thing", "thtion"))
        return bitmap_cardinality(merge(a, b))

    return over_index(run)


def docset_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap_cardinality(DocSet(read_table(spark, sf_dir, "documents"), True).bitmaps())


def docset_minus(index: TextIndex) -> DataFrame:
    return DocSet(index.lookup("thing"), True).minus(DocSet(index.lookup("thtion"), True)).rows


def docset_round_trip(index: TextIndex) -> DataFrame:
    return DocSet.from_bitmaps(DocSet(index.lookup("thing"), True).bitmaps()).rows


def log_of(spark: SparkSession, sf_dir: str, merge=None) -> KeyValueLog:
    return KeyValueLog(event_log(read_table(spark, sf_dir, "events")), merge)


def over_log(make: Callable[[KeyValueLog], DataFrame], merge=None) -> Query:
    return lambda spark, sf_dir: make(log_of(spark, sf_dir, merge))


def merged_value():
    return F.struct(F.count(F.lit(1)).alias("ops"), F.round(F.sum("value"), 4).alias("total"))


def kv_merge(log: KeyValueLog) -> DataFrame:
    return log.live().select("key", F.col("value.ops").alias("ops"), F.col("value.total").alias("total"))


def kv_delete(log: KeyValueLog) -> DataFrame:
    """All keys up to user_00000050 deleted after the fact."""
    keys = log.versions.where(F.col("key") <= "user_00000050").select("key").distinct()
    last = log.versions.agg((F.max("seq") + 1).alias("seq"))
    return log.delete(keys.crossJoin(F.broadcast(last))).live()


def kv_put(log: KeyValueLog) -> DataFrame:
    """A newer value for every user whose number ends in 7."""
    keys = log.versions.where(F.col("key").endswith("7")).select("key").distinct()
    last = log.versions.agg((F.max("seq") + 1).alias("seq"))
    return log.put(keys.crossJoin(F.broadcast(last)).select("key", F.lit(-1.0).alias("value"), "seq")).live()


def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct members, and how many the filter misses: none."""
    events = read_table(spark, sf_dir, "events")
    made = BloomFilter(*optimal_params(100_000, 0.01)).build(events, "user_id")
    return made.check(events, "user_id").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(~F.col("may_hold"), 1)).alias("missed"))


def saved(make: Callable[[TextIndex], DataFrame], config: AnalyzerConfig = PLAIN) -> Query:
    """A query of an index that was saved and opened again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "index")
        index_of(spark, sf_dir, config).save(path)
        return make(TextIndex.load(spark, path, config))

    return run


def merged_batches(make: Callable[[TextIndex], DataFrame]) -> Query:
    """A query of an index saved in two batches, the second of which indexes every document
    a second time from its eleventh character on; positions of both are united."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, docs = scratch(spark, "index"), read_table(spark, sf_dir, "documents")
        for text in (F.col("text"), F.expr("substr(text, 11)")):
            TextIndex.build(spread(docs.select("doc_id", text.alias("text"))), PLAIN).save(path, "append")
        return make(TextIndex.load(spark, path, PLAIN))

    return run


def shown_postings(index: TextIndex) -> DataFrame:
    return index.lookup_postings("thing").select("doc_id", F.size("positions").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


def flushed(make: Callable[[KeyValueLog], DataFrame]) -> Query:
    """A query of a log that was written in key order and opened again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "log")
        log_of(spark, sf_dir).flush(path)
        return make(KeyValueLog.open(spark, path))

    return run


def leveled(make: Callable[[KeyValueLog], DataFrame], batches: int = LeveledStore.LIMIT + 2, merge=None) -> Query:
    """A query of a store to which the events came in batches, by time; the tenth one sets
    off a compaction."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = read_table(spark, sf_dir, "events")
        least, most = events.agg(F.min("event_id"), F.max("event_id")).first()
        store = LeveledStore(spark, scratch(spark, "store"), merge)
        number = F.floor((F.col("event_id") - least) * batches / (most - least + 1))
        for i in range(batches):
            store.flush(KeyValueLog(event_log(events.where(number == i))))
        return make(store.log())

    return run


def bloom_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored filter's members, those that it misses (none), and whether it takes at most
    three times the rate that it was made for of as many others for members."""
    path, events = scratch(spark, "bloom"), read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    BloomFilter(*optimal_params(events.count(), 0.01)).build(events, "id").save(path)
    others = events.select((-F.col("id") - 1).alias("id"))
    told = BloomFilter.load(spark, path).check(events.unionByName(others), "id")
    member = F.col("key") >= 0
    return told.agg(F.count(F.when(member, 1)).alias("members"), F.count(F.when(member & ~F.col("may_hold"), 1)).alias("missed"), (F.avg(F.when(~member, F.col("may_hold").cast("int"))) <= 0.03).alias("rate_met"))


ENGLISH = AnalyzerConfig("english")
QUERIES: dict[str, Query] = {
    "analyze_tokens": analyze_tokens,
    "analyze_tokens_english": analyze_tokens_english,
    "document_snippets": document_snippets,
    "index_postings": over_index(lambda index: index.postings().select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))),
    "term_df": over_index(TextIndex.term_stats),
    "corpus_size": over_index(TextIndex.n_docs),
    "universe": over_index(lambda index: index.universe),
    "lookup_postings": over_index(lambda index: index.lookup_postings("thing").select("doc_id", F.size("positions").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))),
    "term_exact": boolean(Term("thing")),
    "term_prefix": boolean(Term("thing"), PREFIX),
    "term_prefix_ther": boolean(Term("ther"), PREFIX),
    "bool_and": boolean(And(Term("thing"), Term("thtion"))),
    "bool_or": boolean(Or(Term("thing"), Term("thtion"))),
    "bool_not": boolean(Not(Term("thing"))),
    "bool_nested": boolean(NESTED),
    "bool_stopword_term": boolean(Or(Term("the"), Term("thing"))),
    "bool_not_stopword": boolean(Not(Term("the"))),
    "bool_nil": boolean(Or(None, Term("thing"))),
    "phrase_bigram": phrase("eriner", "thanea"),
    "phrase_trigram": phrase("anea", "eriner", "thanea"),
    "phrase_stop_gap": phrase("attion", "to", "thanedble"),
    "phrase_prefix": phrase("erin", "thane", config=PREFIX),
    "phrase_in_bool": boolean(PHRASE_AND_NOT),
    "rank_tfidf": ranked(rank_tfidf, NESTED, RANKED),
    "rank_tfidf_repeated": ranked(rank_tfidf, Or(Term("thing"), Term("attion")), REPEATED),
    "rank_tfidf_top5": ranked(rank_tfidf, And(Term("thing"), Term("thtion")), ["thing thtion"], 5),
    "rank_vsm": ranked(rank_vsm, NESTED, RANKED),
    "rank_vsm_repeated": ranked(rank_vsm, Or(Term("thing"), Term("attion")), REPEATED),
    "champions_tier0": champion_tier(TIERS[0]),
    "champions_tier1": champion_tier(TIERS[1]),
    "tiered_search_k3": tiered(3),
    "tiered_search_k60": tiered(60),
    "tiered_search_k100": tiered(100),
    "tiered_search_k0": tiered(0),
    "docset_cardinality": docset_cardinality,
    "docset_bitmap_or": docset_bitmap(bitmap_or),
    "docset_bitmap_and": docset_bitmap(bitmap_and),
    "docset_minus": over_index(docset_minus),
    "docset_round_trip": over_index(docset_round_trip),
    "kv_latest": over_log(KeyValueLog.live),
    "kv_get": over_log(lambda log: log.get("user_00000012")),
    "kv_range_scan": over_log(lambda log: log.range_scan("user_00000010", "user_00000060")),
    "kv_range_scan_open": over_log(lambda log: log.range_scan("user_00000100", "", 20)),
    "kv_put": over_log(kv_put),
    "kv_delete": over_log(kv_delete),
    "kv_merge": over_log(kv_merge, merged_value),
    "kv_compact": over_log(lambda log: log.compact().versions.select("key", "value", "seq")),
    "kv_bounds": over_log(KeyValueLog.bounds),
    "bloom_members": bloom_members,
    "stemmed_bool_and": boolean(And(Term("things"), Term("thtion")), ENGLISH),
    "stemmed_rank_tfidf": over_index(lambda index: rank_tfidf(index, index.universe, RANKED, 10), ENGLISH),
    "stemmed_phrase": phrase("eriner", "thanea", config=ENGLISH),
    "analyze_tokens_russian": lambda spark, sf_dir: tokens(read_table(spark, sf_dir, "documents"), AnalyzerConfig("russian")),
    "saved_bool_nested": saved(lambda index: run_query(index, NESTED)),
    "saved_phrase": saved(lambda index: phrase_docs(index, "eriner", "thanea")),
    "saved_rank_tfidf": saved(lambda index: rank_tfidf(index, run_query(index, NESTED), RANKED)),
    "saved_rank_vsm": saved(lambda index: rank_vsm(index, run_query(index, NESTED), RANKED)),
    "saved_tiered_search": saved(lambda index: tiered_search(index, 60, 5, *RANKED)),
    "merged_postings": merged_batches(shown_postings),
    "merged_term_df": merged_batches(TextIndex.term_stats),
    "champions_tier2": champion_tier(TIERS[2]),
    "kv_flushed_get": flushed(lambda log: log.get("user_00000012")),
    "kv_flushed_range_scan": flushed(lambda log: log.range_scan("user_00000010", "user_00000060")),
    "kv_flushed_bounds": flushed(KeyValueLog.bounds),
    "kv_leveled": leveled(KeyValueLog.live),
    "kv_leveled_range_scan": leveled(lambda log: log.range_scan("user_00000010", "user_00000060")),
    "bloom_saved": bloom_saved,
}
