import os
import random

import pytest
from demo_corpus import CORPUS
from pyspark.sql import functions as F

from termforge.functions.analysis import AnalyzerConfig, analyze, show_hits, snippet, tokens
from termforge.operators.index import TextIndex
from termforge.operators.phrase import phrase_docs, plan_phrase
from termforge.operators.query import And, Not, Or, Phrase, Term, run_query
from termforge.operators.ranking import champions, rank_tfidf, rank_vsm, tiered_search
from termforge.sources.tables import documents_from

PLAIN = AnalyzerConfig("none")


@pytest.fixture(scope="module")
def demo(spark):
    return documents_from(spark, CORPUS).cache()


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def scores(df):
    return [(r.doc_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("match", ["exact", "prefix"])
@pytest.mark.parametrize(
    "words, found",
    [
        (("roaring", "bitmap"), [2, 31, 32, 33, 34, 35, 36, 37, 38]),
        (("write", "ahead", "log"), [25, 103]),
        (("write", "amplification"), [22, 23, 66]),
        (("read", "amplification"), [8, 67]),
        (("writes", "in", "memory"), [21]),
        (("garbage", "amplification"), []),
    ],
)
def test_known_phrases_with_english_stems(demo, words, found, match):
    index = TextIndex.build(demo, AnalyzerConfig("english", match))
    assert ids(phrase_docs(index, *words)) == found
    assert ids(run_query(index, Phrase(*words))) == found


def test_boolean_queries(demo):
    index = TextIndex.build(demo, PLAIN)
    assert ids(run_query(index, And(Term("lsm"), Term("compact")))) == [22]
    assert ids(run_query(index, Or(Term("bitmap"), Term("b-tree")))) == [31, 32, 33, 34, 35, 36, 38, 61, 62]
    assert len(ids(run_query(index, ~Term("go")))) == 37
    assert ids(run_query(index, Term("log"))) == [25]
    prefix = TextIndex.build(demo, AnalyzerConfig("none", "prefix"))
    assert ids(run_query(prefix, Term("log"))) == [25, 62, 103]
    assert ids(run_query(prefix, Term("compact"))) == [8, 22, 23, 27, 37, 107]


def test_empty_and_unknown_queries(demo):
    index = TextIndex.build(demo, PLAIN)
    assert ids(run_query(index, None)) == []
    assert len(ids(run_query(index, Not(None)))) == 46
    assert ids(run_query(index, Term("the"))) == []
    assert len(ids(run_query(index, Not(Term("the"))))) == 46
    assert ids(phrase_docs(index)) == []
    with pytest.raises(TypeError):
        run_query(index, And(Term("lsm"), "tree"))


def test_rankings(demo):
    index = TextIndex.build(demo, PLAIN)
    both, either = And(Term("lsm"), Term("tree")), Or(Term("lsm"), Term("compaction"))
    assert scores(rank_tfidf(index, run_query(index, both), ["lsm", "tree"], 5)) == [(i, 3.012892) for i in (21, 22, 27, 63, 64)]
    assert scores(rank_tfidf(index, run_query(index, either), ["lsm", "compaction"], 5)) == [(8, 3.482896), (22, 3.482896), (23, 3.482896), (27, 3.482896), (107, 2.219203)]
    assert scores(rank_vsm(index, run_query(index, either), ["lsm", "compaction"]))[:6] == [(8, 1.0), (22, 1.0), (23, 1.0), (27, 1.0), (107, 0.868988), (3, 0.494832)]
    assert scores(tiered_search(index, 3, 5, "lsm", "write")) == [(i, 2.895109) for i in (22, 23, 24)]
    assert scores(tiered_search(index, 3, 5, "roaring", "bitmap", "intersection")) == [(35, 8.647799), (33, 4.819158), (34, 4.819158)]
    assert scores(tiered_search(index, 3, 0, "write", "amplification")) == [(i, 3.668299) for i in (22, 23, 66)]
    assert scores(tiered_search(index, 3, 5, "the")) == []
    assert champions(index, 2).groupBy("term").count().agg(F.max("count")).first()[0] == 2


def test_tiers_widen_until_there_are_enough(demo):
    index = TextIndex.build(demo, PLAIN)
    narrow = scores(tiered_search(index, 1, 1, "lsm", "go", sizes=(1, 5, 50)))
    wide = scores(tiered_search(index, 0, 1, "lsm", "go", sizes=(50,)))
    assert narrow[0] in wide and len(narrow) == 1 and len(wide) > 15


@pytest.mark.parametrize(
    "text, lang, kept",
    [
        ("B-tree 1.18 x", "none", [("b-tree", 0), ("18", 2)]),
        ("a_b --", "none", [("--", 2)]),
        ("я мир", "none", [("я", 0), ("мир", 1)]),
        ("я мир", "russian", [("мир", 1)]),
        ("cafés", "none", [("cafe", 0)]),
        ("writes in memory", "none", [("writes", 0), ("memory", 2)]),
        ("writes in memory", "english", [("write", 0), ("memori", 2)]),
        ("", "english", []),
        (None, "english", []),
    ],
)
def test_analysis(spark, text, lang, kept):
    got = tokens(documents_from(spark, [(1, text)]), AnalyzerConfig(lang)).orderBy("pos").collect()
    assert [(r.term, r.pos) for r in got] == kept
    assert analyze(text or "", AnalyzerConfig(lang)) == [t for t, _ in kept]


def test_documents_without_tokens_count(spark):
    index = TextIndex.build(documents_from(spark, [(1, "alpha"), (2, "it"), (3, None)]), PLAIN)
    assert index.n_docs().first().n == 3
    assert ids(run_query(index, Not(Term("alpha")))) == [2, 3]
    assert scores(rank_tfidf(index, index.universe, ["alpha"])) == [(1, 1.098612)]


def test_words_that_are_dropped_after_stemming_never_match():
    english = AnalyzerConfig("english")
    assert plan_phrase(["doing", "things"], english) is None
    assert plan_phrase(["the", "lsm", "of", "a", "tree"], english).steps == (("lsm", 0), ("tree", 3))


def test_compiled_queries_agree_with_set_algebra(spark):
    random.seed(11)
    words = ["aa", "bb", "cc", "dd", "ee"]
    rows = [(i, " ".join(random.choices(words + ["it"], k=random.randint(0, 6)))) for i in range(60)]
    index = TextIndex.build(documents_from(spark, rows).cache(), PLAIN)
    has = {w: {i for i, t in rows if w in t.split()} for w in words}
    every = {i for i, _ in rows}

    def pair(a, b):
        return {i for i, t in rows if any(x == a and y == b for x, y in zip(t.split(), t.split()[1:]))}

    def grow(depth):
        kind = random.choice("tpnao") if depth else "t"
        if kind == "t":
            w = random.choice(words)
            return Term(w), has[w]
        if kind == "p":
            a, b = random.choice(words), random.choice(words)
            return Phrase(a, b), pair(a, b)
        a, x = grow(depth - 1)
        if kind == "n":
            return Not(a), every - x
        b, y = grow(depth - 1)
        return (And(a, b), x & y) if kind == "a" else (Or(a, b), x | y)

    for _ in range(12):
        expr, expected = grow(3)
        assert ids(run_query(index, expr)) == sorted(expected), expr


def test_saved_index_and_merge(spark, demo, tmp_path):
    index = TextIndex.build(demo, PLAIN)
    index.save(str(tmp_path / "index"))
    back = TextIndex.load(spark, str(tmp_path / "index"), PLAIN)
    assert ids(run_query(back, And(Term("lsm"), Term("compact")))) == [22]
    assert ids(phrase_docs(back, "write", "ahead", "log")) == [25]
    plan = back.occurrences.where(back.matches("lsm"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,lsm)" in plan and "PartitionFilters: [isnotnull(slot" in plan
    assert scores(rank_tfidf(back, back.universe, ["lsm tree"])) == scores(rank_tfidf(index, index.universe, ["lsm tree"]))
    more = TextIndex.build(documents_from(spark, [(22, "zebra compact"), (500, "zebra")]), PLAIN)
    merged = back.merge(more)
    assert ids(run_query(merged, Term("zebra"))) == [22, 500]
    assert ids(run_query(merged, And(Term("zebra"), Term("lsm")))) == [22]
    assert merged.n_docs().first().n == 47
    with pytest.raises(ValueError):
        back.merge(TextIndex.build(demo, AnalyzerConfig("english")))


def test_snippet(spark):
    texts = ["x" * 80, "short", None, "", "x" * 72, "x" * 71 + "é!", "x" * 70 + "漢字", "x" * 69 + "😀😀", "é" * 37, "a" + "漢" * 30, "x" * 71 + "y" + "漢"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(snippet(F.col("t")).alias("s")).collect()
    expected = []
    for t in texts:
        data = (t or "").encode()
        expected.append(t if len(data) <= 72 else data[:72].decode("utf-8", "ignore") + "…")
    assert [r.s for r in got] == expected and expected[0] == "x" * 72 + "…"


def test_hits_are_printed_with_snippets(spark, demo, capsys):
    index = TextIndex.build(demo, PLAIN)
    show_hits(phrase_docs(index, "write", "ahead", "log"), demo)
    show_hits(rank_tfidf(index, index.universe, ["roaring"], 2), demo)
    shown = capsys.readouterr().out
    assert "|25 " in shown and "score" in shown


def test_streamed_documents_are_found(spark, tmp_path):
    from termforge.streaming.ingest import index_stream

    source = str(tmp_path / "in")
    documents_from(spark, CORPUS[:20]).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    index_stream(stream, str(tmp_path / "index"), str(tmp_path / "check"), PLAIN).awaitTermination()
    documents_from(spark, CORPUS[20:]).write.mode("append").parquet(source)
    index_stream(stream, str(tmp_path / "index"), str(tmp_path / "check"), PLAIN).awaitTermination()
    index = TextIndex.load(spark, str(tmp_path / "index"), PLAIN)
    assert index.n_docs().first().n == 46
    assert ids(run_query(index, And(Term("lsm"), Term("compact")))) == [22]
    assert os.path.isdir(tmp_path / "check")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stems_are_made_of_whole_arrays_before_tokens_are_rows(spark):
    texts = [(1, "Книгами о книгах İİ ΟΔΟΣ.ΑΣ ΟΔΟΣ"), (2, None), (3, "it --")]
    got = tokens(documents_from(spark, texts), AnalyzerConfig("russian"))
    plan = plan_of(got)
    assert plan.index("Generate posexplode") < plan.index("ArrowEvalPython")
    assert sorted((r.doc_id, r.pos, r.term) for r in got.collect()) == [(1, 0, "книг"), (1, 2, "книг"), (1, 3, "i̇i̇"), (1, 4, "οδος"), (1, 5, "ας"), (1, 6, "οδος"), (3, 0, "it"), (3, 1, "--")]


@pytest.mark.parametrize("lang", ["none", "english"])
def test_postings_are_made_without_a_shuffle_of_tokens(spark, lang):
    rows = [(1, "bb aa bb"), (None, "aa"), (2, None), (1, "cc bb"), (2, "the"), (3, "bb"), (None, "dd aa"), (4, "x")]
    made = TextIndex.build(documents_from(spark, rows), AnalyzerConfig(lang)).postings()
    plan = plan_of(made)
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 == plan.count("Exchange") and "Aggregate" not in plan
    got = sorted((r.term, r.doc_id or 0, r.tf, r.positions) for r in made.collect())
    assert got == [("aa", 0, 2, [0, 1]), ("aa", 1, 1, [1]), ("bb", 1, 3, [0, 1, 2]), ("bb", 3, 1, [0]), ("cc", 1, 1, [0]), ("dd", 0, 1, [0])]


def test_documents_of_several_batches_are_whole(spark):
    rows = [(i // 7, f"aa w{i}") for i in range(700)]
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    made = TextIndex.build(documents_from(session, rows), PLAIN).postings()
    got = {(r.term, r.doc_id): r.positions for r in made.collect()}
    assert got == {("aa", i): [0] for i in range(100)} | {(f"w{i}", i // 7): [1] for i in range(700)}


def test_a_saved_index_shuffles_no_postings(spark, tmp_path):
    from pyspark.sql.types import ArrayType

    rows = [(i // 2, f"aa w{i % 5} aa") for i in range(40)] + [(None, "aa"), (None, "bb")]
    for text in (rows, [(i, "cc" + t) for i, t in rows]):
        TextIndex.build(documents_from(spark, text), PLAIN).save(str(tmp_path / "index"), "append")
    saved = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert isinstance(saved.schema["docs"].dataType, ArrayType) and saved.where("term = 'aa'").count() < 42
    back = TextIndex.load(spark, str(tmp_path / "index"), PLAIN)
    df = {r.term: r.df for r in back.term_stats().collect()}
    assert df["aa"] == 21 and df["ccaa"] == 21 and df["bb"] == 1 and df["w0"] == 8
    got = {r.doc_id: r.positions for r in back.lookup_postings("aa").collect()}
    assert got[None] == [0] and got[0] == [0, 2] and len(got) == 21
    merged = back.merge(TextIndex.build(documents_from(spark, [(7, "zz aa")]), PLAIN))
    merged.save(str(tmp_path / "merged"))
    again = TextIndex.load(spark, str(tmp_path / "merged"), PLAIN)
    assert {r.doc_id: r.positions for r in again.lookup_postings("aa").collect()}[7] == [0, 1, 2]
    merged.postings().write.partitionBy("tf").parquet(str(tmp_path / "other" / "postings"))
    with pytest.raises(ValueError):
        merged.save(str(tmp_path / "other"), "append")


def test_champions_of_all_terms_read_the_documents_once(spark):
    rows = [(1, "aa aa bb"), (2, "aa"), (3, "bb cc"), (4, None), (5, "aa")]
    best = champions(TextIndex.build(documents_from(spark, rows), PLAIN), 2)
    plan = plan_of(best)
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan
    assert sorted((r.term, r.rnk, r.doc_id, r.score) for r in best.collect()) == [("aa", 1, 1, 0.864903), ("aa", 2, 2, 0.510826), ("bb", 1, 1, 0.916291), ("bb", 2, 3, 0.916291), ("cc", 1, 3, 1.609438)]
