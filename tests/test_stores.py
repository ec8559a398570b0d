import pytest
from pyspark.sql import functions as F

from termforge.operators.bloom import BloomFilter, optimal_params
from termforge.operators.docset import DocSet, bitmap_and, bitmap_cardinality, bitmap_or
from termforge.operators.kvlog import KeyValueLog, LeveledStore


def live(df):
    return [(r.key, r.value) for r in df.orderBy("key").collect()]


def filled(spark, merge=None):
    log = KeyValueLog.empty(spark, merge)
    log = log.put(spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3)], "key string, value string, seq long"))
    log = log.put(spark.createDataFrame([("a", "4", 4)], "key string, value string, seq long"))
    return log.delete(spark.createDataFrame([("b", 5)], "key string, seq long"))


def test_newest_version_wins_and_deletes_hide(spark):
    log = filled(spark)
    assert live(log.live()) == [("a", "4"), ("c", "3")]
    assert live(log.get("a")) == [("a", "4")]
    assert live(log.get("b")) == [] and live(log.get("z")) == []
    again = log.put(spark.createDataFrame([("b", "6", 6)], "key string, value string, seq long"))
    assert live(again.live()) == [("a", "4"), ("b", "6"), ("c", "3")]


def test_range_scan(spark):
    log = filled(spark)
    assert live(log.range_scan("a", "c")) == [("a", "4")]
    assert live(log.range_scan("b")) == [("c", "3")]
    assert live(log.range_scan("a", "", 1)) == [("a", "4")]
    assert live(log.range_scan("a", "", 0)) == [("a", "4"), ("c", "3")]
    with pytest.raises(ValueError):
        log.range_scan("b", "a")


def test_merge_on_read_and_compaction(spark, tmp_path):
    def joined():
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "+")

    log = filled(spark, joined)
    assert live(log.live()) == [("a", "1+4"), ("c", "3")]
    log.compact().flush(str(tmp_path / "kv"))
    back = KeyValueLog.open(spark, str(tmp_path / "kv"), joined)
    assert live(back.live()) == [("a", "1+4"), ("c", "3")]
    assert back.versions.count() == 2
    more = back.put(spark.createDataFrame([("c", "9", 9)], "key string, value string, seq long"))
    assert live(more.live()) == [("a", "1+4"), ("c", "3+9")]


def test_empty_keys_are_refused(spark):
    with pytest.raises(Exception, match="keys are not empty"):
        KeyValueLog.empty(spark).put(spark.createDataFrame([("", "1", 1)], "key string, value string, seq long")).live().collect()


def test_bounds_and_metrics(spark):
    log = filled(spark)
    assert tuple(log.bounds().first()) == ("a", "c")
    assert tuple(KeyValueLog.empty(spark).bounds().first()) == (None, None)
    assert tuple(log.metrics().first()) == (3, 5, 9)


def test_document_sets(spark):
    a, b = DocSet.of(spark, [0, 1, 5, 32768, 32769, 70000]), DocSet.of(spark, [5, 6, 32769])
    assert a.cardinality() == 6 and a.add(5).cardinality() == 6 and a.add(7).cardinality() == 7
    assert a.contains(70000) and not a.contains(2)
    assert a.union(b).to_array().first().ids == [0, 1, 5, 6, 32768, 32769, 70000]
    assert a.intersect(b).to_array().first().ids == [5, 32769]
    assert a.minus(b).to_array().first().ids == [0, 1, 32768, 70000]
    assert DocSet.from_bitmaps(a.bitmaps()).to_array().first().ids == [0, 1, 5, 32768, 32769, 70000]
    assert bitmap_cardinality(bitmap_or(a.bitmaps(), b.bitmaps())).first().cardinality == 7
    assert bitmap_cardinality(bitmap_and(a.bitmaps(), b.bitmaps())).first().cardinality == 2
    assert bitmap_cardinality(DocSet.of(spark).bitmaps()).first().cardinality == 0


def test_bloom_filter(spark):
    assert optimal_params(1_000_000, 0.01) == (9_585_059, 7)
    assert optimal_params(0, 0.01) == (8, 1)
    assert optimal_params(1000, 0) == optimal_params(1000, -1) == optimal_params(1000, 1e-9) and optimal_params(1000, 0)[0] > 40_000
    assert optimal_params(1000, 1) == optimal_params(1000, 7) == (1, 1)
    rows = spark.range(0, 4000, 2)
    made = BloomFilter(*optimal_params(2000, 0.01)).build(rows, "id")
    found = {r.key: r.may_hold for r in made.check(spark.range(4000), "id").collect()}
    assert len(found) == 4000 and all(found[i] for i in range(0, 4000, 2))
    assert sum(found[i] for i in range(1, 4000, 2)) < 100
    assert all(r.may_hold for r in made.build(spark.range(1, 100, 2), "id").check(spark.range(100), "id").collect())


def test_saved_bloom_filter(spark, tmp_path):
    made = BloomFilter(*optimal_params(500, 0.01)).build(spark.range(500), "id")
    made.save(str(tmp_path / "b"))
    back = BloomFilter.load(spark, str(tmp_path / "b"))
    assert (back.m, back.k) == (made.m, made.k)
    found = {r.key: r.may_hold for r in back.check(spark.range(1500), "id").collect()}
    assert all(found[i] for i in range(500)) and sum(found[i] for i in range(500, 1500)) < 50


def test_damaged_bitmaps_are_an_error(spark):
    for bad in ([(0, bytearray(b"abc"))], [(None, bytearray(4096))]):
        with pytest.raises(Exception, match="damaged bitmap"):
            DocSet.from_bitmaps(spark.createDataFrame(bad, "bucket long, bits binary")).rows.collect()
    assert [r.doc_id for r in DocSet.of(spark, [9, 2, 5]).ascending().collect()] == [2, 5, 9]


VERSIONS = "key string, value string, seq long, is_tombstone boolean"


def test_levels_are_rewritten_when_they_are_full(spark, tmp_path):
    store = LeveledStore(spark, str(tmp_path / "s"), limit=3)
    expected, seq = {}, 0
    assert live(store.log().live()) == [] and store.levels() == {}
    seen = []
    for i in range(10):
        rows = []
        for k in ("a", "b", f"k{i}", f"k{i - 4}"):
            seq += 1
            dead = k == f"k{i - 4}" or (k == "b" and i % 2 == 1)
            rows.append((k, None if dead else str(seq), seq, dead))
            expected.pop(k, None) if dead else expected.update({k: str(seq)})
        store.flush(KeyValueLog(spark.createDataFrame(rows, VERSIONS)))
        seen.append(store.levels())
        assert live(LeveledStore(spark, str(tmp_path / "s")).log().live()) == sorted(expected.items())
    assert seen[:4] == [{0: 1}, {0: 2}, {1: 1}, {0: 1, 1: 1}] and seen[8] == {2: 1} and seen[9] == {0: 1, 2: 1}
    # The deepest level holds no deletes, and the batches that were rewritten are gone.
    assert len(list((tmp_path / "s" / "batches").iterdir())) == 2


def test_deletes_stay_above_what_they_hide_and_merges_end_at_them(spark, tmp_path):
    def total():
        return F.sum(F.col("value").cast("long")).cast("string")

    store = LeveledStore(spark, str(tmp_path / "s"), total, limit=2)
    for rows in ([("a", "1", 1, False), ("b", "5", 2, False)], [("a", "2", 3, False)], [("b", None, 4, True)], [("a", None, 5, True), ("a", "7", 6, False)], [("a", "1", 7, False), ("b", "2", 8, False)]):
        store.flush(KeyValueLog(spark.createDataFrame(rows, VERSIONS)))
    assert live(store.log().live()) == [("a", "8"), ("b", "2")]


def test_two_writers_and_a_reader(spark, tmp_path):
    """Each writer's batches all arrive, and a reader always sees whole ones."""
    from concurrent.futures import ThreadPoolExecutor

    def write(w):
        store = LeveledStore(spark, str(tmp_path / "s"), limit=4)
        for i in range(6):
            store.flush(KeyValueLog(spark.createDataFrame([(f"k_w{w}_{i}_{j}", f"v{i}", 2 * i + w, False) for j in range(5)], VERSIONS)))

    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(write, w) for w in (0, 1)]
        while not all(f.done() for f in both):
            try:
                count = LeveledStore(spark, str(tmp_path / "s")).log().versions.count()
            except Exception as e:  # a batch may be rewritten between listing and reading
                assert "PATH_NOT_FOUND" in str(e) or "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e), e
                continue
            assert count % 5 == 0
        [f.result() for f in both]
    assert len(live(LeveledStore(spark, str(tmp_path / "s")).log().live())) == 60


def test_the_shared_folder_is_the_sessions_own(spark, monkeypatch):
    from termforge.sources.tables import scratch, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "a") != scratch(spark, "a") and scratch(spark, "a").startswith(shared_dir(spark) + "/a-")

    class Elsewhere:
        """A session on a cluster that names no shared folder."""

        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)
