"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

value is the sum of the search and log queries; the store_ ones have a shape of their own
(100,000 keys, whatever the scale) and stand apart: a write, and a get and a scan of 100
keys as means over TIMES seeded keys."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termforge.operators.index import TextIndex
from termforge.operators.kvlog import KeyValueLog
from termforge.operators.phrase import phrase_docs
from termforge.operators.query import And, Term, run_query
from termforge.operators.ranking import rank_tfidf, rank_vsm, tiered_search
from termforge.plans.search import NESTED, PLAIN, RANKED, index_of
from termforge.sources.tables import event_log, read_table

KEYS, WIDTH, TIMES = 100_000, 100, 10
HERE = os.path.dirname(os.path.abspath(__file__))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    def write(df):
        df.write.format("noop").mode("overwrite").save()

    try:
        write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())  # starts the engine
        timed("index_build", lambda: index_of(spark, sf_dir).save(f"{work}/index"))
        index = TextIndex.load(spark, f"{work}/index", PLAIN)
        timed("boolean", lambda: write(run_query(index, NESTED)))
        timed("phrase", lambda: write(phrase_docs(index, "eriner", "thanea")))
        timed("tfidf_top10", lambda: write(rank_tfidf(index, run_query(index, And(Term("thing"), Term("thtion"))), RANKED, 10)))
        timed("vsm_top10", lambda: write(rank_vsm(index, run_query(index, NESTED), RANKED, 10)))
        timed("tiered_top10", lambda: write(tiered_search(index, 10, 5, *RANKED)))
        timed("kv_write", lambda: KeyValueLog(event_log(read_table(spark, sf_dir, "events"))).flush(f"{work}/kv"))
        log = KeyValueLog.open(spark, f"{work}/kv")
        timed("kv_get", lambda: write(log.get("user_00000012")))
        timed("kv_range_scan", lambda: write(log.range_scan("user_00000010", "user_00000110")))
        timed("kv_compact", lambda: write(log.compact().versions))
        rows = spark.range(KEYS).select(F.format_string("key_%08d", "id").alias("key"), F.format_string("value_payload_%08d", "id").alias("value"), F.col("id").alias("seq"), F.lit(False).alias("is_tombstone"))
        timed("store_write_100k", lambda: KeyValueLog(rows).flush(f"{work}/store"))
        store = KeyValueLog.open(spark, f"{work}/store")
        gets, starts = [random.Random(seed).choices(range(KEYS - WIDTH), k=TIMES) for seed in (1, 2)]
        timed("store_get", lambda: [write(store.get(f"key_{i:08d}")) for i in gets])
        timed("store_scan_100", lambda: [write(store.range_scan(f"key_{i:08d}", f"key_{i + WIDTH:08d}", WIDTH)) for i in starts])
        for name in ("store_get", "store_scan_100"):
            took[name] = round(took[name] / TIMES, 4)
    finally:
        shutil.rmtree(work, ignore_errors=True)
        spark.stop()
    print(json.dumps({"metric": "search_and_kv_total", "value": round(sum(v for k, v in took.items() if not k.startswith("store_")), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
