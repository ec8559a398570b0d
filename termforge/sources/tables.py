"""Sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session
    names none, one of our own if it all runs in this process, and an error otherwise."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(shared_dir, "own", None)
        if named is None:
            named = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="termforge-")
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in one partition a core at least: a small file is a single task
    otherwise. Tables of more partitions than cores are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents_from(spark: SparkSession, rows: Iterable[tuple[int, str]]) -> DataFrame:
    """doc_id, text from values in memory."""
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def write_sorted(rows: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """In ranges of the key, each sorted: what a scan by key can skip."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def event_log(events: DataFrame) -> DataFrame:
    """Events as versions of a key/value log: a user's newest event wins, an error deletes."""
    key = F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    return events.select(key.alias("key"), "value", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_tombstone"))
