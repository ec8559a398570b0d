"""A versioned key/value log: puts, deletes, reads of the newest version, compaction.

The log is a table of versions (key, value, seq, is_tombstone); the highest seq of a key
is its newest. A delete hides everything before it. With a merge, a key's value is the
merge of all its versions since its last delete, on reading as on compaction."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100
#: An aggregate of a key's versions; `ordered` gives them oldest first where order matters.
Merge = Callable[[], Column]


@dataclass(frozen=True)
class KeyValueLog:
    versions: DataFrame
    merge: Merge | None = None

    @classmethod
    def empty(cls, spark: SparkSession, merge: Merge | None = None) -> KeyValueLog:
        return cls(spark.createDataFrame([], "key string, value string, seq long, is_tombstone boolean"), merge)

    def _appended(self, rows: DataFrame) -> KeyValueLog:
        # An empty key can't be scanned, so it is refused where it would be written.
        checked = rows.withColumn("key", F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("keys are not empty"))))
        return KeyValueLog(self.versions.unionByName(checked), self.merge)

    def put(self, rows: DataFrame) -> KeyValueLog:
        """rows: key, value, seq."""
        return self._appended(rows.select("key", "value", "seq", F.lit(False).alias("is_tombstone")))

    def delete(self, rows: DataFrame) -> KeyValueLog:
        """rows: key, seq."""
        none = F.lit(None).cast(self.versions.schema["value"].dataType)
        return self._appended(rows.select("key", none.alias("value"), "seq", F.lit(True).alias("is_tombstone")))

    def live(self, where: Column | None = None) -> DataFrame:
        """key, value of the keys that exist; `where` is on the key and reaches the scan."""
        of = self.versions if where is None else self.versions.where(where)
        if self.merge is None:
            newest = of.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone"), "seq").alias("top"))
            return newest.where(~F.col("top.is_tombstone")).select("key", F.col("top.value").alias("value"))
        ends = of.groupBy("key").agg(F.max(F.when(F.col("is_tombstone"), F.col("seq"))).alias("dead"))
        alive = of.where(~F.col("is_tombstone")).join(ends, "key").where(F.col("dead").isNull() | (F.col("seq") > F.col("dead")))
        return alive.groupBy("key").agg(self.merge().alias("value"))

    def get(self, key: str) -> DataFrame:
        """key, value: one row, or none."""
        return self.live(F.col("key") == key)

    def range_scan(self, start: str, end: str = "", limit: int = DEFAULT_LIMIT) -> DataFrame:
        """key, value with start <= key < end (no end: unbounded), ascending; limit <= 0: 100."""
        if end and start >= end:
            raise ValueError("start must be before end")
        within = F.col("key") >= start
        within = within & (F.col("key") < end) if end else within
        return self.live(within).orderBy("key").limit(limit if limit > 0 else DEFAULT_LIMIT)

    def newest(self) -> DataFrame:
        """key, value, seq, is_tombstone: one version a key, by one aggregate. With a merge it is
        that of the versions since the last delete, and the delete stays beside it: older
        versions elsewhere are hidden by it alone."""
        if self.merge is None:
            top = self.versions.groupBy("key").agg(F.max_by(F.struct("value", "seq", "is_tombstone"), "seq").alias("top"))
            return top.select("key", "top.*")
        ends = self.versions.groupBy("key").agg(F.max(F.when(F.col("is_tombstone"), F.col("seq"))).alias("dead"))
        alive = self.versions.where(~F.col("is_tombstone")).join(ends, "key").where(F.col("dead").isNull() | (F.col("seq") > F.col("dead")))
        merged = alive.groupBy("key").agg(self.merge().alias("value"), F.max("seq").alias("seq")).withColumn("is_tombstone", F.lit(False))
        gone = ends.where(F.col("dead").isNotNull()).select("key", F.lit(None).cast(merged.schema["value"].dataType).alias("value"), F.col("dead").alias("seq"), F.lit(True).alias("is_tombstone"))
        return merged.unionByName(gone)

    def compact(self) -> KeyValueLog:
        """One version a key; deleted keys are gone."""
        return KeyValueLog(self.newest().where(~F.col("is_tombstone")), self.merge)

    def bounds(self) -> DataFrame:
        """least, greatest: of all keys, null of an empty log."""
        return self.versions.agg(F.min("key").alias("least"), F.max("key").alias("greatest"))

    def metrics(self) -> DataFrame:
        """keys, versions, bytes."""
        size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
        return self.versions.agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))

    def flush(self, path: str, mode: str = "append") -> None:
        """Write in key order: files and row groups hold narrow ranges, so scans skip them."""
        rows = self.versions.repartitionByRange("key").sortWithinPartitions("key", "seq")
        rows.write.mode(mode).option("parquet.bloom.filter.enabled#key", "true").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, merge: Merge | None = None) -> KeyValueLog:
        return cls(spark.read.parquet(path), merge)


class LeveledStore:
    """A log kept in a folder, in levels of sorted batches that are compacted level by level.

    A flush adds a batch to level 0. A level that has `limit` batches is rewritten as one
    batch of the next one, which may set that off in its turn. Deletes stay until they reach
    the deepest level, below which there is nothing that they hide. Which batches count is
    told by the newest of the numbered manifests, each made whole by one rename: a reader sees
    the state before or after a change, and a change that fails leaves the old state. Of two
    writers that make the same manifest one fails and may try again (add() does)."""

    LIMIT = 10
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, merge: Merge | None = None, limit: int = LIMIT):
        self.spark, self.path, self.merge, self.limit = spark, path.rstrip("/"), merge, limit
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self) -> tuple[int, list[list]]:
        """The newest manifest's number, and its batches as [level, folder]."""
        numbers = self._manifests()
        if not numbers:
            return 0, []
        return numbers[-1], json.loads(self.spark.read.text(f"{self.path}/manifests/{numbers[-1]}", wholetext=True).first().value)

    def _replace(self, number: int, batches: list[list]) -> bool:
        """Make manifest number + 1; false if another writer has made it."""
        self._fs.mkdirs(self._hadoop(f"{self.path}/manifests"))
        made = self._fs.makeQualified(self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}"))
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        target = self._fs.makeQualified(self._hadoop(f"{self.path}/manifests/{number + 1}"))
        context, rename = self.spark._jvm.org.apache.hadoop.fs.FileContext, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:  # without options it refuses to replace a file
            context.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, target, self.spark.sparkContext._gateway.new_array(rename, 0))
            return True
        except Py4JJavaError:
            self._fs.delete(made, False)
            if self._fs.exists(target):
                return False
            raise

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        KeyValueLog(rows).flush(f"{self.path}/batches/{name}", "errorifexists")
        return name

    def _of(self, names: list[str]) -> KeyValueLog:
        return KeyValueLog(self.spark.read.parquet(*[f"{self.path}/batches/{n}" for n in names]), self.merge)

    def levels(self) -> dict[int, int]:
        """The number of batches of each level."""
        return dict(sorted(Counter(level for level, _ in self._read()[1]).items()))

    def log(self) -> KeyValueLog:
        """All that is stored; an empty log before the first flush."""
        names = [n for _, n in self._read()[1]]
        return self._of(names) if names else KeyValueLog.empty(self.spark, self.merge)

    def flush(self, log: KeyValueLog) -> None:
        """Add a batch to level 0, then compact the levels that have become full."""
        name = self._write(log.versions)
        for _ in range(self.TRIES):
            number, batches = self._read()
            if self._replace(number, [[0, name], *batches]):
                break
            time.sleep(0.05)
        else:
            raise RuntimeError("other writers kept changing the store")
        level = 0
        while self.compact(level):
            level += 1

    def compact(self, level: int) -> bool:
        """Rewrite a full level as one batch of the next; false if it isn't full, or has
        been changed by another writer meanwhile."""
        number, batches = self._read()
        full = [n for at, n in batches if at == level]
        if len(full) < self.limit:
            return False
        rows = self._of(full).newest()
        if not any(at > level for at, _ in batches):
            rows = rows.where(~F.col("is_tombstone"))
        made = self._write(rows)
        rest = [b for b in batches if b[1] not in set(full)]
        if not self._replace(number, [[level + 1, made], *rest]):
            self._fs.delete(self._hadoop(f"{self.path}/batches/{made}"), True)
            return False
        for n in full:
            self._fs.delete(self._hadoop(f"{self.path}/batches/{n}"), True)
        return True
