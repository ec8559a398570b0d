"""Approximate membership: a Bloom filter kept as bitmap rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BITS = 32_768
LEAST_RATE = 1e-9


def optimal_params(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n members at a false positive rate of p, which is kept
    between LEAST_RATE and 1 - LEAST_RATE."""
    if n <= 0:
        return 8, 1
    p = min(max(p, LEAST_RATE), 1 - LEAST_RATE)
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, math.ceil(math.log(2) * m / n)


@dataclass(frozen=True)
class BloomFilter:
    """bits: bucket, bits (4096 bytes a row); m bits in all, k probes a member."""

    m: int
    k: int
    bits: DataFrame | None = None

    def __post_init__(self):
        object.__setattr__(self, "m", self.m or 8)
        object.__setattr__(self, "k", self.k or 1)

    def places(self, key: Column) -> Column:
        """The k places of a key, by double hashing."""
        first, second = F.pmod(F.xxhash64(key), F.lit(self.m)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(self.m))
        return F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: F.pmod(first + i * second, F.lit(self.m)))

    def build(self, rows: DataFrame, key: str) -> BloomFilter:
        """A filter that holds the rows' keys as well."""
        place = rows.select(F.explode(self.places(F.col(key))).alias("place"))
        made = place.groupBy((F.col("place") / BUCKET_BITS).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BUCKET_BITS).alias("bits"))
        if self.bits is not None:
            made = made.unionByName(self.bits).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return BloomFilter(self.m, self.k, made)

    def check(self, rows: DataFrame, key: str) -> DataFrame:
        """The distinct keys of rows and whether the filter may hold them; never false for a member."""
        probes = rows.select(F.col(key).alias("key")).distinct().select("key", F.explode(self.places(F.col("key"))).alias("place"))
        probes = probes.withColumn("bucket", (F.col("place") / BUCKET_BITS).cast("long"))
        byte = F.substring("bits", ((F.col("place") % BUCKET_BITS) / 8).cast("int") + 1, F.lit(1))
        bit = F.expr("shiftright(cast(conv(hex(byte), 16, 10) as int), cast(place % 8 as int)) & 1")
        seen = probes.join(self.bits, "bucket", "left").withColumn("byte", byte).withColumn("bit", F.coalesce(bit, F.lit(0)))
        return seen.groupBy("key").agg((F.min("bit") == 1).alias("may_hold"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """The filter's rows, each with m and k."""
        self.bits.select("bucket", "bits", F.lit(self.m).cast("long").alias("m"), F.lit(self.k).alias("k")).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BloomFilter:
        """The filter that was saved; one without rows held nothing."""
        rows = spark.read.parquet(path)
        size = rows.select("m", "k").first()
        return cls(*(size or (8, 1)), rows.select("bucket", "bits"))
