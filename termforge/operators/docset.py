"""Sets of document ids: as rows for algebra, as bitmaps (a row a bucket) for keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BITS = 32_768


class DocSet:
    """rows: doc_id, distinct."""

    def __init__(self, rows: DataFrame, distinct: bool = False):
        self.rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
        self.rows = self.rows if distinct else self.rows.distinct()

    @classmethod
    def of(cls, spark: SparkSession, ids: list[int] = ()) -> DocSet:
        return cls(spark.createDataFrame([(i,) for i in ids], "doc_id long"))

    def add(self, *ids: int) -> DocSet:
        return DocSet(self.rows.unionByName(DocSet.of(self.rows.sparkSession, list(ids)).rows))

    def contains(self, doc_id: int) -> bool:
        return not self.rows.where(F.col("doc_id") == doc_id).isEmpty()

    def union(self, other: DocSet) -> DocSet:
        return DocSet(self.rows.unionByName(other.rows))

    def intersect(self, other: DocSet) -> DocSet:
        return DocSet(self.rows.join(other.rows, "doc_id", "left_semi"), True)

    def minus(self, other: DocSet) -> DocSet:
        return DocSet(self.rows.join(other.rows, "doc_id", "left_anti"), True)

    def cardinality(self) -> int:
        return self.rows.count()

    def to_array(self) -> DataFrame:
        """One row, ids: ascending. The set must fit a row; rows is the form without that bound."""
        return self.rows.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))

    def ascending(self) -> DataFrame:
        """doc_id in order."""
        return self.rows.orderBy("doc_id")

    def bitmaps(self) -> DataFrame:
        """bucket, bits. Bucket 0 holds id 0 alone; bucket b > 0 the ids (b - 1) * 32768 + 1 to b * 32768."""
        return self.rows.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))

    @classmethod
    def from_bitmaps(cls, bitmaps: DataFrame) -> DocSet:
        """The ids of bucket, bits; bit p of byte b is bit 8 b + p, least significant first.
        Rows without a bucket or of another length than 4096 bytes are an error."""
        sound = (F.length("bits") == BUCKET_BITS // 8) & F.col("bucket").isNotNull()
        bitmaps = bitmaps.select("bucket", F.when(sound, F.col("bits")).otherwise(F.raise_error(F.lit("damaged bitmap"))).alias("bits"))
        byte = bitmaps.select("bucket", F.posexplode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("at", "byte"), "bits")
        value = F.conv(F.hex(F.substring("bits", F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
        some = byte.select("bucket", "byte", value.alias("value")).where(F.col("value") > 0)
        bit = some.select("bucket", "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.expr("(value >> bit) & 1 = 1"))
        place = F.col("byte").cast("long") * 8 + F.col("bit")
        return cls(bit.select(F.when(F.col("bucket") == 0, place).otherwise((F.col("bucket") - 1) * BUCKET_BITS + place + 1).alias("doc_id")), True)


def bitmap_or(*sets: DataFrame) -> DataFrame:
    """The union of bitmap tables, bucket by bucket."""
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intersection of two bitmap tables; buckets that only one has are empty."""
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("sides")).where(F.col("sides") == 2).select("bucket", "bits")


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    """One row, cardinality."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("cardinality"))
