"""What the operators of this folder share: scratch tables, Arrow mapping, chunks of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many bytes of text are handled at once by the vectorised operators.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch that are turned into Python values at once.
ROWS_AT_ONCE = 512


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives the planner the true size."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def few(df: DataFrame) -> DataFrame:
    """A small table (pairs, links, sums) in a sixteenth of the shuffle partitions: each file
    that is written costs its executor a few calls, whatever it holds. For plans whose last
    stage is cheap, as it runs in so many tasks."""
    return df.coalesce(max(8, shuffle_parts(df.sparkSession) // 16))


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made from them has been
    stored in its turn, so a lost executor can't ask for them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text's bytes; a null text is an empty one."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def give_back() -> None:
    """Return to the system what a task has freed: a worker is used again by tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """mapInArrow over tuples of Python values; rows is called once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = None
        out: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

        fields = to_arrow_schema(shape)
        tuples = (t for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE) for t in zip(*(c.to_pylist() for c in b.slice(i, ROWS_AT_ONCE).columns)))
        for row in rows(tuples):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str))) + 64
            if size > CHUNK_BYTES or len(out) >= 10_000:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()
        give_back()

    from pyspark.sql.types import _parse_datatype_string

    shape = _parse_datatype_string(schema)
    return df.mapInArrow(run, shape)


def chunks(rows: Iterable[tuple], at: int, most: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Lists of rows whose field `at` (bytes) sums to about `most`; never splits a row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[at]) + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- dealing many small records by hash ---------------------------------------------

#: Parts that a task deals to at once; more are dealt in two rounds, so that what a task
#: gives out stays in few rows however many parts there are.
FAN = 4096
#: Records that a task holds before it gives them out.
HELD_RECORDS = 500_000


def part_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def by_part(n_parts: int, kind: str, width: int = 8) -> Callable[[Iterable[tuple[np.ndarray, np.ndarray]]], Iterator[tuple]]:
    """Turns pieces (hashes, values of the numpy type `kind`) into rows part, hashes, values
    (binary), with the hashes of each row ascending and their lowest `width` bytes kept."""

    def out(pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        held, size = [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece[0])
            if size > HELD_RECORDS:
                yield from give(held)
                held, size = [], 0
        if size:
            yield from give(held)

    def give(held) -> Iterator[tuple]:
        hashes, values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(hashes, kind="stable")
        hashes, values = hashes[order], values[order].astype(kind)
        part = part_of(hashes, n_parts)
        cuts = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(part[a]), hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), values[a:b].tobytes()

    return out


def deal(df: DataFrame, pieces: Callable[[Iterator[tuple]], Iterable[tuple[np.ndarray, np.ndarray]]], n_parts: int, kind: str, width: int = 8) -> DataFrame:
    """part, hashes, values: records from `pieces` (called once a partition), dealt by hash.

    A row holds what a task has for a part. Beyond FAN parts tasks deal to FAN ranges of
    parts first, and each range is dealt to its parts after an exchange."""
    schema = "part int, hashes binary, values binary"
    coarse = by_part(min(n_parts, FAN), kind, width if n_parts <= FAN else 8)
    rows = map_rows(df, lambda tuples: coarse(pieces(tuples)), schema)
    if n_parts <= FAN:
        return rows
    fine = by_part(n_parts, kind, width)
    again = lambda tuples: fine((np.frombuffer(h, "<u8"), np.frombuffer(v, kind)) for h, v in tuples)
    return map_rows(rows.repartition(F.col("part")).select("hashes", "values"), again, schema)
