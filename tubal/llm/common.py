"""Helpers shared by the corpus operators: table access, shared tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, in every operator that counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a function of texts holds as Python objects at a time.
BATCH_ROWS = 1024

#: Bits of a filter of keys for each of its keys, the most bits that it has (8 MB go to all tasks), and those of one bitmap.
FILTER_BITS, FILTER_MOST, BITMAP_BITS = 16, 1 << 26, 1 << 15

_own_folder: list[str] = []
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Only on one machine (tests) may it be unset: then a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own_folder[0]


def materialize(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back. It cuts the lineage, so
    that a lost executor costs a reread and not the whole history, and it gives later joins
    plain scans on both sides, whose skewed partitions adaptive execution can split. Inside
    ``temporary_tables`` it is deleted at their end, or where it ``outlives`` them at the end of the next outer ones."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    at = len(_scopes) - (2 if outlives else 1)
    if at >= 0:
        _scopes[at].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end: nothing read later may need them."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _scopes.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows before in ``order`` (which tells all rows
    apart), in two steps: ranges of rows, then rows in a range. No task gets all rows."""
    ranged = df.repartitionByRange(tasks(df), *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(totals), "_range")
    added = [(F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_{name}")).alias(name) for name, x in sums.items()]
    return joined.select(*df.columns, *added)


def maybe_among(df: DataFrame, key: Sequence[Column], keys: DataFrame, of_keys: Sequence[Column], most: int = FILTER_MOST) -> DataFrame:
    """``df`` with ``_maybe``: true where its ``key`` is one of the ``of_keys`` of ``keys`` (a table), and by chance, about one in
    ``FILTER_BITS``, where it is not. A join with ``keys`` then needs these rows only, and the wide rest is not shuffled
    for it. Columns of both have the same types; nulls count as values. The filter is a table of bitmaps, of ``most`` bits in all."""
    bits = max(BITMAP_BITS, min(most, keys.count() * FILTER_BITS) // BITMAP_BITS * BITMAP_BITS)

    def place(columns: Sequence[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(bits).cast("long"))

    def bitmap_of(at: Column) -> Column:
        return F.floor(at / BITMAP_BITS).cast("int")

    at = place(of_keys)
    maps = keys.groupBy(bitmap_of(at).alias("_of")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BITMAP_BITS))).alias("_bits"))
    placed = df.withColumn("_at", place(key))
    joined = placed.join(F.broadcast(maps), bitmap_of(F.col("_at")) == F.col("_of"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.pmod("_at", F.lit(BITMAP_BITS)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("_at", F.lit(8)))), F.lit(2)) == 1
    return joined.select(*[named(c) for c in df.columns], F.coalesce(set_, F.lit(False)).alias("_maybe"))


def same(left: Column, right: Column) -> Column:
    """Equality that holds between nulls too."""
    return left.eqNullSafe(right)


def named(column: str) -> Column:
    """A column of just this name, whatever stands in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """The caller's columns as one, ``row``, so that columns added beside it clash with none."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *more)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch, of ``BATCH_ROWS`` rows at most, that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield from function(batch.slice(start, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def byte_strings(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to ``most`` or that hold a single one."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)
