"""Logs and tables of comma-separated values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.sources.sinks import upserted

#: Time of a run that was started and has not ended well. Fixed value.
STARTED = -1.0


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content`` of every file in a folder that is not empty."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; a row that does not fit the schema is an error."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns given, in that order, with a header."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def upsert_csv(spark: SparkSession, path: str, new: DataFrame, keys: list[str], schema: str) -> None:
    """Rows of ``new`` take the place of those with their keys. The table is written beside the old one, which is moved aside before the new one takes its
    name and goes after it; where a writer died in between, the next one starts from the one aside. One writer at a time: for more see ``VersionedTable``.
    A run that begins is put in with the time ``STARTED``, and again with its own."""
    aside = f"{path}-before"
    if not exists(spark, path) and exists(spark, aside):
        _rename(spark, aside, path)
    old = read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)
    beside = f"{path}-{uuid.uuid4().hex}"
    write_csv(upserted(old, new.select(*old.columns), keys), beside, old.columns)
    where, files = _file_system(spark, aside)
    files.delete(where, True)
    if exists(spark, path):
        _rename(spark, path, aside)
    _rename(spark, beside, path)
    files.delete(where, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    where, files = _file_system(spark, old)
    if not files.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not take the name {new}")


def saved_or(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written to its end, else what ``make`` gives, written there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
