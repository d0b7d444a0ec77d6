"""Tensors and matrices whose parts differ in rank.

A ragged tensor is slice rows ``slice, nrow, ncol, data`` (column-major) that share one side and differ in
the other; a ragged matrix is column rows ``c, data``. Factors of a decomposition by tolerance are such."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ragged_tensor(spark: SparkSession, values: Sequence[float], fixed: int, ranks: Sequence[int], first_varies: bool = False) -> DataFrame:
    """Slices of a flat list of values, one after the other."""
    if len(values) != fixed * sum(ranks):
        raise ValueError(f"{len(values)} values for slices of {fixed} by {list(ranks)}")
    rows, at = [], 0
    for number, k in enumerate(ranks):
        rows.append((number, *((k, fixed) if first_varies else (fixed, k)), [float(x) for x in values[at : at + fixed * k]]))
        at += fixed * k
    return spark.createDataFrame(rows, "slice long, nrow int, ncol int, data array<double>")


def _there(parts: DataFrame, name: str, number: int) -> DataFrame:
    """The part of that number; an error, when it is read, where there is none."""
    found = parts.where(F.col(name) == number).agg(F.first(F.struct(*parts.columns)).alias("part"), F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("n") > 0, F.col("part")).otherwise(F.raise_error(F.lit(f"no {name} {number}")))
    return found.select(part.alias("part")).select("part.*")


def get_slice(slices: DataFrame, number: int) -> DataFrame:
    return _there(slices, "slice", number)


def with_slice(slices: DataFrame, number: int, data: Sequence[float]) -> DataFrame:
    """``data`` column-major; its length must be the slice's."""
    fits = F.assert_true(F.size("data") == len(data), F.lit(f"slice {number} does not have {len(data)} values"))
    new = F.array(*[F.lit(float(x)) for x in data]).cast("array<double>")
    changed = _there(slices, "slice", number).withColumn("data", F.coalesce(fits.cast("array<double>"), new))
    return slices.where(F.col("slice") != number).unionByName(changed)


def flat(slices: DataFrame) -> DataFrame:
    """``at, v``: all values in order of slice, numbered by their place in the buffer. Only the slices' lengths
    are summed in one place."""
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("slice", F.size("data").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return slices.join(starts, "slice").select("first", F.posexplode("data").alias("k", "v")).select((F.col("first") + F.col("k")).alias("at"), "v")


def ragged_matrix(spark: SparkSession, values: Sequence[float], ranks: Sequence[int]) -> DataFrame:
    """``c, data``: columns of a flat list of values."""
    columns = ragged_tensor(spark, values, 1, ranks)
    return columns.select(F.col("slice").cast("int").alias("c"), "data")


def get_value(columns: DataFrame, r: int, c: int) -> DataFrame:
    """``v``; an error where the column has no such row."""
    return _there(columns, "c", c).select(F.element_at("data", r + 1).alias("v"))


def set_value(columns: DataFrame, r: int, c: int, value: float) -> DataFrame:
    fits = F.assert_true(F.size("data") > r, F.lit(f"column {c} has no row {r}"))
    new = F.transform("data", lambda x, k: F.when(k == r, F.lit(float(value))).otherwise(x))
    changed = _there(columns, "c", c).withColumn("data", F.coalesce(fits.cast("array<double>"), new))
    return columns.where(F.col("c") != c).unionByName(changed)


def get_column(columns: DataFrame, c: int) -> DataFrame:
    return _there(columns, "c", c).select(F.posexplode("data").alias("r", "v"))


def with_column(columns: DataFrame, c: int, data: Sequence[float]) -> DataFrame:
    named = with_slice(columns.withColumnRenamed("c", "slice"), c, data)
    return named.withColumnRenamed("slice", "c")
