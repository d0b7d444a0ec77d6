"""Tensors from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.tensor import Tensor, index_names


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tensor_from_table(df: DataFrame, modes: list[tuple[Column, int]], measure: Column, strict: bool = False) -> Tensor:
    """Sums ``measure`` by the index columns. Null or non-finite measures count as zero. Rows with an index
    outside its mode or null are left out, or if ``strict`` are an error."""
    dims = tuple(n for _, n in modes)
    names = index_names(len(dims))
    value = F.when(F.isnan(measure.cast("double")) | F.isnull(measure) | (F.abs(measure.cast("double")) == float("inf")), 0.0).otherwise(measure.cast("double"))
    placed = df.select(*[c.cast("int").alias(n) for (c, _), n in zip(modes, names, strict=True)], value.alias("v"))
    for n, d in zip(names, dims, strict=True):
        inside = F.coalesce(F.col(n).between(0, d - 1), F.lit(False))
        placed = placed.where(F.assert_true(inside, F.concat(F.lit(f"{n} outside its mode: "), F.coalesce(F.col(n).cast("string"), F.lit("null")))).isNull() if strict else inside)
    return Tensor(placed.groupBy(*names).agg(F.sum("v").alias("v")), dims)


def code_of(column: str, values: list) -> Column:
    """Position of the column's value in a short list, null if it is none of them."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(at > 0, at - 1)
