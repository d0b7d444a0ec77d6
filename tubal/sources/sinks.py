"""Results to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.tensor import Tensor


def write_tensor(t: Tensor, path: str) -> None:
    """Cells as Parquet, with the mode sizes as a one-row JSON table beside them."""
    t.cells.write.mode("overwrite").parquet(f"{path}/cells")
    write_metadata(t.cells.sparkSession.range(1).select(F.array(*[F.lit(d) for d in t.dims]).alias("dims")), path)


def read_tensor(spark, path: str) -> Tensor:
    dims = spark.read.json(f"{path}/metadata").first().dims
    return Tensor(spark.read.parquet(f"{path}/cells"), tuple(dims))


def write_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def as_pixel(value: Column) -> Column:
    """0 to 255, cut off."""
    return F.floor(F.greatest(F.least(value, F.lit(255.0)), F.lit(0.0))).cast("int")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and ``new``. Null keys match null keys."""
    fresh = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    match = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = here if match is None else match & here
    return old.join(fresh, match, "left_anti").unionByName(new)
