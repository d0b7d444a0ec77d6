"""The tensor model: a table of cells, ``i0, ..., i{N-1}`` (int, from 0) and ``v`` (double), with known
mode sizes. A cell that is missing is zero. The first two modes span the frontal slices; slices are
numbered with mode 2 fastest. A matrix is a table ``r, c, v``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Entries of a matrix that may be sent to the driver (8 bytes each there, more on the way).
DRIVER_ENTRIES = 1 << 24
#: Cells that make a task worth while where what is kept is dealt to tasks by size (2 MB).
TASK_CELLS = 1 << 18


def index_names(count: int) -> list[str]:
    return [f"i{k}" for k in range(count)]


def tasks_for(cells: int) -> int:
    """Tasks that so many cells are worth, however large the tables that they come from."""
    return -(-cells // TASK_CELLS)


@dataclass(frozen=True)
class Tensor:
    cells: DataFrame
    dims: tuple[int, ...]

    def __post_init__(self):
        if len(self.dims) < 2 or any(d < 1 for d in self.dims):
            raise ValueError(f"a tensor has two modes at least and no empty ones, not {self.dims}")

    @property
    def modes(self) -> list[str]:
        return index_names(len(self.dims))

    @property
    def size(self) -> int:
        return prod(self.dims)

    @property
    def tasks(self) -> int:
        return tasks_for(self.size)

    @property
    def slices(self) -> int:
        """Frontal slices; a matrix is one."""
        return prod(self.dims[2:])

    def with_cells(self, cells: DataFrame, dims: tuple[int, ...] | None = None) -> Tensor:
        dims = tuple(dims or self.dims)
        return Tensor(cells.select(*index_names(len(dims)), "v"), dims)

    def mode(self, mode: int) -> str:
        if not 0 <= mode < len(self.dims):
            raise ValueError(f"no mode {mode} in a tensor of {len(self.dims)} modes")
        return f"i{mode}"

    def unpersist(self) -> None:
        self.cells.unpersist()


@dataclass(frozen=True)
class Matrix:
    entries: DataFrame
    rows: int
    columns: int
    known: np.ndarray | None = field(default=None, compare=False, repr=False)  # the same, where it is at hand

    @property
    def size(self) -> int:
        return self.rows * self.columns

    def leading_columns(self, k: int) -> Matrix:
        return Matrix(self.entries.where(F.col("c") < k), self.rows, k, None if self.known is None else self.known[:, :k])

    def transposed(self) -> Matrix:
        known = None if self.known is None else self.known.T
        return Matrix(self.entries.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), self.columns, self.rows, known)

    def to_numpy(self) -> np.ndarray:
        """For matrices that fit the driver: transforms along one mode."""
        if self.known is not None:
            return self.known
        if self.rows * self.columns > DRIVER_ENTRIES:
            raise ValueError(f"a matrix of {self.rows} x {self.columns} is not sent to the driver")
        out = np.zeros((self.rows, self.columns))
        for r in self.entries.collect():
            out[r.r, r.c] += r.v
        return out


def linear_index(dims: tuple[int, ...], names: list[str]) -> Column:
    """Column-major position: the first name runs fastest."""
    stride, terms = 1, []
    for d, n in zip(dims, names, strict=True):
        terms.append(F.col(n).cast("long") * F.lit(stride))
        stride *= d
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0).cast("long")


def split_index(position: Column, dims: tuple[int, ...]) -> list[Column]:
    out, stride = [], 1
    for d in dims:
        out.append(F.pmod(F.floor(position / F.lit(stride)), F.lit(d)).cast("int"))
        stride *= d
    return out


def slice_number(t: Tensor) -> Column:
    return linear_index(t.dims[2:], t.modes[2:])


def dense(t: Tensor) -> Tensor:
    """With a row for every cell. The grid is a range of positions, not a product of ranges."""
    grid = t.cells.sparkSession.range(t.size)
    grid = grid.select(*[c.alias(n) for c, n in zip(split_index(F.col("id"), t.dims), t.modes, strict=True)])
    cells = grid.join(t.cells, t.modes, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return replace(t, cells=cells)


def from_numpy(spark: SparkSession, array: np.ndarray) -> Tensor:
    array = np.asarray(array, float)
    at = np.indices(array.shape).reshape(array.ndim, -1, order="F")
    import pandas as pd

    frame = pd.DataFrame({n: at[k].astype("int32") for k, n in enumerate(index_names(array.ndim))} | {"v": array.ravel(order="F")})
    return Tensor(spark.createDataFrame(frame), array.shape)


def matrix_from_numpy(spark: SparkSession, array: np.ndarray) -> Matrix:
    array = np.asarray(array, float)
    rows = [(int(r), int(c), float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return Matrix(spark.createDataFrame(rows, "r int, c int, v double"), *array.shape, array)


def to_numpy(t: Tensor) -> np.ndarray:
    """For small tensors and tests."""
    out = np.zeros(t.dims)
    frame = t.cells.toPandas()
    np.add.at(out, tuple(frame[n].to_numpy() for n in t.modes), frame["v"].to_numpy())
    return out


def random_tensor(spark: SparkSession, dims: tuple[int, ...], seed: int = 1234) -> Tensor:
    """Uniform in [0, 100)."""
    grid = spark.range(prod(dims))
    cells = grid.select(*[c.alias(n) for c, n in zip(split_index(F.col("id"), dims), index_names(len(dims)), strict=True)], (F.rand(seed) * 100).alias("v"))
    return Tensor(cells, tuple(dims))
