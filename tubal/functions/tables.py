"""Table functions for SQL: decompositions of the slices of a table of cells.

``register`` makes them known to a session; then, for instance::

    SELECT * FROM slice_values(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 5, 24)
    SELECT * FROM slice_rank(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 5, 24, 2)

The functions say themselves that the table is partitioned by ``slice``, so a slice is in one call and slices are spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

_NEEDED = ("slice", "i0", "i1", "v")
_VALUES = StructType().add("slice", LongType()).add("q", IntegerType()).add("sigma", DoubleType())
_CELLS = StructType().add("slice", LongType()).add("i0", IntegerType()).add("i1", IntegerType()).add("v", DoubleType())


def _analyzed(cells: AnalyzeArgument, numbers: dict[str, AnalyzeArgument], schema: StructType) -> AnalyzeResult:
    if not cells.isTable or not set(_NEEDED) <= set(cells.dataType.names):
        raise ValueError(f"the first argument is a table with the columns {', '.join(_NEEDED)}")
    for name, n in numbers.items():
        if n.value is None or n.value < 1:
            raise ValueError(f"{name} is a number from 1 on, not {n.value}")
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn("slice")])


class _Slices:
    """Gathers the cells of one slice; those at one place are added up, and missing ones are zero."""

    def __init__(self):
        self.slice, self.cells, self.shape = None, [], (0, 0)

    def add(self, cell: Row, rows: int, columns: int) -> None:
        if not (0 <= cell["i0"] < rows and 0 <= cell["i1"] < columns):
            raise ValueError(f"no place {cell['i0']}, {cell['i1']} in slices of {rows} x {columns}")
        self.slice, self.shape = cell["slice"], (rows, columns)
        self.cells.append((cell["i0"], cell["i1"], cell["v"]))

    def matrix(self) -> np.ndarray:
        x = np.zeros(self.shape)
        i0, i1, v = zip(*self.cells, strict=True)
        np.add.at(x, (np.array(i0), np.array(i1)), np.array(v, float))
        return x


class SliceValues(_Slices):
    @staticmethod
    def analyze(cells: AnalyzeArgument, rows: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(cells, {"rows": rows, "columns": columns}, _VALUES)

    def eval(self, cells: Row, rows: int, columns: int) -> None:
        self.add(cells, rows, columns)

    def terminate(self) -> Iterator[tuple]:
        if self.cells:
            for q, s in enumerate(np.linalg.svd(self.matrix(), compute_uv=False).tolist()):
                yield self.slice, q, s


class SliceRank(_Slices):
    """The cells of each slice at a rank."""

    @staticmethod
    def analyze(cells: AnalyzeArgument, rows: AnalyzeArgument, columns: AnalyzeArgument, rank: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(cells, {"rows": rows, "columns": columns, "rank": rank}, _CELLS)

    def eval(self, cells: Row, rows: int, columns: int, rank: int) -> None:
        self.add(cells, rows, columns)
        self.rank = rank

    def terminate(self) -> Iterator[tuple]:
        if self.cells:
            u, s, vt = np.linalg.svd(self.matrix(), full_matrices=False)
            x = (u[:, : self.rank] * s[: self.rank]) @ vt[: self.rank]
            for i0, i1 in np.ndindex(*x.shape):
                yield self.slice, i0, i1, float(x[i0, i1])


def register(spark: SparkSession) -> None:
    spark.udtf.register("slice_values", udtf(SliceValues))
    spark.udtf.register("slice_rank", udtf(SliceRank))
