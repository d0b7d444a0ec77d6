"""Dense tensors as blocks of tubes, for work at the speed of array products.

A block row is ``block, tubes, data``: ``tubes`` neighbouring positions of the first two modes (column-major)
with all their cells along the other modes, as float64 bytes, a tube after the other and in it mode 2
fastest. Products along the modes from 2 on need no shuffle at all; slices are one shuffle away."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.operators.products import BLOCK_CELLS
from tubal.tensor import Tensor, index_names, linear_index, split_index, tasks_for

SCHEMA = "block long, tubes int, data binary"
#: Cells of a block: small enough that reading, products and writing go on at once where Arrow batches are as small
#: (``spark.sql.execution.arrow.maxBytesPerBatch`` of 2 MB).
DENSE_CELLS = 1 << 18


@dataclass(frozen=True)
class Blocks:
    """A tensor of blocks. ``step`` is the tubes of a full block, whatever the modes' sizes have become since; a block that is
    missing is zero."""

    frame: DataFrame
    dims: tuple[int, ...]
    step: int

    @property
    def size(self) -> int:
        return prod(self.dims)

    @property
    def tasks(self) -> int:
        return tasks_for(self.size)

    @property
    def slices(self) -> int:
        return prod(self.dims[2:])

    def tubes(self, block: int) -> int:
        return min(self.step, self.dims[0] * self.dims[1] - block * self.step)

    def cells(self) -> Tensor:
        return cells_of(self.frame, self.dims, self.step)


def to_blocks(t: Tensor, block_cells: int = DENSE_CELLS) -> Blocks:
    return Blocks(blocks_of(t, block_cells), t.dims, tubes_of_block(t.dims, block_cells))


def tubes_of_block(dims: Sequence[int], block_cells: int = DENSE_CELLS) -> int:
    return max(1, block_cells // prod(dims[2:]))


def _batch(blocks: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(blocks, pa.int64()), pa.array([len(a) for a in arrays], pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())], ["block", "tubes", "data"])


def random_blocks(spark: SparkSession, dims: Sequence[int], seed: int = 1234, block_cells: int = DENSE_CELLS) -> DataFrame:
    """Uniform in [0, 100)."""
    step, positions, trailing = tubes_of_block(dims, block_cells), dims[0] * dims[1], prod(dims[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = min(step, positions - b * step)
                yield _batch([b], [np.random.default_rng([seed, b]).random((n, trailing)) * 100])

    return spark.range(-(-positions // step)).mapInArrow(run, SCHEMA)


def blocks_of(t: Tensor, block_cells: int = DENSE_CELLS) -> DataFrame:
    """From cells, by one shuffle. Missing cells are zero; blocks without cells are missing."""
    step, positions, trailing = tubes_of_block(t.dims, block_cells), t.dims[0] * t.dims[1], prod(t.dims[2:])
    tube = linear_index(t.dims[:2], t.modes[:2])
    placed = t.cells.select(F.floor(tube / step).alias("block"), (F.pmod(tube, F.lit(step)) * trailing + linear_index(t.dims[2:], t.modes[2:])).alias("at"), "v")

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        x = np.zeros(min(step, positions - b * step) * trailing)
        np.add.at(x, table.column("at").to_numpy(), table.column("v").to_numpy())
        return pa.Table.from_batches([_batch([b], [x.reshape(-1, trailing)])])

    return placed.groupBy("block").applyInArrow(fill, SCHEMA)


def _checked(dims: Sequence[int], matrices: Sequence[np.ndarray], modes: Sequence[int]) -> tuple[list[np.ndarray], list[int], tuple[int, ...]]:
    """Matrices and modes in the order of their use, those that shrink first, and the new mode sizes."""
    order = sorted(range(len(modes)), key=lambda i: matrices[i].shape[0] / matrices[i].shape[1])
    matrices, modes = [np.asarray(matrices[i], float) for i in order], [modes[i] for i in order]
    out_dims = list(dims)
    for m, mode in zip(matrices, modes, strict=True):
        if not 2 <= mode < len(dims) or m.shape[1] != dims[mode]:
            raise ValueError(f"a matrix of shape {m.shape} does not fit mode {mode} of {tuple(dims)}")
        out_dims[mode] = m.shape[0]
    return matrices, modes, tuple(out_dims)


def _moved(x: np.ndarray, dims: Sequence[int], matrices: Sequence[np.ndarray], modes: Sequence[int]) -> np.ndarray:
    """Products along trailing modes of tubes (one a row)."""
    sizes, n = list(dims[2:]), len(x)
    for m, mode in zip(matrices, modes, strict=True):
        # Seen as (slower modes and tubes, this mode, faster modes) the product is one of matrices.
        x = np.matmul(m, x.reshape(-1, sizes[mode - 2], prod(sizes[: mode - 2]))) if mode > 2 else x.reshape(-1, sizes[0]) @ m.T
        sizes[mode - 2] = m.shape[0]
    return x.reshape(n, -1)


def transform_blocks(blocks: DataFrame, dims: Sequence[int], matrices: Sequence[np.ndarray], modes: Sequence[int]) -> tuple[DataFrame, tuple[int, ...]]:
    """Mode products along modes from 2 on, and the new mode sizes. The modes that shrink come first."""
    matrices, modes, out_dims = _checked(dims, matrices, modes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, raw in _opened(batch):
                yield _batch([b], [_moved(raw.reshape(n, -1), dims, matrices, modes)])

    return blocks.mapInArrow(run, SCHEMA), out_dims


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for b, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield b, n, np.frombuffer(raw.as_buffer(), np.float64)


def slices_of_group(rows: int, columns: int, group_cells: int = BLOCK_CELLS) -> int:
    return max(1, group_cells // (rows * columns))


def over_slices(b: Blocks, work: Callable[[np.ndarray, np.ndarray], pa.Table], schema: str, matrices: Sequence[np.ndarray] = (), modes: Sequence[int] = (), group_cells: int = BLOCK_CELLS) -> DataFrame:
    """``work(numbers, slices)`` of all frontal slices after mode products along trailing modes, some slices (an array of slice, row, column) at a
    time. One shuffle: blocks are multiplied and cut on one side of it, slices put together and worked on at the other."""
    matrices, modes, dims = _checked(b.dims, matrices, modes)
    rows, columns, count, old, step = *dims[:2], prod(dims[2:]), b.dims, b.step
    per = slices_of_group(rows, columns, group_cells)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, raw in _opened(batch):
                x = np.ascontiguousarray(_moved(raw.reshape(n, -1), old, matrices, modes).T)
                groups = range(0, count, per)
                yield pa.record_batch(
                    [pa.array(range(len(groups)), pa.int64()), pa.array([number] * len(groups), pa.int64()), pa.array([memoryview(x[g : g + per]).cast("B") for g in groups], pa.binary())], ["part", "block", "data"]
                )

    def join(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        numbers = np.arange(part * per, min(count, (part + 1) * per))
        x = np.zeros((len(numbers), rows * columns))
        for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
            if block is not None:
                piece = np.frombuffer(data.as_buffer(), np.float64).reshape(len(numbers), -1)
                x[:, block * step : block * step + piece.shape[1]] = piece
        if not np.isfinite(x).all():
            raise ValueError("a slice has cells that are not finite")
        return work(numbers, x.reshape(len(numbers), columns, rows).transpose(0, 2, 1))

    pieces = b.frame.mapInArrow(cut, "part long, block long, data binary")
    # Slices of blocks that are all missing are slices all the same.
    every = b.frame.sparkSession.range(-(-count // per)).select(F.col("id").alias("part"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"))
    return pieces.unionByName(every).groupBy("part").applyInArrow(join, schema)


def from_slices(slices: DataFrame, make: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], dims: Sequence[int], step: int, matrices: Sequence[np.ndarray] = (), modes: Sequence[int] = ()) -> Blocks:
    """The inverse of ``over_slices``: ``make`` yields slices (number, array of row and column) of a batch of rows; they are cut, put
    together as blocks and multiplied along trailing modes, with one shuffle. Slices that are missing are zero."""
    matrices, modes, out_dims = _checked(dims, matrices, modes)
    positions, count = dims[0] * dims[1], prod(dims[2:])
    dims = tuple(dims)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x in make(batch):
                flat, starts = np.ascontiguousarray(x.T).ravel(), range(0, positions, step)
                yield pa.record_batch([pa.array(range(len(starts)), pa.int64()), pa.array([number] * len(starts), pa.int64()), pa.array([memoryview(flat[a : a + step]).cast("B") for a in starts], pa.binary())], ["block", "slice", "data"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        x = np.zeros((count, min(step, positions - block * step)))
        for number, data in zip(table.column("slice").to_pylist(), table.column("data"), strict=True):
            x[number] = np.frombuffer(data.as_buffer(), np.float64)
        return pa.Table.from_batches([_batch([block], [_moved(np.ascontiguousarray(x.T), dims, matrices, modes)])])

    return Blocks(slices.mapInArrow(cut, "block long, slice long, data binary").groupBy("block").applyInArrow(join, SCHEMA), out_dims, step)


def block_sums(a: Blocks, b: Blocks) -> DataFrame:
    """One row: ``lost, left, right``, the squared norms of a - b, a and b. Blocks that are missing are zero."""
    if (a.dims, a.step) != (b.dims, b.step):
        raise ValueError(f"blocks of {a.dims} and {b.dims} by {a.step} and {b.step} tubes are not compared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.float64) if v.is_valid else np.zeros(1) for v in (one, other))
                d = x - y
                sums.append((d @ d, x @ x, y @ y))
            yield pa.record_batch([pa.array(np.array(c), pa.float64()) for c in zip(*sums, strict=True)] if sums else [pa.array([], pa.float64())] * 3, ["lost", "left", "right"])

    both = a.frame.select("block", F.col("data").alias("x")).join(b.frame.select("block", F.col("data").alias("y")), "block", "full")
    parts = both.select("x", "y").mapInArrow(run, "lost double, left double, right double")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("lost", "left", "right")])


def block_slices(blocks: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Frontal slices ``slice, nrow, ncol, data`` of blocks that are all there."""
    rows, columns = dims[:2]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.float64).reshape(n, -1).T)
                yield pa.record_batch([pa.array(np.arange(len(x))), pa.array(np.full(len(x), b)), pa.array([r.tobytes() for r in x], pa.binary())], ["slice", "block", "data"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())
        data = np.frombuffer(b"".join(table.column("data").take(pa.array(order)).to_pylist()), np.float64)
        if len(data) != rows * columns:
            raise ValueError(f"slice {key[0]} has {len(data)} cells, not {rows * columns}")
        values = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "nrow": pa.array([rows], pa.int32()), "ncol": pa.array([columns], pa.int32()), "data": values})

    pieces = blocks.mapInArrow(cut, "slice long, block long, data binary")
    return pieces.groupBy("slice").applyInArrow(join, "slice long, nrow int, ncol int, data array<double>")


def cells_of(blocks: DataFrame, dims: Sequence[int], step: int) -> Tensor:
    """Cells of blocks that hold ``step`` tubes each (``tubes_of_block`` of the dims that they were made with)."""
    dims = tuple(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.float64).reshape(n, -1)
                tube = b * step + np.repeat(np.arange(n), x.shape[1])
                yield pa.record_batch([pa.array(tube), pa.array(np.tile(np.arange(x.shape[1]), n)), pa.array(x.ravel())], ["tube", "at", "v"])

    flat = blocks.mapInArrow(run, "tube long, at long, v double")
    columns = split_index(F.col("tube"), dims[:2]) + split_index(F.col("at"), dims[2:])
    return Tensor(flat.select(*[c.alias(n) for c, n in zip(columns, index_names(len(dims)), strict=True)], "v"), dims)
