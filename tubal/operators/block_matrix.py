"""Large matrices as blocks: products, singular values of tall ones, and leading subspaces.

A block row is ``i, j, data``: the block's row and column among the blocks, and its float64 entries row by row. A
block that is missing is zero. Blocks are full but at the last row and column, so a shape follows from the place.

No step holds a matrix in one place. What reaches the driver is as wide and as high as the short side of a tall matrix, or
as the subspace: ``DRIVER_ENTRIES`` numbers at most, which is checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.storage import Steps
from tubal.tensor import DRIVER_ENTRIES, Matrix

SCHEMA = "i long, j long, data binary"
#: Edge of a block, blocks along the edge of a cube of a product, entries of a row block, and triangles put together at a time.
EDGE, CUBE, ROW_BLOCK, FAN = 1024, 2, 1 << 19, 8


@dataclass(frozen=True)
class BlockMatrix:
    frame: DataFrame
    rows: int
    columns: int
    height: int = EDGE
    width: int = EDGE

    @property
    def down(self) -> int:
        return -(-self.rows // self.height)

    @property
    def across(self) -> int:
        return -(-self.columns // self.width)

    @property
    def shape_of(self) -> Callable[[int, int], tuple[int, int]]:
        """The shape of a block by its place: a function of its own, as tasks get it without the frame."""
        rows, columns, height, width = self.rows, self.columns, self.height, self.width
        return lambda i, j: (min(height, rows - i * height), min(width, columns - j * width))

    def map(self, work: Callable[[int, int, np.ndarray], Iterator[tuple[int, int, np.ndarray]]], rows: int, columns: int, height: int, width: int) -> BlockMatrix:
        """Blocks that ``work`` yields for each block."""
        shape_of = self.shape_of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, x in opened(batch, shape_of):
                    for block in work(i, j, x):
                        yield packed([block])

        return BlockMatrix(self.frame.mapInArrow(run, SCHEMA), rows, columns, height, width)

    def transposed(self) -> BlockMatrix:
        return self.map(lambda i, j, x: iter([(j, i, x.T)]), self.columns, self.rows, self.width, self.height)

    def entries(self) -> Matrix:
        """The entries that are not zero."""
        shape_of, height, width = self.shape_of, self.height, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, x in opened(batch, shape_of):
                    r, c = np.nonzero(x)
                    yield pa.record_batch([pa.array(r + i * height), pa.array(c + j * width), pa.array(x[r, c])], ["r", "c", "v"])

        return Matrix(self.frame.mapInArrow(run, "r long, c long, v double"), self.rows, self.columns)


def opened(batch: pa.RecordBatch, shape_of: Callable[[int, int], tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("data"), strict=True):
        yield i, j, np.frombuffer(data.as_buffer(), np.float64).reshape(shape_of(i, j))


def packed(blocks: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    i, j, x = zip(*blocks, strict=True) if blocks else ((), (), ())
    return pa.record_batch([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array([np.ascontiguousarray(b, np.float64).tobytes() for b in x], pa.binary())], ["i", "j", "data"])


def to_blocks(m: Matrix, height: int = EDGE, width: int = EDGE) -> BlockMatrix:
    """From entries, by one shuffle; entries at one place are added up."""
    out = BlockMatrix(m.entries, m.rows, m.columns, height, width)
    shape_of = out.shape_of

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        x = np.zeros(shape_of(i, j))
        np.add.at(x, (table.column("r").to_numpy(), table.column("c").to_numpy()), table.column("v").to_numpy())
        return pa.Table.from_batches([packed([(i, j, x)])])

    at = [F.floor(F.col(n) / size).alias(k) for k, n, size in (("i", "r", height), ("j", "c", width))]
    inside = [F.pmod(F.col(n), F.lit(size)).cast("long").alias(n) for n, size in (("r", height), ("c", width))]
    placed = m.entries.select(*at, *inside, F.col("v").cast("double").alias("v"))
    return BlockMatrix(placed.groupBy("i", "j").applyInArrow(fill, SCHEMA), m.rows, m.columns, height, width)


def from_rows(rows: DataFrame, count: int, columns: int, height: int | None = None) -> BlockMatrix:
    """From a row each, ``r`` (from 0) and ``data`` (an array of ``columns`` numbers), as row blocks: a dense matrix needs no entry rows. Rows that are
    missing are zero; of another length they are an error."""
    height = height or max(columns, ROW_BLOCK // columns, 1)
    out = BlockMatrix(rows, count, columns, height, columns)
    shape_of = out.shape_of

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        x = np.zeros(shape_of(i, 0))
        for chunk_r, chunk in zip(table.column("r").chunks, table.column("data").chunks, strict=True):
            lengths = np.diff(chunk.offsets.to_numpy())
            if (lengths != columns).any():
                raise ValueError(f"a row has {lengths[lengths != columns][0]} numbers, not {columns}")
            x[chunk_r.to_numpy()] = chunk.flatten().to_numpy().reshape(-1, columns)
        return pa.Table.from_batches([packed([(i, 0, x)])])

    placed = rows.select(F.floor(F.col("r") / height).alias("i"), F.pmod("r", F.lit(height)).cast("long").alias("r"), F.col("data").cast("array<double>").alias("data"))
    return BlockMatrix(placed.groupBy("i").applyInArrow(fill, SCHEMA), count, columns, height, columns)


def _summed(parts: DataFrame, count: int, shape_of: Callable[[int, int], tuple[int, int]]) -> DataFrame:
    """Blocks of parts ``i, j, part, data``, of which there are ``count`` at most for a block; ``FAN`` are added in a task at a time."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        i, j, part = (k.as_py() for k in key)
        total = np.zeros(shape_of(i, j))
        for data in table.column("data"):
            total += np.frombuffer(data.as_buffer(), np.float64).reshape(total.shape)
        return pa.table({"i": [i], "j": [j], "part": [part], "data": pa.array([total.tobytes()], pa.binary())})

    while count > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("i", "j", "part").applyInArrow(add, "i long, j long, part long, data binary")
        count = -(-count // FAN)
    return parts.select("i", "j", "data")


def multiply(a: BlockMatrix, b: BlockMatrix, cube: int = CUBE) -> BlockMatrix:
    """The product: cubes of ``cube`` blocks along rows, columns and the inner side are multiplied in a task each, then the parts along
    the inner side are added up. A block of ``a`` is sent to as many cubes as ``b`` has columns of them, and the other way round."""
    if (a.columns, a.width) != (b.rows, b.height):
        raise ValueError(f"{a.rows} x {a.columns} and {b.rows} x {b.columns} matrices by {a.width} and {b.height} have no product")
    ni, nj, nk = (-(-n // cube) for n in (a.down, b.across, a.across))
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    group = lambda c: F.floor(F.col(c) / cube)
    left = a.frame.select(group("i").alias("gi"), over(nj).alias("gj"), group("j").alias("gk"), F.lit(True).alias("left"), "i", "j", "data")
    right = b.frame.select(over(ni).alias("gi"), group("j").alias("gj"), group("i").alias("gk"), F.lit(False).alias("left"), "i", "j", "data")
    sides = (a.shape_of, b.shape_of)

    def product(key: tuple, table: pa.Table) -> pa.Table:
        part = key[2].as_py()
        held: tuple[dict, dict] = ({}, {})
        for is_left, block in zip(table.column("left").to_pylist(), opened(table.select(["i", "j", "data"]).combine_chunks(), lambda i, j: (-1,)), strict=True):
            i, j, x = block
            held[not is_left][i, j] = x.reshape(sides[not is_left](i, j))
        out: dict[tuple[int, int], np.ndarray] = {}
        for (i, k), x in held[0].items():
            for (l, j), y in held[1].items():
                if k == l:
                    out[i, j] = out[i, j] + x @ y if (i, j) in out else x @ y
        found = packed([(i, j, x) for (i, j), x in out.items()])
        return pa.table({"i": found.column(0), "j": found.column(1), "part": pa.array([part] * len(out), pa.int64()), "data": found.column(2)})

    parts = left.unionByName(right).groupBy("gi", "gj", "gk").applyInArrow(product, "i long, j long, part long, data binary")
    whole = BlockMatrix(parts, a.rows, b.columns, a.height, b.width)
    return BlockMatrix(_summed(parts, nk, whole.shape_of), a.rows, b.columns, a.height, b.width)


def matmul(a: Matrix, b: Matrix, edge: int = EDGE) -> Matrix:
    """The product of two matrices of entries, through blocks."""
    return multiply(to_blocks(a, edge, edge), to_blocks(b, edge, edge)).entries()


# Tall matrices


def _qr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With a diagonal that is not negative, so that it comes out the same again."""
    q, r = np.linalg.qr(x)
    sign = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


@dataclass(frozen=True)
class TallSvd:
    """Of a matrix ``u diag(s) v'``: the long side's vectors as row blocks, all others at hand."""

    long: BlockMatrix
    s: np.ndarray
    short: np.ndarray
    flipped: bool  # the matrix was wide: the long side is v
    steps: Steps  # the tables that the vectors are made from

    def drop(self) -> None:
        """Deletes those tables, once the vectors have been used or written."""
        self.steps.drop()

    def product(self) -> Matrix:
        """The matrix of these triplets, made block by block."""
        right = (self.short * self.s).T
        n = len(self.short)
        out = self.long.map(lambda i, j, x: iter([(i, 0, x @ right)]), self.long.rows, n, self.long.height, n).entries()
        return out.transposed() if self.flipped else out


def _triangles(a: BlockMatrix, steps: Steps) -> list[DataFrame]:
    """``i, data``: the triangular factors of row blocks, then of ``FAN`` triangles at a time, up to one."""
    n, shape_of = a.columns, a.shape_of

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, x in opened(batch, shape_of):
                yield packed([(i, 0, _qr(x)[1])])

    def higher(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed([(key[0].as_py(), 0, _qr(_stacked(table, n)[1])[1])])])

    levels, count = [steps.cut(a.frame.mapInArrow(lowest, SCHEMA))], a.down
    while count > 1:
        levels.append(steps.cut(levels[-1].withColumn("up", F.floor(F.col("i") / FAN)).groupBy("up").applyInArrow(higher, SCHEMA)))
        count = -(-count // FAN)
    return levels


def _stacked(table: pa.Table, n: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Triangles in the order of their blocks: (block, rows) of each, and all rows."""
    parts = sorted((i, np.frombuffer(d.as_buffer(), np.float64).reshape(-1, n)) for i, d in zip(table.column("i").to_pylist(), table.column("data"), strict=True))
    return [(i, len(x)) for i, x in parts], np.concatenate([x for _, x in parts])


def tall_svd(m: Matrix | BlockMatrix, k: int | None = None, vectors: bool = True, entries: int = ROW_BLOCK) -> TallSvd:
    """All or the ``k`` leading singular triplets of a matrix with one long side: a tree of triangular factors of row blocks up to one small
    triangle, whose vectors are multiplied back down the tree. A wide matrix is transposed; a ``BlockMatrix`` of row blocks is taken as it is. The largest entry of each vector of the short side
    is positive. Without ``vectors`` only the values are found."""
    spark = (m.frame if isinstance(m, BlockMatrix) else m.entries).sparkSession
    flipped = m.columns > m.rows
    n = min(m.rows, m.columns)
    if n * n > DRIVER_ENTRIES:
        raise ValueError(f"both sides of {m.rows} x {m.columns} are long; ask leading_subspace for the leading part")
    if k is not None and not 1 <= k <= n:
        raise ValueError(f"rank {k} of a {m.rows} x {m.columns} matrix")
    if isinstance(m, BlockMatrix) and (flipped or m.width < n):
        m = m.entries()
    steps = Steps(spark)
    a = m if isinstance(m, BlockMatrix) else to_blocks(m.transposed() if flipped else m, max(n, entries // n, 1), n)
    a = BlockMatrix(steps.cut(a.frame), a.rows, a.columns, a.height, n)
    levels = _triangles(a, steps)
    found = levels[-1].toArrow()
    top = _stacked(found, n)[1] if found.num_rows else np.zeros((1, n))
    u, s, vt = np.linalg.svd(np.concatenate([top, np.zeros((n - len(top), n))]) if len(top) < n else top)
    u, s, v = u[: len(top), :k], s[:k], vt[:k].T
    sign = np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    u, v, rank = u * sign, v * sign, len(s)
    if not vectors:
        return TallSvd(a, s, v, flipped, steps)
    back = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(u.tobytes()).alias("back"))

    def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "back": pa.array([], pa.binary())})
        parts, x = _stacked(table, n)
        w = _qr(x)[0] @ np.frombuffer(above.column("back")[0].as_buffer(), np.float64).reshape(-1, rank)
        ends = np.cumsum([c for _, c in parts])
        return pa.table({"i": pa.array([i for i, _ in parts], pa.int64()), "back": pa.array([w[e - c : e].tobytes() for (_, c), e in zip(parts, ends, strict=True)], pa.binary())})

    for level in levels[-2::-1]:
        below = level.select(F.floor(F.col("i") / FAN).alias("up"), "i", "data").groupBy("up")
        back = below.cogroup(back.select(F.col("i").alias("up"), "back").groupBy("up")).applyInArrow(down, "i long, back binary")
    shape_of = a.shape_of

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (i, _, x), w in zip(opened(batch, shape_of), batch.column("back"), strict=True):
                yield packed([(i, 0, _qr(x)[0] @ np.frombuffer(w.as_buffer(), np.float64).reshape(-1, rank))])

    joined = a.frame.join(back, "i").select("i", "j", "data", "back")
    return TallSvd(BlockMatrix(joined.mapInArrow(last, SCHEMA), a.rows, rank, a.height, rank), s, v, flipped, steps)


def singular_values(m: Matrix | BlockMatrix) -> DataFrame:
    """``q, sigma``: all singular values of a matrix with one long side at most, descending."""
    found = tall_svd(m, vectors=False)
    found.drop()
    return found.long.frame.sparkSession.createDataFrame(list(enumerate(found.s.tolist())), "q int, sigma double")


# Leading subspaces


def _gram(y: BlockMatrix) -> np.ndarray:
    """Y' Y of a matrix of one column of blocks, for the driver. Each task adds its blocks' up, and ``FAN`` of those sums are added at a time."""
    n, shape_of = y.columns, y.shape_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((n, n)), None
        for batch in batches:
            for i, _, x in opened(batch, shape_of):
                total += x.T @ x
                first = i if first is None else first
        if first is not None:  # a block is in one task only, so its number names the task's sum
            yield pa.record_batch([pa.array([0]), pa.array([0]), pa.array([first]), pa.array([total.tobytes()], pa.binary())], ["i", "j", "part", "data"])

    found = _summed(y.frame.mapInArrow(run, "i long, j long, part long, data binary"), y.down, lambda i, j: (n, n)).toArrow().column("data")
    return np.frombuffer(found[0].as_buffer(), np.float64).reshape(n, n) if len(found) else np.zeros((n, n))


def _times(y: BlockMatrix, small: np.ndarray) -> BlockMatrix:
    k = small.shape[1]
    return y.map(lambda i, j, x: iter([(i, 0, x @ small)]), y.rows, k, y.height, k)


def _orthonormal(y: BlockMatrix, cut: Callable[[BlockMatrix], BlockMatrix]) -> BlockMatrix:
    """By its Gram matrix, twice; directions that are nothing but rounding are left out."""
    for _ in range(2):
        w, v = np.linalg.eigh(_gram(y))
        kept = w > max(w.max(), 0.0) * 1e-14
        if not kept.any():
            raise ValueError("a zero matrix has no leading vectors")
        y = cut(_times(y, v[:, kept] / np.sqrt(w[kept])))
    return y


@dataclass(frozen=True)
class Subspace:
    energies: np.ndarray  # squared singular values, descending
    vectors: BlockMatrix  # of the rows' side, a column each
    residual: float  # the largest |A A' x - energy x| over the largest energy
    total: float  # sum of all squared singular values


def leading_subspace(a: BlockMatrix, k: int, accuracy: float = 1e-7, oversample: int = 16, most: int = 60, seed: int = 7) -> Subspace:
    """The ``k`` largest squared singular values of a matrix with two long sides and their left vectors, by subspace iteration. The basis stays a
    table of blocks; the driver sees only matrices of its width. It goes on until the residuals of all ``k`` are within ``accuracy`` of the largest energy,
    and is an error where ``most`` steps do not reach that."""
    spark = a.frame.sparkSession
    width = min(a.rows, a.columns, k + oversample)
    if not 1 <= k <= min(a.rows, a.columns) or width * width > DRIVER_ENTRIES:
        raise ValueError(f"{k} leading vectors of a {a.rows} x {a.columns} matrix: from 1 to {min(a.rows, a.columns, int(DRIVER_ENTRIES**0.5) - oversample)} can be found")
    steps = Steps(spark)
    cut = lambda y: BlockMatrix(steps.cut(y.frame), y.rows, y.columns, y.height, y.width)
    a, height, rows = cut(a), a.height, a.rows
    flipped = cut(a.transposed())
    total = float(a.frame.mapInArrow(_squares, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0])
    # The start's numbers belong to the block, so that a lost task makes the same again.
    start = lambda i, h: np.random.default_rng([seed, i]).standard_normal((h, width))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield packed([(i, 0, start(i, min(height, rows - i * height)))])

    q = _orthonormal(cut(BlockMatrix(spark.range(a.down).mapInArrow(begin, SCHEMA), rows, width, height, width)), cut)
    for _ in range(most):
        z = cut(multiply(flipped, q))
        energies, turn = np.linalg.eigh(_gram(z))
        energies, turn = np.maximum(energies[::-1], 0.0), turn[:, ::-1]
        y = cut(multiply(a, z))
        moved = np.einsum("ij,ij->j", turn, _gram(y) @ turn)  # squared lengths of A A' x
        residuals = np.sqrt(np.maximum(moved - energies**2, 0.0))
        worst = float(residuals[:k].max() / energies[0]) if energies[0] > 0 else 0.0
        if worst <= accuracy:
            break
        q = _orthonormal(y, cut)
    else:
        steps.drop()
        raise ValueError(f"{most} steps left a residual of {worst:.1e}; ask for more steps or more vectors than {k}")
    found = cut(_times(q, turn[:, :k]))
    steps.drop([steps.last])
    return Subspace(energies[:k], found, worst, total)


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            x = np.frombuffer(data.as_buffer(), np.float64)
            yield pa.record_batch([pa.array([float(x @ x)])], ["v"])
