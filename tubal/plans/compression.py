"""Compression in a transform domain, and back; the two matrix baselines; reports on errors.

A tensor's trailing modes are transformed, every frontal slice is decomposed, and the factors are
truncated: to a rank, or to what a relative error allows over all slices together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.functions import transforms
from tubal.operators import factors as fx
from tubal.operators import block_matrix, blocks, kept, products, shape, threshold
from tubal.tensor import Matrix, Tensor, matrix_from_numpy


class _Kept:
    kept: DataFrame | None

    def unpersist(self) -> None:
        """Frees what was kept on the way, once the factors have been used or written."""
        if self.kept is not None:
            self.kept.unpersist()


@dataclass(frozen=True)
class Compressed(_Kept):
    factors: DataFrame
    dims: tuple[int, ...]  # in the transform domain
    inverses: list[Matrix]
    modes: list[int]
    kept: DataFrame | None = None  # what was persisted on the way


@dataclass(frozen=True)
class CompressedBlocks(_Kept):
    factors: DataFrame
    dims: tuple[int, ...]
    step: int
    inverses: list[np.ndarray]
    modes: list[int]
    kept: DataFrame | None = None


def mode_transforms(t: Tensor, kind: str, modes: Sequence[int] | None = None) -> tuple[list[Matrix], list[Matrix], list[int]]:
    """Matrices, inverses and modes. ``eye`` has none; ``hosvd`` uses the left vectors of each mode's
    unfolding as they are, ``hosvd_t`` their transposes."""
    modes = list(range(2, len(t.dims))) if modes is None else list(modes)
    spark = t.cells.sparkSession
    if kind == "eye":
        return [], [], []
    if kind == "dct":
        forward = [transforms.dct(spark, t.dims[m]) for m in modes]
        return forward, [m.transposed() for m in forward], modes
    if kind in ("hosvd", "hosvd_t"):
        u = [matrix_from_numpy(spark, mode_vectors(t, m)) for m in modes]
        flipped = [m.transposed() for m in u]
        return (u, flipped, modes) if kind == "hosvd" else (flipped, u, modes)
    raise ValueError(f"no transform {kind!r}")


def compress(t: Tensor, kind: str = "dct", modes: Sequence[int] | None = None, *, rank: int | None = None, tol: float | None = None, strategy: str = "auto") -> Compressed:
    """Give either ``rank`` or ``tol``. The tolerance bounds the relative error of the whole tensor
    where the transform is orthonormal."""
    if (rank is None) == (tol is None):
        raise ValueError("either a rank or a tolerance")
    forward, inverse, modes = mode_transforms(t, kind, modes)
    hat = products.transform(t, forward, modes, strategy)
    slices = fx.to_slices(hat)
    if rank is not None:
        return Compressed(fx.decompose(slices, rank), hat.dims, inverse, modes)
    # One reduction of each slice serves both the cut-off and the factors. A cache keeps its partitions, of which each reader has a
    # task, so there are no more than the tensor's size asks for.
    reduced = kept.reduce_slices(slices.coalesce(hat.tasks)).persist()
    return Compressed(kept.form_factors(reduced, threshold.ranks(kept.kept_values(reduced), tol)), hat.dims, inverse, modes, reduced)


def reconstruct(c: Compressed, strategy: str = "auto") -> Tensor:
    return products.transform(fx.to_cells(fx.multiply(c.factors), c.dims), c.inverses, c.modes, strategy)


def compress_blocks(b: blocks.Blocks, kind: str = "dct", modes: Sequence[int] | None = None, *, rank: int | None = None, tol: float | None = None) -> CompressedBlocks:
    """``compress`` of a dense tensor in blocks: the same factors, with array products from end to end and one shuffle. Matrices of the
    transforms go to all tasks, so a mode's is of ``products.BROADCAST_ENTRIES`` at most."""
    if (rank is None) == (tol is None):
        raise ValueError("either a rank or a tolerance")
    modes = list(range(2, len(b.dims))) if modes is None else list(modes)
    if kind not in ("dct", "eye"):
        raise ValueError(f"no transform {kind!r} of blocks")
    forward = [transforms.dct_array(b.dims[m]) for m in modes] if kind == "dct" else []
    modes = modes if kind == "dct" else []
    if any(m.size > products.BROADCAST_ENTRIES for m in forward):
        raise ValueError("a transform is too large to go to all tasks; keep the tensor as cells")
    dims, inverse = b.dims, [m.T for m in forward]
    small = min(dims[:2])
    if rank is not None:
        if not 1 <= rank <= small:
            raise ValueError(f"rank {rank} of {dims[0]} x {dims[1]} slices")

        def leading(numbers: np.ndarray, x: np.ndarray) -> pa.Table:
            u, s, vt = np.linalg.svd(x, full_matrices=False)
            u, v = fx.signed_vectors(u[:, :, :rank], vt[:, :rank].transpose(0, 2, 1))
            return _slice_table(numbers, x.shape, {"k": pa.array([rank] * len(numbers), pa.int32())} | {n: _lists(y) for n, y in (("u", u.transpose(0, 2, 1)), ("s", s[:, :rank]), ("v", v.transpose(0, 2, 1)))})

        return CompressedBlocks(blocks.over_slices(b, leading, fx.FACTORS, forward, modes), dims, b.step, inverse, modes)

    def reduce(numbers: np.ndarray, x: np.ndarray) -> pa.Table:
        s, work, scales = kept.reduce_stack(x)
        return _slice_table(numbers, x.shape, {"s": _lists(s)} | {n: pa.array([r.tobytes() for r in y], pa.binary()) for n, y in (("work", work), ("scales", scales))})

    reduced = blocks.over_slices(b, reduce, kept.KEPT, forward, modes).coalesce(b.tasks).persist()
    factors = kept.form_factors(reduced, threshold.ranks(kept.kept_values(reduced), tol))
    return CompressedBlocks(factors, dims, b.step, inverse, modes, reduced)


def values_of_blocks(b: blocks.Blocks, kind: str = "eye") -> DataFrame:
    """``slice, q, sigma``: all singular values of the slices, in the transform domain, with one shuffle."""

    def values(numbers: np.ndarray, x: np.ndarray) -> pa.Table:
        s = np.linalg.svd(x, compute_uv=False)
        q = s.shape[1]
        return pa.table({"slice": pa.array(np.repeat(numbers, q)), "q": pa.array(np.tile(np.arange(q, dtype=np.int32), len(numbers))), "sigma": pa.array(s.ravel())})

    modes = list(range(2, len(b.dims))) if kind == "dct" else []
    return blocks.over_slices(b, values, "slice long, q int, sigma double", [transforms.dct_array(b.dims[m]) for m in modes], modes)


def _lists(x: np.ndarray) -> pa.Array:
    """An array for each entry of the first axis."""
    flat = np.ascontiguousarray(x).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _slice_table(numbers: np.ndarray, shape_: tuple[int, ...], more: dict[str, pa.Array]) -> pa.Table:
    sizes = {n: pa.array([d] * len(numbers), pa.int32()) for n, d in zip(("nrow", "ncol"), shape_[1:], strict=True)}
    return pa.table({"slice": pa.array(numbers, pa.int64())} | sizes | more)


def reconstruct_blocks(c: CompressedBlocks) -> blocks.Blocks:
    """Blocks of the factors' products, transformed back: one shuffle."""

    def products_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        columns = [batch.column(n) for n in ("slice", "nrow", "ncol", "k", "u", "s", "v")]
        for number, m, n, k, u, s, v in zip(*columns, strict=True):
            if (k := k.as_py()) > 0:  # a slice of rank 0 is zero
                u, s, v = (x.values.to_numpy() for x in (u, s, v))
                yield number.as_py(), (u.reshape(k, m.as_py()).T * s) @ v.reshape(k, n.as_py())

    found = blocks.from_slices(c.factors, products_of, c.dims, c.step, c.inverses, c.modes)
    return blocks.Blocks(found.frame, c.dims, c.step)


def report_blocks(b: blocks.Blocks, c: CompressedBlocks, back: blocks.Blocks | None = None) -> DataFrame:
    """As ``report``, from blocks."""
    sums = blocks.block_sums(b, back or reconstruct_blocks(c))
    roots = [F.sqrt(x).alias(n) for n, x in (("abs_err", "lost"), ("norm", "left"), ("norm_back", "right"))]
    return _reported(b.size, c.factors, sums.select(*roots))


def _reported(size: int, factors: DataFrame, err: DataFrame) -> DataFrame:
    """One row of both; a ratio to nothing stored is null, and an error relative to a norm of zero is zero where there is none."""
    held = factors.agg(F.count(F.lit(1)).alias("n_slices"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("sum_rank"), F.sum(F.size("u") + F.size("s") + F.size("v")).alias("stored"))
    relative = F.when(F.col("abs_err") == 0, F.lit(0.0)).otherwise(F.try_divide("abs_err", "norm"))
    ratio = F.try_divide(F.lit(float(size)), F.col("stored"))
    return held.join(F.broadcast(err)).select("n_slices", "sum_rank", ratio.alias("compression_ratio"), "abs_err", relative.alias("relative_err"), "norm", "norm_back")  # one row each


def report(t: Tensor, c: Compressed, back: Tensor | None = None) -> DataFrame:
    """One row: ``n_slices, sum_rank, compression_ratio, relative_err``, and the norms."""
    back = back or reconstruct(c)
    return _reported(t.size, c.factors, errors(t, back))


def errors(a: Tensor, b: Tensor) -> DataFrame:
    """``abs_err, relative_err, norm, norm_back``. Missing cells are zero; the relative error is 0 where there is none, and null where the
    first tensor is zero and the second is not."""
    both = a.cells.select(*a.modes, F.col("v").alias("x"), F.lit(0.0).alias("y")).unionByName(b.cells.select(*b.modes, F.lit(0.0).alias("x"), F.col("v").alias("y")))
    cells = both.groupBy(*a.modes).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    d = F.col("x") - F.col("y")
    sums = cells.agg(*[F.sqrt(F.sum(e * e)).alias(n) for e, n in ((d, "abs_err"), (F.col("x"), "norm"), (F.col("y"), "norm_back"))])
    sums = sums.select(*[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("abs_err", "norm", "norm_back")])
    relative = F.when(F.col("abs_err") == 0, F.lit(0.0)).otherwise(F.try_divide("abs_err", "norm"))
    return sums.select("abs_err", relative.alias("relative_err"), "norm", "norm_back")


def _summed(m: Matrix, width: int, add) -> DataFrame:
    """``a, data``: the rows of a matrix of ``width`` columns that is the sum of ``add(X, columns)`` over blocks X of
    whole columns. Each task adds its blocks up first, so as many rows are shuffled as tasks times rows."""

    count = m.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, None

        def blocks(t: pa.Table) -> None:
            nonlocal total
            columns, at = np.unique(t.column("c").to_numpy(), return_inverse=True)
            x = np.zeros((count, len(columns)))
            np.add.at(x, (t.column("r").to_numpy(), at), t.column("v").to_numpy())
            step = max(1, products.BLOCK_CELLS // max(count, width))
            for k in range(0, len(columns), step):
                part = add(x[:, k : k + step], columns[k : k + step])
                total = part if total is None else total + part

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            c = t.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1])) if len(c) else 0  # the last column may go on
            if t.num_rows >= products.BLOCK_CELLS // 4 and cut:
                blocks(t.slice(0, cut))
                t = t.slice(cut)
            held = t
        if held is not None and held.num_rows:
            blocks(held)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["a", "data"])

    def sum_up(key: tuple, table: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x, np.float64) for x in table.column("data").to_pylist()], axis=0)
        return pa.table({"a": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    entries = m.entries.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))
    parts = entries.repartition("c").sortWithinPartitions("c").mapInArrow(run, "a long, data binary")
    return parts.groupBy("a").applyInArrow(sum_up, "a long, data binary")


def _array(rows: DataFrame, count: int, width: int) -> np.ndarray:
    table = rows.toArrow()
    out = np.zeros((count, width))
    for a, data in zip(table.column("a").to_pylist(), table.column("data").to_pylist(), strict=True):
        out[a] = np.frombuffer(data, np.float64)
    return out


#: A Gram matrix of more rows than this is not made.
GRAM_ROWS = 4096


def _gram_rows(m: Matrix) -> DataFrame:
    if m.rows > GRAM_ROWS:
        raise ValueError(f"a side of {m.rows} is too long for a Gram matrix")
    return _summed(m, m.rows, lambda x, _: x @ x.T)


def gram(m: Matrix) -> DataFrame:
    """``a, b, g``: M M', by rows, without zeros."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.frombuffer(data, np.float64)
                b = np.flatnonzero(g)
                yield pa.record_batch([pa.array(np.full(len(b), a)), pa.array(b), pa.array(g[b])], ["a", "b", "g"])

    return _gram_rows(m).mapInArrow(unpack, "a long, b long, g double")


def _signs(u: np.ndarray) -> np.ndarray:
    top = np.take_along_axis(u, np.abs(u).argmax(axis=0)[None, :], axis=0)
    return u * np.where(top < 0, -1.0, 1.0)


def _eigen(m: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, descending, and left singular vectors, of a matrix with few rows."""
    g = _array(_gram_rows(m), m.rows, m.rows)
    w, u = np.linalg.eigh((g + g.T) / 2)
    return np.maximum(w[::-1], 0), _signs(u[:, ::-1])


def leading_vectors(m: Matrix, k: int) -> tuple[np.ndarray, Matrix]:
    """The ``k`` largest squared singular values and their left vectors: from the Gram matrix where the rows are few, by subspace iteration, with the
    vectors left on the cluster, where they are many."""
    if m.rows <= GRAM_ROWS:
        energies, vectors = _eigen(m)
        return energies[:k], matrix_from_numpy(m.entries.sparkSession, vectors[:, :k])
    found = block_matrix.leading_subspace(block_matrix.to_blocks(m), min(k, m.rows, m.columns))
    return found.energies, found.vectors.entries()


def vectors_within(m: Matrix, lost: float) -> Matrix:
    """As few leading left vectors as leave out no more than ``lost`` of the energy, one at least."""
    if m.rows <= GRAM_ROWS:
        energies, vectors = _eigen(m)
        beyond = np.cumsum(energies[::-1])[::-1]  # energy from each value on
        return matrix_from_numpy(m.entries.sparkSession, vectors[:, : max(1, int((beyond > lost).sum()))])
    blocks_, k = block_matrix.to_blocks(m), 32
    while True:
        k = min(k, m.rows, m.columns)
        found = block_matrix.leading_subspace(blocks_, k)
        left = found.total - np.cumsum(found.energies)
        if left[-1] <= lost or k == min(m.rows, m.columns):
            return found.vectors.entries().leading_columns(min(k, int((left > lost).sum()) + 1))
        k *= 2  # the count that is enough is not known before


def mode_vectors(t: Tensor, mode: int) -> np.ndarray:
    """Left singular vectors of a mode's unfolding, all of them: a square matrix, so for modes of ``GRAM_ROWS`` at most."""
    return _eigen(shape.unfold(t, [mode]))[1]


def energy_rank(energies: np.ndarray, tol: float, k_max: int) -> int:
    """The least rank that keeps (1 - tol^2) of the energy of the leading ``k_max`` values."""
    e = energies[:k_max]
    return int(min(np.searchsorted(np.cumsum(e), (1 - tol * tol) * e.sum()) + 1, len(e)))


def eof(t: Tensor, tol: float, k_max: int = 1000) -> tuple[Tensor, int, float]:
    """The matrix baseline: space (all modes but the last) by time, truncated. Returns the
    reconstruction, the rank and the compression ratio."""
    last = len(t.dims) - 1
    flat = shape.unfold(t, [last])
    energies, vectors = leading_vectors(flat, min(k_max, flat.rows, flat.columns) if flat.rows > GRAM_ROWS else flat.rows)
    k = energy_rank(energies, tol, k_max)
    kept_vectors = vectors.leading_columns(k)
    # Through the k coefficients of each place, never through a matrix of time by time.
    back = products.transform(products.transform(t, [kept_vectors.transposed()], [last]), [kept_vectors], [last])
    return back, k, t.size / (k * (flat.rows + flat.columns + 1))


def hosvd(t: Tensor, *, tol: float | None = None, share: float | None = None) -> tuple[Tensor, list[Matrix]]:
    """Core and factor matrices; the ranks are ``ceil(share x size)``, or what each mode's part of the
    squared tolerance allows. Of modes longer than ``GRAM_ROWS`` only leading vectors are ever found, and they stay on the cluster."""
    if (tol is None) == (share is None):
        raise ValueError("either a tolerance or a share")
    energy = None if tol is None else shape.norm(t).first()[0] ** 2
    found = []
    for mode, d in enumerate(t.dims):
        flat = shape.unfold(t, [mode])
        found.append(leading_vectors(flat, min(d, math.ceil(d * share)))[1] if share is not None else vectors_within(flat, tol**2 * energy / len(t.dims)))
    core = products.transform(t, [u.transposed() for u in found], list(range(len(t.dims))))
    return core, found


def hosvd_back(core: Tensor, vectors: list[Matrix]) -> Tensor:
    return products.transform(core, vectors, list(range(len(vectors))))


def report_hosvd(t: Tensor, core: Tensor, vectors: list[Matrix]) -> DataFrame:
    """One row: ``ranks`` by mode, ``compression_ratio`` and the errors."""
    stored = core.size + sum(u.size for u in vectors)
    ranks = F.array(*[F.lit(u.columns) for u in vectors])
    return errors(t, hosvd_back(core, vectors)).select(ranks.alias("ranks"), F.lit(t.size / stored).alias("compression_ratio"), "abs_err", "relative_err", "norm", "norm_back")
