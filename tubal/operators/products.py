"""Products: of matrices, and of a tensor with a matrix along a mode.

Two strategies for a mode product. ``cells`` is a join and an aggregation, all in Catalyst; its partial
sums grow with the rows of the matrix. ``tubes`` brings the tubes (all cells that share the first two
indexes) of some positions together once, in bounded blocks, and applies the matrices of any number of
trailing modes there in NumPy, so several modes cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.operators import block_matrix
from tubal.tensor import Matrix, Tensor, index_names, linear_index, split_index

#: Matrices up to so many entries are broadcast (24 bytes each); larger ones are joined by a shuffle.
BROADCAST_ENTRIES = 1 << 20
#: Cells that a task holds at once in the ``tubes`` strategy (8 bytes each, three copies).
BLOCK_CELLS = 1 << 21


def matmul(a: Matrix, b: Matrix) -> Matrix:
    """Through blocks: dense products in tasks, no row for each pair of entries."""
    return block_matrix.matmul(a, b)


def _small(m: Matrix) -> DataFrame:
    entries = m.entries.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("v").alias("_w"))
    return F.broadcast(entries) if m.rows * m.columns <= BROADCAST_ENTRIES else entries


def ttm(t: Tensor, m: Matrix, mode: int) -> Tensor:
    """Mode product by join and aggregation; the mode's size becomes the rows of ``m``."""
    name = t.mode(mode)
    if m.columns != t.dims[mode]:
        raise ValueError(f"mode {mode} has {t.dims[mode]} positions, the matrix {m.columns} columns")
    others = [n for n in t.modes if n != name]
    joined = t.cells.join(_small(m), F.col(name) == F.col("_c"))
    cells = joined.groupBy(*others, F.col("_r").cast("int").alias(name)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return t.with_cells(cells, (*t.dims[:mode], m.rows, *t.dims[mode + 1 :]))


def ttm_tubes(t: Tensor, matrices: Sequence[np.ndarray], modes: Sequence[int], block_cells: int = BLOCK_CELLS) -> Tensor:
    """Mode products along any of the modes from 2 on, with one shuffle."""
    for m, mode in zip(matrices, modes, strict=True):
        if not 2 <= mode < len(t.dims) or m.shape[1] != t.dims[mode]:
            raise ValueError(f"a matrix of shape {m.shape} does not fit mode {mode} of {t.dims}")
    # The modes commute; those that shrink the tubes come first.
    order = sorted(range(len(modes)), key=lambda i: matrices[i].shape[0] / matrices[i].shape[1])
    matrices, modes = [np.asarray(matrices[i], float) for i in order], [modes[i] for i in order]
    out_dims = list(t.dims)
    for m, mode in zip(matrices, modes, strict=True):
        out_dims[mode] = m.shape[0]
    old, new = t.dims[2:], tuple(out_dims[2:])
    per_block = max(1, block_cells // max(prod(old), prod(new)))
    position = linear_index(t.dims[:2], t.modes[:2])
    placed = t.cells.select(F.floor(position / per_block).alias("block"), position.alias("tube"), linear_index(old, t.modes[2:]).alias("at"), "v")

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        tubes, row = np.unique(frame["tube"].to_numpy(), return_inverse=True)
        x = np.zeros((len(tubes), prod(old)))
        np.add.at(x, (row, frame["at"].to_numpy()), frame["v"].to_numpy())
        x = x.reshape((len(tubes), *old), order="F") if old else x
        for m, mode in zip(matrices, modes, strict=True):
            x = np.moveaxis(np.tensordot(m, x, (1, mode - 1)), 0, mode - 1)
        x = x.reshape((len(tubes), -1), order="F")
        return pd.DataFrame({"tube": np.repeat(tubes, x.shape[1]), "at": np.tile(np.arange(x.shape[1]), len(tubes)), "v": x.ravel()})

    done = placed.groupBy("block").applyInPandas(apply, "tube long, at long, v double")
    names = index_names(len(out_dims))
    columns = [c.alias(n) for c, n in zip(split_index(F.col("tube"), t.dims[:2]) + split_index(F.col("at"), new), names, strict=True)]
    return t.with_cells(done.select(*columns, "v"), tuple(out_dims))


def transform(t: Tensor, matrices: Sequence[Matrix], modes: Sequence[int], strategy: str = "auto") -> Tensor:
    """Mode products one after the other; none: the tensor as it is. ``auto`` takes ``tubes`` where the modes are
    trailing ones, the matrices small enough to ship and a tube fits a task, else ``cells``."""
    if not matrices:
        return t
    if strategy == "auto":
        sizes = {mode: max(m.rows, m.columns) for m, mode in zip(matrices, modes, strict=True)}
        tube = prod(sizes.get(k, d) for k, d in enumerate(t.dims) if k >= 2)
        fits = min(modes) >= 2 and tube <= BLOCK_CELLS and all(m.rows * m.columns <= BROADCAST_ENTRIES for m in matrices)
        strategy = "tubes" if fits else "cells"
    if strategy == "tubes":
        return ttm_tubes(t, [m.to_numpy() for m in matrices], modes)
    for m, mode in sorted(zip(matrices, modes, strict=True), key=lambda x: x[0].rows / x[0].columns):
        t = ttm(t, m, mode)
    return t
