"""Slice-wise singular value decomposition, truncation and products.

A slice row is ``slice, nrow, ncol, data`` (column-major). A factor row is ``slice, nrow, ncol, k, u, s,
v``: u (nrow x k) and v (ncol x k) are column-major, so keeping the leading triplets keeps prefixes of
the arrays. Ranks may differ from slice to slice; rank 0 has empty arrays and stands for a zero slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.tensor import Matrix, Tensor, index_names, linear_index, slice_number, split_index

FACTORS = "slice long, nrow int, ncol int, k int, u array<double>, s array<double>, v array<double>"


#: Cells that a task turns into arrays at a time.
FRAME_CELLS = 1 << 22


def _bounded(frame: pd.DataFrame, cells: int) -> Iterator[pd.DataFrame]:
    """Parts of a frame whose rows have so many cells each."""
    step = max(1, FRAME_CELLS // max(1, cells))
    for a in range(0, len(frame), step):
        yield frame.iloc[a : a + step]


def to_slices(t: Tensor) -> DataFrame:
    """One row per frontal slice that has cells, and one for every other, all zero."""
    rows, columns = t.dims[:2]
    position = linear_index(t.dims[:2], t.modes[:2]).cast("int")
    cells = t.cells.select(slice_number(t).alias("slice"), position.alias("at"), "v")
    size = rows * columns

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in _bounded(whole, size)):
            data = []
            for at, v in zip(frame["at"], frame["v"], strict=True):
                x = np.zeros(size)
                if at is not None and len(at):
                    np.add.at(x, np.asarray(at), np.asarray(v))
                data.append(x)
            yield pd.DataFrame({"slice": frame["slice"], "nrow": rows, "ncol": columns, "data": data})

    grouped = cells.groupBy("slice").agg(F.collect_list(F.struct("at", "v")).alias("c")).select("slice", F.col("c.at").alias("at"), F.col("c.v").alias("v"))
    every = t.cells.sparkSession.range(t.slices).withColumnRenamed("id", "slice").join(grouped, "slice", "left")
    return every.mapInPandas(fill, "slice long, nrow int, ncol int, data array<double>")


def matrix_slice(m: Matrix) -> DataFrame:
    """A matrix as the only slice."""
    cells = m.entries.select(F.col("r").cast("int").alias("i0"), F.col("c").cast("int").alias("i1"), "v")
    return to_slices(Tensor(cells, (m.rows, m.columns)))


def stacks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one shape, and their matrices."""
    for (m, n), every in frame.groupby(["nrow", "ncol"]).indices.items():
        step = max(1, FRAME_CELLS // max(1, m * n))
        for at in (every[a : a + step] for a in range(0, len(every), step)):
            flat = np.stack([np.asarray(frame["data"].iloc[i], float) for i in at])
            if not np.isfinite(flat).all():
                raise ValueError("a slice has cells that are not finite")
            yield at, flat.reshape(len(at), n, m).transpose(0, 2, 1)


def signed_vectors(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest entry of each left vector made positive."""
    top = np.take_along_axis(u, np.abs(u).argmax(axis=1)[:, None, :], axis=1)
    sign = np.where(top < 0, -1.0, 1.0)
    return u * sign, v * sign


def singular_values(slices: DataFrame) -> DataFrame:
    """``slice, q, sigma``: all singular values, q from 0 in descending order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, x in stacks(frame):
                s = np.linalg.svd(x, compute_uv=False)
                q = s.shape[1]
                yield pd.DataFrame({"slice": np.repeat(frame["slice"].to_numpy()[at], q), "q": np.tile(np.arange(q), len(at)), "sigma": s.ravel()})

    return slices.mapInPandas(run, "slice long, q int, sigma double")


def decompose(slices: DataFrame, k: int | None = None) -> DataFrame:
    """Factor rows of every slice, thin, or with the leading ``k`` triplets. Slices with a column
    ``k`` (see ``decompose_ranks``) get as many each."""
    if k is not None and k < 1:
        raise ValueError("the rank is 1 at least")
    own = "k" in slices.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, x in stacks(frame):
                m, n = x.shape[1:]
                if k is not None and k > min(m, n):
                    raise ValueError(f"rank {k} of a {m} x {n} slice")
                ranks = frame["k"].to_numpy()[at] if own else np.full(len(at), k or min(m, n))
                if (ranks > min(m, n)).any() or (ranks < 0).any():
                    raise ValueError(f"a rank outside 0 to {min(m, n)}")
                u, s, vt = np.linalg.svd(x, full_matrices=False)
                u, v = signed_vectors(u, vt.transpose(0, 2, 1))
                rows = [(int(i), m, n, int(r), u[j, :, :r].ravel("F"), s[j, :r], v[j, :, :r].ravel("F")) for j, (i, r) in enumerate(zip(frame["slice"].to_numpy()[at], ranks, strict=True))]
                yield pd.DataFrame(rows, columns=["slice", "nrow", "ncol", "k", "u", "s", "v"])

    return slices.mapInPandas(run, FACTORS)


def decompose_ranks(slices: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks`` has ``slice, k``; slices that it lacks get rank 0."""
    joined = slices.join(ranks, "slice", "left").withColumn("k", F.coalesce(F.col("k"), F.lit(0)).cast("int"))
    return decompose(joined)


def truncate(factors: DataFrame, ranks: DataFrame) -> DataFrame:
    """The leading triplets of each slice, as prefixes of the arrays: no decomposition again."""
    wanted = ranks.select("slice", F.col("k").alias("_k"))
    k = F.least(F.col("k"), F.coalesce("_k", F.lit(0))).cast("int")
    joined = factors.join(wanted, "slice", "left").withColumn("k", k)
    cut = {c: F.slice(c, F.lit(1), F.col("k") * F.col(n) if n else F.col("k")) for c, n in (("u", "nrow"), ("s", None), ("v", "ncol"))}
    return joined.withColumns(cut).select("slice", "nrow", "ncol", "k", "u", "s", "v")


def multiply(factors: DataFrame) -> DataFrame:
    """Slice rows of u diag(s) v' ; rank 0 gives zeros."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in _bounded(whole, int((whole["nrow"] * whole["ncol"]).max() or 1) if len(whole) else 1)):
            data = []
            for m, n, k, u, s, v in zip(*(frame[c] for c in ("nrow", "ncol", "k", "u", "s", "v")), strict=True):
                if k:
                    left = np.asarray(u).reshape((m, k), order="F") * np.asarray(s)
                    data.append((left @ np.asarray(v).reshape((n, k), order="F").T).ravel("F"))
                else:
                    data.append(np.zeros(m * n))
            yield pd.DataFrame({"slice": frame["slice"], "nrow": frame["nrow"], "ncol": frame["ncol"], "data": data})

    return factors.mapInPandas(run, "slice long, nrow int, ncol int, data array<double>")


def to_cells(slices: DataFrame, dims: tuple[int, ...]) -> Tensor:
    """Cells of slice rows."""
    flat = slices.select("slice", F.posexplode("data").alias("at", "v"))
    columns = split_index(F.col("at"), tuple(dims[:2])) + split_index(F.col("slice"), tuple(dims[2:]))
    return Tensor(flat.select(*[c.alias(n) for c, n in zip(columns, index_names(len(dims)), strict=True)], "v"), tuple(dims))


def stored_numbers(factors: DataFrame) -> DataFrame:
    """``stored``: numbers that the factors hold."""
    return factors.agg(F.coalesce(F.sum(F.size("u") + F.size("s") + F.size("v")), F.lit(0)).cast("long").alias("stored"))


def sigma_rows(factors: DataFrame) -> DataFrame:
    return factors.select("slice", F.posexplode("s").alias("q", "sigma"))
