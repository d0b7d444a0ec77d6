"""Decomposition by tolerance with kept intermediates: values first, vectors only of ranks that survive.

Ranks are known only when the values of all slices are. Until then a slice is kept as its orthogonal reduction: of a
tall slice (of a wide one's transpose) the triangular factor and, below it, the reflectors, in the place of the slice itself and
one number a column besides. That is less than full factors, and no slice is reduced twice. Vectors are formed where
the rank is not zero: those of the small triangle, with the reflectors applied to as many columns as the rank says.

A kept row is ``slice, nrow, ncol, s, work, scales``: all singular values, the reduction and its scales (float64 bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.operators.factors import FACTORS, signed_vectors, stacks

KEPT = "slice long, nrow int, ncol int, s array<double>, work binary, scales binary"


def reduce_stack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of matrices of one shape: singular values, reductions (each column after column) and scales."""
    tall = x if x.shape[1] >= x.shape[2] else x.transpose(0, 2, 1)
    work, scales = np.linalg.qr(tall, mode="raw")
    n = tall.shape[2]
    triangle = np.triu(work[:, :, :n].transpose(0, 2, 1))
    return np.linalg.svd(triangle, compute_uv=False), work, scales


def apply_reflectors(work: np.ndarray, scales: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The orthogonal factor of one reduction times ``small`` (n x k), in the form I - V T V'."""
    n, m = work.shape
    v = np.tril(work.T, -1)
    v[np.arange(n), np.arange(n)] = 1.0
    v[:, scales == 0] = 0.0  # those columns were not reflected
    inverse = np.triu(v.T @ v, 1)
    inverse[np.arange(n), np.arange(n)] = np.where(scales == 0, 1.0, 1.0 / np.where(scales == 0, 1.0, scales))
    out = np.zeros((m, small.shape[1]))
    out[:n] = small
    return out - v @ np.linalg.solve(inverse, v[:n].T @ small)


def form_vectors(m: int, n: int, k: int, work: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading ``k`` triplets from a kept reduction."""
    small = min(m, n)
    work = work.reshape(small, max(m, n))
    u, s, vt = np.linalg.svd(np.triu(work[:, :small].T))
    long = apply_reflectors(work, scales, u[:, :k])
    u, v = (long, vt[:k].T) if m >= n else (vt[:k].T, long)
    u, v = signed_vectors(u[None], v[None])
    return u[0], s[:k], v[0]


def reduce_slices(slices: DataFrame) -> DataFrame:
    """Kept rows of slice rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, x in stacks(frame):
                s, work, scales = reduce_stack(x)
                of = frame["slice"].to_numpy()[at]
                yield pd.DataFrame({"slice": of, "nrow": x.shape[1], "ncol": x.shape[2], "s": list(s), "work": [w.tobytes() for w in work], "scales": [t.tobytes() for t in scales]})

    return slices.mapInPandas(run, KEPT)


def kept_values(kept: DataFrame) -> DataFrame:
    """``slice, q, sigma``. The reductions are not read for it where ``kept`` is a table or a cache."""
    return kept.select("slice", F.posexplode("s").alias("q", "sigma"))


def kept_bytes(kept: DataFrame) -> DataFrame:
    """``bytes`` that the rows hold, and ``factor_bytes`` that full thin factors would."""
    held = F.octet_length("work") + F.octet_length("scales") + 8 * F.size("s")
    small = F.least("nrow", "ncol")
    return kept.agg(F.sum(held.cast("long")).alias("bytes"), F.sum((8 * small * (F.col("nrow") + F.col("ncol") + 1)).cast("long")).alias("factor_bytes"))


def form_factors(kept: DataFrame, ranks: DataFrame) -> DataFrame:
    """Factor rows of kept rows at ``ranks`` (``slice, k``; missing: 0). Of slices of rank 0 nothing is formed."""
    wanted = ranks.select("slice", F.col("k").alias("_k"))
    joined = kept.join(wanted, "slice", "left").withColumn("k", F.coalesce("_k", F.lit(0)).cast("int"))
    # A slice of rank 0 needs no reduction, so none is sent to Python for it.
    sent = [F.when(F.col("k") > 0, F.col(c)).alias(c) for c in ("work", "scales")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, m, n, k, work, scales in frame.itertuples(index=False):
                u = s = v = np.zeros(0)
                if k:
                    u, s, v = form_vectors(m, n, k, np.frombuffer(work, np.float64), np.frombuffer(scales, np.float64))
                rows.append((number, m, n, k, u.ravel("F"), s, v.ravel("F")))
            yield pd.DataFrame(rows, columns=["slice", "nrow", "ncol", "k", "u", "s", "v"])

    return joined.select("slice", "nrow", "ncol", "k", *sent).mapInPandas(run, FACTORS)
