"""Matrices to transform a mode with."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.tensor import Matrix

#: Weights of red, green and blue in brightness (BT.601). Fixed values.
GRAY = (0.298936021293775, 0.587043074451121, 0.114020904255103)


def _grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("r"), F.pmod("id", F.lit(columns)).cast("int").alias("c"))


def dct(spark: SparkSession, n: int) -> Matrix:
    """The orthonormal DCT-II; its transpose is its inverse."""
    scale = F.when(F.col("r") == 0, F.lit(math.sqrt(1 / n))).otherwise(F.lit(math.sqrt(2 / n)))
    v = scale * F.cos(F.lit(math.pi) * (2 * F.col("c") + 1) * F.col("r") / F.lit(2.0 * n))
    return Matrix(_grid(spark, n, n).withColumn("v", v), n, n, dct_array(n))


def dct_array(n: int) -> np.ndarray:
    r, c = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(r == 0, math.sqrt(1 / n), math.sqrt(2 / n)) * np.cos(math.pi * (2 * c + 1) * r / (2 * n))


def eye(spark: SparkSession, n: int) -> Matrix:
    return Matrix(spark.range(n).select(F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"), F.lit(1.0).alias("v")), n, n)


def gray(spark: SparkSession) -> Matrix:
    """Three colour channels to one."""
    return Matrix(spark.createDataFrame([(0, c, w) for c, w in enumerate(GRAY)], "r int, c int, v double"), 1, 3)


def orthonormality_error(m: Matrix) -> DataFrame:
    """``error``: the largest entry of |M' M - 1|."""
    left = m.entries.select(F.col("r"), F.col("c").alias("a"), F.col("v").alias("x"))
    right = m.entries.select(F.col("r"), F.col("c").alias("b"), F.col("v").alias("y"))
    gram = left.join(right, "r").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    return gram.agg(F.max(F.abs(F.col("g") - (F.col("a") == F.col("b")).cast("double"))).alias("error"))
