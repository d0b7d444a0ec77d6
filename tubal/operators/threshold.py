"""The global cut-off of singular values for a relative error, and the ranks it gives.

Values are dropped from the smallest on while the sum of their squares stays within tol^2 of all; the
cut-off is the largest value that could still go. It and its ties are kept. Zero where nothing can go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values are summed in bins of the exponent, so many an octave, and those of one bin in so many parts of it.
BINS, PARTS = 64, 4096


def _crossed(sums: DataFrame, part: str, limit: Column, base: Column, top: Column) -> DataFrame:
    """One row: of the parts in order the first with which the sum of ``energy`` passes the limit; and ``base``, the
    energy, and ``top``, the largest value, of all parts before it. Of ``sums`` there are no more than parts."""
    order = Window.orderBy(part)
    through = (base + F.sum("energy").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("through")
    below = F.coalesce(F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), top).alias("top")
    placed = sums.select(part, "energy", limit.alias("limit"), through, below).where((F.col("limit") > 0) & (F.col("through") > F.col("limit")))
    first = F.min(F.struct(part, "limit", (F.col("through") - F.col("energy")).alias("base"), "top"))
    return placed.agg(first.alias("x")).select("x.*")


def cutoff(sigma: DataFrame, tol: float, bins: int = BINS, parts: int = PARTS) -> DataFrame:
    """``cutoff``, one row, from a column ``sigma``.

    Equal values are one row with their number from the first shuffle on. Sums by bin are prefix-summed,
    then sums by parts of the one bin in which the limit is crossed; only values of one part are sorted."""
    if not 0 < tol < 1:
        raise ValueError("the tolerance lies between 0 and 1")
    counted = sigma.groupBy("sigma").agg(F.count(F.lit(1)).alias("n")).withColumn("energy", F.col("sigma") * F.col("sigma") * F.col("n"))
    bin_of = F.when(F.col("sigma") > 0, F.floor(F.log2("sigma") * bins)).otherwise(F.lit(-(1 << 40))).cast("long")
    binned = counted.withColumn("bin", bin_of)
    sums = [F.sum("energy").alias("energy"), F.max("sigma").alias("most")]
    limit = F.sum("energy").over(Window.partitionBy()) * F.lit(tol * tol)
    one = _crossed(binned.groupBy("bin").agg(*sums), "bin", limit, F.lit(0.0), F.lit(None).cast("double"))
    low = F.when(F.col("sigma") > 0, F.pow(F.lit(2.0), F.col("bin") / bins)).otherwise(F.lit(1.0))
    part = F.floor((F.col("sigma") / low - 1) * (parts / (2 ** (1 / bins) - 1)))
    inside = binned.join(F.broadcast(one), "bin").withColumn("part", part)  # one row
    two = _crossed(inside.groupBy("part", "limit", "base", "top").agg(*sums), "part", F.col("limit"), F.col("base"), F.col("top"))
    order = Window.partitionBy("part").orderBy("sigma").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.select("sigma", "energy", "part").join(F.broadcast(two), "part").withColumn("within", F.coalesce(F.sum("energy").over(order), F.lit(0.0)))
    # Of equal values one at least must be able to go.
    droppable = F.col("base") + F.col("within") + F.col("sigma") * F.col("sigma") <= F.col("limit")
    return last.agg(F.coalesce(F.max(F.when(droppable, F.col("sigma"))), F.max("top"), F.lit(0.0)).alias("cutoff"))


def ranks(sigma: DataFrame, tol: float) -> DataFrame:
    """``slice, k`` from ``slice, sigma``: values at the cut-off or above."""
    kept = F.sum((F.col("sigma") >= F.col("cutoff")).cast("int")).cast("int").alias("k")
    return sigma.join(F.broadcast(cutoff(sigma, tol))).groupBy("slice").agg(kept)  # one row is broadcast
