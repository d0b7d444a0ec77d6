"""One global tolerance over slices that keep arriving.

A rank by tolerance depends on the singular values of all slices, those to come too, so no slice can be cut when it arrives. Each micro-batch is reduced
once (see ``operators.kept``) and written under its own number, values and reductions; a batch that a restart runs again writes over itself. What
the tolerance allows is then worked out over all slices so far, from the values alone, and vectors are formed only of ranks that survive. The values are the
state: a slice's are as many as its short side is long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tubal.operators import kept, threshold
from tubal.storage import BLOCK_OPTIONS


def keep_arriving(slices: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream of slice rows ``slice, nrow, ncol, data`` into the folder ``out``. A slice that arrives again takes the place of the one before."""

    def reduce(batch: DataFrame, number: int) -> None:
        reduced = kept.reduce_slices(batch).persist()
        reduced.write.options(**BLOCK_OPTIONS).mode("overwrite").parquet(f"{out}/kept/batch={number}")
        kept.kept_values(reduced).write.mode("overwrite").parquet(f"{out}/values/batch={number}")
        reduced.unpersist()

    return slices.writeStream.foreachBatch(reduce).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _latest(rows: DataFrame) -> DataFrame:
    """Of each slice the rows of the last batch that has it."""
    last = rows.groupBy("slice").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["slice", "batch"]).drop("batch")


def ranks_so_far(spark: SparkSession, out: str, tol: float) -> DataFrame:
    """``slice, k`` over all slices that have arrived."""
    return threshold.ranks(_latest(spark.read.option("basePath", f"{out}/values").parquet(f"{out}/values")), tol)


def factors_so_far(spark: SparkSession, out: str, tol: float) -> DataFrame:
    """Factor rows of all slices that have arrived, within one tolerance of them all together."""
    reduced = spark.read.option("basePath", f"{out}/kept").parquet(f"{out}/kept")
    return kept.form_factors(_latest(reduced), ranks_so_far(spark, out, tol))
