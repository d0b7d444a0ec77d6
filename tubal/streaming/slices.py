"""Compression of slices as they arrive.

New frontal slices (later positions of the last mode) can be compressed one by one where the
transform leaves their modes alone; each is decomposed by itself, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tubal.operators.factors import decompose


def compress_stream(slices: DataFrame, rank: int, path: str, checkpoint: str) -> StreamingQuery:
    """Appends factor rows of a stream of slice rows to a Parquet table, exactly once."""
    factors = decompose(slices, rank)
    return factors.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
