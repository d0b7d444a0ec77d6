"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al. 2014), with plain joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import materialize, temporary_tables


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns ``a`` and ``b``. Returns ``node, component`` for every node that
    has an edge to another; ``component`` is the smallest node reachable. No edges: no rows."""
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        with temporary_tables(edges.sparkSession):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "low")
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
            large = materialize(large, "large-star")
            low = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "low")
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
            edges = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "small-star", outlives=True)
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
