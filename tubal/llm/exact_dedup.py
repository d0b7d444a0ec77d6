"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are compared by text length, then by a hash of a prefix, and only rows that still share both
with another row have their whole text hashed with SHA-256. Every level counts with partial
aggregation, and looks its counts up by a join of two plain scans, which adaptive execution splits
where one length or one text holds a large part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import materialize, same, text_or_empty, wrapped

PREFIX_CHARS = 128


def _measures(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> tuple[DataFrame, DataFrame]:
    """Lengths and prefixes that several rows share (``_len, _prefix``), and one row for each text that
    several rows have: ``text_sha256``, ``keep_id`` (the largest id), ``group_size`` and ``n_top``
    (rows with that id)."""
    text = text_or_empty(text_col)
    probe = materialize(docs.select(F.col(id_col).alias("_id"), *_measures(text, prefix_chars)), "exact-probe")
    lengths = materialize(_repeated(probe, ["_len"]), "exact-lengths")
    level1 = probe.join(lengths, "_len", "left_semi")
    prefixes = materialize(_repeated(level1, ["_len", "_prefix"]), "exact-prefixes")
    whole = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *_measures(text, prefix_chars))
    survivors = whole.join(prefixes, ["_len", "_prefix"], "left_semi")
    hashed = survivors.select("_id", F.sha2("_text", 256).alias("text_sha256"))
    ids = hashed.groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = ids.groupBy("text_sha256").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.max_by("_n", F.coalesce("_id", F.lit(-(1 << 63)))).alias("n_top")
    )
    return prefixes, materialize(groups.where("group_size > 1"), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after no change; a null text counts as empty. Of equal texts the
    row with the largest id stays. Null ids sort below all others; where all ids of a group are null
    ``keep_id`` is null and one row stays. Of identical rows with the same id exactly one stays. An
    empty table gives no rows; other columns are ignored. The digest of rows without a copy is
    computed only as a column of this result.
    """
    _, groups = copy_groups(docs, id_col, text_col, prefix_chars)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "exact-rows")  # so that row numbers hold still and both uses are plain scans
    # Only where rows tie for their group's largest id does one of them have to be chosen.
    ties = groups.where("n_top > 1").select("text_sha256", F.col("keep_id").alias("_tied_id"))
    chosen = rows.join(ties, "text_sha256").where(same(F.col("doc_id"), F.col("_tied_id"))).groupBy("text_sha256").agg(F.min("_row").alias("_chosen"))
    joined = rows.join(groups.join(chosen, "text_sha256", "left"), "text_sha256", "left")
    single = F.col("group_size").isNull()
    largest = same(F.col("doc_id"), F.col("keep_id")) & (F.col("_chosen").isNull() | (F.col("_row") == F.col("_chosen")))
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | largest).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each text, the one with the largest id; of rows that tie for it any one.
    Nulls are as in ``exact_dedup``. Only texts that share length and prefix with another are hashed;
    where few do, their list is broadcast (Spark's own bound) and no other text is shuffled."""
    prefixes, groups = copy_groups(docs, id_col, text_col, prefix_chars)
    id_of, text = F.col(f"row.`{id_col}`"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    marked = wrapped(docs, *_measures(text_or_empty(text_col), prefix_chars)).join(prefixes.withColumn("shared", F.lit(True)), ["_len", "_prefix"], "left")
    alone = marked.where("shared is null").select("row")
    among = marked.where("shared").select("row", F.sha2(text, 256).alias("text_sha256")).join(groups, "text_sha256", "left")
    top = among.where(F.col("n_top").isNull() | same(id_of, F.col("keep_id")))
    out = alone.unionByName(top.where("n_top is null or n_top = 1").select("row"))
    if not groups.where("n_top > 1").isEmpty():
        tied = top.where("n_top > 1").groupBy("text_sha256").agg(F.first("row").alias("row"))
        out = out.unionByName(tied.select("row"))
    return out.select("row.*")
