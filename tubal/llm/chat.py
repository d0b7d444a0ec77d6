"""Chat formatting by multi-party perspective rotation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubal.llm.common import materialize, running_sums

SYSTEM = "system"
OWN, SYSTEM_HEAD, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"
#: A dialogue of more turns than this is rendered in consecutive rows of so many turns each.
PART_TURNS = 4096


def escaped(text: Column) -> Column:
    """So that nothing said looks like a marker: after ``<`` and before ``>`` a run of bars gets one more."""
    return F.regexp_replace(F.regexp_replace(text, r"<\|", "<||"), r"\|>", "||>")


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Renders every dialogue whole once for each participant, with that speaker as the assistant.

    Needs ``conv_id, turn, role, text``; other columns are ignored. Speakers are the roles; a null or
    empty role is one more speaker, without a name (null); ``system`` speaks in all renderings but is no
    participant, so a dialogue of system turns alone gives no row. A turn reads ``<|assistant|>`` (the
    participant), ``<|user name=...|>`` or ``<|user|>`` (the others) or ``<|system|>``, a newline, its text
    (null: empty) and ``<|end|>`` with a newline. Texts and names are ``escaped``. Turns are ordered by
    number (null first), speaker (no name first) and text; turns of equal number all stay, repeated rows
    too. A null ``conv_id`` is a dialogue of its own. An empty table gives no rows.

    Returns per conversation and perspective: ``conv_id, perspective, part, n_turns, text`` and
    ``loss_spans`` (array of ``start, length`` in code points of ``text``): the participant's words with
    their end marks, on which alone the loss is taken. ``part`` is 0, but for dialogues of over
    ``part_turns`` turns: their texts in order of ``part`` join to the whole rendering."""
    speaker = F.when(F.col("role") != "", escaped(F.col("role")))
    said = F.concat(escaped(F.coalesce("text", F.lit(""))), F.lit(END))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), said.alias("body"))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = materialize(counts.where(F.col("n") > part_turns).select("conv_id"), "long-dialogues")
    numbered = turns.withColumn("part", F.lit(0).cast("long"))
    if not long.isEmpty():
        # Their turns are numbered over ranges of rows, so that no task gets a whole dialogue.
        of_long = turns.join(long, turns["conv_id"].eqNullSafe(long["conv_id"]), "left_semi")
        order = [F.col(c) for c in ("conv_id", "turn", "speaker", "body")]
        nth = running_sums(of_long.withColumn("row", F.monotonically_increasing_id()), [*order, F.col("row")], {"nth": F.lit(1).cast("long")}, "long-turns")
        first = nth.groupBy("conv_id").agg(F.min("nth").alias("first")).withColumnRenamed("conv_id", "of")
        nth = nth.join(first, nth["conv_id"].eqNullSafe(first["of"])).withColumn("part", F.floor((F.col("nth") - F.col("first")) / part_turns))
        usual = numbered.join(long, numbered["conv_id"].eqNullSafe(long["conv_id"]), "left_anti")
        numbered = usual.unionByName(nth.select("conv_id", "turn", "speaker", "body", "part"))

    # Where a turn's words start if no turn is the reader's own; each own turn before moves that by the heads' difference.
    other = F.concat(F.lit("<|user"), F.coalesce(F.concat(F.lit(" name="), F.col("speaker")), F.lit("")), F.lit("|>\n"))
    headed = numbered.withColumn("head", F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM_HEAD)).otherwise(other))
    before = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = headed.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body")).over(before), F.lit(0)))
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "speaker", "head", "body"))).alias("turns"))
    cast = turns.where(~F.col("speaker").eqNullSafe(F.lit(SYSTEM))).select(F.col("conv_id").alias("cast_of"), F.col("speaker").alias("perspective")).distinct()
    pairs = parts.join(cast, F.col("conv_id").eqNullSafe(F.col("cast_of")))

    def own(turn: Column) -> Column:
        return turn["speaker"].eqNullSafe(F.col("perspective"))

    def span(turn: Column, k: Column) -> Column:
        start = turn["at"] + k * (F.lit(len(OWN)) - F.length(turn["head"])) + F.lit(len(OWN))
        return F.struct(start.cast("int").alias("start"), F.length(turn["body"]).alias("length"))

    rendered = F.transform("turns", lambda t: F.concat(F.when(own(t), F.lit(OWN)).otherwise(t["head"]), t["body"]))
    return pairs.select(
        "conv_id", "perspective", "part", F.size("turns").alias("n_turns"), F.array_join(rendered, "").alias("text"),
        F.transform(F.filter("turns", own), span).alias("loss_spans"),
    )
