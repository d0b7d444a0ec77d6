"""Mixing sources to target weights (DataFrame functions only).

The words of each source, in the order of a hash of the document ids, form a stream that is cut into
blocks of ``block_words`` words. The mix is a list of places, one block each, cut into output shards of
``shard_slots`` places. A shard draws the source of each of its places, each source with the chance of its
share of all slots (a source has as many slots as its target needs): its source counts are a multinomial
draw of its own. Prefix sums of a source's counts over the shards give each shard a range of the source's
indexes. Where the draws of a source go beyond its slots, in its last shards, the places go to sources that
were drawn too seldom, index by index, so that each source fills its slots exactly. An index's block follows
from a pseudorandom permutation of its source's blocks, computed per index by the swap-or-not shuffle (Hoang,
Morris, Rogaway 2012), and the last slot of a source is cut so that its total meets the target to the
word. Blocks and slots are joined by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubal.llm.common import WORD, materialize, running_sums, same, tasks, wrapped

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 256
#: A word with the white space after it, the first with that before it too: their matches join to the text.
SPACED_WORD = rf"(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"
SHARD_SLOTS = 4096
ROUNDS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def _offsets(key: str, rounds: int) -> list[int]:
    """56 pseudorandom bits for each round of the permutation that ``key`` names."""
    seven = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:7], 16)
    return [seven(f"k/{key}/{r}") * (1 << 28) + seven(f"l/{key}/{r}") for r in range(1, rounds + 1)]


def offsets_of(key: Column, rounds: int) -> Column:
    """``_offsets`` of a column of keys."""

    def seven(letter: str, r: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(letter), key, r.cast("string"))), 1, 7), 16, 10).cast("long")

    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: seven("k", r) * F.lit(1 << 28) + seven("l", r))


def permuted(index: Column, n: Column, key: Column, offsets: Column, back: bool = False) -> Column:
    """Where the permutation of 0..n-1 that ``key`` names takes ``index``; ``offsets`` as ``_offsets``.
    ``back``: which index it takes there, by the same rounds, the last first."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.element_at(offsets, r) - x, n)
        coin = F.substring(F.md5(F.concat_ws("/", key, r.cast("string"), F.greatest(x, other).cast("string"))), 1, 1)
        return F.when(coin < F.lit("8"), x).otherwise(other)

    rounds = F.sequence(F.size(offsets), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.size(offsets))
    return F.aggregate(rounds, index, step)


def index_of(value: int, n: int, key: str, rounds: int) -> int:
    """The index that ``permuted`` takes to ``value``: the same rounds, the last first."""
    offsets = _offsets(key, rounds)
    for r in range(rounds, 0, -1):
        other = (offsets[r - 1] - value) % n
        if hashlib.md5(f"{key}/{r}/{max(value, other)}".encode()).hexdigest()[0] >= "8":
            value = other
    return value


def source_targets(sized: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """From rows of ``source`` and ``size``: ``nth``, ``source``, ``weight``, ``source_size``, ``target``.

    Sources in code point order, null last (``nth``), take the weights in turn and share ``share`` times
    all sizes by weight; no target exceeds ``most`` times its source's size, and what that cuts off is
    shared by weight among the others, again and again. That fixed point is a common level (target =
    weight x level) below which all sources not at their limit lie, found here in one pass over
    the sources in order of limit / weight."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = [F.col("source").isNull().cast("int"), F.col("source")]
    named = running_sums(per, by_name, {"nth": F.lit(1).cast("long")}, "mix-names")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")).cast("long")
    limited = named.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    by_limit = [F.col("limit") / F.col("weight"), *by_name]
    ranked = materialize(running_sums(limited, by_limit, {"limits_before": F.col("limit"), "weights_before": F.col("weight")}, "mix-limits"), "mix-ranked")
    whole = ranked.agg(F.sum("weight").alias("all_weights"), (F.sum("source_size") * F.lit(share)).alias("total"))
    ranked = ranked.crossJoin(F.broadcast(whole))
    # With all sources before it at their limits, is this one at its limit too? The first that is not sets the level;
    # of sources with equal limit / weight the first has the largest level.
    level = (F.col("total") - F.col("limits_before")) / (F.col("all_weights") - F.col("weights_before"))
    free = level * F.col("weight") < F.col("limit")
    common = ranked.agg((-F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), (-level).alias("least"))))["least"]).alias("level"))
    found = ranked.crossJoin(F.broadcast(common))
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")))
    return found.select("nth", "source", "weight", "source_size", target.alias("target"))


def plan_mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, share: float = 1.5, most: int = 2, weights: Sequence[int] = WEIGHTS, seed: str = "mix", rounds: int = ROUNDS):
    """``sized`` holds ``row`` (unique), ``doc_id``, ``source`` and ``size``. Returns (sources, pieces, slots).

    pieces: the part of a document that lies in a block: ``row, doc_id, nth, block, doc_from,
    words, block_from``; slots: ``slot, shard, place, nth, block, block_most`` (words taken of the block)."""
    targets = source_targets(sized, share, most, weights)
    size, blocks = F.col("source_size"), F.col("blocks")
    counted = targets.withColumn("blocks", F.floor((size + (block_words - 1)) / block_words))
    counted = counted.withColumn("words", F.least(F.rint("target").cast("long"), size * most))
    # Each whole round takes every block once; the rest takes blocks in permuted order and cuts the last.
    whole = F.floor(F.col("words") / F.greatest(size, F.lit(1)))
    rest = F.col("words") - whole * size
    need = F.least(whole * blocks + F.floor((rest + (block_words - 1)) / block_words) + (rest > 0).cast("long"), blocks * most)
    counted = counted.withColumn("slots", need)
    names = [F.concat_ws("/", F.lit(seed), F.col("nth").cast("string"), F.lit(str(k))) for k in range(most)]
    numbered = running_sums(counted, [F.col("nth")], {"first_slot": F.col("slots"), "first_word": size}, "mix-needs")
    numbered = numbered.withColumn("offsets", F.array(*[offsets_of(name, rounds) for name in names]))
    # All blocks hold block_words words but the last of the source, which may lie anywhere in a round.
    tails = [blocks * k + permuted(blocks - 1, F.greatest(blocks, F.lit(1)), name, F.col("offsets")[k], back=True) for k, name in enumerate(names)]
    numbered = numbered.withColumn("tails", F.when(blocks > 0, F.array(*tails)).otherwise(F.array().cast("array<bigint>")))
    sources = materialize(numbered, "mix-sources")

    # All words of all sources are one stream, so that no task gets a whole source or a whole id.
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.join(sources.select("nth", "source", "first_word"), same(sized["source"], sources["source"])).select("row", "doc_id", "size", "nth", "first_word", key.alias("key"))
    placed = running_sums(keyed, [F.col(c) for c in ("nth", "key", "doc_id", "size", "row")], {"all_before": F.col("size")}, "mix-placed")
    placed = placed.withColumn("from", F.col("all_before") - F.col("first_word")).where("size > 0")
    first, last = F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words)
    pieces = placed.select("row", "doc_id", "size", "nth", "from", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("from"), F.col("block") * block_words)
    end = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("row", "doc_id", "nth", "block", (start - F.col("from")).alias("doc_from"), (end - start).alias("words"), (start - F.col("block") * block_words).alias("block_from"))

    dealt = deal_slots(sources, shard_slots, seed).join(sources.select("nth", "source_size", "blocks", "words", "first_slot", "tails", "offsets"), "nth")
    turn = F.floor(F.col("ordinal") / F.col("blocks"))
    name = F.concat_ws("/", F.lit(seed), F.col("nth").cast("string"), turn.cast("string"))
    block = permuted(F.pmod("ordinal", "blocks"), F.col("blocks"), name, F.element_at("offsets", (turn + 1).cast("int")))
    short = F.col("blocks") * block_words - F.col("source_size")
    before = F.col("ordinal") * block_words - short * F.size(F.filter("tails", lambda t: t < F.col("ordinal")))
    most = F.greatest(F.lit(0), F.least(F.lit(block_words).cast("long"), F.col("words") - before))
    filled = dealt.select((F.col("first_slot") + F.col("ordinal")).alias("slot"), "shard", "place", "nth", block.alias("block"), most.alias("block_most"))
    return sources, pieces, materialize(filled.where("block_most > 0"), "mix-slots")  # as a table it has its true size, which decides how it is joined


def deal_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """``nth, ordinal, shard, place``: every slot of the ``sources`` (``nth, first_slot, slots``) once, each in
    the shard that drew it, in the order of a hash there. Only slots that draws left over are placed by number."""
    total, n_sources = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    # A draw is a number among all slots. Cells of equal width, as many as sources, find the source that it falls to.
    width = max(1, -(-total // max(n_sources, 1)))
    first, end = F.col("first_slot"), F.col("first_slot") + F.col("slots")
    cells = sources.where("slots > 0").select("nth", first.alias("low"), end.alias("high"), F.explode(F.sequence(F.floor(first / width), F.floor((end - 1) / width))).alias("cell"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}/draw"), F.col("id").cast("string"))), 1, 14), 16, 10).cast("long")
    drawn = sources.sparkSession.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(draw, F.lit(max(total, 1)).cast("long")).alias("draw"))
    met = drawn.withColumn("cell", F.floor(F.col("draw") / width)).join(cells, "cell").where("draw >= low and draw < high")
    counts = materialize(met.groupBy("shard", "nth").agg(F.count(F.lit(1)).alias("n")), "mix-counts")

    per = sources.select("nth", "slots").join(counts.groupBy("nth").agg(F.sum("n").alias("drawn")), "nth", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    over, lacking = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    per = materialize(running_sums(per, [F.col("nth")], {"drawn_before": F.col("drawn"), "over_before": over, "lacking_before": lacking}, "mix-drawn"), "mix-settling")
    indexed = running_sums(counts, [F.col("nth"), F.col("shard")], {"before": F.col("n")}, "mix-indexes").join(per, "nth")
    start = F.col("before") - F.col("drawn_before")
    listed = indexed.select("shard", "nth", "slots", "over_before", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("ordinal"))
    own = listed.where("ordinal < slots").select("shard", "nth", "ordinal")
    spare = listed.where("ordinal >= slots").select("shard", (F.col("over_before") + F.col("ordinal") - F.col("slots")).alias("number"))
    free = per.where("drawn < slots").select("nth", "drawn", "lacking_before", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("ordinal"))
    free = free.select("nth", "ordinal", (F.col("lacking_before") + F.col("ordinal") - F.col("drawn")).alias("number"))
    dealt = own.unionByName(spare.join(free, "number").select("shard", "nth", "ordinal"))
    mixed = F.md5(F.concat_ws("/", F.lit(f"{seed}/place"), F.col("nth").cast("string"), F.col("ordinal").cast("string")))
    within = F.row_number().over(Window.partitionBy("shard").orderBy(mixed, "nth", "ordinal")) - 1
    return dealt.select("nth", "ordinal", "shard", (F.col("shard") * shard_slots + within).alias("place"))


def mixed_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix, block by block: ``shard, place, block_from, row, doc_id, doc_from, words``."""
    joined = slots.join(pieces, ["nth", "block"])
    words = F.least(F.col("words"), F.col("block_most") - F.col("block_from"))
    return joined.withColumn("words", words).where("words > 0")


def _sized(docs: DataFrame, doc_id: Column) -> DataFrame:
    """Rows with numbers of their own, as a table, so that the numbers hold still."""
    size = n_words(F.col("text").cast("string"))
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``, and how the mix takes it:
    ``n_pieces``, ``first_shard`` and ``first_place`` (null where it takes nothing).

    A null text has size 0; a null source is a source of its own, the last; rows of size 0 are taken 0
    times; an empty table gives no rows. Rows that repeat a ``doc_id``, and those with none, are documents
    of their own; where they have one source and size, which of them gets which share may differ
    between runs. Texts of any length are cut into blocks. Other columns are ignored."""
    sized = _sized(docs, F.col("doc_id"))
    sources, pieces, slots = plan_mix(sized, **options)
    mixed = mixed_pieces(pieces, slots)
    first = F.min("place").alias("first_place")
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_pieces"), F.min("shard").alias("first_shard"), first)
    named = sized.join(sources.select(F.col("source").alias("source_"), "source_size", "target"), same(F.col("source"), F.col("source_")))
    out = named.join(taken, "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_pieces")]
    return out.select("doc_id", "size", "source_size", "target", *counts, "first_shard", "first_place")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``, shard by shard in the order of their places: each
    row holds the stretch that one slot takes of one document's text, from its first word to where the
    next word after it starts, so that the stretches of a whole document join to its exact text
    (white space before the first word goes with that word); ``n_chars``, if there, is its length. Texts
    without words are in no mix. Nulls, repeated rows and empty tables are as in ``mix_report``; other
    columns go along, whatever their names."""
    # Rows that repeat id and text share a key, and any one of them stands for all.
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").cast("string")))
    sized = _sized(docs, key)
    _, pieces, slots = plan_mix(sized, **options)
    cut = F.struct("shard", "place", "block_from", "doc_from", "words")
    cuts = materialize(mixed_pieces(pieces, slots).groupBy("doc_id", "row").agg(F.collect_list(cut).alias("cuts")).select(F.col("doc_id").alias("key"), "cuts"), "mix-cuts")
    twins = materialize(sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("key")), "mix-twins")
    keyed = wrapped(docs, key.alias("key"))
    if not twins.isEmpty():
        one = keyed.join(twins, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        keyed = keyed.join(twins, "key", "left_anti").unionByName(one.select("row", "key"))
    words = keyed.join(cuts, "key").withColumn("all", F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(SPACED_WORD), F.lit(0)))
    part = F.transform("cuts", lambda c: F.struct(c["shard"].alias("shard"), c["place"].alias("place"), c["block_from"].alias("at"), F.array_join(F.slice("all", (c["doc_from"] + 1).cast("int"), c["words"].cast("int")), "").alias("text")))
    mixed = words.select("row", F.explode(part).alias("part")).select("row", "part.*")
    mixed = mixed.repartition(tasks(docs), "shard").sortWithinPartitions("shard", "place", "at")
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return mixed.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
