"""A Merkle manifest of a dataset, by checkpoint and recompute.

Every document is a leaf, every source a tree of its leaves in the order of ids, and the sources' tops are the
leaves of one tree over all. A node is the digest of up to ``ARITY`` neighbours. Of a tree only every ``STRIDE``-th level is
kept as a table: an aligned subtree, the nodes of one kept level under one node of the next, is at most
``ARITY ** STRIDE`` rows. Whoever needs proofs goes down from the top: each subtree's missing levels are made again
from its kept nodes, the siblings on the way up are written beside each of these, and the levels are forgotten. All
of it is grouping by subtree and joining with the kept level above, so no task holds more than some subtrees.

Digests are lower-case hex SHA-256 and are concatenated as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import materialize, running_sums, same

ARITY, STRIDE = 16, 2
_STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as an unambiguous part of a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(node: Column, path: Column) -> Column:
    """The top that follows from a node and the siblings beside its way up."""
    return F.aggregate(path, node, lambda acc, step: digest(step["before"], acc, step["after"]))


def path_digest(path: Column) -> Column:
    """One digest of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def _parents(nodes: Column, arity: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda g: F.sha2(F.array_join(F.slice(nodes, g * arity + 1, arity), "").cast("binary"), 256))


def _subtrees(level: DataFrame, arity: int, stride: int) -> DataFrame:
    """Of trees that go on above this kept level: ``tree, part, n, members`` (in order) and the levels ``l0`` to
    ``l{stride}`` made again; a level above the tree's top repeats the top."""
    members = F.array_sort(F.collect_list(F.struct("at", "node", "more")))
    part = F.floor(F.col("at") / arity**stride).alias("part")
    out = level.where("n > 1").groupBy("tree", part).agg(F.max("n").alias("n"), members.alias("members")).withColumn("l0", F.col("members.node"))
    for k in range(stride):
        below = F.col(f"l{k}")
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > arity**k, _parents(below, arity)).otherwise(below))
    return out


def build(leaves: DataFrame, label: str, arity: int = ARITY, stride: int = STRIDE) -> list[DataFrame]:
    """The kept levels of all trees at once, from the leaves up: ``tree, n`` (nodes of the tree on this level),
    ``at`` (from 0), ``node``, ``more`` (with leaves only). A row with n = 1 is a tree's top; it is on one level only."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        above = _subtrees(levels[-1], arity, stride).select(
            "tree", F.ceil(F.col("n") / arity**stride).alias("n"), F.col("part").alias("at"), F.element_at(f"l{stride}", 1).alias("node"), F.lit(None).cast(leaves.schema["more"].dataType).alias("more")
        )
        levels.append(materialize(above, label))
        most = -(-most // arity**stride)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``tree, node``: each tree's top."""
    out = None
    for level in levels:
        found = level.where("n = 1").select("tree", "node")
        out = found if out is None else out.unionByName(found)
    return out


def proofs(levels: list[DataFrame], above: DataFrame, label: str, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """``node, more, path, known`` of all leaves: ``path`` is an array of ``before`` and ``after`` from the leaf up. ``above``
    has for each tree the ``path`` from its top on and what is ``known`` of it."""
    found = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        here = level.where("n = 1").join(above, "tree").select("tree", "at", "node", "more", "path", "known")
        if found is not None:
            trees = _subtrees(level, arity, stride).join(found.select("tree", F.col("at").alias("part"), "path", "known"), ["tree", "part"])

            def steps(i: Column, trees: DataFrame = trees) -> Column:
                out = []
                for k in range(stride):
                    at = F.floor(i / arity**k).cast("int")
                    place, nodes = F.pmod(at, F.lit(arity)), F.col(f"l{k}")
                    before, after = F.slice(nodes, at - place + 1, place), F.slice(nodes, at + 2, F.lit(arity - 1) - place)
                    step = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
                    out.append(F.when(F.col("n") > arity**k, F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>")))
                return F.concat(*out, F.col("path"))

            member = F.transform("members", lambda m, i: F.struct(m["at"].alias("at"), m["node"].alias("node"), m["more"].alias("more"), steps(i).alias("path")))
            each = trees.select("tree", "known", F.explode(member).alias("m")).select("tree", "m.at", "m.node", "m.more", "m.path", "known")
            here = here.unionByName(each)
        found = materialize(here, label) if depth else here
    return found.select("node", "more", "path", "known")


def manifest(rows: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """From ``doc_id, source, leaf, claimed``, one row per row: ``doc_id, leaf, claimed, subroot, root, path``.

    ``leaf`` is a digest (see ``leaf``) and ``claimed`` any other digest that the caller wants beside it, or null. Sources
    are ordered with null first, then by their UTF-8 bytes, and the empty source is no null one; leaves by ``doc_id``, null first, equal ids by leaf, and of
    rows that are equal in both each is a leaf. An only leaf is its source's top, and the only source's top the root. An empty
    table gives no rows. Long texts matter to the caller's leaf alone."""
    rows = materialize(rows.select("doc_id", "source", "leaf", "claimed", F.monotonically_increasing_id().alias("_row")), "merkle-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("_row").asc()]
    placed = running_sums(rows, order, {"place": F.lit(1)}, "merkle-order")
    # Places are counted through all rows; a source's first place stands for the source from here on.
    sources = materialize(placed.groupBy("source").agg(F.min("place").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    named = sources.select(F.col("source").alias("_source"), "tree", "n")
    more = F.struct("doc_id", "claimed")
    leaves = placed.join(named, same(F.col("source"), F.col("_source"))).select("tree", "n", (F.col("place") - F.col("tree")).alias("at"), F.col("leaf").alias("node"), more.alias("more"))
    levels = build(materialize(leaves, "merkle-level"), "merkle-level", arity, stride)
    subroots = materialize(tops(levels), "merkle-subroots")
    numbered = running_sums(subroots, [F.col("tree").asc()], {"at": F.lit(1)}, "merkle-subroot-order")
    count = subroots.count()
    whole = numbered.select(F.lit(0).cast("long").alias("tree"), F.lit(count).alias("n"), "at", "node", F.struct("tree").alias("more"))
    upper = build(materialize(whole, "merkle-upper"), "merkle-upper", arity, stride)
    root = tops(upper).select("tree", F.array().cast(f"array<{_STEP}>").alias("path"), F.array("node").alias("known"))
    over = proofs(upper, root, "merkle-upper-proofs", arity, stride).select(F.col("more.tree").alias("tree"), "path", F.concat(F.array("node"), F.col("known")).alias("known"))
    found = proofs(levels, materialize(over, "merkle-tops"), "merkle-proofs", arity, stride)
    return found.select("more.doc_id", F.col("node").alias("leaf"), "more.claimed", F.col("known")[0].alias("subroot"), F.col("known")[1].alias("root"), "path")
