"""SimHash near copies at five words and similarity 0.8 or more.

64 bits cannot tell texts of similarity 0.8 from others, so the fingerprint has 1024 bits here, by
majority of the hashes of a text's distinct shingles. Two texts of Jaccard similarity 0.8 differ in
about 155 of them (standard deviation 11.5), of 0.7 in 197 (12.6); the radius of 177 lies between: 97 %
of pairs at 0.8 are linked and 6 % of those at 0.7, as a binomial draw. Texts meet in buckets by
least hashes of their shingles, five for each of 12 tables, of which a pair at 0.8 shares one with a chance of
99 %. In a bucket fingerprints are compared bit-sliced, as ``simhash`` does. Equal sets of shingles are one
throughout. A bucket of many is dealt out anew by three more least hashes, in eight tables. What is large even then is
compared with one of its rows, the pivot: rows within the radius of it are one component, and only rows
farther away are compared with all of the bucket, block by block.

The fingerprints only find components. In each of them the texts are then compared by all hashes of their
shingles, and only pairs of Jaccard similarity 0.8 or more link (``verified_links``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import byte_strings, map_batches, materialize, maybe_among, runs_of, same, text_or_empty
from tubal.llm.components import connected_components
from tubal.llm.simhash import _digest, bucket_links, keep_first
from tubal.llm.substring_dedup import window_hashes
from tubal.llm.wordhash import Words, mix

SHINGLE_WORDS = 5
BYTES, RADIUS = 128, 177
TABLES, LEAST = 12, 5
#: Buckets with more fingerprints than this are dealt out anew.
LARGE_BUCKET = 4096
#: A task compares the buckets that it holds when they have so many rows.
HELD = 8192
AGAIN_TABLES, AGAIN_LEAST = 8, 3
#: The similarity, in percent, from which on two texts are linked.
PERCENT = 80
#: Bytes of shingle hashes that one task compares at a time, and about how many texts of a larger component take part in all its parts.
GROUP_BYTES, PIVOTS = 8 << 20, 16
_CHUNK = 1 << 21
_MINIMA = TABLES * LEAST + AGAIN_TABLES * AGAIN_LEAST
_PARAMETERS = np.random.default_rng(510).integers(0, 1 << 32, (2, _MINIMA), np.uint32, endpoint=False)
_WORD_KEYS = np.random.default_rng(511).integers(0, 1 << 64, BYTES // 8, np.uint64, endpoint=False)


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half the hashes, each widened to ``BYTES``."""
    set_bits = np.zeros(8 * BYTES, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        wide = mix(hashes[i : i + (1 << 13), None] ^ _WORD_KEYS)
        set_bits += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(set_bits * 2 > len(hashes)).tobytes()


def shingle_sets(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, as ``text number, hash``; none without words. A
    text of fewer words is one shingle."""
    texts = [t.lower() for t in texts]
    words = Words(texts)
    whole = np.flatnonzero(np.arange(len(words.start)) + shingle_words <= words.last)
    shingles = window_hashes(words.hashes(), shingle_words)[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle_words))
    extra = np.array([xxhash.xxh64_intdigest(b" ".join(texts[i].split())) for i in short], np.uint64)
    doc, values = np.concatenate([words.doc[whole], short]), np.concatenate([shingles, extra])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])] if len(doc) else np.empty(0, bool)
    return doc[new], values[new]


def sketches(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> tuple[list[bytes], list[int]]:
    """For each text its fingerprint, one byte for each of its least hashes and a digest of its shingle set
    (no words: no bytes); and the size of that set."""
    doc, values = shingle_sets(texts, shingle_words)
    out, sizes = [b""] * len(texts), [0] * len(texts)
    if not len(doc):
        return out, sizes
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    small, least = (values >> np.uint64(32)).astype(np.uint32), np.empty((len(first), _MINIMA), np.uint8)
    for k in range(_MINIMA):
        found = np.minimum.reduceat((small ^ _PARAMETERS[0, k]) * (_PARAMETERS[1, k] | np.uint32(1)), first)
        least[:, k] = (found * np.uint32(0x9E3779B1)) >> np.uint32(24)
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(doc)], strict=True)):
        out[doc[a]] = majority(values[a:b]) + least[k].tobytes() + xxhash.xxh3_128_digest(values[a:b].tobytes())
        sizes[doc[a]] = int(b - a)
    return out, sizes


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, sketch, n_shingles`` of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = byte_strings(batch.column(2))
        found = [sketches(texts[a:b]) for a, b in runs_of([len(t) for t in texts], _CHUNK)]
        columns = [pa.array([s for made, _ in found for s in made], pa.binary()), pa.array([n for _, sizes in found for n in sizes], pa.int64())]
        yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "digest", "sketch", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("doc_id"), _digest(text_col), text_or_empty(text_col))
    return map_batches(columns, run, f"doc_id {kind}, digest binary, sketch binary, n_shingles long")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _compare(buckets: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` of ``key, node, print``. A task holds whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, rows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BYTES), np.uint8)

        def judge(n: int) -> Iterator[pa.RecordBatch]:
            a, b = bucket_links(keys[:n], rows[:n], radius)
            if len(a):
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        for batch in batches:
            keys, nodes = np.r_[keys, batch.column(0).to_numpy()], np.r_[nodes, batch.column(1).to_numpy()]
            rows = np.r_[rows, _rows(batch.column(2))]
            if len(keys) >= HELD:
                whole = int(np.searchsorted(keys != keys[-1], False))  # the last bucket may go on
                yield from judge(whole)
                keys, nodes, rows = keys[whole:], nodes[whole:], rows[whole:]
        yield from judge(len(keys))

    n = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return buckets.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _around_pivots(rows: DataFrame, large: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """For buckets ``key, node, print, n`` (their number of rows) the links of rows to their bucket's pivot, its
    least node; and smaller buckets in which each row that is farther from the pivot meets all rows. Two
    rows near the pivot need not meet, as both are linked to it. A bucket with f rows far from the pivot is cut
    into about 4 f n / large^2 buckets of ``large`` rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        apart = np.bitwise_count(_rows(batch.column(3)) ^ _rows(batch.column(5))).sum(axis=1, dtype=np.int64)
        yield pa.record_batch([*batch.columns[:5], pa.array(apart > radius)], ["key", "node", "n", "print", "pivot", "far"])

    pivots = materialize(rows.groupBy("key").agg(F.min(F.struct("node", "print")).alias("low")), "near-pivots")
    joined = rows.join(pivots, "key").select("key", "node", "n", "print", F.col("low.node").alias("pivot"), F.col("low.print").alias("center"))
    placed = materialize(map_batches(joined, run, "key long, node long, n long, print binary, pivot long, far boolean"), "near-placed")
    far = materialize(placed.where("far").groupBy("key").agg(F.count(F.lit(1)).alias("n_far")), "near-far")
    both = placed.join(far, "key")

    def parts(n: str):
        return F.ceil(F.col(n) / max(1, large // 2))

    def own(n: str):
        return F.pmod(F.xxhash64("node"), parts(n))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))

    left = both.where("far").select("key", "node", "print", own("n_far").alias("i"), every("n").alias("j"))
    right = both.select("key", "node", "print", own("n").alias("j"), every("n_far").alias("i"))
    blocks = left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("key"), "node", "print")
    return placed.where("not far and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), blocks


def _keys(first: int, tables: int, size: int, *more):
    return F.array(*[F.xxhash64(*more, F.lit(t), F.substring("sketch", BYTES + first + 1 + t * size, size)) for t in range(tables)])


def similar_pairs(distinct: DataFrame, large: int = LARGE_BUCKET, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` among the distinct sketches ``node, sketch``."""
    usable = distinct.where(F.length("sketch") > 0)
    buckets = usable.select("node", F.explode(_keys(0, TABLES, LEAST)).alias("key"))
    shared = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    rows = materialize(buckets.join(shared, "key").select("key", "node", "n"), "near-rows").join(usable, "node")
    bits = F.substring("sketch", 1, BYTES).alias("print")
    usual = rows.where(F.col("n") <= large).select("key", "node", bits)
    again = _keys(TABLES * LEAST, AGAIN_TABLES, AGAIN_LEAST, "key")
    dealt = materialize(rows.where(F.col("n") > large).select(F.explode(again).alias("key"), "node"), "near-dealt")
    still = materialize(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large), "near-large")
    prints = usable.select("node", bits)
    buckets = usual.unionByName(dealt.join(still, "key", "left_anti").join(prints, "node").select("key", "node", "print"))
    if still.isEmpty():
        return _compare(buckets, radius)
    links, blocks = _around_pivots(dealt.join(still, "key").join(prints, "node").select("key", "node", "print", "n"), large, radius)
    return _compare(buckets.unionByName(blocks), radius).unionByName(links)


def similar_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each of the sets (sorted, none empty) the number of the first set of its component; sets are
    linked when their Jaccard similarity is ``percent`` or more. Each set, when reached, is compared with
    those not reached yet."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.r_[0, np.cumsum(sizes)]
    held, root = np.zeros(int(codes.max()) + 1, bool), np.arange(n)
    left, left_codes = np.arange(n), codes

    def leave(out: np.ndarray) -> None:
        nonlocal left, left_codes
        left_codes, left = left_codes[~np.repeat(out, sizes[left])], left[~out]

    while len(left):
        first = left[0]
        queue = [first]
        leave(left == first)
        while queue and len(left):
            reached = queue.pop()
            own = codes[bounds[reached] : bounds[reached + 1]]
            held[own] = True
            common = np.add.reduceat(held[left_codes], np.r_[0, np.cumsum(sizes[left])[:-1]], dtype=np.int64)
            held[own] = False
            close = 100 * common >= percent * (sizes[left] + sizes[reached] - common)
            if close.any():
                root[left[close]] = first
                queue.extend(left[close])
                leave(close)
    return root


def _judge(grouped: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between the ``node`` of one ``key`` whose ``text`` are similar by all their shingles.
    A task holds whole groups, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def judge() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                ids, root = np.array(nodes), similar_sets(sets, percent)
                linked = np.flatnonzero(ids != ids[root])
                yield pa.record_batch([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

        for batch in batches:
            keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_strings(batch.column(2))
            for a, b in runs_of([len(t) for t in texts], _CHUNK):
                doc, values = shingle_sets(texts[a:b])
                for i, own in enumerate(np.split(values, np.searchsorted(doc, np.arange(1, b - a))), a):
                    if keys[i] != key:
                        yield from judge()
                        key, nodes, sets = keys[i], [], []
                    nodes.append(ids[i])
                    sets.append(own)
        yield from judge()

    n = max(1, int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return grouped.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def verified_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, large: int = LARGE_BUCKET, group_bytes: int = GROUP_BYTES, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` that join exactly those ``node`` of each ``component`` of ``members`` (with ``low``, the
    id and digest of a row that has the text, and ``n_shingles``) that pairs of Jaccard similarity ``percent`` or more
    join. A component of up to ``large`` texts and ``group_bytes`` of hashes is compared in one task. A larger one
    is cut into parts of that size, and some of its texts, about ``PIVOTS``, take part in each. What these parts
    join most of is its core: two texts of the core are joined already, and every other text is compared
    with all of the component, part by part."""

    def parts(n: str, size: str) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / large), F.ceil(F.col(size) * 8 / group_bytes))

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(count))

    def every(count: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    def judged(rows: DataFrame) -> DataFrame:
        found = texts.join(rows, same(F.col("_id"), F.col("low.doc_id")) & (texts["digest"] == F.col("low.digest")))
        return _judge(found.select("key", "node", "text"), percent)

    def total(rows: DataFrame, n: str, size: str) -> DataFrame:
        return rows.groupBy("component").agg(F.count(F.lit(1)).alias(n), F.sum("n_shingles").alias(size))

    sizes = total(members, "n", "size").withColumn("parts", parts("n", "size"))
    placed = materialize(members.join(sizes, "component"), "near-members")
    # Only texts that may be members are shuffled.
    texts = docs.select(F.col(id_col).alias("_id"), _digest(text_col), text_or_empty(text_col).alias("text"))
    texts = maybe_among(texts, [F.col("_id"), F.col("digest")], placed, [F.col("low.doc_id"), F.col("low.digest")]).where("_maybe").drop("_maybe")
    small = judged(placed.where("parts = 1").select("low", "node", F.col("component").alias("key")))
    cut = placed.where("parts > 1")
    if cut.isEmpty():
        return small
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS
    spread = cut.withColumn("part", F.explode(F.when(pivot, every("parts")).otherwise(F.array(own("parts")))))
    inside = materialize(judged(spread.select("low", "node", F.xxhash64("component", "part").alias("key"))), "near-inside")
    joined = cut.join(connected_components(inside).withColumnRenamed("component", "inner"), "node", "left")
    joined = materialize(joined.withColumn("inner", F.coalesce("inner", "node")), "near-inner")
    counts = joined.groupBy("component", "inner").agg(F.count(F.lit(1)).alias("k"))
    core = materialize(counts.groupBy("component").agg(F.max_by("inner", F.struct("k", "inner")).alias("core")), "near-core")
    rest = joined.join(core, "component").where("inner <> core").select("component", "low", "node", "n_shingles", "parts")
    rest_sizes = materialize(total(rest, "n_rest", "size_rest").withColumn("rest_parts", parts("n_rest", "size_rest")), "near-rest")
    left = rest.join(rest_sizes, "component").withColumn("i", own("rest_parts")).withColumn("j", F.explode(every("parts")))
    right = joined.join(rest_sizes, "component").withColumn("j", own("parts")).withColumn("i", F.explode(every("rest_parts")))
    key = F.xxhash64("component", "i", "j", F.lit(2)).alias("key")
    blocks = left.select("low", "node", key).unionByName(right.select("low", "node", key))
    return small.unionByName(inside).unionByName(judged(blocks))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE_BUCKET, radius: int = RADIUS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with one row of each component of similar texts, linked by pairs of Jaccard similarity 0.8
    or more, exactly: the one with the smallest id, null ids last; among rows with that id the one whose text's digest is least, and any one of identical ones.
    So rows with null or repeated ids are told apart by their texts. Texts without words, null and
    empty ones too, are one component. Texts of any length are taken whole, those over 2 MB by
    themselves. An empty table gives no rows; other columns go along, whatever their names."""
    prints = materialize(sketched(docs, id_col, text_col), "near-sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    distinct = prints.groupBy("sketch").agg(F.min(order).alias("low"), F.max("n_shingles").alias("n_shingles"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "near-distinct")
    alike = connected_components(similar_pairs(distinct.select("node", "sketch"), large, radius))
    members = distinct.join(alike, "node").select("component", "low", "node", "n_shingles")
    stars = materialize(connected_components(verified_links(members, docs, id_col, text_col, large, group_bytes)), "near-stars")
    labelled = distinct.join(stars, "node", "left").select("sketch", "low", F.coalesce("component", "node").alias("component"))
    lowest = materialize(distinct.join(stars, "node").groupBy("component").agg(F.min("low").alias("least")), "near-lowest")
    found = labelled.join(lowest, "component", "left").select("sketch", F.coalesce("least", "low").alias("low"))
    return keep_first(docs, prints.join(materialize(found, "near-components"), "sketch"), id_col, text_col)
