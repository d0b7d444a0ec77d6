"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are collapsed first. Distinct ones meet in buckets: of six bands of a fingerprint,
two fingerprints that differ in at most four bits share at least two, so each of the 15 pairs of bands
is a table of buckets and no link is lost. Inside a task the fingerprints of all its buckets lie in
bucket order as 64 vertical bit planes; a shift of the planes by d lanes puts each fingerprint over
the d-th next one, and carry-save adders count differing bits of all lanes at once, plane by plane,
giving the lanes up as soon as all of them exceed the radius. A bucket's links are reported as a
spanning forest, so their number stays below the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import byte_strings, map_batches, materialize, maybe_among, same, text_or_empty, wrapped
from tubal.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
BANDS = 6
_SEED = 42
#: Buckets with more fingerprints than this are dealt out anew, at most so many times.
LARGE_BUCKET, DEALS = 4096, 3
LANES = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits as an unsigned integer; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle_words:
        hashes = digest(joined, _SEED)
    else:
        ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(n + 1 for n in ends[:-shingle_words])]
        hashes = b"".join([digest(joined[s:e], _SEED) for s, e in zip(starts, ends[shingle_words - 1 :], strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 15):
        set_bits += np.unpackbits(rows[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of every row, the 64 bits as a long; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(t, shingle_words) for t in byte_strings(batch.column(1))], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col)), run, f"doc_id {kind}, fp long")


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col))).alias("digest")


def _planes(rows: np.ndarray) -> np.ndarray:
    """Bit planes of rows of bytes, one for each bit, each padded by one word."""
    n, width = rows.shape
    out = np.zeros((8 * width, ((n + 63) // 64 + 1) * 8), np.uint8)
    bits = np.unpackbits(rows, axis=1)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _down(planes: np.ndarray, d: int) -> np.ndarray:
    """The planes moved d lanes towards lane 0, without their last word."""
    skip, by = divmod(d, 64)
    out = np.zeros((len(planes), planes.shape[1] - 1), np.uint64)
    rest = planes[:, skip:]
    n = rest.shape[1] - 1
    if n > 0:
        out[:, :n] = rest[:, :-1] if not by else (rest[:, :-1] >> np.uint64(by)) | (rest[:, 1:] << np.uint64(64 - by))
    return out


def _sum_planes(planes: np.ndarray) -> list[np.ndarray]:
    """How many of the planes are set in each lane, as planes of the number's bits, lowest first, by
    carry-save adders: three planes of one weight become a sum and a carry of twice that weight."""
    out = []
    while len(planes):
        carries = []
        while len(planes) > 1:
            k = len(planes) // 3
            if k:
                a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
                apart = a ^ b
                carries.append((a & b) | (apart & c))
                planes = np.concatenate([apart ^ c, planes[3 * k :]])
            else:
                carries.append(planes[:1] & planes[1:])
                planes = planes[:1] ^ planes[1:]
        out.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    return out


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers in bit planes."""
    zero, out = np.zeros_like(b[0]), []
    carry = zero
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else zero, b[i] if i < len(b) else zero
        apart = x ^ y
        out.append(apart ^ carry)
        carry = (x & y) | (apart & carry)
    return [*out, carry]


def _at_least(limit: int, counter: list[np.ndarray]) -> np.ndarray:
    """Lanes whose counter (bit planes, lowest first) is ``limit`` or more."""
    more, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for bit in reversed(range(max(len(counter), limit.bit_length()))):
        plane = counter[bit] if bit < len(counter) else np.zeros_like(more)
        if limit >> bit & 1:
            equal = equal & plane
        else:
            more, equal = more | (equal & plane), equal & ~plane
    return more | equal


def close_lanes(planes: np.ndarray, open_lanes: np.ndarray, d: int, radius: int = RADIUS) -> np.ndarray:
    """Bits of the lanes i among ``open_lanes`` whose value differs from that of lane i + d in at most
    ``radius`` bits. The lanes are given up as soon as all of them differ in more."""
    counter: list[np.ndarray] = []
    step = max(8, len(planes) // 8)
    for b in range(0, len(planes), step):
        counter = _add(counter, _sum_planes(planes[b : b + step, :-1] ^ _down(planes[b : b + step], d)))
        open_lanes = open_lanes & ~_at_least(radius + 1, counter)
        if not open_lanes.any():
            break
    return open_lanes


class Forest:
    """Union-find over lanes, for arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs with one key that differ in at most ``radius`` bits, as
    row numbers. Rows of a key are neighbours; ``values`` are rows of bytes."""
    n = len(values)
    forest = Forest(n)
    lanes = np.arange(n)
    run_start = np.r_[True, keys[1:] != keys[:-1]] if n else np.empty(0, bool)
    run = np.cumsum(run_start) - 1
    after = np.r_[np.flatnonzero(run_start)[1:], n][run] if n else lanes  # just past the lane's run
    d = 1
    while n:
        keep = lanes[after[lanes] - lanes > 0]
        size = np.bincount(run[keep], minlength=run[-1] + 1)
        keep = keep[size[run[keep]] > d]
        if not len(keep):
            break
        for part in _whole_runs(run[keep], LANES):
            own = keep[part]
            planes, own_after = _planes(values[own]), after[own]
            # Lanes of a part are whole runs, so that lane i + d of the part is the d-th next of its run.
            for step in range(d, min(2 * d, int(size[run[own]].max()))):
                pairs = np.zeros(len(own), bool)
                if step < len(own):
                    pairs[: len(own) - step] = own_after[: len(own) - step] > own[step:]
                if not pairs.any():
                    break
                packed = np.zeros((planes.shape[1] - 1) * 8, np.uint8)
                bits = np.packbits(pairs, bitorder="little")
                packed[: len(bits)] = bits
                hit = close_lanes(planes, packed.view(np.uint64), step, radius)
                at = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(own)])
                if len(at):
                    forest.unite(own[at], own[at + step])
        lanes, d = keep, 2 * d
    linked = np.flatnonzero(forest.root != np.arange(n))
    return linked, forest.root[linked]


def _whole_runs(run: np.ndarray, most: int) -> Iterator[slice]:
    """Slices that end where a run does and hold about ``most`` rows at most, or one run."""
    start, n = 0, len(run)
    while start < n:
        end = min(start + most, n)
        if end < n:
            back = int(np.searchsorted(run, run[end], "left"))
            end = back if back > start else int(np.searchsorted(run, run[end], "right"))
        yield slice(start, end)
        start = end


def _band_bounds(low: int, high: int, bands: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * i // bands for i in range(bands + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _compare(buckets: DataFrame, radius: int, partitions: int) -> DataFrame:
    """``buckets`` has ``key`` and ``fp``. Whole buckets meet in a partition, sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held, enough = [], [], 0, 4 * LANES

        def flush(last: bool):
            nonlocal keys, values, held, enough
            k, v = np.concatenate(keys), np.concatenate(values)
            cut = len(k) if last else int(np.searchsorted(k != k[-1], False))  # the last bucket may go on
            if cut:
                a, b = bucket_links(k[:cut], v[:cut].view(np.uint8).reshape(cut, 8), radius)
                if len(a):
                    yield pa.record_batch([pa.array(v[a]), pa.array(v[b])], ["a", "b"])
            keys, values, held = [k[cut:]], [v[cut:]], len(k) - cut
            enough = max(4 * LANES, 2 * held)

        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            values.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= enough:
                yield from flush(False)
        if held:
            yield from flush(True)

    return buckets.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_pairs(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, large: int = LARGE_BUCKET, deals: int = DEALS) -> DataFrame:
    """Links ``a, b`` among the distinct fingerprints ``fp``: pairs within ``radius`` bits, enough of
    them to join all that such pairs join. Two fingerprints within the radius agree in at least
    ``bands - radius`` bands. A bucket of over ``large`` fingerprints is dealt out anew by radius + 1
    classes of all bits, in one of which they differ nowhere, and what is large still again by other
    classes, ``deals`` times. So no link is lost, and what a task gets whole agrees in the bands and in
    a class of every deal."""
    agree = bands - radius
    if agree < 1:
        raise ValueError("more bands than the radius are needed")
    partitions = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def masked(mask: int) -> Column:
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    bounds = _band_bounds(0, 64, bands)
    tables = [sum(((1 << hi - lo) - 1) << lo for lo, hi in chosen) for chosen in combinations(bounds, agree)]
    rows = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), masked(m)) for t, m in enumerate(tables)])).alias("key"))
    usual = []
    for deal in range(1, deals + 1):
        hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("key"), "simhash-large")
        if hot.isEmpty():
            break
        usual.append(rows.join(hot, "key", "left_anti").select("key", "fp"))
        of_bit = (lambda i: i % (radius + 1), lambda i: i // (radius + 1) % (radius + 1), lambda i: i * (radius + 1) // 64)[(deal - 1) % 3]
        classes = [sum(1 << i for i in range(64) if of_bit(i) == j) for j in range(radius + 1)]
        again = F.array(*[F.xxhash64("key", F.lit(deal), F.lit(j), masked(m)) for j, m in enumerate(classes)])
        rows = materialize(rows.join(hot, "key", "left_semi").select("fp", F.explode(again).alias("key")), "simhash-dealt")
    return _compare(reduce(DataFrame.unionByName, usual, rows.select("key", "fp")), radius, partitions)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id, kept``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable by links, its own included, and that row is ``kept``. Texts without words
    (null and empty too) have the fingerprint zero, which is linked like any other. Rows with a null id
    take part; where a component has no other ids its ``component_id`` is null. Rows that repeat an id
    are compared each, and all of them that bear the smallest id are ``kept``. An empty table gives no
    rows; other columns are ignored."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    links = connected_components(near_pairs(distinct.select("fp"), radius))
    labelled = distinct.join(links, distinct["fp"] == links["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    labelled = materialize(labelled, "simhash-labelled")
    lowest = materialize(labelled.groupBy("component").agg(F.min("low").alias("low")), "simhash-lowest")
    found = materialize(labelled.drop("low").join(lowest, "component").select("fp", "low"), "simhash-components")
    return prints.join(found, "fp").select("doc_id", "fp", F.col("low").alias("component_id"), same(F.col("doc_id"), F.col("low")).alias("kept"))


def keep_first(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that their component keeps. ``labelled`` has ``doc_id``, ``digest`` and, as
    ``low``, the least id and digest of the component. Of rows with one id and text any one."""
    first = same(F.col("doc_id"), F.col("low.doc_id")) & (F.col("digest") == F.col("low.digest"))
    marked = materialize(labelled.select("doc_id", "digest", first.alias("first")), "near-marked")
    of_row = same(F.col(f"row.`{id_col}`"), F.col("_id")) & (F.col("digest") == F.col("_other"))

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_other"))

    # Most rows are told from the dropped ones by a filter, so that their texts are not shuffled for the join.
    dropped = keys(marked.where("not first"))
    rows = maybe_among(wrapped(docs, _digest(text_col)), [F.col(f"row.`{id_col}`"), F.col("digest")], dropped, [F.col("_id"), F.col("_other")])
    left = rows.where("_maybe").drop("_maybe").join(dropped, of_row, "left_anti")
    kept = rows.where("not _maybe").drop("_maybe").unionByName(left)
    twins = marked.where("first").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = materialize(keys(twins), "near-twins")
    if twins.isEmpty():
        return kept.select("row.*")
    single = kept.join(twins, of_row, "left_semi").groupBy(F.col(f"row.`{id_col}`"), "digest").agg(F.first("row").alias("row"))
    return kept.join(twins, of_row, "left_anti").select("row").unionByName(single.select("row")).select("row.*")
