"""Near-duplicates among embeddings, by sorted projection passes.

Each pass sorts the vectors lexicographically by 62 concatenated random hyperplane hashes and compares
every vector with its neighbours in that order. What is sorted are ids and codes of a byte a
component, with a bound of what the code leaves out: pairs whose cosine is certainly at the threshold
or above are united at once, those that may be are looked up and computed in double precision, no
others are touched. Pairs found are united across passes into components.

How far the windows reach is measured, not supposed: in each pass, all vectors that agree with a vector
in more hashes than the last one in its window does are in its window. That gives, for each vector, the
chance that a pair at the threshold was missed in all passes. Vectors for which it is too large (dense
clusters, whose windows hold few of their like) go on to further passes with wider windows, among
themselves, until none is left or all that are left are compared with each other.

Inside a component all pairs of vectors are then compared once, block against block, for the number of
their links. Identical vectors are one throughout, with the number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import materialize, runs_of, same, temporary_tables
from tubal.llm.components import connected_components
from tubal.llm.simhash import Forest

THRESHOLD = 0.9
WINDOW = 256
#: Chance that a pair just at the threshold is in no window of any pass: aimed at, and at most.
MISS, MOST_MISS = 0.02, 0.05
#: Vectors of a block in the comparison of all pairs of a component, at most; components of some hundreds are
#: cut into up to ``SPREAD`` blocks all the same, so that one of them is the work of many tasks.
BLOCK, SPREAD, _LEAST_BLOCK = 8192, 16, 256
MOST_PASSES = 24
_HASHES = 62
_TILE = 512
#: Vectors of small components that are compared in one product.
_TOGETHER = 256


def agreement(threshold: float) -> float:
    """Chance that a random hyperplane leaves two vectors at the threshold on one side."""
    return 1 - math.acos(threshold) / math.pi


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes needed for ``n`` vectors whose directions are spread evenly: two vectors at the threshold
    stay within a window where they agree in the first log2(n / window) hashes."""
    hit = agreement(threshold) ** max(1.0, math.log2(max(2.0, n / window)))
    return min(MOST_PASSES, max(3, math.ceil(math.log(miss) / math.log1p(-hit))))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * size
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])
    return pa.array([r.tobytes() for r in rows], pa.binary())


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec, data`` (float64 little-endian, unit length) of the vectors that can link at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
            first = np.cumsum(sizes) - sizes
            for width in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == width)
                x = values[first[at][:, None] + np.arange(width)]
                top = np.abs(x).max(axis=1)
                fine = np.isfinite(x).all(axis=1) & (top > 0)
                x, at = x[fine] / top[fine, None], at[fine]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), _binary(x)], ["vec", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(run, f"vec {kind}, data binary")


def _matrices(data: pa.Array, kind=np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each length of row."""
    raw = data.to_pylist()
    sizes = np.array([len(x) for x in raw])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)


def coded(m: np.ndarray) -> np.ndarray:
    """Rows of bytes: the scale and the length of what is left out (float32 each), then a signed byte a
    component."""
    scale = (np.abs(m).max(axis=1) / 127).astype(np.float32)
    code = np.rint(m / np.maximum(scale, 1e-30)[:, None]).clip(-127, 127).astype(np.int8)
    left = np.linalg.norm(m - code * scale[:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-6
    return np.hstack([scale[:, None].view(np.uint8), left.astype(np.float32)[:, None].view(np.uint8), code.view(np.uint8)])


def _shared_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes two orders share from the first on."""
    return _HASHES - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64)


class Sweep:
    """Compares rows of one pass, which come in order, with those up to ``window`` places before."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold = window, threshold

    def links(self, raw: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows from ``new`` on with any before them: a spanning forest of certain pairs, and the
        other pairs that may be links and that the forest does not join already."""
        scale, left = raw[:, :4].copy().view(np.float32)[:, 0], raw[:, 4:8].copy().view(np.float32)[:, 0].astype(np.float64)
        m = raw[:, 8:].view(np.int8) * scale[:, None]
        forest, maybe = Forest(len(m)), []
        for a in range(new, len(m), _TILE):
            b, low = min(a + _TILE, len(m)), max(0, a - self.window)
            near = m[a:b] @ m[low:b].T
            i, j = np.nonzero(near >= self.threshold - 3 * float(left.max()) - 2e-5)
            gap = (i + a) - (j + low)
            inside = (gap > 0) & (gap <= self.window)
            i, j = i[inside], j[inside]
            cosine, i, j = near[i, j].astype(np.float64), i + a, j + low
            # |x y - x' y'| <= |x - x'| |y| + |x'| |y - y'|, and the sum itself is in single precision.
            slack = left[i] + left[j] * (1 + left[i]) + 1e-5
            sure = cosine - slack >= self.threshold
            forest.unite(i[sure], j[sure])
            may = ~sure & (cosine + slack >= self.threshold)
            maybe.append((i[may], j[may]))
        i, j = (np.concatenate(x) for x in zip(*maybe, strict=True)) if maybe else (np.empty(0, np.int64),) * 2
        apart = forest.root[i] != forest.root[j]
        linked = np.flatnonzero(forest.root != np.arange(len(m)))
        return linked, forest.root[linked], i[apart], j[apart]


def swept(vectors: DataFrame, first_pass: int, passes: int, threshold: float, window: int, seed: int) -> DataFrame:
    """``a, b, sure, miss``: pairs of ``node`` that link (``sure``) or may, and with ``b`` null for each node
    and pass the logarithm of the chance that a pair of it at the threshold is not in its window."""
    agree = agreement(threshold)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, m in _matrices(batch.column(1)):
                node, code = batch.column(0).take(pa.array(at)), _binary(coded(m))
                for k in range(first_pass, first_pass + passes):
                    planes = np.random.default_rng([seed, k, m.shape[1]]).standard_normal((m.shape[1], _HASHES))
                    order = ((m @ planes) > 0) @ (1 << np.arange(_HASHES - 1, -1, -1, dtype=np.int64))
                    number = np.full(len(at), m.shape[1] * MOST_PASSES * 64 + k, np.int64)
                    yield pa.record_batch([pa.array(number), pa.array(order), pa.array((np.asarray(node) * -7046029254386353131 + np.int64(k * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF)) >> 16), node, code], ["pass", "sig", "tie", "node", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(window, threshold)
        number = None
        sig, node, raw, judged, opened = np.empty(0, np.int64), np.empty(0, np.int64), None, 0, False

        def rows_of(a, b, sure, miss) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
            return pa.record_batch([pa.array(a, pa.int64()), b, pa.array(sure, pa.bool_()), pa.array(miss, pa.float64())], ["a", "b", "sure", "miss"])

        def misses(upto: int, closed: bool) -> pa.RecordBatch:
            """For the rows from ``judged`` to ``upto``. Where the pass is cut off by the task's range, as far as
            the range reaches."""
            at = np.arange(judged, upto)
            low, high = np.maximum(at - window, 0), np.minimum(at + window, len(sig) - 1)
            before = np.where((at < window) & opened & (start == 0), -1, _shared_hashes(sig[at], sig[low]))
            after = np.where((at + window >= len(sig)) & closed, -1, _shared_hashes(sig[at], sig[high]))
            hit = np.minimum(agree ** (np.maximum(before, after) + 1.0), 1 - 1e-12)
            return rows_of(node[at], None, np.zeros(len(at), bool), np.log1p(-hit))

        start = 0  # rows of the pass that were let go
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), batch.num_rows]
            for c, d in zip(cuts, cuts[1:], strict=False):
                if c == d:
                    continue
                if numbers[c] != number:
                    if number is not None and len(sig):
                        yield misses(len(sig), True)
                    opened = number is not None
                    number, start, judged = numbers[c], 0, 0
                    sig, node, raw = sig[:0], node[:0], None
                part = batch.slice(c, d - c)
                code = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(d - c, -1)
                new = len(sig)
                sig, node = np.r_[sig, part.column(1).to_numpy()], np.r_[node, part.column(3).to_numpy()]
                raw = code if raw is None else np.r_[raw, code]
                a, b, i, j = sweep.links(raw, new)
                yield rows_of(np.r_[node[a], node[i]], np.r_[node[b], node[j]], np.arange(len(a) + len(i)) < len(a), np.zeros(len(a) + len(i)))
                ready = max(judged, len(sig) - window)
                if ready > judged:
                    yield misses(ready, False)
                judged = ready
                drop = max(0, judged - window)
                sig, node, raw, judged, start = sig[drop:], node[drop:], raw[drop:], judged - drop, start + drop
        if number is not None and len(sig):
            yield misses(len(sig), False)

    signed = vectors.mapInArrow(keys, "pass long, sig long, tie long, node long, code binary")
    n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = signed.repartitionByRange(n, "pass", "sig", "tie").sortWithinPartitions("pass", "sig", "tie")
    return ordered.mapInArrow(run, "a long, b long, sure boolean, miss double")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose cosine in double precision is at the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            hit = [len(x) == len(y) and float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left = vectors.select(F.col("node").alias("a"), F.col("data").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("data").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_pairs(members: DataFrame, threshold: float, block: int, forest: bool = False) -> DataFrame:
    """``node, links, other``: for members of one group (``component, node, data, copies, size``) how many
    other members link with them, copies counted; with ``forest`` (``links`` null) the pairs ``node, other``
    of a spanning forest of the links of each comparison. Small groups are compared at once, many together;
    larger ones block by block."""
    spread = F.least(F.lit(SPREAD).cast("long"), F.floor(F.col("size") / _LEAST_BLOCK))
    blocks = F.greatest(F.ceil(F.col("size") / block), spread).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = members.withColumn("own", own).select("component", "node", "data", "copies", "own", F.explode(pairs).alias("p")).select("component", "p.i", "p.j", "own", "node", "data", "copies")

    def judge(group: np.ndarray, own: np.ndarray, node: np.ndarray, copies: np.ndarray, data: pa.Array, i: int, j: int) -> Iterator[pa.RecordBatch]:
        links, trees = np.zeros(len(node), np.int64), Forest(len(node))
        for at, m in _matrices(data):
            left, right = at[own[at] == i], at[own[at] == j]
            x, y = m[own[at] == i], m[own[at] == j]
            y32 = y.astype(np.float32)
            for a in range(0, len(x), 1024):
                near = x[a : a + 1024].astype(np.float32) @ y32.T
                p, q = np.nonzero(near >= np.float32(threshold - 1e-5))  # single precision decides all but those next to the threshold
                close = np.flatnonzero(near[p, q] <= threshold + 1e-5)
                hit = np.ones(len(p), bool)
                hit[close] = np.einsum("ij,ij->i", x[a + p[close]], y[q[close]]) >= threshold
                p, q = left[p[hit] + a], right[q[hit]]
                apart = (p != q) & (group[p] == group[q])
                p, q = p[apart], q[apart]
                links += np.bincount(p, copies[q], len(node)).astype(np.int64)
                if i != j:
                    links += np.bincount(q, copies[p], len(node)).astype(np.int64)
                if forest:
                    trees.unite(p, q)
        if forest:
            linked = np.flatnonzero(trees.root != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[linked]), pa.nulls(len(linked), pa.int64()), pa.array(node[trees.root[linked]])], ["node", "links", "other"])
        else:
            yield pa.record_batch([pa.array(node), pa.array(links), pa.nulls(len(node), pa.int64())], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = t.combine_chunks()
            keys = [t.column(k).to_numpy() for k in range(3)]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)] if t.num_rows else np.empty(0, bool)
            cuts = [*np.flatnonzero(new), t.num_rows]
            own, node, copies = (t.column(c).to_numpy() for c in ("own", "node", "copies"))
            data = t.column("data").combine_chunks()
            data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
            whole = cuts if last else cuts[:-1]
            starts = [0, *(k for k in range(1, len(whole) - 1) if keys[2][whole[k]] or keys[2][whole[k - 1]])]
            for k, upto in zip(starts, [*starts[1:], len(whole) - 1], strict=True):
                for c, d in runs_of(np.diff(whole[k : upto + 1]).tolist(), _TOGETHER):
                    a, b = whole[k + c], whole[k + d]
                    yield from judge(keys[0][a:b], own[a:b], node[a:b], copies[a:b], data.slice(a, b - a), int(keys[1][a]), int(keys[2][a]))
            held = None if last or not len(cuts) > 1 else t.slice(cuts[-2])

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= 2 * block:
                yield from groups(pa.Table.from_batches(waiting) if held is None else pa.concat_tables([held, pa.Table.from_batches(waiting)]), False)
                waiting, size = [], 0
        rest = ([held] if held is not None else []) + ([pa.Table.from_batches(waiting)] if waiting else [])
        if rest:
            yield from groups(pa.concat_tables(rest), True)

    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "own")
    return met.mapInArrow(run, "node long, links long, other long")


def found_links(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Links ``a, b`` among distinct vectors ``node, data``, enough of them to join all that links found join."""
    active, links, done = vectors, [], 0
    n = active.count()
    while n > 1:
        passes = passes_for(n, threshold, window, miss)
        out = materialize(swept(active, done, passes, threshold, window, seed), "sweep")
        pairs = out.where("b is not null")
        links.append(pairs.where("sure").select("a", "b"))
        links.append(_verified(pairs.where("not sure").select("a", "b").distinct(), active, threshold))
        chance = out.where("b is null").groupBy("a").agg(F.sum("miss").alias("miss")).where(F.col("miss") > math.log(MOST_MISS))
        active = materialize(active.join(chance.select(F.col("a").alias("node")), "node", "left_semi"), "sweep-active")
        n, done, window = active.count(), done + passes, 2 * window
        if 1 < n <= max(block, window):  # those that are left, all with each other
            one, size = F.lit(1).cast("long"), F.lit(n).cast("long")
            everyone = active.select(F.lit(0).cast("long").alias("component"), "node", "data", one.alias("copies"), size.alias("size"))
            links.append(block_pairs(everyone, threshold, block, forest=True).select(F.col("node").alias("a"), F.col("other").alias("b")))
            break
    if not links:
        return vectors.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Links are pairs with cosine >= ``threshold`` in double precision. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do vectors of different length. The
    id of a row is compared as a number; rows with null ids link with nothing and are kept. Rows that
    repeat an id count as one vector, the first by content, if they differ. Recall is measured in the
    tests against brute force. An empty table gives no rows; other columns are ignored."""
    vectors = usable_vectors(df.where(F.col(id_col).isNotNull()), id_col, vector_col)
    vectors = materialize(vectors.select(F.col("vec").cast("long").alias("node"), "data").groupBy("node").agg(F.min("data").alias("data")), "vectors")
    distinct = materialize(vectors.groupBy("data").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors-distinct")
    with temporary_tables(df.sparkSession):
        stars = materialize(connected_components(found_links(distinct.select("node", "data"), threshold, window, miss, block, seed)), "vector-components", outlives=True)
    sizes = stars.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = stars.join(sizes, "component").join(distinct, "node")
    links = block_pairs(members.select("component", "node", "data", "copies", "size"), threshold, block).groupBy("node").agg(F.sum("links").alias("links"))
    first = distinct.join(stars, "node", "left").join(links, "node", "left")
    total = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    found = materialize(first.select("data", F.coalesce("component", "node").alias("component"), total.alias("links")), "vector-links")
    found = vectors.join(found, "data").select("node", "component", "links")
    ids = df.select(F.col(id_col).alias("vec_id"))
    out = ids.join(found, ids["vec_id"] == found["node"], "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), same(F.col("vec_id").cast("long"), component).alias("kept"))
