"""Periodic runs of words, by a branching tandem test on enhanced suffix arrays.

The words of some documents are numbered, apart for each document, so that one suffix array serves them all and no
repeat crosses from one to another. It is made by doubling; the ranks of every doubling step are kept and give common prefixes and common endings by
descent over powers of two. An interval of the array that shares a prefix of ``depth`` words and no longer one is what a node of
the suffix tree would be. A square ``ww`` with ``|w| = depth`` that does not go on to the right has its two halves in one such interval
and in different children of it. So of each interval the suffixes of all children but the largest are tested:
does the interval hold the suffix ``depth`` words on, or before (by the inverse array), and do the words after differ? All
intervals and suffixes of a batch are tested at once. A square found is rotated to the left as far as words repeat, which gives the
run that it ends; of squares that give the same run the least period stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tubal.llm.common import byte_strings, map_batches, named, runs_of

#: A run is at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are in one suffix array, but for a single longer text.
BATCH_BYTES = 1 << 18

RUN = "struct<start:long,length:long,period:long>"
BEST = "struct<start:long,length:long,period:long,exponent_milli:long>"


class Repeats:
    """The enhanced suffix array of numbers, of which ``docs`` (ascending) never share any."""

    def __init__(self, numbers: np.ndarray):
        self.n = n = len(numbers)
        self.words = np.append(numbers, -1)
        order = np.argsort(numbers, kind="stable")
        self.order, self.levels = order, []
        rank = self._ranked(numbers[order])
        place = np.empty(n + 1, np.int32)
        place[order], place[n] = rank, -1
        self.levels.append(place)
        # A rank is the first place of its group in the array, so groups of one keep theirs for good.
        size = np.diff(np.append(np.flatnonzero(rank == np.arange(n)), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        step = 1
        while len(open_):
            at = order[open_]
            place = self.levels[-1]
            group, after = place[at], place[np.minimum(at + step, n)]
            key = group.astype(np.int64) * (n + 2) + (after + 1)
            turn = np.argsort(key, kind="stable")
            at, key, group = at[turn], key[turn], group[turn]
            order[open_] = at
            new = np.empty(len(at), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            fresh = place.copy()
            fresh[at] = np.repeat(open_[first], size)
            self.levels.append(fresh)
            open_ = open_[np.repeat(size > 1, size)]
            step *= 2

    @staticmethod
    def _ranked(sorted_numbers: np.ndarray) -> np.ndarray:
        n = len(sorted_numbers)
        new = np.ones(n, bool)
        np.not_equal(sorted_numbers[1:], sorted_numbers[:-1], out=new[1:])
        first = np.flatnonzero(new)
        return np.repeat(first, np.diff(np.append(first, n))).astype(np.int32)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b, which differ, have in common."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[np.minimum(a + out, self.n)] == level[np.minimum(b + out, self.n)]).astype(np.int64) << k
        return out

    def common_ending(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words just before a and before b, which differ, that are the same."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x, y = self.levels[k], a - out - (1 << k), b - out - (1 << k)
            same = (np.minimum(x, y) >= 0) & (level[np.maximum(x, 0)] == level[np.maximum(y, 0)])
            out += same.astype(np.int64) << k
        return out

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For places k of the array whose common prefix with the place before is a word at least: k, that prefix, and
        the first and past the last place of the interval that shares it."""
        common = np.zeros(self.n, np.int64)
        grouped = np.flatnonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]]) + 1
        common[grouped] = self.common_prefix(self.order[grouped - 1], self.order[grouped])
        at = grouped
        if not len(at):
            return at, at, at, at
        depth = common[at]
        # Least values of stretches of 1, 2, 4 ... places; an interval is no longer than the longest group of one first word.
        longest = int(np.diff(np.flatnonzero(np.append(common == 0, True))).max())
        least = [np.append(common, 0)]
        while 1 << len(least) <= longest:
            half, last = 1 << (len(least) - 1), least[-1]
            wider = last.copy()
            wider[:-half] = np.minimum(last[:-half], last[half:])
            wider[-half:] = 0
            least.append(wider)
        right, left = at + 1, at.copy()
        for k in range(len(least) - 1, -1, -1):
            right += (least[k][np.minimum(right, self.n)] >= depth).astype(np.int64) << k
            x = left - (1 << k)
            left -= ((x >= 0) & (least[k][np.maximum(x, 0)] >= depth)).astype(np.int64) << k
        return at, depth, left - 1, right

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and half length of all squares that do not go on to the right."""
        at, depth, left, right = self.intervals()
        if not len(at):
            return at, at
        turn = np.lexsort((at, depth, left))
        at, depth, left, right = at[turn], depth[turn], left[turn], right[turn]
        head = np.ones(len(at), bool)
        head[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
        # The children of an interval lie between its bounds and its places with just its depth.
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(at)))
        begin = np.insert(at, first, left[first])
        child = np.repeat(np.arange(len(first)), count + 1)
        child_first = first + np.arange(len(first))
        size = np.empty(len(begin), np.int64)
        size[:-1] = begin[1:] - begin[:-1]
        last = child_first + count
        size[last] = right[first] - begin[last]
        # All children but one largest of each interval.
        small = np.ones(len(begin), bool)
        ranked = np.lexsort((size, child))
        small[ranked[last]] = False
        begin, size, child = begin[small], size[small], child[small]
        found_at, found_half = [], []
        ends = np.cumsum(size)
        n = self.n
        for lo, hi in runs_of(size.tolist(), 1 << 22):
            total = int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            skipped = np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo - 1] if lo else 0), size[lo:hi])
            i = self.order[np.repeat(begin[lo:hi], size[lo:hi]) + np.arange(total) - skipped]
            node = first[np.repeat(child[lo:hi], size[lo:hi])]
            d, low, high = depth[node], left[node], right[node]
            for start in (i, i - d):  # this suffix begins the square, or its second half does
                other = i + d if start is i else start
                where = np.where((other >= 0) & (other < n), self.inverse[np.clip(other, 0, n)], -1)
                ok = (where >= low) & (where < high)
                s, h = start[ok], d[ok]
                ok = self.words[s + h] != self.words[np.minimum(s + 2 * h, n)]
                found_at.append(s[ok])
                found_half.append(h[ok])
        return np.concatenate(found_at), np.concatenate(found_half)

    @property
    def inverse(self) -> np.ndarray:
        return self.levels[-1]  # all groups are of one there

    def runs(self) -> np.ndarray:
        """Rows of start, end and least period of all maximal repetitions of two periods or more."""
        start, half = self.squares()
        if not len(start):
            return np.zeros((0, 3), np.int64)
        end = start + 2 * half
        rows = np.stack([start - self.common_ending(start, start + half), end, half], 1)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return rows[new]


@dataclass
class Found:
    runs: np.ndarray  # start, length, period, in order of start and period
    words: list[bytes]
    kept: np.ndarray


def periodic_runs(documents: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Iterator[Found]:
    """The runs of each document's words, and which words are left when each run keeps but its first period."""
    counts = np.array([len(w) for w in documents], np.int64)
    bounds = np.append(0, np.cumsum(counts))
    total = int(bounds[-1])
    rows = np.zeros((0, 3), np.int64)
    if total:
        column = pa.array(list(chain.from_iterable(documents)), pa.large_binary()).dictionary_encode()
        numbers = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers += np.repeat(np.arange(len(documents)), counts) * len(column.dictionary)
        rows = Repeats(numbers).runs()
    long = rows[:, 1] - rows[:, 0] >= np.maximum(least_words, least_periods * rows[:, 2])
    rows = rows[long]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    doc = np.searchsorted(bounds, rows[:, 0], "right") - 1
    cuts = np.searchsorted(doc, np.arange(len(documents) + 1))
    for d, words in enumerate(documents):
        mine = rows[cuts[d] : cuts[d + 1]]
        runs = np.stack([mine[:, 0] - bounds[d], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
        yield Found(runs[np.lexsort((runs[:, 2], runs[:, 0]))], words, kept[bounds[d] : bounds[d + 1]])


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones the first, then that of the least period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def with_tail(words: list[bytes], at: int, period: int) -> list[bytes]:
    """The words before ``at``, and from there on the first ``period`` of the others over and over."""
    tail = words[at : at + period]
    return words[:at] + (tail * (-(-(len(words) - at) // max(1, period))))[: len(words) - at]


def find_runs(docs: DataFrame, text: Column, tail: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``keep``), ``n_words``, ``runs`` (array of start, length, period), ``best`` (start, length, period, exponent_milli; null
    without a run), ``runs_sha256`` and ``collapsed_sha256``.

    A word is a run of anything but ASCII white space. A run is a stretch of words with least period q of ``LEAST_WORDS`` and
    ``LEAST_PERIODS`` q words at least that no neighbouring word continues. ``runs_sha256`` is the digest of all ``start,length,period`` lines, ``collapsed_sha256`` of
    the text's words without those that a run holds after its first q. ``tail`` is an optional pair (g, spread) of longs: with it the
    words from g mod n on are replaced by repetitions of the first 1 + (n - g mod n) // spread of them; null or a text without words: none are. A null
    text has no words and no runs; ids play no part; rows may repeat; an empty table gives no rows; a text of any length is taken whole, by one task."""
    extra = F.lit(None).cast("struct<shift:long,spread:long>") if tail is None else tail
    carried = F.struct(*[named(c) for c in (docs.columns if keep is None else keep)]).alias("row")
    rows = docs.select(carried, text.cast("string").alias("text"), extra["shift"].alias("shift"), extra["spread"].alias("spread"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(f"n_words long, runs array<{RUN}>, best {BEST}, runs_sha256 string, collapsed_sha256 string")])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, texts, shift, spread = (batch.column(k) for k in range(4))
        texts, shift, spread = byte_strings(texts), shift.to_pylist(), spread.to_pylist()
        for a, b in runs_of([len(t) for t in texts], BATCH_BYTES):
            documents = []
            for t, g, s in zip(texts[a:b], shift[a:b], spread[a:b], strict=True):
                words = t.split()
                if g is not None and s and words:
                    at = g % len(words)
                    words = with_tail(words, at, 1 + (len(words) - at) // s)
                documents.append(words)
            sizes, counts, flat, best, digests, collapsed = [], [], [], [], [], []
            for f in periodic_runs(documents):
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in f.runs.tolist())
                top = greatest(f.runs)
                best.append(top and dict(zip(("start", "length", "period", "exponent_milli"), (*top, 1000 * top[1] // top[2]), strict=True)))
                left = f.words if f.kept.all() else [f.words[i] for i in np.flatnonzero(f.kept).tolist()]
                sizes.append(len(f.words))
                counts.append(len(f.runs))
                flat.append(f.runs)
                digests.append(hashlib.sha256(lines.encode()).hexdigest())
                collapsed.append(hashlib.sha256(b" ".join(left)).hexdigest())
            every = np.concatenate(flat)
            parts = pa.StructArray.from_arrays([pa.array(every[:, k].copy(), pa.int64()) for k in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), parts)
            kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period", "exponent_milli")])
            yield pa.record_batch(
                [row.slice(a, b - a), pa.array(sizes, pa.int64()), runs, pa.array(best, kind), pa.array(digests, pa.string()), pa.array(collapsed, pa.string())],
                ["row", "n_words", "runs", "best", "runs_sha256", "collapsed_sha256"],
            )

    return map_batches(rows, run, schema)
