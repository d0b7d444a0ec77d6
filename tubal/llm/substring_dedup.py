"""Removal of repeated word windows, by level-wise doubling.

The lengths double: 9, 18 and 35 words for windows of 35. Only anchors count: a window of the full
length owns the one of its 18 half windows whose hash is least, so that equal windows own equal anchors
at the same place, and about one half window in ten is an anchor. Level 1 looks at the first 9 words of
each anchor; those that stand nowhere else are dropped with all that they own. Level 2 extends those
that are left to 18 words, of which again only the repeated go on. Level 3 extends to the full length:
where the whole stretch of words that an anchor's windows cover is repeated, all its windows are, and
are settled; the other windows are hashed one by one (128 bits) and counted. Where no candidate survives
a level, the next ones have nothing to do. A row carries its hashes of all lengths up to 18, so that
levels need no text.

Each level is one shuffle by hash. Rows of one hash within a batch are reduced to one that takes part
and copies that are known to be repeated and are dealt out anywhere, so that a passage in a third of
all documents does not gather in one task; a task reads its rows in hash order and holds one group, or a
bounded part of it. Very long texts are worked on in stretches that overlap by a window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import byte_strings, materialize, runs_of, signed
from tubal.llm.wordhash import Words, mix, pair, wider

WINDOW = 35
#: The first level's windows have this many words or more.
FIRST = 8
_CHUNK = 1 << 22
_KNOWN_HALF, _KNOWN_SPAN, _FOLLOWER = 1, 2, 4
_SETTLED, _OPEN, _PARTNER = 0, 1, 2
#: Texts that more rows than this have are dealt out over so many parts where they meet their marks.
_OFTEN, _SALTS = 1000, 64
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bits of a word's number in its stretch; more bits tell the stretches apart.
_LOCAL = 22
#: Rows of one group that a task holds before it settles those it has.
_HELD = 1 << 18


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of ``length`` words at each word, from single words by doubling."""
    if length == 1:
        return hashes
    half = window_hashes(hashes, (length + 1) // 2)
    return wider(half, half, length - (length + 1) // 2)


def short_lengths(window: int, least: int = FIRST) -> list[int]:
    """Lengths of the levels below half a window, shortest first, each about twice the one before."""
    out, n = [], ((window + 1) // 2 + 1) // 2
    while n >= least:
        out.append(n)
        n = (n + 1) // 2
    return out[::-1]


def stretches(text: bytes, window: int) -> list[tuple[int, int, int]]:
    """First byte, end and number of the first word of parts of about ``_CHUNK`` bytes, each with the
    ``window`` - 1 words after it, so that each window lies in the part in which it starts and in no other."""
    out, start, first = [], 0, 0
    while start < len(text) or not out:
        found = _GAP.search(text, start + _CHUNK)
        cut = found.start() if found else len(text)
        more = re.compile(rb"(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}" % (window - 1)).match(text, cut)
        out.append((start, more.end(), first))
        if cut < len(text):
            first += len(text[start:cut].split())
        start = cut
    return out


def cut_up(texts: list[bytes], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Stretches of the texts, the text of each, and its number in that text."""
    found = [(t[a:b], i, k) for i, t in enumerate(texts) for k, (a, b, _) in enumerate(stretches(t, window))]
    return [x for x, _, _ in found], np.array([i for _, i, _ in found], np.int64), np.array([k for _, _, k in found], np.int64)


class Windows:
    """Anchors and windows of some texts. ``anchor`` are word indexes, ``owned`` their numbers of
    windows, ``start`` all windows' starts, grouped by anchor."""

    def __init__(self, texts: list[bytes], window: int):
        self.words, self.window = Words(texts), window
        half = (window + 1) // 2
        self.single = self.words.hashes()
        self.half = window_hashes(self.single, half)
        self.start = np.flatnonzero(np.arange(len(self.single)) + window <= self.words.last)
        if len(self.start):
            seen = np.lib.stride_tricks.sliding_window_view(self.half, window - half + 1)[self.start]
            owner = self.start + seen.argmin(axis=1)
            order = np.lexsort((self.start, owner))
            self.start, owner = self.start[order], owner[order]
            self.anchor, self.first, self.owned = np.unique(owner, return_index=True, return_counts=True)
        else:
            self.anchor = self.first = self.owned = np.empty(0, np.int64)

    def spans(self) -> np.ndarray:
        """Hash of all the words that an anchor's windows cover, and of where they start. The owned
        windows need not be neighbours, so their places are hashed as well."""
        full = window_hashes(self.single, self.window)
        low, high = self.start[self.first], self.start[self.first + self.owned - 1]
        place = mix(((self.anchor - low) << 40 | (high - self.anchor) << 20 | self.owned).astype(np.uint64))
        return pair(pair(full[low], full[high]), place)

    def shorter(self) -> list[np.ndarray]:
        """Hashes of each anchor's first words, for each of the ``short_lengths``."""
        return [window_hashes(self.single, n)[self.anchor] for n in short_lengths(self.window)]

    def of(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that these anchors (positions in ``anchor``) own."""
        return np.concatenate([self.start[self.first[a] : self.first[a] + self.owned[a]] for a in anchors]) if len(anchors) else np.empty(0, np.int64)


def _flags(half: np.ndarray, span: np.ndarray) -> np.ndarray:
    """What a batch alone shows: is the half window, the span repeated, and is there an earlier row of
    the same half window and span."""
    order = np.lexsort((span, half))
    h, s = half[order], span[order]
    new_half = np.r_[True, h[1:] != h[:-1]]
    new_span = new_half | np.r_[True, s[1:] != s[:-1]]
    out = np.where(new_span, 0, _FOLLOWER)
    for new, flag in ((new_half, _KNOWN_HALF), (new_span, _KNOWN_SPAN)):
        group = np.cumsum(new) - 1
        out |= np.where(np.bincount(group)[group] > 1, flag, 0)
    flags = np.empty(len(out), np.int64)
    flags[order] = out
    return flags


def _level_flags(level: int) -> tuple[int, int]:
    """Bits of a level below half a window: the batch shows the row to be repeated; an earlier row is like it."""
    return 8 << 2 * level, 16 << 2 * level


def _short_flags(hashes: np.ndarray, level: int) -> np.ndarray:
    _, first, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    known, follower = _level_flags(level)
    out = np.where(count[group] > 1, known | follower, 0)
    out[first] &= ~follower
    return out


def _place(kept: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (kept.astype(np.int64) << 32) | words


def _doc_key(text: str = "text") -> tuple[Column, Column]:
    """96 bits that stand for the text. Rows with one text have one result, so their marks are the same."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(text).alias("key"), F.hash(text).alias("dk")


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors of all texts, with the hashes ``short0, short1, ...`` of the levels below half a window."""
    shorts = [f"short{k}" for k in range(len(short_lengths(window)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, text_of, number = cut_up(byte_strings(batch.column(2)), window)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for a, b in runs_of([len(t) for t in parts], _CHUNK):
                w = Windows(parts[a:b], window)
                part = w.words.doc[w.anchor] + a if len(w.anchor) else w.anchor
                rel = number[part] << _LOCAL | (w.anchor - w.words.first[part - a]) if len(part) else part
                found.append((w.half[w.anchor], w.spans() if len(part) else np.empty(0, np.uint64), text_of[part], rel, *w.shorter()))
            half, span, doc, rel, *short = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(half):
                flags = _flags(half, span)
                for k, hashes in enumerate(short):
                    flags |= _short_flags(hashes, k)
                arrays = [pa.array(signed(half)), pa.array(signed(span)), batch.column(0).take(pa.array(doc)), pa.array(_place(keys[doc], rel)), pa.array(flags)]
                yield pa.record_batch([*arrays, *[pa.array(signed(x)) for x in short]], ["half", "span", "key", "place", "flags", *shorts])

    schema = "half long, span long, key long, place long, flags long" + "".join(f", {c} long" for c in shorts)
    return docs.select(*_doc_key(), "text").mapInArrow(run, schema)


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """The anchors that survive the levels below half a window. Each level meets only those of the one before."""
    rows = _anchors(docs, window)
    for level in range(len(short_lengths(window))):
        known, follower = _level_flags(level)
        kept = [c for c in rows.columns if c != f"short{level}"]
        rows = _met_again(rows, [f"short{level}"], kept, known, follower)
    return rows


def _dealt(rows: DataFrame, key: str, *order: str, follower_bit: int = _FOLLOWER) -> DataFrame:
    """By hash, followers anywhere; in a task followers first, then in hash order."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    follower = F.col("flags").bitwiseAND(F.lit(follower_bit)) > 0
    return rows.repartition(n, F.when(follower, F.col("place")).otherwise(F.col(key))).sortWithinPartitions(follower, *order)


def _judged_anchors(anchors: DataFrame) -> DataFrame:
    """``key, place, state`` of the anchors that are repeated."""

    def judge(t: pa.Table, open_before: bool, more: bool) -> tuple[pa.RecordBatch, bool]:
        half, span, flags = (t.column(c).to_numpy() for c in ("half", "span", "flags"))
        n = len(half)
        lead = (flags & _FOLLOWER) == 0
        new_half = np.r_[True, (half[1:] != half[:-1]) | (lead[1:] != lead[:-1])] | ~lead
        new_span = new_half | np.r_[True, span[1:] != span[:-1]]
        g, s = np.cumsum(new_half) - 1, np.cumsum(new_span) - 1
        repeated = (np.bincount(g)[g] > 1) | ((flags & _KNOWN_HALF) > 0)
        if n and (open_before or more):
            edge = g == 0 if open_before else np.zeros(n, bool)
            repeated |= edge | ((g == g[-1]) if more else False)
        settled = (np.bincount(s)[s] > 1) | ((flags & _KNOWN_SPAN) > 0)
        opened = np.bincount(g, repeated & ~settled) > 0
        if open_before and n:
            opened[0] = True
        state = np.where(~settled, _OPEN, np.where(lead & new_span & opened[g], _PARTNER, _SETTLED))
        kept = np.flatnonzero(repeated)
        out = t.select(["key", "place"]).take(pa.array(kept)).append_column("state", pa.array(state[kept].astype(np.int32)))
        return out.combine_chunks().to_batches(), bool(n and opened[g[-1]] and lead[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            half, span, flags = (held.column(c).to_numpy() for c in ("half", "span", "flags"))
            same_half = (half == half[-1]) & ((flags & _FOLLOWER) == (flags[-1] & _FOLLOWER))
            cut = len(half) - int(np.argmin(same_half[::-1])) if not same_half.all() else 0
            if cut:  # all groups but the last are whole
                found, _ = judge(held.slice(0, cut), opened, False)
                yield from found
                held, opened = held.slice(cut), False
            if held.num_rows > _HELD:  # one large group, taken as open from here on, which costs work but no window
                tail = held.column("span").to_numpy()
                same_span = tail == tail[-1]
                one = bool(same_span.all())  # then its last row stays, known to be repeated
                cut = len(tail) - 1 if one else len(tail) - int(np.argmin(same_span[::-1]))
                found, _ = judge(held.slice(0, cut), True, True)
                yield from found
                held, opened = held.slice(cut), True
                if one:
                    known = pa.array(held.column("flags").to_numpy() | _KNOWN_HALF | _KNOWN_SPAN)
                    held = held.set_column(held.schema.get_field_index("flags"), "flags", known)
        if held is not None and held.num_rows:
            yield from judge(held, opened, False)[0]

    return _dealt(anchors, "half", "half", "span").mapInArrow(run, "key long, place long, state int")


def _per_document(places: DataFrame, mark) -> DataFrame:
    """``key_, dk_, marks, copies``: the distinct marks of each text, whose number its words bound, and
    about how many rows have it."""
    keyed = places.select(F.col("key").alias("key_"), F.shiftright("place", 32).cast("int").alias("dk_"), mark.alias("mark"))
    found = keyed.groupBy("key_", "dk_").agg(F.collect_set("mark").alias("marks"), F.count(F.lit(1)).alias("n"))
    return materialize(found.withColumn("copies", F.col("n") / F.size("marks")).drop("n"), "repeat-marks")


def _with_marks(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """``docs`` and their ``marks``. Rows of a text that many rows have, and those too short for any
    mark, are dealt out over ``_SALTS`` parts."""
    often = marks.where(F.col("copies") > _OFTEN)
    # As a table it has its true size, by which Spark decides whether to broadcast it.
    frequent = materialize(often.select(F.col("key_").alias("_key"), F.col("dk_").alias("_dk")), "repeat-often")
    flagged = docs.join(frequent, (F.col("key") == F.col("_key")) & (F.col("dk") == F.col("_dk")), "left")
    any_part = F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))
    short = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) < 2 * window - 1
    flagged = flagged.withColumn("_part", F.when(F.col("_key").isNotNull(), any_part).when(short, -1 - any_part).otherwise(0))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("copies") > _OFTEN, _SALTS - 1).otherwise(0).cast("long")))
    dealt = marks.select("key_", "dk_", "marks", parts.alias("part_"))
    joined = flagged.join(dealt, (F.col("key") == F.col("key_")) & (F.col("dk") == F.col("dk_")) & (F.col("_part") == F.col("part_")), "left")
    return joined.select(*docs.columns, "marks")


def _digest(words: Words, gone: np.ndarray) -> tuple[int, int, str]:
    """Of one text: words, words removed, SHA-256 of the others."""
    kept, data, digest = np.flatnonzero(~gone), words.data, hashlib.sha256()
    for i in range(0, len(kept), 1 << 16):
        part = kept[i : i + (1 << 16)]
        joined = b" ".join([data[s:e] for s, e in zip(words.start[part].tolist(), words.end[part].tolist(), strict=True)])
        digest.update(b" " + joined if i else joined)
    return len(gone), int(gone.sum()), digest.hexdigest()


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + window + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _starts_of(text: bytes, marks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that are settled and of those that wait, by the marks of a text's anchors."""
    settled, waiting = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (a, b, first) in enumerate(stretches(text, window)):
        own = marks[marks >> (_LOCAL + 2) == k]
        if len(own):
            w = Windows([text[a:b]], window)
            at, state = np.searchsorted(w.anchor, own >> 2 & ((1 << _LOCAL) - 1)), own & 3
            settled.append(w.of(at[state != _OPEN]) + first)
            waiting.append(w.of(at[state != _SETTLED]) + first)
    return np.concatenate(settled), np.concatenate(waiting)


def _first_results(marked: DataFrame, window: int) -> DataFrame:
    """Documents without open windows get their results; of the others the text goes on, with the
    starts that are settled and those still to be counted (``waiting``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(2).cast(pa.binary())], _CHUNK):
                part = batch.slice(a, b - a)
                rows = []
                for text, marks in zip(byte_strings(part.column(2)), part.column(3).to_pylist(), strict=True):
                    if not marks:
                        words = Words([text])
                        rows.append((*_digest(words, np.zeros(len(words.start), bool)), None, None, None))
                        continue
                    settled, waiting = _starts_of(text, np.unique(np.array(marks, np.int64)), window)
                    if len(waiting):
                        rows.append((None, None, None, text, settled.astype("<i4").tobytes(), waiting.astype("<i4").tobytes()))
                    else:
                        words = Words([text])
                        rows.append((*_digest(words, covered(len(words.start), settled, window)), None, None, None))
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), part.column(4), *columns], ["doc_id", "dk", "key", "n_words", "n_removed", "kept_sha256", "text", "settled", "waiting"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "dk", "text", "marks", "key").mapInArrow(run, f"doc_id {kind}, dk int, key long, n_words long, n_removed long, kept_sha256 string, text binary, settled binary, waiting binary")


def _waiting_windows(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, parts = batch.column(1).to_numpy(zero_copy_only=False), [], []
            for i, (text, raw) in enumerate(zip(byte_strings(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                waits, pieces = np.sort(np.frombuffer(raw, "<i4").astype(np.int64)), stretches(text, window)
                ends = [*(f for _, _, f in pieces[1:]), 1 << 40]
                for (a, b, first), end in zip(pieces, ends, strict=True):
                    own = waits[(waits >= first) & (waits < end)]
                    if len(own):
                        parts.append((text[a:b], i, first, own))
            for a, b in runs_of([len(p[0]) for p in parts], _CHUNK):
                words = Words([p[0] for p in parts[a:b]])
                at = np.concatenate([own - first + words.first[i] for i, (_, _, first, own) in enumerate(parts[a:b])])
                doc, rel = np.repeat([p[1] for p in parts[a:b]], [len(p[3]) for p in parts[a:b]]), np.concatenate([p[3] for p in parts[a:b]])
                one, two = (window_hashes(words.hashes(k), window)[at] for k in (0, 1))
                found.append((one, two, doc, rel))
            if not found:
                continue
            one, two, doc, rel = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(one):
                arrays = [pa.array(signed(one)), pa.array(signed(two)), batch.column(0).take(pa.array(doc)), pa.array(_place(keys[doc], rel)), pa.array(_flags(one, two))]
                yield pa.record_batch(arrays, ["one", "two", "key", "place", "flags"])

    return rows.select("key", "dk", "text", "waiting").mapInArrow(run, "one long, two long, key long, place long, flags long")


def _met_again(rows: DataFrame, keys: list[str], kept: list[str], known: int, follower: int) -> DataFrame:
    """The columns ``kept`` of the rows whose ``keys`` some other row has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row waits for the next one

        def alike(t: pa.Table) -> np.ndarray:
            flags = t.column("flags").to_numpy()
            like = (flags[1:] | flags[:-1]) & follower == 0
            for name in keys:
                x = t.column(name).to_numpy()
                like &= x[1:] == x[:-1]
            return like

        def judge(t: pa.Table, like: np.ndarray, before: bool, after: bool) -> list[pa.RecordBatch]:
            hit = np.r_[before, like] | np.r_[like, after] | ((t.column("flags").to_numpy() & known) > 0)
            return t.select(kept).take(pa.array(np.flatnonzero(hit))).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if t.num_rows > 1:
                like = alike(t)
                yield from judge(t.slice(0, t.num_rows - 1), like[:-1], before, bool(like[-1]))
                before = bool(like[-1])
            held = t.slice(t.num_rows - 1)
        if held is not None:
            yield from judge(held, alike(held), before, False)

    dealt = _dealt(rows, keys[0], *keys, follower_bit=follower)
    return dealt.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept))


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """``key, place`` of the windows that stand elsewhere too."""
    return _met_again(windows, ["one", "two"], ["key", "place"], _KNOWN_SPAN, _FOLLOWER)


def _last_results(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for text, settled, marks in zip(byte_strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = Words([text])
                starts = np.concatenate([np.frombuffer(settled, "<i4"), np.array(marks or [], "<i4")]).astype(np.int64)
                out.append(_digest(words, covered(len(words.start), np.unique(starts), window)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "settled", "marks").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``.

    Words are runs of anything but ASCII white space. Removed is each word that a window of ``window``
    words covers whose word sequence also starts anywhere else, in the same text too; all windows are
    judged on the input. ``kept_sha256`` is of the kept words, joined by single spaces. A null text has
    no words; texts shorter than a window keep all; null ids are carried; rows that repeat an id and
    text repeat each other. An empty table gives no rows; other columns are ignored. Windows are
    compared by 128 bits of hash, texts by 96."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = _per_document(_judged_anchors(_candidates(base, window)), F.shiftleft(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 2) + F.col("state"))
    first = materialize(_first_results(_with_marks(base.select("doc_id", *_doc_key(), "text"), marks, window), window), "repeats")
    done = first.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    going = first.where("text is not null").select("doc_id", "key", "dk", "text", "settled", "waiting")
    counted = _per_document(_repeated_windows(_waiting_windows(going, window)), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return done.unionByName(_last_results(_with_marks(going.drop("waiting"), counted, window), window))
