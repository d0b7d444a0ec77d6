"""Packing documents into token sequences: bounded-space online packing.

A task keeps a fixed number of open windows. A document takes whole windows while it is longer than
one; its rest goes to the open window that it fills best; where it fits none, the fullest is filled up
with its beginning and emitted, and so on; a piece of fewer than eight ids is not cut off. What is left open at the end of a partition is merged, some
partitions at a time, by the same rule; one window per merge may stay unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import materialize
from tubal.llm.tokens import encoder

CAPACITY = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: No document is cut into pieces of fewer ids than this for a window's sake, so that an emitted window lacks less than twice as many.
LEAST_PIECE = 8
#: Partitions whose leftovers are merged together.
MERGED = 64
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) in windows."""

    def __init__(self, capacity: int, windows: int, first_sequence: int):
        self.capacity, self.windows, self.next = capacity, windows, first_sequence
        self.open: list[tuple[int, int, list]] = []  # (used, sequence, pieces)

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[tuple[int, list]]:
        """Yields windows that are closed by this, as (sequence, pieces)."""
        while len(ids) >= self.capacity:
            yield self.next, [(doc_id, start, ids[: self.capacity], doc_tokens)]
            self.next += 1
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.capacity]
            full = False
            if fits:
                best = max(fits, key=lambda w: w[0])
                take = len(ids)
            elif len(self.open) < self.windows:
                best, take = (0, self.next, []), len(ids)
                self.next += 1
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                take = min(self.capacity - best[0], len(ids) - LEAST_PIECE)
                take = take if take >= LEAST_PIECE else 0
                full = True
            self.open.remove(best)
            used, sequence, pieces = best
            if take:
                pieces.append((doc_id, start, ids[:take], doc_tokens))
                start, ids = start + take, ids[take:]
            if full or used + take == self.capacity:
                yield sequence, pieces
            else:
                self.open.append((used + take, sequence, pieces))

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, sequence, pieces in self.open:
            yield sequence, pieces
        self.open = []


def _rows(sequence: int, pieces: list, with_ids: bool, part: int | None) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, doc_tokens in pieces:
        raw = ids.tobytes()
        yield doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, sequence, offset, raw if with_ids else None, part
        offset += len(ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and with
    ``with_ids`` the ids (binary, little-endian unsigned 32-bit).

    A document is the ids of its whole text, a null text counting as empty, and ``END_ID``; each id lies
    in one piece. Null and repeated ids of any type are carried as they are; a text of any length is one row's ids, taken
    window by window; of windows that are equally full the one opened first is taken. An empty table gives no rows; other
    columns are ignored. A sequence's padding is what it lacks to ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 6, pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, packer, id_type, rows = encoder(tokenizer_path), Packer(capacity, windows, part << 32), pa.int64(), []
        end = np.array([END_ID], "<u4")
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time as a Python object
                doc_id, ids = doc_id.as_py(), np.concatenate([enc.encode(text.as_py() or ""), end])
                for sequence, pieces in packer.add(doc_id, 0, ids, len(ids)):
                    rows.extend(_rows(sequence, pieces, with_ids, None))
                if len(rows) >= 4096:
                    yield batch_of(rows, id_type)
                    rows = []
        for sequence, pieces in packer.rest():
            rows.extend(_rows(sequence, pieces, True, part))
        if rows:
            yield batch_of(rows, id_type)

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        group = table.column("part")[0].as_py() // MERGED
        packer, rows = Packer(capacity, 1, (1 << 62) + (group << 32)), []
        ids, kind = table.column("doc_id").to_pylist(), table.schema.field("doc_id").type  # as they are: pandas would make doubles of longs beside a null
        for doc_id, start, piece, doc_tokens in zip(ids, *(table.column(c).to_pylist() for c in ("start", "ids", "doc_tokens")), strict=True):
            for sequence, pieces in packer.add(doc_id, start, np.frombuffer(piece, "<u4"), doc_tokens):
                rows.extend(_rows(sequence, pieces, with_ids, None))
        for sequence, pieces in packer.rest():
            rows.extend(_rows(sequence, pieces, with_ids, None))
        return pa.Table.from_batches([batch_of(rows, kind)])

    first = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema), "packed")
    left = first.where("part is not null")
    merged = left.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInArrow(merge, schema)
    out = first.where("part is null").unionByName(merged).drop("part")
    return out if with_ids else out.drop("ids")
