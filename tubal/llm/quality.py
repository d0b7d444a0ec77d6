"""Quality classifier by compression.

A text is compressed with a zstandard dictionary of good text and with one of bad text, in blocks, so
that the dictionaries matter throughout a long text. The difference of the two sizes per byte of text
becomes a probability by logistic regression on labelled rows that the dictionaries were not made from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tubal.llm.common import byte_strings, map_batches, wrapped

#: Training bounds: so many labelled documents of each class, and so many characters of each.
TRAIN_DOCS = 1024
TRAIN_CHARS = 2000
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3


def training_sample(docs: DataFrame, labels: DataFrame, seed: int = 5, docs_per_class: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """``quality, bucket, piece``: excerpts from a bounded number of labelled documents per class. For
    each class and bucket of hashes, the labelled document with the smallest hash; where documents
    repeat its id, the excerpt that is first by content."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    rated = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality", order.alias("order"))
    rated = rated.withColumn("bucket", F.pmod("order", F.lit(docs_per_class)))
    chosen = rated.groupBy("quality", "bucket").agg(F.min("order").alias("order"))
    picked = docs.select("doc_id", "text", order.alias("order")).join(F.broadcast(chosen), "order")
    at = F.pmod(F.xxhash64("order", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    return picked.where("length(text) > 0").select("quality", "bucket", F.col("text").substr(at.cast("int"), F.lit(chars)).alias("piece")).groupBy("quality", "bucket").agg(F.min("piece").alias("piece"))


class Classifier:
    def __init__(self, rows: list[tuple[int, int, str]], dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL):
        rows = sorted(rows)
        make = {c: [p.encode() for q, b, p in rows if q == c and b % 2 == 0] for c in (0, 1)}
        fit = [(q, p.encode()) for q, b, p in rows if b % 2]
        share = sum(q for q, _ in fit) / len(fit) if fit else 0.5
        self.slope, self.offset = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        self.compressors = []
        for c in (0, 1):
            try:
                d = zstandard.train_dictionary(dictionary_bytes, make[c])
            except (zstandard.ZstdError, ValueError):  # too little text to choose from: all of it
                d = zstandard.ZstdCompressionDict(b"\n".join(make[c]) or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))
        if make[0] and make[1] and len({q for q, _ in fit}) == 2:
            self._calibrate(np.array([self.difference(p) for _, p in fit]), np.array([q for q, _ in fit], float))

    def difference(self, text: bytes, block: int = BLOCK) -> float:
        bad = good = 0
        for i in range(0, len(text), block):
            part = text[i : i + block]
            bad += len(self.compressors[0].compress(part))
            good += len(self.compressors[1].compress(part))
        return (bad - good) / len(text) if text else 0.0

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression with a small ridge, both classes weighing the same, by Newton steps."""
        scale = x.std() or 1.0
        z = np.column_stack([x / scale, np.ones(len(x))])
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), z.T @ (weight * (y - p)) - 0.01 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0] / scale), float(w[1])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.offset, -40, 40))))


_classifiers: dict[int, Classifier] = {}


def score_quality(docs: DataFrame, training: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``) and ``score`` of every row: the probability, from 0 to 1, that its
    label is 1. ``training`` is bounded (``training_sample``) and sent to all workers.

    A null text counts as empty; an empty text has difference 0 and so the score of the calibration's
    offset. Texts of any length are compressed block by block. Without labels of both classes every row
    has the share of label 1 among the calibration rows (0.5 without any). Repeated rows are each
    answered; an empty table gives no rows."""
    rows = sorted((int(r.quality), int(r.bucket), r.piece) for r in training.collect())
    key = hash(tuple(rows))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if key not in _classifiers:
            _classifiers.clear()
            _classifiers[key] = Classifier(rows)
        model = _classifiers[key]
        scores = pa.array([model.score(t) for t in byte_strings(batch.column(1))], pa.float64())
        yield pa.record_batch([batch.column(0), scores], ["row", "score"])

    texts = wrapped(docs, F.col(f"`{text_col}`").cast("string").alias("_text"))
    return map_batches(texts, run, StructType([texts.schema["row"], StructField("score", DoubleType())]))
