"""Tensors from files of numbers, read by tasks from ``binaryFile`` rows."""

from __future__ import annotations

import calendar
import io
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tubal.plans.analytics import calendar_tensor
from tubal.tensor import Tensor, index_names

_CELLS_AT_ONCE = 1 << 20


def _cells(array: np.ndarray, first: int = 0) -> Iterator[pd.DataFrame]:
    """Rows of cells; ``first`` is added to the last index."""
    flat = np.asarray(array, float).reshape(-1, order="F")
    for a in range(0, len(flat), _CELLS_AT_ONCE):
        at = np.unravel_index(np.arange(a, min(a + _CELLS_AT_ONCE, len(flat))), array.shape, order="F")
        frame = {f"i{k}": x.astype("int32") for k, x in enumerate(at)}
        frame[f"i{array.ndim - 1}"] = (at[-1] + first).astype("int32")
        yield pd.DataFrame(frame | {"v": flat[a : a + _CELLS_AT_ONCE]})


def _schema(ndim: int) -> str:
    return ", ".join(f"{n} int" for n in index_names(ndim)) + ", v double"


def read_npy(spark: SparkSession, path: str, dims: tuple[int, ...]) -> Tensor:
    """One ``.npy`` file of the stated shape."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.shape != tuple(dims):
                    raise ValueError(f"the file holds {array.shape}, not {tuple(dims)}")
                yield from _cells(array)

    files = spark.read.format("binaryFile").load(path).select("content")
    return Tensor(files.mapInPandas(load, _schema(len(dims))), tuple(dims))


def load_npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def read_series(spark: SparkSession, paths: list[str], dims: tuple[int, ...], decode: Callable[[bytes], np.ndarray] = load_npy, axes: tuple[int, ...] | None = None, starts: list[int] | None = None) -> Tensor:
    """Many files in one scan, each decoded in a task and transposed by ``axes``. Without ``starts`` they are
    stacked along a new last mode in the order given (``dims`` are a file's); with ``starts`` file k's last
    mode begins at ``starts[k]`` of the whole (``dims`` are the whole's). File names must differ."""
    number = {p.rsplit("/", 1)[-1]: k for k, p in enumerate(paths)}
    if len(number) < len(paths):
        raise ValueError("files of one name")
    whole = tuple(dims) if starts else (*dims, len(paths))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                k = number[unquote(path).rsplit("/", 1)[-1]]
                array = np.asarray(decode(bytes(content)), float)
                array = array.transpose(axes) if axes else array
                first = starts[k] if starts else k
                array = array if starts else array[..., None]
                if array.shape[:-1] != whole[:-1] or first + array.shape[-1] > whole[-1]:
                    raise ValueError(f"{path} holds {array.shape}, which does not fit {whole} from {first}")
                for t in range(array.shape[-1]):
                    yield from _cells(array[..., t : t + 1], first + t)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return Tensor(files.mapInPandas(load, _schema(len(whole))), whole)


def read_years(spark: SparkSession, paths: list[str], first_year: int, lead: tuple[int, ...], decode: Callable[[bytes], np.ndarray] = load_npy, axes: tuple[int, ...] | None = None, per_day: int = 4) -> Tensor:
    """One file a year, from ``first_year`` on, time last, as a tensor with the modes time of day, day and year."""
    lengths = [per_day * (366 if calendar.isleap(first_year + k) else 365) for k in range(len(paths))]
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    t = read_series(spark, paths, (*lead, starts[-1]), decode, axes, starts[:-1])
    step = F.col(f"i{len(lead)}")
    year = F.lit(0)
    for k, s in enumerate(starts[:-1]):
        year = F.when(step >= s, F.lit(k)).otherwise(year)
    steps = t.cells.withColumn("k", year).withColumn("year", F.col("k") + first_year)
    steps = steps.withColumn("step", step - F.element_at(F.array(*[F.lit(s) for s in starts[:-1]]), F.col("k") + 1))
    return calendar_tensor(steps.select(*index_names(len(lead)), "year", "step", "v"), tuple(lead), first_year, len(paths), per_day)


def read_yearly(parts: list[Tensor]) -> Tensor:
    """Tensors joined along their last mode."""
    first, out, at = parts[0], None, 0
    last = f"i{len(first.dims) - 1}"
    for p in parts:
        if p.dims[:-1] != first.dims[:-1]:
            raise ValueError("the parts differ in another mode than the last")
        cells = p.cells.withColumn(last, (F.col(last) + F.lit(at)).cast("int"))
        out, at = cells if out is None else out.unionByName(cells), at + p.dims[-1]
    return Tensor(out, (*first.dims[:-1], at))


def video_header(content: bytes) -> tuple[int, int, float, int]:
    """Height, width, frames a second and number of frames of a colour video: two little-endian uint32
    and a float64, then float64 values of (height, width, 3, frames), the first index fastest."""
    height, width, rate = struct.unpack_from("<IId", content)
    frames, rest = divmod((len(content) - 16) // 8, height * width * 3)
    if rest or (len(content) - 16) % 8:
        raise ValueError("the file does not hold whole frames")
    return height, width, rate, frames


def read_video(spark: SparkSession, path: str, dims: tuple[int, int, int, int]) -> Tensor:
    """A colour video file as (height, width, 3, frames). ``dims`` from ``video_header``."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                height, width, _, count = video_header(content)
                values = np.frombuffer(content, "<f8", offset=16).reshape((height, width, 3, count), order="F")
                for t in range(count):
                    yield from _cells(values[..., t : t + 1], t)

    files = spark.read.format("binaryFile").load(path).select("content")
    return Tensor(files.mapInPandas(load, _schema(4)), tuple(dims))


def read_decoded(spark: SparkSession, path: str, dims: tuple[int, ...], decode: Callable[[bytes], np.ndarray]) -> Tensor:
    """One file of any format: ``decode`` makes an array of its bytes inside the task."""
    return read_series(spark, [path], dims, decode, starts=[0])
