"""Files of dense arrays as a data source of byte ranges: ``.npy``, raw colour video, classic NetCDF variables, uncompressed TIFF stacks.

A row is ``at, data``: a position along the file's slowest mode and all numbers there, in the file's order. The header is read when the query is planned;
a partition is some neighbouring positions, and its task reads just their bytes, so a file of any size is read by many tasks. Comparisons of
``at`` with constants are pushed down (``spark.sql.python.filterPushdown.enabled``): other positions are neither planned nor read. Paths are what ``pyarrow.fs`` opens.

``read_dense`` makes tensors of it; a filter on the index of the slowest mode reaches the source through Catalyst."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tubal.tensor import Tensor, index_names, split_index

#: Bytes that a task reads, but for a single larger position.
PARTITION_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """Where the numbers are. ``inner`` are the sizes of the other modes in the file's order, the fastest first; a position's bytes are at
    ``first + at * stride``, or in the ``pieces`` of its own. Numbers are ``value * scale + shift``, and NaN where they are ``missing``."""

    count: int
    inner: tuple[int, ...]
    kind: str
    slowest_first: bool  # the slowest mode is the tensor's first, and the fastest its last
    first: int = 0
    stride: int = 0
    pieces: tuple[tuple[tuple[int, int], ...], ...] = field(default=(), repr=False)
    scale: float = 1.0
    shift: float = 0.0
    missing: tuple[float, ...] = ()

    @property
    def dims(self) -> tuple[int, ...]:
        return (self.count, *self.inner[::-1]) if self.slowest_first else (*self.inner, self.count)

    @property
    def bytes_each(self) -> int:
        return prod(self.inner) * np.dtype(self.kind).itemsize

    def ranges(self, at: int) -> tuple[tuple[int, int], ...]:
        return self.pieces[at] if self.pieces else ((self.first + at * self.stride, self.bytes_each),)

    def numbers(self, raw: bytes) -> np.ndarray:
        stored = np.frombuffer(raw, self.kind)
        out = stored.astype(np.float64)
        if self.scale != 1.0 or self.shift != 0.0:
            out = out * self.scale + self.shift
        for m in self.missing:
            out[stored == np.dtype(self.kind).type(m)] = np.nan
        return out


def _opened(path: str):
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    system, inside = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inside)


def npy_layout(file, size: int) -> Layout:
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
    dims, fortran, kind = read(file)
    if len(dims) < 2 or kind.hasobject:
        raise ValueError(f"an array of {dims} and {kind} is no tensor of numbers")
    count, inner = (dims[-1], dims[:-1]) if fortran else (dims[0], dims[:0:-1])
    out = Layout(count, tuple(inner), kind.str, not fortran, file.tell())
    out = Layout(count, tuple(inner), kind.str, not fortran, file.tell(), out.bytes_each)
    if size != out.first + count * out.stride:
        raise ValueError(f"the file has {size} bytes, not {out.first + count * out.stride}")
    return out


def video_layout(file, size: int) -> Layout:
    """Height and width as little-endian uint32, the rate as float64, then float64 values of (height, width, 3, frames), the first fastest."""
    height, width, _ = struct.unpack("<IId", file.read(16))
    out = Layout(0, (height, width, 3), "<f8", False, 16)
    count, rest = divmod(size - 16, max(1, out.bytes_each))
    if rest or not height * width:
        raise ValueError("the file does not hold whole frames")
    return Layout(count, out.inner, "<f8", False, 16, out.bytes_each)


# Fixed values of the classic NetCDF format: types by number, and the tags of its lists.
_NETCDF_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


class _Netcdf:
    """The header of a classic NetCDF file (CDF-1 and CDF-2)."""

    def __init__(self, file):
        self.file = file
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("no classic NetCDF file")
        self.offset = ">i4" if magic[3] == 1 else ">i8"
        self.records = self.number()
        self.dimensions = [(self.name(), self.number()) for _ in range(self.list_of(_DIMENSIONS))]
        self.attributes()
        self.variables = dict(self.variable() for _ in range(self.list_of(_VARIABLES)))

    def number(self) -> int:
        return struct.unpack(">i", self.file.read(4))[0]

    def padded(self, size: int) -> bytes:
        return self.file.read(size + -size % 4)[:size]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def list_of(self, tag: int) -> int:
        found, count = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and count):
            raise ValueError("the header of the file is damaged")
        return count

    def attributes(self) -> dict[str, np.ndarray]:
        out = {}
        for _ in range(self.list_of(_ATTRIBUTES)):
            name, kind, count = self.name(), np.dtype(_NETCDF_KINDS[self.number()]), self.number()
            out[name] = np.frombuffer(self.padded(count * kind.itemsize), kind)
        return out

    def variable(self) -> tuple[str, dict]:
        name = self.name()
        dims = [self.number() for _ in range(self.number())]
        attributes, kind, size = self.attributes(), _NETCDF_KINDS[self.number()], self.number()
        begin = int(np.frombuffer(self.file.read(np.dtype(self.offset).itemsize), self.offset)[0])
        return name, {"dims": dims, "attributes": attributes, "kind": kind, "size": size, "begin": begin}


def netcdf_layout(file, size: int, name: str) -> Layout:
    """One variable of a classic NetCDF file, with its scale, offset and missing values."""
    header = _Netcdf(file)
    if name not in header.variables:
        raise ValueError(f"no variable {name!r} among {sorted(header.variables)}")
    v = header.variables[name]
    lengths = [header.dimensions[d][1] for d in v["dims"]]
    if len(lengths) < 2 or v["kind"] == "S1":
        raise ValueError(f"{name!r} is no tensor of numbers")
    inner, kind = tuple(lengths[:0:-1]), v["kind"]
    each = prod(inner) * np.dtype(kind).itemsize
    count, stride = lengths[0], each
    if lengths[0] == 0:  # the record dimension: records of all such variables lie one after the other
        of_record = [w for w in header.variables.values() if w["dims"] and header.dimensions[w["dims"][0]][1] == 0]
        stride = each if len(of_record) == 1 else sum(w["size"] for w in of_record)
        count = header.records if header.records >= 0 else (size - v["begin"]) // stride
    if count and v["begin"] + (count - 1) * stride + each > size:
        raise ValueError(f"the file ends within {name!r}")
    said = lambda key, other: float(v["attributes"].get(key, [other])[0])
    missing = tuple(float(v["attributes"][key][0]) for key in ("missing_value", "_FillValue") if key in v["attributes"])
    return Layout(count, inner, kind, True, v["begin"], stride, scale=said("scale_factor", 1.0), shift=said("add_offset", 0.0), missing=missing)


# Fixed values of TIFF: the fields that are read, sizes of field types, and sample formats.
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _TILE, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 322, 339
_FIELD_KINDS = {1: "u1", 3: "u2", 4: "u4"}
_SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}


def tiff_layout(file, size: int) -> Layout:
    """A stack of uncompressed one-channel images of one size, a position each, in strips."""
    raw = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at, pages, shape = struct.unpack(order + "I", raw[4:])[0], [], None
    while at:
        file.seek(at)
        (fields,) = struct.unpack(order + "H", file.read(2))
        block = file.read(12 * fields + 4)
        tags = {}
        for k in range(fields):
            tag, kind, count, value = struct.unpack(order + "HHI4s", block[12 * k : 12 * k + 12])
            if kind in _FIELD_KINDS:
                dtype = np.dtype(order + _FIELD_KINDS[kind])
                if count * dtype.itemsize > 4:
                    file.seek(struct.unpack(order + "I", value)[0])
                    value = file.read(count * dtype.itemsize)
                tags[tag] = np.frombuffer(value[: count * dtype.itemsize], dtype).tolist()
        one = lambda tag, other, tags=tags: tags.get(tag, [other])[0]
        if one(_COMPRESSION, 1) != 1 or one(_SAMPLES, 1) != 1 or _TILE in tags:
            raise ValueError("only uncompressed strips of one channel are read; give a decoder to read_series")
        found = (one(_WIDTH, 0), one(_LENGTH, 0), f"{order}{_SAMPLE_KINDS[one(_FORMAT, 1)]}{one(_BITS, 1) // 8}")
        shape = shape or found
        strips = tuple(zip(tags[_OFFSETS], tags[_COUNTS], strict=True))
        if found != shape or sum(n for _, n in strips) != found[0] * found[1] * np.dtype(found[2]).itemsize or any(a + n > size for a, n in strips):
            raise ValueError("the images of the stack differ in size, or the file ends within one")
        pages.append(strips)
        at = struct.unpack(order + "I", block[-4:])[0]
    if not pages:
        raise ValueError("the file has no images")
    return Layout(len(pages), shape[:2], shape[2], True, pieces=tuple(pages))


def layout_of(path: str, kind: str | None = None, variable: str | None = None) -> Layout:
    """From the file's header; ``kind`` (npy, video, netcdf, tiff) is else told by the path's ending."""
    kind = kind or {"npy": "npy", "bin": "video", "nc": "netcdf", "tif": "tiff", "tiff": "tiff"}.get(path.rsplit(".", 1)[-1].lower())
    with _opened(path) as file:
        size = file.size()
        if kind == "netcdf":
            return netcdf_layout(file, size, variable or "")
        if kind in ("npy", "video", "tiff"):
            return {"npy": npy_layout, "video": video_layout, "tiff": tiff_layout}[kind](file, size)
    raise ValueError(f"no reader for {path!r}; say its kind")


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class DenseFileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.layout = layout_of(self.path, options.get("kind"), options.get("variable"))
        self.low, self.high, self.among = 0, self.layout.count, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``at`` with constants are answered here in full."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("at",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
            elif isinstance(f, In):
                self.among = {*f.value} if self.among is None else self.among & {*f.value}
            else:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))

    def partitions(self) -> list[Range]:
        per, out = max(1, self.most // max(1, self.layout.bytes_each)), []
        wanted = range(self.low, self.high)
        spans = [(wanted.start, wanted.stop)] if self.among is None else [(k, k + 1) for k in sorted(self.among) if k in wanted]
        for a, b in spans:
            out += [Range(k, min(b, k + per)) for k in range(a, b, per)]
        return out or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as file:
            for at in range(partition.start, partition.stop):
                x = self.layout.numbers(b"".join(file.read_at(n, offset) for offset, n in self.layout.ranges(at)))
                lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64()))
                yield pa.record_batch([pa.array([at], pa.int32()), lists], ["at", "data"])


class DenseFile(DataSource):
    """``spark.read.format("dense_file").options(path=..., kind=..., variable=..., partitionBytes=...)``."""

    @classmethod
    def name(cls) -> str:
        return "dense_file"

    def schema(self) -> str:
        return "at int, data array<double>"

    def reader(self, schema) -> DenseFileReader:
        return DenseFileReader(self.options)


def read_dense(spark: SparkSession, path: str, kind: str | None = None, variable: str | None = None, partition_bytes: int = PARTITION_BYTES) -> Tensor:
    """The file as a tensor, its modes in the file's order: the slowest is the last one of ``.npy`` in Fortran order and of video, the first one of all
    others (images: page, row, column). Missing values are NaN. A filter on the slowest mode's index is pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DenseFile)
    layout = layout_of(path, kind, variable)
    options = {"path": path, "partitionBytes": str(partition_bytes)} | {k: v for k, v in (("kind", kind), ("variable", variable)) if v}
    rows = spark.read.format("dense_file").options(**options).load().select("at", F.posexplode("data").alias("place", "v"))
    names = index_names(len(layout.dims))
    slowest, inner = (names[0], names[:0:-1]) if layout.slowest_first else (names[-1], names[:-1])
    placed: dict[str, Column] = {slowest: F.col("at")} | dict(zip(inner, split_index(F.col("place"), layout.inner), strict=True))
    return Tensor(rows.select(*[placed[n].alias(n) for n in names], "v"), layout.dims)
