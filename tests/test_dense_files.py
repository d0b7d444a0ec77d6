"""Dense files by byte ranges: each format is written byte by byte here and read back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tubal.sources.dense_files import DenseFileReader, layout_of, read_dense
from tubal.tensor import to_numpy


def netcdf(path, records, fixed, version=1, scale=0.5, shift=3.0):
    """A file with a record variable ``air`` of shorts (time, lat, lon), one ``time`` of doubles, and a fixed variable ``mask`` of floats (lat, lon)."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    count, lat, lon = records.shape
    each = lat * lon * 2 + -(lat * lon * 2) % 4
    attribute = lambda n, kind, raw, k: name(n) + struct.pack(">ii", kind, k) + raw + b"\0" * (-len(raw) % 4)
    kind = ">i" if version == 1 else ">q"

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", count)
        out += struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", lat) + name("lon") + struct.pack(">i", lon)
        out += struct.pack(">ii", 12, 1) + attribute("title", 2, b"made", 4)
        own = struct.pack(">ii", 12, 3) + attribute("scale_factor", 5, struct.pack(">f", scale), 1) + attribute("add_offset", 5, struct.pack(">f", shift), 1) + attribute("missing_value", 3, struct.pack(">h", -99), 1)
        out += struct.pack(">ii", 11, 3)
        out += name("air") + struct.pack(">iiii", 3, 0, 1, 2) + own + struct.pack(">ii", 3, each) + struct.pack(kind, begins[0])
        out += name("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 8) + struct.pack(kind, begins[1])
        return out + name("mask") + struct.pack(">iii", 2, 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 5, lat * lon * 4) + struct.pack(kind, begins[2])

    size = len(header((0, 0, 0)))
    begins = (size + fixed.size * 4, size + fixed.size * 4 + each, size)
    body = fixed.astype(">f4").tobytes()
    for t in range(count):
        raw = records[t].astype(">i2").tobytes()
        body += raw + b"\0" * (each - len(raw)) + struct.pack(">d", t)
    path.write_bytes(header(begins) + body)


def tiff(path, pages, order="<", rows=2):
    """A stack of images in strips of some rows."""
    kind = {"f": 3, "u": 1, "i": 2}[pages.dtype.kind]
    out, last = bytearray(b"II" if order == "<" else b"MM"), 4
    out += struct.pack(order + "HI", 42, 0)
    for page in pages:
        strips = [page[r : r + rows].astype(pages.dtype.newbyteorder(order)).tobytes() for r in range(0, len(page), rows)]
        offsets = []
        for s in strips:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        lists = []
        for values in (offsets, [len(s) for s in strips]):
            lists.append(len(out))
            out += struct.pack(f"{order}{len(values)}I", *values)
        fields = [(256, 3, 1, page.shape[1]), (257, 3, 1, page.shape[0]), (258, 3, 1, pages.dtype.itemsize * 8), (259, 3, 1, 1), (273, 4, len(strips), None), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, len(strips), None), (339, 3, 1, kind)]
        struct.pack_into(order + "I", out, last, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, kind_, count, value in fields:
            if value is None:
                value = lists[tag == 279] if count > 1 else (offsets if tag == 273 else [len(strips[0])])[0]
            out += struct.pack(order + "HHI", tag, kind_, count) + (struct.pack(order + "HH", value, 0) if kind_ == 3 else struct.pack(order + "I", value))
        last = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(bytes(out))


@pytest.mark.parametrize("fortran", [True, False])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2"])
def test_npy(spark, tmp_path, fortran, kind):
    a = (np.random.default_rng(1).random((3, 4, 5)) * 100).astype(kind)
    np.save(tmp_path / "a.npy", np.asfortranarray(a) if fortran else a)
    t = read_dense(spark, str(tmp_path / "a.npy"), partition_bytes=100)
    assert t.dims == a.shape and np.array_equal(to_numpy(t), a)


def test_video(spark, tmp_path):
    video = np.random.default_rng(5).random((2, 3, 3, 7))
    (tmp_path / "v.bin").write_bytes(struct.pack("<IId", 2, 3, 25.0) + video.ravel(order="F").tobytes())
    t = read_dense(spark, str(tmp_path / "v.bin"), partition_bytes=300)
    assert np.array_equal(to_numpy(t), video) and t.cells.rdd.getNumPartitions() == 4
    (tmp_path / "short.bin").write_bytes((tmp_path / "v.bin").read_bytes()[:-1])
    with pytest.raises(ValueError):
        layout_of(str(tmp_path / "short.bin"))


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf(spark, tmp_path, version):
    g = np.random.default_rng(6)
    air, mask = g.integers(-500, 500, (6, 3, 5)), g.random((3, 5)).astype("f4")
    air[2, 1, 1] = -99
    netcdf(tmp_path / "air.nc", air, mask, version)
    want = np.where(air == -99, np.nan, air * 0.5 + 3.0)
    t = read_dense(spark, str(tmp_path / "air.nc"), variable="air", partition_bytes=64)
    assert t.dims == (6, 3, 5) and np.array_equal(to_numpy(t), want, equal_nan=True)
    assert np.array_equal(to_numpy(read_dense(spark, str(tmp_path / "air.nc"), variable="mask")), mask)
    for bad in ("time", "wind"):
        with pytest.raises(ValueError):
            layout_of(str(tmp_path / "air.nc"), variable=bad)
    (tmp_path / "cut.nc").write_bytes((tmp_path / "air.nc").read_bytes()[:-40])
    with pytest.raises(ValueError, match="ends"):
        layout_of(str(tmp_path / "cut.nc"), variable="air")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiff(spark, tmp_path, order, kind):
    pages = (np.random.default_rng(7).random((4, 5, 6)) * 200).astype(kind)
    tiff(tmp_path / "p.tif", pages, order)
    t = read_dense(spark, str(tmp_path / "p.tif"), partition_bytes=40)
    assert t.dims == (4, 5, 6) and np.array_equal(to_numpy(t), pages)


def test_only_wanted_bytes_are_read(spark, tmp_path):
    """Filters on the slowest mode become byte ranges; all else of the file is never opened."""
    a = np.random.default_rng(8).random((10, 10, 50))
    np.save(tmp_path / "a.npy", np.asfortranarray(a))
    path = str(tmp_path / "a.npy")

    def planned(*filters):
        reader = DenseFileReader({"path": path, "partitionBytes": "3000"})
        rest = list(reader.pushFilters(list(filters)))
        return rest, [k for p in reader.partitions() for k in range(p.start, p.stop)]

    assert planned(EqualTo(("at",), 7)) == ([], [7]) and planned(In(("at",), (3, 90, 9)))[1] == [3, 9]
    assert planned(GreaterThan(("at",), 40), LessThanOrEqual(("at",), 43))[1] == [41, 42, 43]
    assert planned(EqualTo(("at",), 99))[1] == [] and len(planned()[1]) == 50
    other = EqualTo(("v",), 1.0)
    assert planned(other) == ([other], list(range(50)))
    # The file's other frames are overwritten: were they read, they would show.
    layout = layout_of(path)
    raw = bytearray((tmp_path / "a.npy").read_bytes())
    for k in range(50):
        if k != 7:
            raw[layout.first + k * layout.stride : layout.first + (k + 1) * layout.stride] = b"\xff" * layout.stride
    (tmp_path / "a.npy").write_bytes(bytes(raw))
    cells = read_dense(spark, path).cells.where(F.col("i2") == 7)
    assert "EqualTo(at,7)" in cells._jdf.queryExecution().toString() or cells.rdd.getNumPartitions() == 1
    got = np.zeros((10, 10))
    for r in cells.collect():
        got[r.i0, r.i1] = r.v
    assert np.array_equal(got, a[:, :, 7])


def test_unknown_files(tmp_path):
    (tmp_path / "x.dat").write_bytes(b"0")
    with pytest.raises(ValueError):
        layout_of(str(tmp_path / "x.dat"))
    for name in ("x.tif", "x.nc"):
        (tmp_path / name).write_bytes(b"XXXXXXXXXXXX")
        with pytest.raises(ValueError):
            layout_of(str(tmp_path / name), variable="v")
