"""Versioned tables, tolerance over arriving slices, and table functions."""

import numpy as np
import pytest

from tubal.functions import tables
from tubal.operators import factors as fx
from tubal.plans import compression
from tubal.sources import text
from tubal.sources.versioned import Conflict, VersionedTable
from tubal.streaming.tolerance import factors_so_far, keep_arriving, ranks_so_far
from tubal.tensor import from_numpy, to_numpy

SCHEMA = "name string, run int, time double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.version() == 0 and rows(t.read()) == []
    assert t.upsert(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], SCHEMA), ["name", "run"]) == 1
    assert t.upsert(spark.createDataFrame([("b", 1, 3.0), ("c", 2, None)], SCHEMA), ["name", "run"]) == 2
    assert rows(t.read()) == [("a", 1, 1.0), ("b", 1, 3.0), ("c", 2, None)] and rows(t.read(1)) == [("a", 1, 1.0), ("b", 1, 2.0)]


@pytest.mark.parametrize("step", ["_write", "_publish", "_rename"])
def test_a_writer_that_dies(spark, tmp_path, monkeypatch, step):
    """Before or within any step: the old version is there, and the next writer goes on from it."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    t.upsert(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), ["name"])
    new = spark.createDataFrame([("a", 1, 2.0)], SCHEMA)
    real = getattr(VersionedTable, step)

    def dies(self, *args):
        if step == "_write":
            real(self, *args)  # the data is written, and no version names it
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, step, dies)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(new, ["name"])
    monkeypatch.setattr(VersionedTable, step, real)
    assert t.version() == 1 and rows(t.read()) == [("a", 1, 1.0)]
    assert t.upsert(new, ["name"]) == 2 and rows(t.read()) == [("a", 1, 2.0)]
    t.drop_old(1)
    assert t.versions() == [2] and rows(t.read()) == [("a", 1, 2.0)] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 1


def test_two_writers(spark, tmp_path):
    one, two = (VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA) for _ in range(2))
    at = one.version()
    assert one.commit(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), at) == 1
    with pytest.raises(Conflict):
        two.commit(spark.createDataFrame([("b", 1, 1.0)], SCHEMA), at)
    assert rows(two.read()) == [("a", 1, 1.0)]
    assert two.upsert(spark.createDataFrame([("b", 1, 1.0)], SCHEMA), ["name"], tries=3) == 2 and len(rows(one.read())) == 2


def test_csv_writer_that_dies(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "t"), ["name", "run"]
    text.upsert_csv(spark, path, spark.createDataFrame([("a", 1, 1.0)], SCHEMA), keys, SCHEMA)
    real, calls = text._rename, []

    def dies(spark_, old, new):
        calls.append(new)
        if len(calls) == 2:
            raise KeyboardInterrupt  # the old table is aside, the new one has no name yet
        real(spark_, old, new)

    monkeypatch.setattr(text, "_rename", dies)
    with pytest.raises(KeyboardInterrupt):
        text.upsert_csv(spark, path, spark.createDataFrame([("b", 1, 2.0)], SCHEMA), keys, SCHEMA)
    monkeypatch.setattr(text, "_rename", real)
    text.upsert_csv(spark, path, spark.createDataFrame([("c", 1, 3.0)], SCHEMA), keys, SCHEMA)
    assert rows(text.read_csv(spark, path, SCHEMA)) == [("a", 1, 1.0), ("c", 1, 3.0)]


def test_tolerance_over_arriving_slices(spark, tmp_path):
    """In three pieces with restarts between, one slice sent twice: the ranks, and the error, of all slices together."""
    a = np.random.default_rng(1).standard_normal((4, 5, 9)) * np.logspace(0, -2, 9)
    t = from_numpy(spark, a)
    slices = fx.to_slices(t).persist()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 4), (4, 7), (6, 9)):
        slices.where(f"slice >= {low} and slice < {high}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(slices.schema).parquet(source)
        keep_arriving(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    whole = compression.compress(t, "eye", tol=0.2)
    assert {r.slice: r.k for r in ranks_so_far(spark, out, 0.2).collect()} == {r.slice: r.k for r in whole.factors.collect()}
    back = to_numpy(fx.to_cells(fx.multiply(factors_so_far(spark, out, 0.2)), a.shape))
    assert np.allclose(back, to_numpy(compression.reconstruct(whole))) and np.linalg.norm(back - a) <= 0.2 * np.linalg.norm(a)
    slices.unpersist()


def test_table_functions(spark):
    a = np.random.default_rng(2).standard_normal((3, 4, 5))
    t = from_numpy(spark, a)
    tables.register(spark)
    t.cells.createOrReplaceTempView("cells")
    got = {(r.slice, r.q): r.sigma for r in spark.sql("SELECT * FROM slice_values(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 3, 4)").collect()}
    want = {(r.slice, r.q): r.sigma for r in fx.singular_values(fx.to_slices(t)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    cells = spark.sql("SELECT slice AS i2, i0, i1, v FROM slice_rank(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 3, 4, 2)")
    assert np.allclose(to_numpy(t.with_cells(cells)), to_numpy(compression.reconstruct(compression.compress(t, "eye", rank=2))))
    for bad in ("slice_values(TABLE(SELECT i0, i1, v FROM cells), 3, 4)", "slice_values(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 0, 4)", "slice_values(TABLE(SELECT i2 AS slice, i0, i1, v FROM cells), 2, 4)"):
        with pytest.raises(Exception, match="slice|number|place"):
            spark.sql(f"SELECT * FROM {bad}").collect()
