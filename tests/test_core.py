import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubal.functions import transforms
from tubal.operators import factors as fx
from tubal.operators import blocks, products, ragged, shape, threshold
from tubal.plans import analytics, compression
from tubal.sources import arrays, sinks, text
from tubal.sources.tables import tensor_from_table
from tubal.streaming.slices import compress_stream
from tubal.tensor import Matrix, dense, from_numpy, matrix_from_numpy, random_tensor, to_numpy


def counting(*dims):
    return np.arange(np.prod(dims), dtype=float).reshape(dims, order="F")


def slices_of(a):
    return a.reshape((a.shape[0], a.shape[1], -1), order="F")


def test_cells_and_shape(spark):
    a = counting(5, 4, 3, 2)
    t = from_numpy(spark, a)
    assert np.array_equal(to_numpy(t), a)
    assert np.array_equal(to_numpy(shape.permute(t, [2, 0, 3, 1])), a.transpose(2, 0, 3, 1))
    assert np.array_equal(to_numpy(shape.reshape(t, (20, 6))), a.reshape((20, 6), order="F"))
    assert np.array_equal(shape.unfold(t, [0, 1]).to_numpy(), a.reshape((20, 6), order="F"))
    assert shape.norm(t).first()[0] == pytest.approx(np.linalg.norm(a))
    got = {(r.i0, r.i1): r.v for r in shape.frontal_slice(t, 4).collect()}
    assert all(got[i, j] == slices_of(a)[i, j, 4] for i in range(5) for j in range(4))
    swapped = to_numpy(shape.with_slice(t, 1, shape.frontal_slice(t, 0)))
    assert np.array_equal(slices_of(swapped)[..., 1], slices_of(a)[..., 0])
    assert dense(t.with_cells(t.cells.where("v > 100"))).cells.count() == a.size
    assert random_tensor(spark, (3, 4, 5)).cells.agg(F.min("v"), F.max("v")).first()[1] < 100
    centered, _ = shape.center(t, 3)
    assert np.allclose(to_numpy(centered), a - a.mean(axis=3, keepdims=True))
    for bad in (lambda: shape.permute(t, [0, 1]), lambda: shape.reshape(t, (7, 7)), lambda: shape.frontal_slice(t, 6)):
        with pytest.raises(ValueError):
            bad()


def test_matrix_parts(spark):
    a = counting(4, 3)
    m = matrix_from_numpy(spark, a)
    assert shape.get_element(m, 2, 1).first()[0] == a[2, 1]
    assert shape.set_element(m, 2, 1, -1).to_numpy()[2, 1] == -1
    sparse = Matrix(m.entries.where("v > 100"), 4, 3)
    assert shape.get_element(sparse, 2, 1).first()[0] == 0 and shape.set_element(sparse, 2, 1, 5).to_numpy().sum() == 5
    assert sorted(r.v for r in shape.get_row(m, 1).collect()) == sorted(a[1])
    assert np.array_equal(shape.set_column(m, 0, shape.get_column(m, 2)).to_numpy()[:, 0], a[:, 2])
    assert np.array_equal(shape.set_row(m, 0, shape.get_row(m, 3)).to_numpy()[0], a[3])
    assert np.allclose(products.matmul(m, m.transposed()).to_numpy(), a @ a.T)
    assert shape.matrix_norm(m).first()[0] == pytest.approx(np.linalg.norm(a))
    with pytest.raises(ValueError):
        products.matmul(m, m)


@pytest.mark.parametrize("mode,rows", [(0, 3), (1, 6), (2, 2), (3, 3)])
def test_mode_products(spark, mode, rows):
    a = counting(5, 4, 3, 2)
    m = counting(rows, a.shape[mode])
    want = np.moveaxis(np.tensordot(m, a, (1, mode)), 0, mode)
    t = from_numpy(spark, a)
    assert np.allclose(to_numpy(products.ttm(t, matrix_from_numpy(spark, m), mode)), want)
    if mode >= 2:
        assert np.allclose(to_numpy(products.ttm_tubes(t, [m], [mode], block_cells=20)), want)
    with pytest.raises(ValueError):
        products.ttm(t, matrix_from_numpy(spark, m), (mode + 1) % 4)


def test_transforms(spark):
    assert transforms.orthonormality_error(transforms.dct(spark, 7)).first()[0] < 1e-12
    assert np.allclose(transforms.dct(spark, 7).to_numpy(), transforms.dct_array(7))
    a = np.random.default_rng(0).standard_normal((3, 4, 5, 6))
    t = from_numpy(spark, a)
    for strategy in ("cells", "tubes"):
        forward, inverse, modes = compression.mode_transforms(t, "dct")
        back = products.transform(products.transform(t, forward, modes, strategy), inverse, modes, strategy)
        assert np.allclose(to_numpy(back), a)
    assert products.transform(t, [], []) is t


@pytest.mark.parametrize("dims", [(10, 4, 3, 2), (3, 10, 3, 2), (4, 3)])
def test_slice_svd(spark, dims):
    a = counting(*dims)
    s3 = slices_of(a)
    slices = fx.to_slices(from_numpy(spark, a))
    sigma = {(r.slice, r.q): r.sigma for r in fx.singular_values(slices).collect()}
    for i in range(s3.shape[2]):
        assert np.allclose([sigma[i, q] for q in range(min(dims[:2]))], np.linalg.svd(s3[..., i], compute_uv=False), atol=1e-9)
    assert np.allclose(to_numpy(fx.to_cells(fx.multiply(fx.decompose(slices)), dims)), a)
    with pytest.raises(Exception):
        fx.decompose(slices, 11).collect()


def test_ragged_ranks(spark):
    a = np.random.default_rng(1).standard_normal((5, 4, 3, 2))
    slices = fx.to_slices(from_numpy(spark, a))
    ks = [4, 3, 0, 2, 0, 3]
    ranks = spark.createDataFrame(list(enumerate(ks)), "slice long, k int")
    one = to_numpy(fx.to_cells(fx.multiply(fx.truncate(fx.decompose(slices), ranks)), a.shape))
    two = to_numpy(fx.to_cells(fx.multiply(fx.decompose_ranks(slices, ranks)), a.shape))
    assert np.allclose(one, two)
    for i, k in enumerate(ks):
        u, s, vt = np.linalg.svd(slices_of(a)[..., i], full_matrices=False)
        assert np.allclose(slices_of(one)[..., i], (u[:, :k] * s[:k]) @ vt[:k])
    cut = fx.truncate(fx.decompose(slices), ranks)
    assert fx.stored_numbers(cut).first()[0] == sum(k * 10 for k in ks)


def brute_cutoff(values, tol):
    s = np.sort(values)
    cum = np.cumsum(s * s)
    if cum[-1] == 0:
        return 0.0
    at = np.searchsorted(cum / cum[-1], tol * tol, side="right")
    return 0.0 if at == 0 else s[at - 1]


@pytest.mark.parametrize("tol", [1e-4, 1e-2, 0.1, 0.3, 0.7])
def test_threshold(spark, tol):
    values = np.random.default_rng(2).random((4, 30)) * np.logspace(-6, 0, 30)
    df = spark.createDataFrame([(i, q, float(v)) for i, row in enumerate(values) for q, v in enumerate(row)], "slice long, q int, sigma double")
    want = brute_cutoff(values.ravel(), tol)
    assert threshold.cutoff(df, tol).first()[0] == pytest.approx(want)
    assert {r.slice: r.k for r in threshold.ranks(df, tol).collect()} == {i: int((row >= want).sum()) for i, row in enumerate(values)}


def test_threshold_ties_and_zero(spark):
    zero = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0)], "slice long, q int, sigma double")
    assert threshold.cutoff(zero, 0.1).first()[0] == 0
    assert [r.k for r in threshold.ranks(zero, 0.1).collect()] == [1, 1]
    ties = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)], "slice long, q int, sigma double")
    assert threshold.cutoff(ties, 0.35).first()[0] == 1.0  # one of the two ones can go; both stay
    assert {r.slice: r.k for r in threshold.ranks(ties, 0.35).collect()} == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        threshold.cutoff(ties, 1.0)


@pytest.mark.parametrize("kind", ["dct", "eye", "hosvd", "hosvd_t"])
def test_compress(spark, kind):
    a = np.random.default_rng(3).standard_normal((6, 5, 4, 3))
    t = from_numpy(spark, a)
    c = compression.compress(t, kind, tol=0.3)
    back = to_numpy(compression.reconstruct(c))
    error = np.linalg.norm(back - a) / np.linalg.norm(a)
    assert error <= 0.3
    row = compression.report(t, c).first()
    assert row.relative_err == pytest.approx(error) and row.n_slices == 12
    full = compression.reconstruct(compression.compress(t, kind, rank=5))
    assert np.allclose(to_numpy(full), a)
    with pytest.raises(ValueError):
        compression.compress(t, kind)


def test_baselines(spark):
    r = np.random.default_rng(4)
    a = np.einsum("ir,jr,kr->ijk", *(r.standard_normal((n, 2)) for n in (6, 5, 8)))
    t = from_numpy(spark, a)
    back, k, ratio = compression.eof(t, 0.01)
    assert k == 2 and np.allclose(to_numpy(back), a) and ratio == pytest.approx(240 / (2 * 39))
    core, vectors = compression.hosvd(t, tol=1e-6)
    assert core.dims == (2, 2, 2) and np.allclose(to_numpy(compression.hosvd_back(core, vectors)), a)
    assert compression.hosvd(t, share=0.5)[0].dims == (3, 3, 4)


def test_files(spark, tmp_path):
    a = counting(3, 4, 5)
    for k in range(2):
        np.save(tmp_path / f"{k}.npy", a + k)
    paths = [str(tmp_path / f"{k}.npy") for k in range(2)]
    assert np.array_equal(to_numpy(arrays.read_npy(spark, paths[0], a.shape)), a)
    series = arrays.read_series(spark, paths, a.shape)
    assert np.array_equal(to_numpy(series), np.stack([a, a + 1], axis=-1))
    both = arrays.read_yearly([from_numpy(spark, a), from_numpy(spark, a + 1)])
    assert np.array_equal(to_numpy(both), np.concatenate([a, a + 1], axis=2))
    video = np.random.default_rng(5).random((2, 3, 3, 4))
    content = struct.pack("<IId", 2, 3, 25.0) + video.ravel(order="F").tobytes()
    (tmp_path / "v.bin").write_bytes(content)
    assert arrays.video_header(content) == (2, 3, 25.0, 4)
    t = arrays.read_video(spark, str(tmp_path / "v.bin"), (2, 3, 3, 4))
    assert np.array_equal(to_numpy(t), video)
    gray = to_numpy(products.ttm(t, transforms.gray(spark), 2))
    assert np.allclose(gray[:, :, 0], np.einsum("hwct,c->hwt", video, transforms.GRAY))
    decoded = arrays.read_decoded(spark, paths[1], a.shape, lambda b: np.load(io.BytesIO(b)))
    assert np.array_equal(to_numpy(decoded), a + 1)
    sinks.write_tensor(from_numpy(spark, a), str(tmp_path / "t"))
    assert np.array_equal(to_numpy(sinks.read_tensor(spark, str(tmp_path / "t"))), a)
    pixels = spark.createDataFrame([(-3.0,), (12.9,), (300.0,)], "v double").select(sinks.as_pixel(F.col("v"))).collect()
    assert [r[0] for r in pixels] == [0, 12, 255]
    json.loads(next((tmp_path / "t" / "metadata").glob("*.json")).read_text())


def test_upsert_and_calendar(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (None, "y"), (3, "z")], "k int, v string")
    assert {(r.k, r.v) for r in sinks.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "x"), (None, "y"), (3, "z")}
    steps = spark.range(1464).select(F.lit(2004).alias("year"), F.col("id").alias("step")).unionByName(spark.range(1460).select(F.lit(1900).alias("year"), F.col("id").alias("step")))
    folded = analytics.fold_calendar(steps)
    assert {(r.year, r.n, r.d) for r in folded.groupBy("year").agg(F.count("*").alias("n"), F.max("doy").alias("d")).collect()} == {(2004, 1460, 364), (1900, 1460, 364)}


def test_extremes(spark):
    a = np.random.default_rng(6).random((2, 3, 200)) + 1
    b = a * 1.01
    rows = analytics.extremes(from_numpy(spark, a), from_numpy(spark, b)).collect()
    assert len(rows) == 6
    for r in rows:
        x = a[r.i0, r.i1]
        lo, hi = np.percentile(x, [0.5, 99.5])
        assert r.n_extreme == ((x <= lo) | (x >= hi)).sum() and r.mean_err == pytest.approx(0.01)


def test_stream(spark, tmp_path):
    a = counting(4, 3, 6)
    fx.to_slices(from_numpy(spark, a)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slice long, nrow int, ncol int, data array<double>").parquet(str(tmp_path / "in"))
    query = compress_stream(stream, 2, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    back = fx.to_cells(fx.multiply(spark.read.parquet(str(tmp_path / "out"))), a.shape)
    assert np.allclose(to_numpy(back), a)  # these slices have rank 2


def test_gram_and_leading_vectors(spark, monkeypatch):
    r = np.random.default_rng(40)
    a = r.standard_normal((60, 5)) @ r.standard_normal((5, 90))
    m = matrix_from_numpy(spark, a)
    got = np.zeros((60, 60))
    for x in compression.gram(m).collect():
        got[x.a, x.b] = x.g
    assert np.allclose(got, a @ a.T)
    want = np.linalg.svd(a, compute_uv=False)[:5] ** 2
    energies, vectors = compression.leading_vectors(m, 5)
    u = vectors.to_numpy()
    assert np.allclose(energies, want) and np.allclose(u @ (u.T @ a), a)
    monkeypatch.setattr(compression, "GRAM_ROWS", 20)
    t = from_numpy(spark, a.T.reshape((9, 10, 60), order="F"))
    back, k, _ = compression.eof(t, 1e-6, k_max=8)
    assert k == 5 and np.allclose(to_numpy(back), to_numpy(t))
    with pytest.raises(ValueError):
        compression.gram(m)


def test_blocks(spark):
    dims = (4, 3, 5, 2)
    a = np.random.default_rng(41).standard_normal(dims)
    b = blocks.blocks_of(from_numpy(spark, a), block_cells=25)
    m2, m3 = counting(3, 5), counting(4, 2)
    moved, new = blocks.transform_blocks(b, dims, [m2, m3], [2, 3])
    want = np.einsum("kc,ijcd,ld->ijkl", m2, a, m3)
    assert new == (4, 3, 3, 4) and np.allclose(to_numpy(blocks.cells_of(moved, new, 2)), want)
    assert np.allclose(to_numpy(fx.to_cells(blocks.block_slices(moved, new), new)), want)
    assert blocks.block_slices(blocks.random_blocks(spark, (6, 5, 7), block_cells=28), (6, 5, 7)).count() == 7


def test_ragged(spark):
    ranks = [4, 3, 0, 2, 0, 3]
    values = np.arange(5.0 * sum(ranks))
    t = ragged.ragged_tensor(spark, values, 5, ranks)
    assert [r.v for r in ragged.flat(t).orderBy("at").collect()] == values.tolist()
    one = ragged.get_slice(t, 1).first()
    assert (one.nrow, one.ncol, list(one.data)) == (5, 3, values[20:35].tolist())
    changed = ragged.with_slice(t, 3, [-1.0] * 10)
    assert [r.v for r in ragged.flat(changed).orderBy("at").collect()] == [*values[:35], *[-1.0] * 10, *values[45:]]
    assert list(ragged.ragged_tensor(spark, values, 5, ranks, True).where("slice = 1").first()[1:3]) == [3, 5]
    m = ragged.ragged_matrix(spark, values[:9], [2, 3, 2, 2])
    assert ragged.get_value(m, 2, 1).first()[0] == 4 and [r.v for r in ragged.get_column(m, 3).orderBy("r").collect()] == [7, 8]
    assert list(ragged.set_value(m, 0, 2, 9).where("c = 2").first().data) == [9, 6]
    assert list(ragged.with_column(m, 0, [3, 4]).where("c = 0").first().data) == [3, 4]
    for bad in (lambda: ragged.get_value(m, 2, 0), lambda: ragged.set_value(m, 2, 0, 1), lambda: ragged.with_slice(t, 1, [1.0]), lambda: ragged.with_column(m, 1, [1.0])):
        with pytest.raises(Exception):
            bad().collect()
    with pytest.raises(ValueError):
        ragged.ragged_matrix(spark, [1.0], [2])


def test_normalised_and_levels(spark):
    a = counting(3, 4, 5)
    t = from_numpy(spark, a)
    assert np.allclose(to_numpy(shape.normalised(t)), a / np.linalg.norm(a))
    assert np.array_equal(to_numpy(shape.normalised(t.with_cells(t.cells.where("v < 0")))), np.zeros(a.shape))
    assert np.array_equal(to_numpy(shape.at_level(t, 2, [1000, 925, 850, 700, 600], 850)), a[:, :, 2])
    with pytest.raises(ValueError):
        shape.at_level(t, 2, [1000, 925, 850, 700, 600], 500)


LOG = """alg      : two
mtype    : dct
k        : None
tol      : 0.01
dname    : air
dfile    : /data/air
perm_mode: default (identity)
Tensor shape: (73, 144, 17)
Time to generate transformation matrices: 0.5
Time to convert to dense tensor: 1.25
[two_compress] ttm_modes [2, 3]
[two_compress] Time for TTM on mode 2 : 1.5
[two_compress] Time for TTM on mode 3 : 2.5e-1
[two_compress] Time for slicewise_svdvals: 3
[two_compress] Time for thresholds: 0.25
[two_compress] Time for slicewise_svdks: 4
Compression ratio: 12.5
[two_reconstruct] Time to reconstruct A_hat: 5
[two_reconstruct] Time for TTM on mode 3 : 6
[two_reconstruct] Time for TTM on mode 2 : 7
Absolute err: 1e-3
Relative err: {err}
Norm of original tensor: 100
Norm of reconstructed tensor: 99.5
"""


def test_logs(spark, tmp_path):
    names = {"air_two_0.01_dct_0123_64_run3": LOG.format(err="0.009"), "air_two_0.01_dct_0123_8": LOG.format(err="-nan"), "odd_run1": LOG.split("Compression")[0], "x": "?"}
    for name, content in names.items():
        (tmp_path / name).write_text(content)
    logs = text.read_logs(spark, str(tmp_path))
    got = {r.filename: r for r in analytics.parse_logs(logs).collect()}
    assert set(got) == set(names) and len(analytics.LOG_COLUMNS) == 31
    r = got["air_two_0.01_dct_0123_64_run3"]
    assert r.complete and (r.dname_f, r.k_or_tol_f, r.omp_threads_f, r.run_id, r.tensor_shape, r.perm_mode, r.k) == ("air", "0.01", "64", "run3", "(73, 144, 17)", "default (identity)", "None")
    assert (r.time_compress_ttm_total, r.time_reconstruct_ttm_total, r.time_slicewise_svd, r.time_slicewise_svdks, r.time_reconstruct_matmul, r.compression_ratio) == (1.75, 13, None, 4, 5, 12.5)
    assert not got["air_two_0.01_dct_0123_8"].complete and got["air_two_0.01_dct_0123_8"].run_id is None
    assert not got["odd_run1"].complete and got["odd_run1"].dname_f is None and got["odd_run1"].time_reconstruct_ttm_total is None
    times = analytics.phase_times(logs.where(F.col("file").endswith("run3"))).collect()
    assert {(x.phase, x.mode, x.time_sec) for x in times} == {("compress", 2, 1.5), ("compress", 3, 0.25), ("reconstruct", 3, 6), ("reconstruct", 2, 7)}


def test_log_lines(spark):
    lines = ["alg      : two  ", "mtype: dct", "perm_mode: 1 0 2  ", "Relative err: none", "Relative err: 0.5", "Relative err: 0.7", "Absolute err:3", "Compression ratio: Inf"]
    lines += ["[one_compress] Time for TTM on mode 2 : 1", "[one_reconstruct] starts", "[one_compress] Time for TTM on mode 3 : 8", "[one_compress] Time for thresholds: 8"]
    lines += ["[one_reconstruct] Time for TTM on mode 2 : 2", "Norm of original tensor: 4", "x Norm of reconstructed tensor: 4"]
    logs = spark.createDataFrame([("a", "\r\n".join(lines)), ("b", ""), ("c", None)], "file string, content string")
    a, b, c = sorted(analytics.parse_logs(logs).collect(), key=lambda r: r.filename)
    assert (a.alg, a.mtype, a.perm_mode, a.relative_err, a.absolute_err, a.norm_original, a.norm_reconstructed) == ("two", None, "1 0 2", 0.5, None, 4, None)
    assert (a.time_compress_ttm_total, a.time_thresholds, a.time_reconstruct_ttm_total, a.compression_ratio, a.complete) == (1, None, 2, float("inf"), False)
    assert all(x is None for r in (b, c) for k, x in r.asDict().items() if k not in ("filename", "complete")) and not b.complete and not c.complete
    times = analytics.phase_times(logs).collect()
    assert {(x.file, x.phase, x.mode, x.time_sec) for x in times} == {("a", "compress", 2, 1), ("a", "reconstruct", 2, 2)}


def test_csv_upsert_and_saved(spark, tmp_path):
    path, schema, keys = str(tmp_path / "t"), "dname string, mode int, time_sec double", ["dname", "mode"]
    row = lambda *r: spark.createDataFrame([r], schema)
    text.upsert_csv(spark, path, row("a", 2, text.STARTED), keys, schema)
    text.upsert_csv(spark, path, row("a", 3, 7.5), keys, schema)
    text.upsert_csv(spark, path, row("a", 2, 1.5), keys, schema)
    got = text.read_csv(spark, path, schema)
    assert got.columns == ["dname", "mode", "time_sec"] and {tuple(r) for r in got.collect()} == {("a", 2, 1.5), ("a", 3, 7.5)}
    made = []
    for _ in range(2):
        text.saved_or(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]


def test_years(spark, tmp_path):
    r, paths, want = np.random.default_rng(42), [], []
    for year in (2003, 2004):
        raw = r.random((4 * (366 if year == 2004 else 365), 2, 3, 1))  # time, level, lat, lon
        np.save(tmp_path / f"air.{year}.npy", raw)
        paths.append(str(tmp_path / f"air.{year}.npy"))
        a = raw.transpose(2, 3, 1, 0)
        a = np.delete(a, slice(236, 240), axis=3) if year == 2004 else a
        want.append(a.reshape((3, 1, 2, 4, 365), order="F"))
    t = arrays.read_years(spark, paths, 2003, (3, 1, 2), axes=(2, 3, 1, 0))
    assert t.dims == (3, 1, 2, 4, 365, 2) and np.array_equal(to_numpy(t), np.stack(want, axis=-1))


def test_extremes_of_missing_cells(spark):
    a = np.zeros((1, 2, 200))
    a[0, 0, :3], a[0, 1] = [5, -7, 9], np.arange(200)
    t = from_numpy(spark, a)
    sparse = t.with_cells(t.cells.where("v <> 0"))
    one, two = (sorted(map(tuple, analytics.extremes(x, x).select("i1", "n_extreme", "max_err").collect())) for x in (t, sparse))
    assert one == two


def test_threshold_of_equal_values(spark):
    values = [1.0] * 500 + [1.0 + k / 5000 for k in range(100)] + [0.0] * 50
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(values)], "slice long, q int, sigma double")
    for tol in (0.05, 0.5, 0.92, 0.97):
        assert threshold.cutoff(df, tol).first()[0] == pytest.approx(brute_cutoff(np.array(values), tol))


def test_rows_outside_the_modes(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, float("nan")), (5, 4.0), (None, 8.0)], "k int, v double")
    modes = [(F.col("k"), 2), (F.lit(0), 1)]
    assert to_numpy(tensor_from_table(df, modes, F.col("v"))).tolist() == [[1.0], [2.0]]
    assert tensor_from_table(df.where("k < 2"), modes, F.col("v"), strict=True).cells.count() == 2
    for bad in ("k < 2 or k > 4", "k < 2 or k is null"):
        with pytest.raises(Exception):
            tensor_from_table(df.where(bad), modes, F.col("v"), strict=True).cells.collect()


def test_kept_partitions_follow_the_tensor(spark):
    """Whatever the shuffle partitions are, a small tensor's reductions are kept in one, of which readers have one task each."""
    t, usual = random_tensor(spark, (6, 5, 4, 3)), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for c in (compression.compress(t, "dct", tol=0.2), compression.compress_blocks(blocks.to_blocks(t, 40), "dct", tol=0.2)):
            assert c.kept.rdd.getNumPartitions() == 1 and c.factors.count() == 12
            c.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert random_tensor(spark, (64, 64, 65)).tasks == 2
