"""Block matrices, tall decompositions, subspaces, dense compression and kept reductions, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubal.operators import block_matrix, blocks, kept, ragged, shape, threshold
from tubal.operators import factors as fx
from tubal.plans import compression
from tubal.tensor import Matrix, Tensor, from_numpy, matrix_from_numpy, to_numpy


def rank_r(rows, columns, r, seed=0):
    g = np.random.default_rng(seed)
    return g.standard_normal((rows, r)) @ g.standard_normal((r, columns))


@pytest.mark.parametrize("edge,cube", [(8, 2), (5, 1), (64, 2)])
def test_block_product(spark, edge, cube):
    g = np.random.default_rng(1)
    a, b = g.random((37, 53)), g.random((53, 29))
    a[8:16, 16:24] = 0  # blocks of zeros have no row
    left, right = (block_matrix.to_blocks(matrix_from_numpy(spark, x), edge, edge) for x in (a, b))
    got = block_matrix.multiply(left, right, cube)
    assert np.allclose(got.entries().to_numpy(), a @ b)
    assert np.allclose(got.transposed().entries().to_numpy(), (a @ b).T)
    with pytest.raises(ValueError):
        block_matrix.multiply(left, left)


def test_product_of_nothing(spark):
    none = Matrix(matrix_from_numpy(spark, np.ones((1, 1))).entries.where("v > 1"), 4, 4)
    assert block_matrix.matmul(none, none).entries.count() == 0


def test_product_has_no_row_for_each_pair(spark):
    """512 x 512 squared in blocks of 128: no operator has more rows than there are entries."""
    g = np.random.default_rng(2)
    a = g.random((512, 512))
    cells = spark.range(512 * 512).select((F.col("id") % 512).alias("r"), F.floor(F.col("id") / 512).alias("c"), F.rand(3).alias("v"))
    m = Matrix(cells, 512, 512)
    m = Matrix(m.entries.persist(), 512, 512)
    a = m.to_numpy()
    found = block_matrix.multiply(block_matrix.to_blocks(m, 128, 128), block_matrix.to_blocks(m, 128, 128))
    got = found.frame.toArrow()
    assert got.num_rows == 16
    out = np.zeros((512, 512))
    for i, j, data in zip(got["i"].to_pylist(), got["j"].to_pylist(), got["data"].to_pylist(), strict=True):
        out[i * 128 : (i + 1) * 128, j * 128 : (j + 1) * 128] = np.frombuffer(data).reshape(128, 128)
    assert np.allclose(out, a @ a)
    m.entries.unpersist()


@pytest.mark.parametrize("a", [rank_r(300, 7, 7), rank_r(6, 90, 6), rank_r(9, 9, 9), rank_r(120, 5, 3), np.zeros((20, 3)), np.ones((1, 4))], ids=["tall", "wide", "square", "deficient", "zero", "row"])
def test_tall_svd(spark, a):
    """Row blocks of 70 entries, so that the tree has levels."""
    m = matrix_from_numpy(spark, a)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose([r.sigma for r in block_matrix.singular_values(m).orderBy("q").collect()], want)
    found = block_matrix.tall_svd(m, entries=70)
    assert np.allclose(found.s, want) and np.allclose(found.product().to_numpy(), a)
    long, real = found.long.entries().to_numpy(), want > 1e-9
    assert np.allclose((long.T @ long)[real][:, real], np.eye(real.sum()))
    found.drop()
    k = 2 if min(a.shape) > 1 else 1
    leading = block_matrix.tall_svd(m, k, entries=70)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(leading.product().to_numpy(), (u[:, :k] * s[:k]) @ vt[:k])
    with pytest.raises(ValueError):
        block_matrix.tall_svd(m, 100)


def test_tall_svd_of_ill_conditioned(spark):
    """Vectors of small values are as orthogonal as the others: they come down the tree, not from a product with an inverse."""
    g = np.random.default_rng(3)
    q, _ = np.linalg.qr(g.standard_normal((400, 6)))
    a = q @ np.diag([1e6, 1, 1e-2, 1e-4, 1e-5, 1e-6]) @ np.linalg.qr(g.standard_normal((6, 6)))[0]
    found = block_matrix.tall_svd(matrix_from_numpy(spark, a), entries=120)
    u = found.long.entries().to_numpy()
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-12


def test_two_long_sides_are_told(spark, monkeypatch):
    monkeypatch.setattr(block_matrix, "DRIVER_ENTRIES", 25)
    with pytest.raises(ValueError):
        block_matrix.tall_svd(matrix_from_numpy(spark, np.ones((7, 6))))
    with pytest.raises(ValueError):
        block_matrix.leading_subspace(block_matrix.to_blocks(matrix_from_numpy(spark, np.ones((7, 6)))), 6)


def test_leading_subspace(spark):
    a = rank_r(120, 90, 12, 5) + 1e-3 * np.random.default_rng(6).random((120, 90))
    found = block_matrix.leading_subspace(block_matrix.to_blocks(matrix_from_numpy(spark, a), 50, 40), 5)
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(found.energies, s[:5] ** 2) and found.total == pytest.approx((a * a).sum()) and found.residual <= 1e-7
    got = found.vectors.entries().to_numpy()
    assert np.allclose(got @ got.T, u[:, :5] @ u[:, :5].T, atol=1e-6)


def test_subspace_is_an_error_where_it_does_not_converge(spark):
    a = np.random.default_rng(7).standard_normal((60, 60))
    with pytest.raises(ValueError, match="residual"):
        block_matrix.leading_subspace(block_matrix.to_blocks(matrix_from_numpy(spark, a), 30, 30), 5, oversample=1, most=1)


def test_long_modes(spark, monkeypatch):
    """Modes that are longer than a Gram matrix may be: the basis stays on the cluster, the results are those of the short way."""
    g = np.random.default_rng(8)
    a = np.einsum("ir,jr,kr->ijk", *(g.standard_normal((n, 3)) for n in (6, 5, 60)))
    t = from_numpy(spark, a)
    short = compression.eof(t, 0.05)
    monkeypatch.setattr(compression, "GRAM_ROWS", 20)
    long = compression.eof(t, 0.05)
    assert short[1:] == long[1:] and np.allclose(to_numpy(short[0]), to_numpy(long[0]), atol=1e-6)
    core, vectors = compression.hosvd(t, tol=1e-6)
    assert core.dims == (3, 3, 3) and np.allclose(to_numpy(compression.hosvd_back(core, vectors)), a, atol=1e-5)
    core, vectors = compression.hosvd(t, share=0.05)
    assert core.dims == (1, 1, 3)
    with pytest.raises(ValueError):
        compression.gram(shape.unfold(t, [2]))


@pytest.mark.parametrize("m,n,r", [(7, 4, 4), (4, 7, 4), (6, 6, 6), (9, 5, 2), (5, 9, 0), (1, 3, 1), (3, 1, 1)])
def test_kept_reductions(m, n, r):
    x = np.stack([rank_r(m, n, r, 9 + i) if r else np.zeros((m, n)) for i in range(3)])
    s, work, scales = kept.reduce_stack(x)
    for i in range(3):
        for k in (1, min(m, n)):
            u, values, v = kept.form_vectors(m, n, k, work[i].ravel(), scales[i])
            assert np.allclose(u.T @ u, np.eye(k)) and np.allclose(v.T @ v, np.eye(k)) and np.allclose(values, s[i, :k])
        assert np.allclose((u * values) @ v.T, x[i])


def test_formed_factors(spark):
    a = np.random.default_rng(10).standard_normal((5, 4, 6))
    slices = fx.to_slices(from_numpy(spark, a))
    ranks = spark.createDataFrame(list(enumerate([4, 3, 0, 2, 0])), "slice long, k int")  # the last slice has none
    reduced = kept.reduce_slices(slices)
    got, want = kept.form_factors(reduced, ranks), fx.truncate(fx.decompose(slices), ranks)
    assert np.allclose(to_numpy(fx.to_cells(fx.multiply(got), a.shape)), to_numpy(fx.to_cells(fx.multiply(want), a.shape)))
    assert {r.slice: r.k for r in got.collect()} == {0: 4, 1: 3, 2: 0, 3: 2, 4: 0, 5: 0}
    sizes = kept.kept_bytes(reduced).first()
    assert sizes.bytes == 6 * 8 * (20 + 4 + 4) and sizes.factor_bytes == 6 * 8 * 4 * 10


@pytest.mark.parametrize("dims", [(4, 3, 5, 2), (3, 6, 4), (5, 5)])
@pytest.mark.parametrize("how", [{"rank": 2}, {"tol": 0.1}, {"tol": 0.01}])
def test_dense_compression(spark, dims, how):
    """Blocks of a few tubes give the factors, the tensor and the report of the cell way."""
    a = np.random.default_rng(11).standard_normal(dims)
    t = from_numpy(spark, a)
    b = blocks.to_blocks(t, 24)
    one, two = compression.compress(t, "dct", **how), compression.compress_blocks(b, "dct", **how)
    assert np.allclose(to_numpy(compression.reconstruct(one)), to_numpy(compression.reconstruct_blocks(two).cells()))
    assert np.allclose([*compression.report(t, one).first()], [*compression.report_blocks(b, two).first()])
    one.unpersist()
    two.unpersist()


def test_slices_of_blocks_and_back(spark):
    dims = (4, 3, 6)
    a = np.random.default_rng(12).standard_normal(dims)
    b = blocks.to_blocks(from_numpy(spark, a), 30)
    import pyarrow as pa

    def rows(numbers, x):
        return pa.table({"slice": pa.array(numbers), "data": pa.array([y.T.tobytes() for y in x], pa.binary())})

    slices = blocks.over_slices(b, rows, "slice long, data binary", group_cells=24)
    back = blocks.from_slices(slices, lambda batch: ((i, np.frombuffer(d).reshape(3, 4).T) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), dims, b.step)
    assert np.array_equal(to_numpy(back.cells()), a)
    assert [*blocks.block_sums(b, back).first()] == pytest.approx([0, (a * a).sum(), (a * a).sum()])
    with pytest.raises(ValueError):
        blocks.block_sums(b, blocks.to_blocks(from_numpy(spark, a), 18))


def test_zero_tensor(spark):
    """Nothing can go of a zero tensor: all ranks are full, and nothing is lost."""
    cells = from_numpy(spark, np.zeros((3, 4, 2)))
    for t in (cells, Tensor(cells.cells.where("v <> 0"), (3, 4, 2))):
        b = blocks.to_blocks(t)
        for found in (compression.report(t, compression.compress(t, "dct", tol=0.1)), compression.report_blocks(b, compression.compress_blocks(b, "dct", tol=0.1))):
            r = found.first()
            assert (r.n_slices, r.sum_rank, r.compression_ratio, r.abs_err, r.relative_err, r.norm) == (2, 6, 0.5, 0, 0, 0)
        assert [*compression.errors(t, t).first()] == [0, 0, 0, 0]
        core, vectors = compression.hosvd(t, tol=0.1)
        assert compression.report_hosvd(t, core, vectors).first().relative_err == 0
    one = from_numpy(spark, np.ones((3, 4, 2)))
    assert compression.errors(cells, one).first().relative_err is None


def test_infinite_cells_are_told(spark):
    b = blocks.to_blocks(from_numpy(spark, np.full((2, 2, 2), np.inf)))
    with pytest.raises(Exception, match="finite"):
        compression.compress_blocks(b, "eye", rank=1).factors.collect()


def test_wrong_requests(spark):
    b = blocks.to_blocks(from_numpy(spark, np.ones((3, 4, 2))))
    for how in ({}, {"rank": 1, "tol": 0.1}, {"rank": 4}, {"rank": 0}):
        with pytest.raises(ValueError):
            compression.compress_blocks(b, "dct", **how)
    with pytest.raises(ValueError):
        compression.compress_blocks(b, "hosvd", rank=1)
    with pytest.raises(ValueError):
        compression.hosvd(from_numpy(spark, np.ones((2, 2))))


def test_places_outside(spark):
    t = from_numpy(spark, np.ones((2, 2, 2)))
    m = matrix_from_numpy(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        shape.with_slice(t, 2, shape.frontal_slice(t, 0))
    for call in (shape.get_row, shape.get_column):
        for n in (-1, 2):
            with pytest.raises(ValueError):
                call(m, n)
    line = spark.createDataFrame([(0, 7.0), (4, 1.0)], "c int, v double")
    with pytest.raises(ValueError):
        shape.set_row(m, 9, line)
    with pytest.raises(ValueError):
        shape.set_column(m, 2, line.withColumnRenamed("c", "r"))
    with pytest.raises(Exception, match="no c 4"):
        shape.set_row(m, 1, line).entries.collect()
    with pytest.raises(Exception, match="no i0 5"):
        shape.with_slice(t, 1, spark.createDataFrame([(5, 0, 1.0)], "i0 int, i1 int, v double")).cells.collect()
    parts, columns = ragged.ragged_tensor(spark, range(6), 2, [1, 2]), ragged.ragged_matrix(spark, range(3), [1, 2])
    for bad in (ragged.get_slice(parts, 2), ragged.with_slice(parts, 2, [1.0]), ragged.get_column(columns, 5), ragged.get_value(columns, 0, 5), ragged.set_value(columns, 0, 5, 1.0), ragged.with_column(columns, 5, [1.0])):
        with pytest.raises(Exception, match="no (slice|c) [25]"):
            bad.collect()


def test_values_of_blocks(spark):
    a = np.random.default_rng(14).standard_normal((4, 3, 5, 2))
    t = from_numpy(spark, a)
    forward, _, modes = compression.mode_transforms(t, "dct")
    for kind, of in (("eye", t), ("dct", compression.products.transform(t, forward, modes))):
        got = {(r.slice, r.q): r.sigma for r in compression.values_of_blocks(blocks.to_blocks(t, 25), kind).collect()}
        want = {(r.slice, r.q): r.sigma for r in fx.singular_values(fx.to_slices(of)).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_threshold_of_kept_values(spark):
    a = np.random.default_rng(13).standard_normal((5, 7, 4))
    slices = fx.to_slices(from_numpy(spark, a))
    one, two = (sorted(map(tuple, threshold.ranks(x, 0.3).collect())) for x in (fx.singular_values(slices), kept.kept_values(kept.reduce_slices(slices))))
    assert one == two
