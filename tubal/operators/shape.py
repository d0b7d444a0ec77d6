"""Norms, elements, slices, and the order and folding of modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubal.tensor import Matrix, Tensor, index_names, linear_index, slice_number, split_index


def norm(t: Tensor) -> DataFrame:
    """``norm``: the Frobenius norm."""
    return t.cells.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def matrix_norm(m: Matrix) -> DataFrame:
    return m.entries.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def normalised(t: Tensor) -> Tensor:
    """Divided by its Frobenius norm; a zero tensor stays as it is."""
    cells = t.cells.join(F.broadcast(norm(t)))  # one row
    return t.with_cells(cells.withColumn("v", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(F.col("v"))))


def at_level(t: Tensor, mode: int, levels: list, value) -> Tensor:
    """The tensor without a mode, where that mode's position stands for ``value`` in the list ``levels``."""
    if value not in levels or len(levels) != t.dims[mode]:
        raise ValueError(f"no level {value!r} among the {t.dims[mode]} of mode {mode}: {levels}")
    kept = [n for n in t.modes if n != t.mode(mode)]
    cells = t.cells.where(F.col(t.mode(mode)) == levels.index(value)).select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(kept)], "v")
    return t.with_cells(cells, tuple(d for k, d in enumerate(t.dims) if k != mode))


def get_element(m: Matrix, r: int, c: int) -> DataFrame:
    if not (0 <= r < m.rows and 0 <= c < m.columns):
        raise ValueError(f"no element {r}, {c} in a {m.rows} x {m.columns} matrix")
    return m.entries.where((F.col("r") == r) & (F.col("c") == c)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def set_element(m: Matrix, r: int, c: int, value: float) -> Matrix:
    if not (0 <= r < m.rows and 0 <= c < m.columns):
        raise ValueError(f"no element {r}, {c} in a {m.rows} x {m.columns} matrix")
    kinds = {f.name: f.dataType for f in m.entries.schema.fields}
    one = m.entries.sparkSession.range(1).select(F.lit(r).cast(kinds["r"]).alias("r"), F.lit(c).cast(kinds["c"]).alias("c"), F.lit(float(value)).alias("v"))
    return Matrix(m.entries.where(~((F.col("r") == r) & (F.col("c") == c))).select("r", "c", "v").unionByName(one), m.rows, m.columns)


def _checked(m: Matrix, r: int | None = None, c: int | None = None) -> None:
    if (r is not None and not 0 <= r < m.rows) or (c is not None and not 0 <= c < m.columns):
        raise ValueError(f"no {'column' if r is None else 'row'} {c if r is None else r} in a {m.rows} x {m.columns} matrix")


def _inside(name: str, size: int) -> Column:
    """The index column; an error where it lies outside."""
    fits = (F.col(name) >= 0) & (F.col(name) < size)
    return F.when(fits, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"no {name} "), F.col(name).cast("string"), F.lit(f" of {size}")))).alias(name)


def get_row(m: Matrix, r: int) -> DataFrame:
    _checked(m, r=r)
    return m.entries.where(F.col("r") == r).select("c", "v")


def get_column(m: Matrix, c: int) -> DataFrame:
    _checked(m, c=c)
    return m.entries.where(F.col("c") == c).select("r", "v")


def set_row(m: Matrix, r: int, row: DataFrame) -> Matrix:
    """``row`` has ``c`` and ``v``."""
    _checked(m, r=r)
    return Matrix(m.entries.where(F.col("r") != r).unionByName(row.select(F.lit(r).alias("r"), _inside("c", m.columns), "v")), m.rows, m.columns)


def set_column(m: Matrix, c: int, column: DataFrame) -> Matrix:
    _checked(m, c=c)
    return Matrix(m.entries.where(F.col("c") != c).unionByName(column.select(_inside("r", m.rows), F.lit(c).alias("c"), "v")), m.rows, m.columns)


def frontal_slice(t: Tensor, number: int) -> DataFrame:
    """Cells ``i0, i1, v`` of one slice."""
    if not 0 <= number < t.slices:
        raise ValueError(f"no slice {number} of {t.slices}")
    at, filters = number, []
    for n, d in zip(t.modes[2:], t.dims[2:], strict=True):
        filters.append(F.col(n) == at % d)
        at //= d
    cells = t.cells
    for f in filters:  # plain comparisons of index columns reach the scan
        cells = cells.where(f)
    return cells.select("i0", "i1", "v")


def with_slice(t: Tensor, number: int, cells: DataFrame) -> Tensor:
    """The tensor with a slice replaced by ``cells`` (``i0, i1, v``)."""
    if not 0 <= number < t.slices:
        raise ValueError(f"no slice {number} of {t.slices}")
    fixed, at = [], number
    for d in t.dims[2:]:
        fixed.append(at % d)
        at //= d
    new = cells.select(_inside("i0", t.dims[0]), _inside("i1", t.dims[1]), *[F.lit(x).cast("int").alias(n) for x, n in zip(fixed, t.modes[2:], strict=True)], "v")
    return t.with_cells(t.cells.where(slice_number(t) != number).unionByName(new.select(*t.modes, "v")))


def permute(t: Tensor, order: list[int]) -> Tensor:
    """Mode ``order[k]`` becomes mode k."""
    if sorted(order) != list(range(len(t.dims))):
        raise ValueError(f"{order} does not order {len(t.dims)} modes")
    cells = t.cells.select(*[F.col(f"i{m}").alias(f"i{k}") for k, m in enumerate(order)], "v")
    return t.with_cells(cells, tuple(t.dims[m] for m in order))


def reshape(t: Tensor, dims: tuple[int, ...]) -> Tensor:
    """Other mode sizes over the same column-major order of cells."""
    position = linear_index(t.dims, t.modes)
    columns = split_index(position, tuple(dims))
    out = t.with_cells(t.cells.select(*[c.alias(n) for c, n in zip(columns, index_names(len(dims)), strict=True)], "v"), tuple(dims))
    if out.size != t.size:
        raise ValueError(f"{t.dims} and {dims} differ in size")
    return out


def unfold(t: Tensor, row_modes: list[int]) -> Matrix:
    """Rows run over ``row_modes`` (the first fastest), columns over the others."""
    other = [m for m in range(len(t.dims)) if m not in row_modes]
    sizes = [tuple(t.dims[m] for m in ms) for ms in (row_modes, other)]
    r, c = (linear_index(d, [f"i{m}" for m in ms]) for d, ms in zip(sizes, (row_modes, other), strict=True))
    count = [1, 1]
    for k, d in enumerate(sizes):
        for x in d:
            count[k] *= x
    return Matrix(t.cells.select(r.alias("r"), c.alias("c"), "v"), *count)


def center(t: Tensor, mode: int) -> tuple[Tensor, DataFrame]:
    """Without the mean along a mode; and the means, by the other indexes. Missing cells count as zero,
    so the mean divides by the mode's size, and the result has all cells of tubes with a mean."""
    others = [n for n in t.modes if n != t.mode(mode)]
    means = t.cells.groupBy(*others).agg((F.sum("v") / F.lit(t.dims[mode])).alias("mean"))
    grid = means.select(*others, F.explode(F.sequence(F.lit(0), F.lit(t.dims[mode] - 1))).alias(t.mode(mode)), "mean")
    cells = grid.join(t.cells, t.modes, "left").select(*t.modes, (F.coalesce("v", F.lit(0.0)) - F.col("mean")).alias("v"))
    return t.with_cells(cells), means


def leading(sigma: DataFrame, k: int) -> DataFrame:
    """The k largest values of each slice of ``slice, q, sigma``."""
    order = Window.partitionBy("slice").orderBy(F.desc("sigma"), "q")
    return sigma.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
