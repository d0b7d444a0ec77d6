"""The core operators as registered queries over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.functions import tables, transforms
from tubal.operators import factors as fx
from tubal.operators import block_matrix, blocks, kept, products, ragged, shape, threshold
from tubal.plans import analytics, compression
from tubal.sources.sinks import upserted
from tubal.sources.tables import code_of, read, tensor_from_table
from tubal.storage import Steps
from tubal.tensor import Matrix, Tensor, dense, matrix_from_numpy

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STATUSES, PRIORITIES = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FLAGS, YEAR = ["A", "N", "R"], 1995


def _rounded(c: str | Column, digits: int = 4) -> Column:
    """Without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _cells(t: Tensor, digits: int = 4) -> DataFrame:
    """Cells that are not zero, for comparison."""
    v = _rounded("v", digits)
    return t.cells.select(*[F.col(n).cast("long").alias(n) for n in t.modes], v.alias("v")).where("v <> 0")


# Tensors of the tables


def events3(spark: SparkSession, sf: str) -> Tensor:
    """Event type x hour x day: sum of values."""
    modes = [(code_of("event_type", EVENT_TYPES), 5), (F.hour("ts"), 24), (F.dayofmonth("ts") - 1, 30)]
    return tensor_from_table(read(spark, sf, "events"), modes, F.col("value"))


def events4(spark: SparkSession, sf: str) -> Tensor:
    """User group x event type x weekday x quarter of a day."""
    modes = [(F.pmod("user_id", F.lit(8)), 8), (code_of("event_type", EVENT_TYPES), 5), (F.pmod(F.dayofmonth("ts") - 1, F.lit(7)), 7), (F.floor(F.hour("ts") / 6), 4)]
    return tensor_from_table(read(spark, sf, "events"), modes, F.col("value"))


def _lines(spark: SparkSession, sf: str, flags: bool) -> Tensor:
    modes = [(code_of("l_linestatus", ["F", "O"]), 2), (F.col("l_linenumber") - 1, 7), (F.year("l_shipdate") - YEAR, 7)]
    modes += [(code_of("l_returnflag", FLAGS), 3)] if flags else []
    return tensor_from_table(read(spark, sf, "lineitem"), modes, F.col("l_extendedprice") / 1e6)


def lines3(spark: SparkSession, sf: str) -> Tensor:
    """Line status x line number x year: revenue in millions. Slices have two rows."""
    return _lines(spark, sf, False)


def lines4(spark: SparkSession, sf: str) -> Tensor:
    return _lines(spark, sf, True)


def orders5(spark: SparkSession, sf: str) -> Tensor:
    """Status x priority x segment x region x year."""
    orders, customers, nations = (read(spark, sf, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    modes = [(code_of("o_orderstatus", STATUSES), 3), (code_of("o_orderpriority", PRIORITIES), 5), (code_of("c_mktsegment", SEGMENTS), 5), (F.col("n_regionkey"), 5), (F.year("o_orderdate") - YEAR, 7)]
    return tensor_from_table(joined, modes, F.col("o_totalprice") / 1e6)


def _list_sql(column: str, values: list[str]) -> str:
    return f"list_position([{', '.join(f"'{v}'" for v in values)}], {column}) - 1"


_EVENTS3 = f"SELECT {_list_sql('event_type', EVENT_TYPES)} AS i0, CAST(hour(ts) AS BIGINT) AS i1, CAST(day(ts) - 1 AS BIGINT) AS i2, sum(value) AS v FROM events WHERE day(ts) <= 30 GROUP BY ALL"
_EVENTS4 = f"SELECT user_id % 8 AS i0, {_list_sql('event_type', EVENT_TYPES)} AS i1, CAST((day(ts) - 1) % 7 AS BIGINT) AS i2, CAST(hour(ts) // 6 AS BIGINT) AS i3, sum(value) AS v FROM events GROUP BY ALL"
_LINES = "SELECT {s} AS i0, CAST(l_linenumber - 1 AS BIGINT) AS i1, CAST(year(l_shipdate) - 1995 AS BIGINT) AS i2{f}, sum(l_extendedprice / 1e6) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 AND l_linenumber BETWEEN 1 AND 7 GROUP BY ALL"
_LINES3 = _LINES.format(s=_list_sql("l_linestatus", ["F", "O"]), f="")
_LINES4 = _LINES.format(s=_list_sql("l_linestatus", ["F", "O"]), f=f", {_list_sql('l_returnflag', FLAGS)} AS i3")
_ORDERS5 = (
    f"SELECT {_list_sql('o_orderstatus', STATUSES)} AS i0, {_list_sql('o_orderpriority', PRIORITIES)} AS i1, {_list_sql('c_mktsegment', SEGMENTS)} AS i2,"
    " CAST(n_regionkey AS BIGINT) AS i3, CAST(year(o_orderdate) - 1995 AS BIGINT) AS i4, sum(o_totalprice / 1e6) AS v"
    " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL"
)


def _cells_sql(source: str, modes: str, value: str = "v", ctes: str = "", group: bool = False) -> str:
    rounded = f"round({f'sum({value})' if group else value}, 4) + 0.0"
    out = f"SELECT {modes}, {rounded} AS v FROM {source}" + (" GROUP BY ALL" if group else "")
    return f"WITH {ctes} SELECT * FROM ({out}) AS o WHERE v <> 0"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


# Shape


@_query(_cells_sql("t", "i0, i1, i2", ctes=f"t AS ({_EVENTS3})"))
def tensor_events(spark, sf):
    return _cells(events3(spark, sf))


@_query(_cells_sql("t", "i0, i1, i2, i3, i4", ctes=f"t AS ({_ORDERS5})"))
def tensor_orders(spark, sf):
    return _cells(orders5(spark, sf))


@_query(" UNION ALL ".join(f"SELECT '{n}' AS tensor, round(sqrt(sum(v * v)), 4) AS norm FROM ({q}) AS t" for n, q in (("events", _EVENTS3), ("lines", _LINES4), ("orders", _ORDERS5))))
def tensor_norm(spark, sf):
    named = [shape.norm(t).select(F.lit(n).alias("tensor"), F.round("norm", 4).alias("norm")) for n, t in (("events", events3(spark, sf)), ("lines", lines4(spark, sf)), ("orders", orders5(spark, sf)))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@_query(f"SELECT i0, i1, round(v, 4) AS v FROM ({_LINES4}) AS t WHERE i2 = 4 AND i3 = 1")
def frontal_slice(spark, sf):
    return shape.frontal_slice(lines4(spark, sf), 4 + 7).select(F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), F.round("v", 4).alias("v"))


@_query(_cells_sql("(SELECT * FROM t WHERE i2 <> 0 UNION ALL SELECT i0, i1, 0 AS i2, v FROM t WHERE i2 = 1) AS u", "i0, i1, i2", ctes=f"t AS ({_EVENTS3})"))
def replace_slice(spark, sf):
    t = events3(spark, sf)
    return _cells(shape.with_slice(t, 0, shape.frontal_slice(t, 1)))


@_query(_cells_sql("t", "i2 AS i0, i0 AS i1, i1 AS i2", ctes=f"t AS ({_EVENTS3})"))
def permute_modes(spark, sf):
    return _cells(shape.permute(events3(spark, sf), [2, 0, 1]))


@_query(f"SELECT i0 + 2 * i1 AS r, i2 + 7 * i3 AS c, round(v, 4) AS v FROM ({_LINES4}) AS t")
def unfold_modes(spark, sf):
    return shape.unfold(lines4(spark, sf), [0, 1]).entries.withColumn("v", F.round("v", 4))


@_query(_cells_sql("t", "i0 + 2 * i1 AS i0, i2 AS i1, i3 AS i2", ctes=f"t AS ({_LINES4})"))
def reshape_modes(spark, sf):
    return _cells(shape.reshape(lines4(spark, sf), (14, 7, 3)))


@_query(_cells_sql("(SELECT i0, i1, d.i2, coalesce(t.v, 0) - m.mean AS v FROM m, range(7) AS d(i2) LEFT JOIN t USING (i0, i1, i2)) AS c", "i0, i1, i2", ctes=f"t AS ({_LINES3}), m AS (SELECT i0, i1, sum(v) / 7 AS mean FROM t GROUP BY ALL)").replace("FROM m, range(7) AS d(i2) LEFT JOIN t USING (i0, i1, i2)", "FROM (m CROSS JOIN range(7) AS d(i2)) LEFT JOIN t ON t.i0 = m.i0 AND t.i1 = m.i1 AND t.i2 = d.i2").replace("(SELECT i0, i1, d.i2", "(SELECT m.i0, m.i1, d.i2"))
def center_mode(spark, sf):
    return _cells(shape.center(lines3(spark, sf), 2)[0])


@_query(f"WITH t AS ({_LINES4}) SELECT CAST(coalesce(sum(v) FILTER (WHERE i0 = 1 AND i1 = 3 AND i2 = 2 AND i3 = 1), 0) AS DOUBLE) AS v FROM t".replace("CAST(coalesce", "round(coalesce").replace("0) AS DOUBLE)", "0), 4)"))
def matrix_element(spark, sf):
    m = shape.unfold(lines4(spark, sf), [0, 1])
    return shape.get_element(m, 1 + 2 * 3, 2 + 7).agg(F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("v"))


@_query(f"WITH t AS ({_LINES4}), m AS (SELECT i0 + 2 * i1 AS r, i2 + 7 * i3 AS c, v FROM t) SELECT r, c, round(v, 4) AS v FROM m WHERE r <> 3 UNION ALL SELECT 3 AS r, 4 AS c, CAST(5 AS DOUBLE) AS v")
def matrix_set_element(spark, sf):
    """Of a row that has no cells at all."""
    m = shape.unfold(lines4(spark, sf), [0, 1])
    return shape.set_element(Matrix(m.entries.where("r <> 3"), m.rows, m.columns), 3, 4, 5.0).entries.withColumn("v", F.round("v", 4))


@_query(f"WITH t AS ({_LINES4}), m AS (SELECT i0 + 2 * i1 AS r, i2 + 7 * i3 AS c, v FROM t) SELECT r, c, round(v, 4) AS v FROM m WHERE r <> 3 AND c <> 2 UNION ALL SELECT 3 AS r, c, round(v, 4) AS v FROM m WHERE r = 5 AND c <> 2 UNION ALL SELECT r, 2 AS c, round(v, 4) AS v FROM (SELECT CASE WHEN r = 3 THEN 5 ELSE r END AS src, r, 9 AS c FROM range(14) AS g(r)) AS w JOIN (SELECT r AS src, c, v FROM m) AS n USING (src, c)")
def matrix_rows_columns(spark, sf):
    """Row 5 in the place of row 3, then column 9 in that of column 2."""
    m = shape.unfold(lines4(spark, sf), [0, 1])
    m = shape.set_row(m, 3, shape.get_row(m, 5))
    return shape.set_column(m, 2, shape.get_column(m, 9)).entries.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.round("v", 4).alias("v"))


@_query(f"WITH t AS ({_EVENTS3}) SELECT i0, i1, i2, round(v / (SELECT sqrt(sum(v * v)) FROM t), 6) AS v FROM t WHERE round(v / (SELECT sqrt(sum(v * v)) FROM t), 6) <> 0")
def normalised_tensor(spark, sf):
    return _cells(shape.normalised(events3(spark, sf)), 6)


@_query(f"SELECT i0, i1, i3 AS i2, round(v, 4) AS v FROM ({_LINES4}) AS t WHERE i2 = 4")
def level_of_mode(spark, sf):
    """The tensor of one year, by the year."""
    return _cells(shape.at_level(lines4(spark, sf), 2, list(range(1995, 2002)), 1999))


_BALANCES = "b AS (SELECT CAST(c_nationkey AS INTEGER) AS c, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS r, c_acctbal AS v FROM customer)"


def _balances(spark, sf) -> DataFrame:
    """Customers' balances, a ragged column for each nation."""
    rows = F.sort_array(F.collect_list(F.struct("c_custkey", "c_acctbal")))
    columns = read(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("int").alias("c")).agg(rows.alias("rows"))
    return columns.select("c", F.col("rows.c_acctbal").alias("data"))


@_query(f"WITH {_BALANCES} SELECT r, v FROM b WHERE c = 5")
def ragged_column(spark, sf):
    return ragged.get_column(_balances(spark, sf), 5)


@_query(f"WITH {_BALANCES} SELECT c, count(*) AS n, round(sum(CASE WHEN c = 7 AND r = 0 THEN 0.5 ELSE v END), 2) AS total FROM b GROUP BY ALL")
def ragged_set_value(spark, sf):
    out = ragged.set_value(_balances(spark, sf), 0, 7, 0.5).select("c", F.explode("data").alias("v"))
    return out.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@_query(f"WITH {_BALANCES}, n AS (SELECT c, count(*) AS k FROM b GROUP BY ALL), o AS (SELECT c, sum(k) OVER (ORDER BY c) - k AS first FROM n) SELECT CAST(first + r AS BIGINT) AS at, v FROM b JOIN o USING (c)")
def ragged_flat(spark, sf):
    """Slices of one row and as many columns as a nation has customers, in one buffer."""
    slices = _balances(spark, sf).select(F.col("c").cast("long").alias("slice"), F.lit(1).alias("nrow"), F.size("data").alias("ncol"), "data")
    return ragged.flat(slices).select(F.col("at").cast("long").alias("at"), "v")


# Products


def _counting(rows: int, columns: int) -> np.ndarray:
    return np.arange(rows * columns, dtype=float).reshape((rows, columns), order="F")


def _ttm_sql(source: str, mode: int, ndim: int, rows: int, columns: int) -> str:
    names = ", ".join(f"m.r AS i{k}" if k == mode else f"t.i{k}" for k in range(ndim))
    matrix = f"m AS (SELECT x % {rows} AS r, x // {rows} AS c, CAST(x AS DOUBLE) AS w FROM range({rows * columns}) AS g(x))"
    return _cells_sql(f"t JOIN m ON t.i{mode} = m.c", names, "v * w", f"t AS ({source}), {matrix}", True)


@_query(f"WITH t AS ({_LINES3}) SELECT CAST(a.i1 AS BIGINT) AS r, CAST(b.i1 AS BIGINT) AS c, round(sum(a.v * b.v), 4) AS v FROM t AS a JOIN t AS b USING (i0, i2) GROUP BY ALL")
def matrix_product(spark, sf):
    m = shape.unfold(lines3(spark, sf), [1])
    return products.matmul(m, m.transposed()).entries.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.round("v", 4).alias("v"))


def _ttm(spark, t: Tensor, mode: int, rows: int) -> DataFrame:
    return _cells(products.ttm(t, matrix_from_numpy(spark, _counting(rows, t.dims[mode])), mode))


@_query(_ttm_sql(_EVENTS3, 0, 3, 3, 5))
def ttm_first(spark, sf):
    return _ttm(spark, events3(spark, sf), 0, 3)


@_query(_ttm_sql(_EVENTS3, 1, 3, 6, 24))
def ttm_middle(spark, sf):
    return _ttm(spark, events3(spark, sf), 1, 6)


@_query(_ttm_sql(_EVENTS3, 2, 3, 4, 30))
def ttm_last(spark, sf):
    return _ttm(spark, events3(spark, sf), 2, 4)


def _dct_sql(n: int) -> str:
    return f"SELECT x // {n} AS r, x % {n} AS c, CASE WHEN x // {n} = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos(pi() * (2 * (x % {n}) + 1) * (x // {n}) / (2.0 * {n})) AS w FROM range({n * n}) AS g(x)"


_DCT_MULTI = _cells_sql("t JOIN a ON t.i2 = a.c JOIN b ON t.i3 = b.c", "t.i0, t.i1, a.r AS i2, b.r AS i3", "v * a.w * b.w", f"t AS ({_EVENTS4}), a AS ({_dct_sql(7)}), b AS ({_dct_sql(4)})", True)


@_query(_cells_sql("t JOIN m ON t.i2 = m.c", "t.i0, t.i1, m.r AS i2", "v * w", f"t AS ({_EVENTS3}), m AS ({_dct_sql(30)})", True))
def ttm_dct(spark, sf):
    return _cells(products.ttm(events3(spark, sf), transforms.dct(spark, 30), 2))


@_query(_DCT_MULTI)
def transform_cells(spark, sf):
    return _cells(products.transform(events4(spark, sf), [transforms.dct(spark, 7), transforms.dct(spark, 4)], [2, 3], "cells"))


@_query(_DCT_MULTI)
def transform_tubes(spark, sf):
    return _cells(products.transform(events4(spark, sf), [transforms.dct(spark, 7), transforms.dct(spark, 4)], [2, 3], "tubes"))


@_query(_DCT_MULTI)
def transform_blocks(spark, sf):
    t = events4(spark, sf)
    step = blocks.tubes_of_block(t.dims, 100)
    moved, dims = blocks.transform_blocks(blocks.blocks_of(t, 100), t.dims, [transforms.dct_array(7), transforms.dct_array(4)], [2, 3])
    return _cells(blocks.cells_of(moved, dims, step))


@_query(_cells_sql("t", "i0, i1, i2", ctes=f"t AS ({_EVENTS3})"))
def transform_roundtrip(spark, sf):
    t = events3(spark, sf)
    forward, inverse, modes = compression.mode_transforms(t, "dct")
    return _cells(products.transform(products.transform(t, forward, modes), inverse, modes))


@_query(_cells_sql("t", "i0, i1, i2, CAST(0 AS BIGINT) AS i3", f"v * [{', '.join(map(str, transforms.GRAY))}][i3 + 1]", f"t AS ({_LINES4})", True))
def gray_channels(spark, sf):
    return _cells(products.ttm(lines4(spark, sf), transforms.gray(spark), 3))


# Slices: two-row slices have closed forms


def _gram2(tensor: str) -> str:
    """CTEs of a tensor ``i0 (0 and 1), i1, i2, v``: by slice the Gram matrix (a b, b c) and both singular values."""
    return (
        f"t AS ({tensor}), g AS (SELECT i2 AS slice, sum(CASE WHEN i0 = 0 THEN v * v ELSE 0 END) AS a, sum(CASE WHEN i0 = 1 THEN v * v ELSE 0 END) AS c FROM t GROUP BY ALL),"
        " h AS (SELECT x.i2 AS slice, sum(x.v * y.v) AS b FROM t AS x JOIN t AS y ON x.i1 = y.i1 AND x.i2 = y.i2 AND x.i0 = 0 AND y.i0 = 1 GROUP BY ALL),"
        " e AS (SELECT slice, a, coalesce(b, 0) AS b, c, sqrt((a - c) * (a - c) + 4 * coalesce(b, 0) * coalesce(b, 0)) AS root FROM g LEFT JOIN h USING (slice)),"
        " s AS (SELECT slice, CAST(q AS BIGINT) AS q, sqrt(greatest(0, CASE WHEN q = 0 THEN (a + c + root) / 2 ELSE (a + c - root) / 2 END)) AS sigma FROM e CROSS JOIN range(2) AS d(q))"
    )


#: Of e the leading left vector (x, y) of each slice.
_LEADING2 = (
    "p AS (SELECT *, CASE WHEN b <> 0 THEN b ELSE CASE WHEN a >= c THEN 1 ELSE 0 END END AS x, CASE WHEN b <> 0 THEN (a + c + root) / 2 - a ELSE CASE WHEN a >= c THEN 0 ELSE 1 END END AS y FROM e),"
    " f AS (SELECT slice, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM p)"
)
_GRAM2 = _gram2(_LINES3)
_CUT = " o AS (SELECT sigma, sum(sigma * sigma) OVER (ORDER BY sigma, slice, q ROWS UNBOUNDED PRECEDING) AS cum, sum(sigma * sigma) OVER () AS total FROM s), x AS (SELECT coalesce(max(CASE WHEN cum <= {tol2} * total THEN sigma END), 0) AS cutoff FROM o)"
TOL = 0.05


@_query(f"WITH {_GRAM2} SELECT slice, q, round(sigma, 4) AS sigma FROM s")
def slice_singular_values(spark, sf):
    return fx.singular_values(fx.to_slices(lines3(spark, sf))).select("slice", F.col("q").cast("long").alias("q"), F.round("sigma", 4).alias("sigma"))


@_query(f"WITH {_GRAM2}, {_CUT.format(tol2=TOL * TOL)} SELECT slice, CAST(sum(CASE WHEN sigma >= cutoff THEN 1 ELSE 0 END) AS INTEGER) AS k FROM s, x GROUP BY ALL")
def slice_ranks(spark, sf):
    return threshold.ranks(fx.singular_values(fx.to_slices(lines3(spark, sf))), TOL)


@_query(f"WITH {_GRAM2} SELECT slice, q, round(sigma, 4) AS sigma FROM s")
def slice_values_in_sql(spark, sf):
    """Singular values of all slices by a table function, in SQL alone."""
    tables.register(spark)
    read(spark, sf, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql(
        "WITH cells AS (SELECT year(l_shipdate) - 1995 AS slice, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS i0, l_linenumber - 1 AS i1, sum(l_extendedprice / 1e6) AS v"
        " FROM _lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 AND l_linenumber BETWEEN 1 AND 7 GROUP BY 1, 2, 3)"
        " SELECT slice, CAST(q AS BIGINT) AS q, round(sigma, 4) AS sigma FROM slice_values(TABLE(cells), 2, 7)"
    )


def _prices(spark, sf):
    """Order prices as values of 100 slices."""
    return read(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(100)).alias("slice"), F.col("o_orderkey").alias("q"), F.col("o_totalprice").alias("sigma"))


_PRICES = "s AS (SELECT o_custkey % 100 AS slice, o_orderkey AS q, o_totalprice AS sigma FROM orders)"


@_query(f"WITH {_PRICES}, {_CUT.format(tol2=0.3 * 0.3)} SELECT cutoff FROM x")
def threshold_values(spark, sf):
    return threshold.cutoff(_prices(spark, sf), 0.3)


@_query(f"WITH {_PRICES}, {_CUT.format(tol2=0.3 * 0.3)} SELECT slice, CAST(sum(CASE WHEN sigma >= cutoff THEN 1 ELSE 0 END) AS INTEGER) AS k FROM s, x GROUP BY ALL")
def threshold_ranks(spark, sf):
    return threshold.ranks(_prices(spark, sf), 0.3)


@_query(f"WITH {_PRICES} SELECT slice, q, sigma FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY sigma DESC, q) AS n FROM s) AS r WHERE n <= 5")
def leading_values(spark, sf):
    return shape.leading(_prices(spark, sf), 5)


def _tolerance_sql(ctes: str, slices: int, shape: tuple[int, int], tol: float) -> str:
    m, n = shape
    return (
        f"WITH {ctes}, {_CUT.format(tol2=tol * tol)}, k AS (SELECT sigma, sigma >= cutoff AS kept FROM s, x)"
        f" SELECT CAST({slices} AS BIGINT) AS n_slices, count(*) FILTER (WHERE kept) AS sum_rank, round({float(m * n * slices)} / (count(*) FILTER (WHERE kept) * {m + n + 1}), 4) AS compression_ratio,"
        " round(sqrt(sum(CASE WHEN kept THEN 0 ELSE sigma * sigma END) / sum(sigma * sigma)), 4) AS relative_err FROM k"
    )


def _reported(report: DataFrame) -> DataFrame:
    return report.select("n_slices", "sum_rank", F.round("compression_ratio", 4).alias("compression_ratio"), F.round("relative_err", 4).alias("relative_err"))


@_query(_tolerance_sql(_GRAM2, 7, (2, 7), TOL))
def compress_tolerance(spark, sf):
    t = lines3(spark, sf)
    return _reported(compression.report(t, compression.compress(t, "eye", tol=TOL)))


@_query(
    f"WITH {_GRAM2}, p AS (SELECT *, CASE WHEN b <> 0 THEN b ELSE CASE WHEN a >= c THEN 1 ELSE 0 END END AS x, CASE WHEN b <> 0 THEN (a + c + root) / 2 - a ELSE CASE WHEN a >= c THEN 0 ELSE 1 END END AS y FROM e),"
    " f AS (SELECT slice, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM p),"
    " d AS (SELECT i1, i2, sum(v * CASE WHEN i0 = 0 THEN x ELSE y END) AS dot FROM t JOIN f ON i2 = slice GROUP BY ALL)"
    " SELECT * FROM (SELECT CAST(r AS BIGINT) AS i0, d.i1, d.i2, round(dot * CASE WHEN r = 0 THEN x ELSE y END, 4) + 0.0 AS v FROM d JOIN f ON i2 = slice CROSS JOIN range(2) AS z(r)) AS u WHERE v <> 0"
)
def compress_rank(spark, sf):
    t = lines3(spark, sf)
    return _cells(compression.reconstruct(compression.compress(t, "eye", rank=1)))


@_query(ORACLE_SQL["compress_tolerance"])
def blocks_compress_tolerance(spark, sf):
    """The same from blocks, of which there are some."""
    b = blocks.to_blocks(lines3(spark, sf), 28)
    return _reported(compression.report_blocks(b, compression.compress_blocks(b, "eye", tol=TOL)))


@_query(ORACLE_SQL["compress_rank"])
def blocks_compress_rank(spark, sf):
    b = blocks.to_blocks(lines3(spark, sf), 28)
    return _cells(compression.reconstruct_blocks(compression.compress_blocks(b, "eye", rank=1)).cells())


@_query(f"WITH {_GRAM2} SELECT count(DISTINCT slice) AS n_slices, count(DISTINCT slice) * 8 * (2 * 7 + 2 + 2) AS bytes, count(DISTINCT slice) * 8 * 2 * (2 + 7 + 1) AS factor_bytes FROM s")
def kept_reductions(spark, sf):
    """What is kept of two by seven slices until their ranks are known, and what full factors would take."""
    reduced = kept.reduce_slices(fx.to_slices(lines3(spark, sf)))
    return kept.kept_bytes(reduced).join(F.broadcast(reduced.agg(F.countDistinct("slice").alias("n_slices"))))  # one row each


@_query(f"WITH {_GRAM2}, {_CUT.format(tol2=TOL * TOL)} SELECT slice, round(coalesce(sum(CASE WHEN sigma >= cutoff THEN sigma * sigma END), 0), 4) AS energy FROM s, x GROUP BY ALL")
def truncate_factors(spark, sf):
    full = fx.decompose(fx.to_slices(lines3(spark, sf)))
    cut = fx.truncate(full, threshold.ranks(fx.sigma_rows(full), TOL))
    return cut.select("slice", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


@_query(f"WITH {_GRAM2}, {_CUT.format(tol2=TOL * TOL)} SELECT slice, round(coalesce(sum(CASE WHEN sigma >= cutoff THEN sigma * sigma END), 0), 4) AS truncated, round(coalesce(sum(CASE WHEN sigma >= cutoff THEN sigma * sigma END), 0), 4) AS direct, round(coalesce(sum(CASE WHEN sigma >= cutoff THEN sigma * sigma END), 0), 4) AS formed, CAST(0 AS DOUBLE) AS gap FROM s, x GROUP BY ALL")
def strategies_agree(spark, sf):
    """Energies of full decomposition then truncation, of decomposition at given ranks, of vectors formed from kept reductions, and the largest gap."""
    slices = fx.to_slices(lines3(spark, sf))
    full = fx.decompose(slices)
    ranks = threshold.ranks(fx.sigma_rows(full), TOL)
    formed = kept.form_factors(kept.reduce_slices(slices), ranks)
    one = fx.multiply(fx.truncate(full, ranks)).select("slice", F.col("data").alias("one"))
    two, three = (fx.multiply(x).select("slice", F.col("data").alias(n)) for x, n in ((fx.decompose_ranks(slices, ranks), "two"), (formed, "three")))
    energy = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x), 4)
    gap = F.greatest(*[F.array_max(F.zip_with("one", other, lambda a, b: F.abs(a - b))) for other in ("two", "three")])
    return one.join(two, "slice").join(three, "slice").select("slice", energy("one").alias("truncated"), energy("two").alias("direct"), energy("three").alias("formed"), F.round(gap, 6).alias("gap"))


@_query(f"WITH {_GRAM2} SELECT slice, CAST(slice % 3 AS INTEGER) AS k, round(coalesce(sum(CASE WHEN q < slice % 3 THEN sigma * sigma END), 0), 4) AS energy FROM s GROUP BY ALL")
def ranks_by_slice(spark, sf):
    """Decomposition at ranks 0, 1 and 2, and the energy of the products."""
    ranks = spark.range(7).select(F.col("id").alias("slice"), F.pmod("id", F.lit(3)).cast("int").alias("k"))
    found = fx.decompose_ranks(fx.to_slices(lines3(spark, sf)), ranks)
    energy = F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x), 4)
    return fx.multiply(found).select("slice", energy.alias("energy")).join(found.select("slice", "k"), "slice")


@_query(f"WITH {_GRAM2} SELECT slice, q, round(sigma, 4) AS sigma FROM s")
def tall_slice_values(spark, sf):
    """Slices of seven rows and two columns."""
    found = fx.singular_values(fx.to_slices(shape.permute(lines3(spark, sf), [1, 0, 2])))
    return found.select("slice", F.col("q").cast("long").alias("q"), F.round("sigma", 4).alias("sigma"))


_MATRIX2 = f"SELECT i0, i1 + 7 * i2 AS i1, 0 AS i2, v FROM ({_LINES3}) AS l"


@_query(f"WITH {_gram2(_MATRIX2)} SELECT q, round(sigma, 4) AS sigma FROM s")
def matrix_singular_values(spark, sf):
    found = block_matrix.singular_values(shape.unfold(lines3(spark, sf), [0]))
    return found.select(F.col("q").cast("long").alias("q"), F.round("sigma", 4).alias("sigma"))


_EMBEDDED = "SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings"


@_query(f"WITH e AS ({_EMBEDDED}), g AS (SELECT sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS g, a.d = b.d AS own FROM e AS a JOIN e AS b USING (vec_id) GROUP BY a.d, b.d) SELECT count(*) FILTER (WHERE own) AS n_values, round(sum(g) FILTER (WHERE own), 4) AS energy, round(sum(g * g), 3) AS energy2 FROM g")
def embedding_energies(spark, sf):
    """Singular values of the matrix of all embeddings, a row each: their squares and fourth powers add up to what the entries give."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("r"), F.col("embedding").alias("data"))
    last = vectors.agg(F.max("r")).first()[0]
    s2 = F.col("sigma") * F.col("sigma")
    return block_matrix.singular_values(block_matrix.from_rows(vectors, last + 1, 64)).agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum(s2), 4).alias("energy"), F.round(F.sum(s2 * s2), 3).alias("energy2"))


def _matrix_cells(m: Matrix) -> DataFrame:
    cells = m.entries.select(F.col("r").cast("long").alias("i0"), F.col("c").cast("long").alias("i1"), _rounded("v").alias("v"))
    return cells.where("v <> 0")


_PROJECTED = " d AS (SELECT i1, i2, sum(v * CASE WHEN i0 = 0 THEN x ELSE y END) AS dot FROM t JOIN f ON i2 = slice GROUP BY ALL)"


@_query(f"WITH {_gram2(_MATRIX2)}, {_LEADING2}, {_PROJECTED} SELECT * FROM (SELECT CAST(r AS BIGINT) AS i0, d.i1, round(dot * CASE WHEN r = 0 THEN x ELSE y END, 4) + 0.0 AS v FROM d JOIN f ON i2 = slice CROSS JOIN range(2) AS z(r)) AS u WHERE v <> 0")
def matrix_rank_one(spark, sf):
    return _matrix_cells(block_matrix.tall_svd(shape.unfold(lines3(spark, sf), [0]), 1).product())


@_query(f"WITH t AS ({_MATRIX2}) SELECT i0, i1, round(v, 4) AS v FROM t WHERE round(v, 4) <> 0")
def matrix_full_svd(spark, sf):
    return _matrix_cells(block_matrix.tall_svd(shape.unfold(lines3(spark, sf), [0])).product())


@_query(f"WITH t AS ({_ORDERS5}), g AS (SELECT x.i0 AS a, y.i0 AS b, x.i2, x.i3, x.i4, sum(x.v * y.v) AS g FROM t AS x JOIN t AS y USING (i1, i2, i3, i4) GROUP BY ALL) SELECT i2 + 5 * i3 + 25 * i4 AS slice, round(sum(CASE WHEN a = b THEN g ELSE 0 END), 4) AS energy, round(sum(g * g), 4) AS energy2 FROM g GROUP BY ALL")
def slice_energies(spark, sf):
    """Sums of squares and fourth powers of the singular values, which the cells give as well."""
    s2 = F.col("sigma") * F.col("sigma")
    sums = fx.singular_values(fx.to_slices(orders5(spark, sf))).groupBy("slice").agg(F.sum(s2).alias("e"), F.sum(s2 * s2).alias("e2"))
    return sums.where("e > 0").select("slice", F.round("e", 4).alias("energy"), F.round("e2", 4).alias("energy2"))


@_query(_cells_sql("t", "i0, i1, i2, i3, i4", ctes=f"t AS ({_ORDERS5})"))
def full_rank_roundtrip(spark, sf):
    t = orders5(spark, sf)
    return _cells(compression.reconstruct(compression.compress(t, "dct", rank=3, strategy="tubes"), "tubes"))


def events2(spark: SparkSession, sf: str) -> Tensor:
    """Purchases and all other events x hour x day: sum of values."""
    modes = [((F.col("event_type") == "purchase").cast("int"), 2), (F.hour("ts"), 24), (F.dayofmonth("ts") - 1, 31)]
    return tensor_from_table(read(spark, sf, "events"), modes, F.col("value"))


_EVENTS2 = "SELECT CAST(event_type = 'purchase' AS BIGINT) AS i0, CAST(hour(ts) AS BIGINT) AS i1, CAST(day(ts) - 1 AS BIGINT) AS i2, sum(value) AS v FROM events GROUP BY ALL"
_EVENTS2_DCT = f"SELECT l.i0, l.i1, m.r AS i2, sum(l.v * m.w) AS v FROM ({_EVENTS2}) AS l JOIN ({_dct_sql(31)}) AS m ON l.i2 = m.c GROUP BY ALL"


@_query(_tolerance_sql(_gram2(_EVENTS2_DCT), 31, (2, 24), 0.1))
def compress_tolerance_events(spark, sf):
    """Method by tolerance in the cosine domain; the achieved error is measured on the reconstruction."""
    t = events2(spark, sf)
    return _reported(compression.report(t, compression.compress(t, "dct", tol=0.1)))


@_query(ORACLE_SQL["compress_tolerance_events"])
def blocks_compress_events(spark, sf):
    b = blocks.to_blocks(events2(spark, sf), 200)
    return _reported(compression.report_blocks(b, compression.compress_blocks(b, "dct", tol=0.1)))


def _held_sql(tensor: str) -> str:
    """A tolerance's report as far as cells alone tell: the norm, and that the rest follows from it."""
    return f"SELECT round(sqrt(sum(v * v)), 4) AS norm, true AS within, true AS parts_add_up, true AS ratio_follows FROM ({tensor}) AS t"


def _held(report: DataFrame, tol: float, ratio: Column) -> DataFrame:
    """That the error is within the tolerance, that kept and lost energy add up (both are orthogonal parts), and that the ratio follows from the ranks."""
    adds = F.abs(F.col("norm") * F.col("norm") - F.col("norm_back") * F.col("norm_back") - F.col("abs_err") * F.col("abs_err")) <= 1e-9 * F.col("norm") * F.col("norm")
    return report.select(F.round("norm", 4).alias("norm"), (F.col("relative_err") <= tol).alias("within"), adds.alias("parts_add_up"), (F.abs(F.col("compression_ratio") - ratio) < 1e-9).alias("ratio_follows"))


@_query(_held_sql(_EVENTS3))
def compress_tolerance_types(spark, sf):
    """The same with a row for each event type."""
    t = events3(spark, sf)
    found = compression.report(t, compression.compress(t, "dct", tol=0.1))
    return _held(found, 0.1, F.lit(float(t.size)) / (F.col("sum_rank") * (t.dims[0] + t.dims[1] + 1)))


@_query(f"SELECT unnest(['dct', 'hosvd', 'hosvd_t']) AS kind, round(sqrt(sum(v * v)), 4) AS norm, round(sqrt(sum(v * v)), 4) AS rebuilt, true AS within FROM ({_EVENTS4}) AS t")
def tolerance_holds(spark, sf):
    """What is dropped is orthogonal to what is kept: their squares sum to that of the norm. The cells are read many times,
    so they are a table (few cells, however many events)."""
    t = events4(spark, sf)
    t = t.with_cells(Steps(spark).cut(t.cells.coalesce(t.tasks)))
    rebuilt = F.sqrt(F.col("norm_back") * F.col("norm_back") + F.col("abs_err") * F.col("abs_err"))
    rows = [compression.report(t, compression.compress(t, kind, tol=0.2)).select(F.lit(kind).alias("kind"), F.round("norm", 4).alias("norm"), F.round(rebuilt, 4).alias("rebuilt"), (F.col("relative_err") <= 0.2).alias("within")) for kind in ("dct", "hosvd", "hosvd_t")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Baselines


@_query(f"WITH t AS ({_ORDERS5}) SELECT CAST(x.i3 AS BIGINT) AS a, CAST(y.i3 AS BIGINT) AS b, round(sum(x.v * y.v), 4) AS g FROM t AS x JOIN t AS y USING (i0, i1, i2, i4) GROUP BY ALL")
def hosvd_gram(spark, sf):
    g = compression.gram(shape.unfold(orders5(spark, sf), [3]))
    return g.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("g", 4).alias("g"))


_PARITY = (
    f"SELECT {_list_sql('l_linestatus', ['F', 'O'])} AS i0, CAST(l_linenumber % 2 AS BIGINT) AS i1, CAST(year(l_shipdate) % 2 AS BIGINT) AS i2, sum(l_extendedprice / 1e6) AS v FROM lineitem GROUP BY ALL"
)


def _mode_vector_sql(k: int) -> str:
    """u{k} (i, w): the leading vector of the Gram matrix of mode k, of size two."""
    others = [m for m in range(3) if m != k]
    same = " AND ".join(f"x.i{m} = y.i{m}" for m in others)
    return (
        f"a{k} AS (SELECT sum(CASE WHEN i{k} = 0 THEN v * v ELSE 0 END) AS a, sum(CASE WHEN i{k} = 1 THEN v * v ELSE 0 END) AS c FROM t),"
        f" b{k} AS (SELECT coalesce(sum(x.v * y.v), 0) AS b FROM t AS x JOIN t AS y ON {same} AND x.i{k} = 0 AND y.i{k} = 1),"
        f" l{k} AS (SELECT b, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 - a AS y FROM a{k}, b{k}),"
        f" u{k} AS (SELECT CAST(r AS BIGINT) AS i, CASE WHEN r = 0 THEN b ELSE y END / sqrt(b * b + y * y) AS w FROM l{k}, range(2) AS z(r))"
    )


@_query(
    f"WITH t AS ({_PARITY}), {', '.join(_mode_vector_sql(k) for k in range(3))}, n AS (SELECT sum(v * v) AS total FROM t),"
    " c AS (SELECT sum(v * u0.w * u1.w * u2.w) AS core FROM t JOIN u0 ON u0.i = t.i0 JOIN u1 ON u1.i = t.i1 JOIN u2 ON u2.i = t.i2)"
    " SELECT round(sqrt(total), 4) AS norm, round(abs(core), 4) AS norm_back, round(sqrt(greatest(total - core * core, 0)), 3) AS abs_err, round(8.0 / 7, 4) AS compression_ratio FROM n, c"
)
def hosvd_compress(spark, sf):
    """A tensor of two by two by two, half of each mode kept."""
    modes = [(code_of("l_linestatus", ["F", "O"]), 2), (F.pmod("l_linenumber", F.lit(2)), 2), (F.pmod(F.year("l_shipdate"), F.lit(2)), 2)]
    t = tensor_from_table(read(spark, sf, "lineitem"), modes, F.col("l_extendedprice") / 1e6)
    found = compression.report_hosvd(t, *compression.hosvd(t, share=0.5))
    return found.select(*[F.round(n, d).alias(n) for n, d in (("norm", 4), ("norm_back", 4), ("abs_err", 3), ("compression_ratio", 4))])


@_query(
    f"WITH {_gram2(f'SELECT i0, i1 + 7 * i2 AS i1, 0 AS i2, v FROM ({_LINES3}) AS l')}, w AS (SELECT (SELECT sigma FROM s WHERE q = 0) AS s0, (SELECT sigma FROM s WHERE q = 1) AS s1),"
    " k AS (SELECT *, CASE WHEN s0 * s0 >= (1 - 0.3 * 0.3) * (s0 * s0 + s1 * s1) THEN 1 ELSE 2 END AS k FROM w)"
    " SELECT CAST(k AS INTEGER) AS k, round(98.0 / (k * 52), 4) AS compression_ratio, round(CASE WHEN k = 1 THEN s1 / sqrt(s0 * s0 + s1 * s1) ELSE 0 END, 4) AS relative_err FROM k"
)
def eof_compress(spark, sf):
    """Line status in the place of time."""
    t = shape.permute(lines3(spark, sf), [1, 2, 0])
    back, k, ratio = compression.eof(t, 0.3)
    return compression.errors(t, back).select(F.lit(k).alias("k"), F.round(F.lit(ratio), 4).alias("compression_ratio"), F.round("relative_err", 4).alias("relative_err"))


def _stored(dims: tuple[int, ...]) -> Column:
    """Numbers of a core and its factor matrices, by the ranks."""
    ranks = [F.col("ranks")[k] for k in range(len(dims))]
    return F.lit(1.0) * math.prod(ranks[1:], start=ranks[0]) + sum((r * d for r, d in zip(ranks[1:], dims[1:], strict=True)), ranks[0] * dims[0])


@_query(_held_sql(_ORDERS5))
def hosvd_compress_orders(spark, sf):
    """Half of each mode; any error is within 1."""
    t = orders5(spark, sf)
    return _held(compression.report_hosvd(t, *compression.hosvd(t, share=0.5)), 1.0, F.lit(float(t.size)) / _stored(t.dims))


@_query(_held_sql(_EVENTS3))
def hosvd_tolerance_events(spark, sf):
    t = events3(spark, sf)
    return _held(compression.report_hosvd(t, *compression.hosvd(t, tol=0.2)), 0.2, F.lit(float(t.size)) / _stored(t.dims))


@_query(_held_sql(_EVENTS3))
def eof_compress_events(spark, sf):
    t = events3(spark, sf)
    back, k, ratio = compression.eof(t, 0.1)
    return _held(compression.errors(t, back).withColumn("compression_ratio", F.lit(ratio)), 0.1, F.lit(t.size / (k * (t.dims[2] + t.dims[0] * t.dims[1] + 1))))


@_query("WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT CAST(a.d AS BIGINT) AS a, CAST(b.d AS BIGINT) AS b, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 4) + 0.0 AS g FROM e AS a JOIN e AS b USING (vec_id) GROUP BY ALL")
def eof_gram(spark, sf):
    cells = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("r", "x"))
    m = Matrix(cells.select("r", F.col("vec_id").alias("c"), F.col("x").cast("double").alias("v")), 64, 1 << 31)
    return compression.gram(m).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), _rounded("g").alias("g"))


# Analyses


@_query(
    f"WITH k AS ({_EVENTS3}), t AS (SELECT CAST(a.i0 AS BIGINT) AS i0, CAST(b.i1 AS BIGINT) AS i1, c.i2, coalesce(k.v, 0) AS v FROM range(5) AS a(i0) CROSS JOIN range(24) AS b(i1) CROSS JOIN range(30) AS c(i2) LEFT JOIN k ON k.i0 = a.i0 AND k.i1 = b.i1 AND k.i2 = c.i2), m AS (SELECT i0, i1, avg(v) AS mean, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM t GROUP BY ALL)"
    " SELECT t.i0, t.i1, count(*) AS n_extreme, round(avg(abs(v - mean) / nullif(abs(v), 0)), 4) AS mean_err, round(max(abs(v - mean) / nullif(abs(v), 0)), 4) AS max_err, round(median(abs(v - mean) / nullif(abs(v), 0)), 4) AS median_err"
    " FROM t JOIN m ON t.i0 = m.i0 AND t.i1 = m.i1 WHERE v <= lo OR v >= hi GROUP BY ALL"
)
def extreme_events(spark, sf):
    """Against the tubes' means in place of a reconstruction."""
    t = events3(spark, sf)
    tubes = t.cells.groupBy("i0", "i1").agg((F.sum("v") / t.dims[2]).alias("mean"))
    back = t.with_cells(dense(t).cells.drop("v").join(tubes, ["i0", "i1"]).withColumnRenamed("mean", "v"))
    errs = [F.round(c, 4).alias(c) for c in ("mean_err", "max_err", "median_err")]
    return analytics.extremes(t, back).select(F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), "n_extreme", *errs)


@_query(
    "WITH d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, dayofyear(o_orderdate) - 1 AS step, o_totalprice AS p FROM orders),"
    " k AS (SELECT *, (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 AS leap FROM d)"
    " SELECT year, CAST(CASE WHEN leap AND step >= 59 THEN step - 1 ELSE step END AS INTEGER) AS doy, CAST(0 AS INTEGER) AS tod, round(sum(p), 2) AS revenue FROM k WHERE NOT (leap AND step = 59) GROUP BY ALL"
)
def calendar_fold(spark, sf):
    steps = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), (F.dayofyear("o_orderdate") - 1).alias("step"), F.col("o_totalprice").alias("p"))
    return analytics.fold_calendar(steps, 1).groupBy("year", "doy", "tod").agg(F.round(F.sum("p"), 2).alias("revenue"))


@_query(
    "WITH d AS (SELECT list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS i0, CAST(year(o_orderdate) AS INTEGER) AS year, dayofyear(o_orderdate) - 1 AS step, o_totalprice AS p FROM orders),"
    " k AS (SELECT *, (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 AS leap FROM d)"
    " SELECT i0, CAST(0 AS BIGINT) AS i1, CAST(CASE WHEN leap AND step >= 59 THEN step - 1 ELSE step END AS BIGINT) AS i2, CAST(year - 1990 AS BIGINT) AS i3, round(sum(p), 2) AS v FROM k WHERE NOT (leap AND step = 59) GROUP BY ALL"
)
def calendar_modes(spark, sf):
    """Status x time of day x day of the year x year."""
    steps = read(spark, sf, "orders").select(code_of("o_orderstatus", STATUSES).cast("int").alias("i0"), F.year("o_orderdate").alias("year"), (F.dayofyear("o_orderdate") - 1).alias("step"), F.col("o_totalprice").alias("v"))
    return _cells(analytics.calendar_tensor(steps, (3,), 1990, 20, 1), 2)


def _runs(spark, sf):
    """Orders read as benchmark runs: the year gives the threads, the price the time."""
    threads = F.pow(F.lit(2), F.year("o_orderdate") - YEAR).cast("int")
    return read(spark, sf, "orders").select(F.col("o_orderpriority").alias("dname"), F.col("o_orderstatus").alias("variant"), threads.alias("threads"), F.col("o_totalprice").alias("time_sec"))


_RUNS = "m AS (SELECT o_orderpriority AS dname, o_orderstatus AS variant, CAST(pow(2, year(o_orderdate) - 1995) AS INTEGER) AS threads, avg(o_totalprice) AS mean_sec, count(*) AS runs FROM orders WHERE o_totalprice > 0 GROUP BY ALL)"


@_query(f"WITH {_RUNS} SELECT dname, variant, threads, round(mean_sec, 4) AS mean_sec, runs FROM m")
def benchmark_means(spark, sf):
    return analytics.means(_runs(spark, sf), ["dname", "variant", "threads"]).withColumn("mean_sec", F.round("mean_sec", 4))


@_query(
    f"WITH {_RUNS} SELECT dname, variant, threads, runs, round(mean_sec, 4) AS mean_sec, round(max(CASE WHEN threads = 1 THEN mean_sec END) OVER (PARTITION BY dname, variant) / mean_sec, 4) AS speedup_one,"
    " round(first_value(mean_sec) OVER (PARTITION BY dname, variant ORDER BY threads) / mean_sec, 4) AS speedup_first FROM m"
)
def benchmark_speedups(spark, sf):
    out = analytics.speedups(analytics.means(_runs(spark, sf), ["dname", "variant", "threads"]), ["dname", "variant"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean_sec", "speedup_one", "speedup_first")})


@_query(
    "WITH d AS (SELECT o_orderpriority AS alg, o_totalprice AS relative_err, CAST(o_orderkey AS DOUBLE) AS compression_ratio, true AS complete FROM orders WHERE o_orderstatus <> 'P')"
    " SELECT alg, relative_err, compression_ratio, complete, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY alg ORDER BY relative_err, compression_ratio) AS INTEGER) AS place,"
    " row_number() OVER (PARTITION BY alg ORDER BY relative_err DESC, compression_ratio DESC) AS back FROM d) AS r WHERE back > 2"
)
def error_frontier(spark, sf):
    runs = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("alg"), F.col("o_totalprice").alias("relative_err"), F.col("o_orderkey").cast("double").alias("compression_ratio"), (F.col("o_orderstatus") != "P").alias("complete"))
    return analytics.frontier(runs, ["alg"], drop_last=2)


@_query(
    "WITH m AS (SELECT l_linenumber AS threads, avg(l_quantity) AS transform, avg(l_discount) AS vectors, avg(l_tax) AS matmul FROM lineitem GROUP BY ALL),"
    " u AS (SELECT threads, unnest(['transform', 'vectors', 'matmul']) AS phase, unnest([transform, vectors, matmul]) AS mean_sec, unnest([1, 2, 3]) AS n FROM m)"
    " SELECT threads, phase, round(mean_sec, 4) AS mean_sec, round(sum(mean_sec) OVER (PARTITION BY threads ORDER BY n ROWS UNBOUNDED PRECEDING), 4) AS stacked_sec FROM u"
)
def phase_stack(spark, sf):
    runs = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("threads"), F.col("l_quantity").alias("transform"), F.col("l_discount").alias("vectors"), F.col("l_tax").alias("matmul"))
    return analytics.phase_stack(runs, ["threads"], ["transform", "vectors", "matmul"]).withColumns({c: F.round(c, 4) for c in ("mean_sec", "stacked_sec")})


@_query("SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders")
def upsert_rows(spark, sf):
    old = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    new = old.where("o_orderstatus = 'P'").withColumn("price", F.round(F.col("price") * 2, 2))
    return upserted(old, new, ["o_orderkey"])


def _logs(spark, sf):
    """A log for each order, written from its columns."""
    key, price = F.col("o_orderkey").cast("string"), F.round("o_totalprice", 2).cast("string")
    lines = [
        "alg      : two", "mtype    : dct", F.concat(F.lit("dname    : "), F.lower("o_orderstatus")), "Tensor shape: (2, 3)", "[two_compress] ttm_modes [2, 3]",
        F.concat(F.lit("[two_compress] Time for TTM on mode 2 : "), price), F.concat(F.lit("[two_compress] Time for TTM on mode 3 : "), key),
        F.concat(F.lit("[two_compress] Time for slicewise_svdks: "), price), F.concat(F.lit("Compression ratio: "), key),
        "[two_reconstruct] Time to reconstruct A_hat: 0.25", F.concat(F.lit("[two_reconstruct] Time for TTM on mode 3 : "), price), "Absolute err: 1e-3",
        F.concat(F.lit("Relative err: "), F.when(F.col("o_orderstatus") == "P", F.lit("nan")).otherwise(F.lit("0.5"))),
    ]
    content = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    run = F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.concat(F.lit("_run"), F.pmod("o_orderkey", F.lit(3)).cast("string"))).otherwise(F.lit(""))
    file = F.concat(F.lit("/logs/air_two_0.1_dct_0123_"), F.pmod("o_orderkey", F.lit(8)).cast("string"), run)
    return read(spark, sf, "orders").select(file.alias("file"), content.alias("content"), "o_orderkey")


@_query(
    "SELECT lower(o_orderstatus) AS dname, 'two' AS alg, 'air' AS dname_f, CAST(o_orderkey % 8 AS VARCHAR) AS omp_threads_f, CASE WHEN o_orderkey % 3 > 0 THEN 'run' || CAST(o_orderkey % 3 AS VARCHAR) END AS run_id,"
    " round(round(o_totalprice, 2) + o_orderkey, 2) AS time_compress_ttm_total, round(o_totalprice, 2) AS time_slicewise_svdks, CAST(NULL AS DOUBLE) AS time_slicewise_svd, CAST(0.25 AS DOUBLE) AS time_reconstruct_matmul,"
    " round(o_totalprice, 2) AS time_reconstruct_ttm_total, CAST(o_orderkey AS DOUBLE) AS compression_ratio, '(2, 3)' AS tensor_shape, o_orderstatus <> 'P' AS complete FROM orders"
)
def log_table(spark, sf):
    kept = ["dname", "alg", "dname_f", "omp_threads_f", "run_id", "time_slicewise_svdks", "time_slicewise_svd", "time_reconstruct_matmul", "time_reconstruct_ttm_total", "compression_ratio", "tensor_shape", "complete"]
    return analytics.parse_logs(_logs(spark, sf)).select(*kept, F.round("time_compress_ttm_total", 2).alias("time_compress_ttm_total"))


@_query(
    "SELECT o_orderkey, unnest(['compress', 'compress', 'reconstruct']) AS phase, CAST(unnest([2, 3, 3]) AS INTEGER) AS mode, unnest([round(o_totalprice, 2), CAST(o_orderkey AS DOUBLE), round(o_totalprice, 2)]) AS time_sec FROM orders"
)
def log_phase_times(spark, sf):
    return analytics.phase_times(_logs(spark, sf), "o_orderkey")
