"""Analyses around the core: extremes, calendars, logs and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubal.tensor import Tensor, dense, index_names

def extremes(original: Tensor, back: Tensor, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Relative errors at extreme events, by the first two indexes: ``i0, i1, n_extreme, mean_err,
    max_err, median_err``. Extreme is what lies at or beyond the interpolated percentiles. Cells that are
    missing are zeros, in both tensors; an error relative to zero is null and left out of the means."""
    original = dense(original)
    ends = original.cells.groupBy("i0", "i1").agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))
    joined = original.cells.join(ends, ["i0", "i1"]).where((F.col("v") <= F.col("lo")) | (F.col("v") >= F.col("hi")))
    joined = joined.join(back.cells.withColumnRenamed("v", "w"), original.modes, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    err = F.when(F.col("v") != 0, F.abs(F.col("v") - F.col("w")) / F.abs(F.col("v")))
    rel = joined.select("i0", "i1", err.alias("e"))
    return rel.groupBy("i0", "i1").agg(F.count(F.lit(1)).alias("n_extreme"), F.avg("e").alias("mean_err"), F.max("e").alias("max_err"), F.median("e").alias("median_err"))


def is_leap(year: Column) -> Column:
    return ((F.pmod(year, F.lit(4)) == 0) & (F.pmod(year, F.lit(100)) != 0)) | (F.pmod(year, F.lit(400)) == 0)


def fold_calendar(steps: DataFrame, per_day: int = 4) -> DataFrame:
    """``year, step, ...`` (step of the year from 0) to ``year, doy, tod, ...`` without the 29th of
    February, so that all years have 365 days."""
    feb29 = 59 * per_day
    leap = is_leap(F.col("year"))
    kept = steps.where(~(leap & F.col("step").between(feb29, feb29 + per_day - 1)))
    step = F.when(leap & (F.col("step") >= feb29), F.col("step") - per_day).otherwise(F.col("step"))
    return kept.withColumn("doy", F.floor(step / per_day).cast("int")).withColumn("tod", F.pmod(step, F.lit(per_day)).cast("int")).drop("step")


def calendar_tensor(steps: DataFrame, lead: tuple[int, ...], first_year: int, years: int, per_day: int = 4) -> Tensor:
    """``i0 ... , year, step, v`` (``lead`` the sizes of the index columns) as a tensor with three modes more:
    time of day, day of the year (365, without the 29th of February) and year. Years outside the range are an error."""
    folded = fold_calendar(steps, per_day)
    year = F.col("year") - first_year
    fits = F.assert_true(year.between(0, years - 1), F.lit("a year outside the range"))
    n = len(lead)
    placed = folded.select(*index_names(n), F.col("tod").alias(f"i{n}"), F.col("doy").alias(f"i{n + 1}"), F.coalesce(fits.cast("int"), year.cast("int")).alias(f"i{n + 2}"), "v")
    return Tensor(placed.groupBy(*index_names(n + 3)).agg(F.sum("v").alias("v")), (*lead, per_day, 365, years))


def means(bench: DataFrame, keys: list[str], time: str = "time_sec") -> DataFrame:
    """Mean time of the runs that succeeded (above zero)."""
    return bench.where(F.col(time) > 0).groupBy(*keys).agg(F.avg(time).alias("mean_sec"), F.count(F.lit(1)).alias("runs"))


def speedups(mean: DataFrame, keys: list[str], threads: str = "threads") -> DataFrame:
    """Against one thread, and against the fewest threads there are, with the same other keys."""
    group = Window.partitionBy(*keys)
    one = F.max(F.when(F.col(threads) == 1, F.col("mean_sec"))).over(group)
    first = F.first("mean_sec").over(group.orderBy(threads).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return mean.withColumn("speedup_one", one / F.col("mean_sec")).withColumn("speedup_first", first / F.col("mean_sec"))


def frontier(runs: DataFrame, keys: list[str], drop_last: int = 0) -> DataFrame:
    """Complete runs in order of error, numbered within their keys; the last few may be left out."""
    done = runs.where("complete")
    up = F.row_number().over(Window.partitionBy(*keys).orderBy("relative_err", "compression_ratio"))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("relative_err"), F.desc("compression_ratio")))
    return done.withColumn("place", up).withColumn("_d", down).where(F.col("_d") > drop_last).drop("_d")


def phase_stack(runs: DataFrame, keys: list[str], phases: list[str]) -> DataFrame:
    """Mean time of each phase by keys, and the sum of it and the phases before it."""
    mean = runs.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in phases])
    long = mean.unpivot(keys, phases, "phase", "mean_sec")
    order = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase"))
    return long.withColumn("stacked_sec", F.sum("mean_sec").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


_NUMBER = r"([-+]?(?:[0-9.]+(?:[eE][-+]?[0-9]+)?|(?i:nan|inf)))"
#: Labels of a log's lines by the column that they fill; sums are over all modes. Fixed values.
_TEXTS = {"alg": "alg", "mtype": "mtype", "k": "k", "tol": "tol", "dname": "dname", "dfile": "dfile", "perm_mode": "perm_mode", "tensor_shape": "Tensor shape"}
_WHOLE_LINES = {"perm_mode", "tensor_shape"}
_NUMBERS = {"time_transform_matrix": "Time to generate transformation matrices", "compression_ratio": "Compression ratio"}
_COMPRESS = {
    "time_slicewise_svd": "Time for slicewise SVD", "time_slicewise_svdvals": "Time for slicewise_svdvals",
    "time_thresholds": "Time for thresholds", "time_slicewise_svdks": "Time for slicewise_svdks",
}
_RECONSTRUCT = {"time_reconstruct_matmul": "Time to reconstruct A_hat"}
_ERRORS = {
    "absolute_err": "Absolute err", "relative_err": "Relative err", "norm_original": "Norm of original tensor",
    "norm_reconstructed": "Norm of reconstructed tensor",
}
_CONVERT = r"Time to convert to \S+ tensor:"
_NAME_PARTS = ["dname_f", "alg_f", "k_or_tol_f", "mtype_f", "perm_mode_f", "omp_threads_f"]
_MODE = r"Time for TTM on mode (\d+) :"
#: Fixed values too: the columns of a parsed log.
LOG_COLUMNS = [
    "filename", "complete", *_NAME_PARTS, "run_id", *_TEXTS, "time_transform_matrix", "time_data_to_tensor", "compression_ratio",
    "time_compress_ttm_total", *_COMPRESS, "time_reconstruct_matmul", "time_reconstruct_ttm_total", *_ERRORS,
]

#: Stands for the brackets around a phase, whatever the algorithm.
_PHASE = "\x01"
_TEXT_LINE = r"(?m)^((?:alg|mtype|k|tol|dname|dfile)(?=[ \t])|perm_mode|Tensor shape(?=:))[ \t]*:[ \t]+(\S.*)"
_NUMBER_LINE = rf"(?m)^([^:\r\n]+):[ \t]+{_NUMBER}"


def _sections(logs: DataFrame, text: str) -> DataFrame:
    """``logs`` with a log up to the first line of the reconstruction, ``compress``, and from there on, ``reconstruct``."""
    marked = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), r"(?m)^\[\w+_(compress|reconstruct)\]", f"{_PHASE}$1"))
    both = logs.withColumn("marked", marked).withColumn("compress", F.substring_index("marked", f"\n{_PHASE}reconstruct", 1))
    return both.withColumn("reconstruct", F.substr("marked", F.length("compress") + 1)).drop("marked")


def parse_logs(logs: DataFrame, name: str = "file", text: str = "content") -> DataFrame:
    """One row per log, ``LOG_COLUMNS``: what its name says (six parts joined by ``_``, then perhaps
    ``_runN``; nulls if it has fewer), its parameters, times, ratio and errors. What a log lacks is null.
    It is complete where ratio and both errors are there and finite. Labels and values of all lines are found in one go."""
    base = F.col("base")
    logs = _sections(logs.select(F.element_at(F.split(F.col(name), "/"), -1).alias("base"), F.col(text).alias("content")), "content")

    def both_of(source: str, pattern: str, name: str) -> list[Column]:
        return [F.regexp_extract_all(source, F.lit(pattern), F.lit(i)).alias(f"{name}_{part}") for i, part in ((1, "labels"), (2, "values"))]

    named = [F.regexp_extract(base, r"_(run\d+)$", 1).alias("run"), F.split(F.regexp_replace(base, r"_run\d+$", ""), "_").alias("parts")]
    found = logs.select("base", *named, "compress", "reconstruct", F.regexp_extract("content", f"(?m)^{_CONVERT}[ \\t]+{_NUMBER}", 1).alias("convert"),
        *both_of("content", _TEXT_LINE, "text"), *both_of("compress", _NUMBER_LINE, "compress"), *both_of("reconstruct", _NUMBER_LINE, "reconstruct"))
    run, parts = F.col("run"), F.col("parts")

    def first(source: str, label: str) -> Column:
        at = F.array_position(f"{source}_labels", F.lit(label))
        return F.when(at > 0, F.get(f"{source}_values", (at - 1).cast("int")))

    def words(column: str) -> Column:
        value = first("text", _TEXTS[column])
        return F.rtrim(value) if column in _WHOLE_LINES else F.regexp_extract(value, r"^\S+", 0)

    def total(phase: str) -> Column:
        values = F.regexp_extract_all(phase, F.lit(f"(?m)^{_PHASE}{phase} {_MODE}\\s+{_NUMBER}"), F.lit(2))
        return F.when(F.size(values) > 0, F.aggregate(F.transform(values, lambda x: x.try_cast("double")), F.lit(0.0), lambda a, b: a + b))

    columns = {"filename": base} | {n: F.when(F.size(parts) >= 6, parts[i]) for i, n in enumerate(_NAME_PARTS)}
    columns["run_id"] = F.when((run != "") & (F.size(parts) >= 6), run)
    columns |= {n: words(n) for n in _TEXTS} | {"time_data_to_tensor": F.col("convert").try_cast("double")}
    columns |= {n: F.coalesce(first("compress", x), first("reconstruct", x)).try_cast("double") for n, x in (_NUMBERS | _ERRORS).items()}
    columns |= {n: first(phase, f"{_PHASE}{phase} {x}").try_cast("double") for phase, names in (("compress", _COMPRESS), ("reconstruct", _RECONSTRUCT)) for n, x in names.items()}
    columns |= {f"time_{phase}_ttm_total": total(phase) for phase in ("compress", "reconstruct")}
    rows = found.select(*[c.alias(n) for n, c in columns.items()])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("relative_err", "absolute_err", "compression_ratio")]
    return rows.withColumn("complete", finite[0] & finite[1] & finite[2]).select(*LOG_COLUMNS)


def phase_times(logs: DataFrame, name: str = "file", text: str = "content") -> DataFrame:
    """Each mode product's time in a log: ``file, phase`` (compress or reconstruct), ``mode, time_sec``."""
    out = None
    logs = _sections(logs.select(F.col(name), F.col(text).alias("content")), "content")
    for phase in ("compress", "reconstruct"):
        pattern = rf"(?m)^{_PHASE}{phase} {_MODE}\s+{_NUMBER}"
        both = F.arrays_zip(*[F.regexp_extract_all(phase, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "mode"), (2, "time"))])
        found = logs.select(F.col(name), F.lit(phase).alias("phase"), F.explode_outer(both).alias("x")).where("x is not null")
        found = found.select(name, "phase", F.col("x.mode").cast("int").alias("mode"), F.col("x.time").try_cast("double").alias("time_sec"))
        out = found if out is None else out.unionByName(found)
    return out
