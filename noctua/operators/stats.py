"""Grouped robust statistics and fits over any table and any key columns.

Every function takes a DataFrame, key column names and value column names, and returns a DataFrame.  Non-finite values
count as missing.  Groups are never collected: medians and ranks come from counts of equal values, ranked in a task where they are few and over
ranges where they are many; fits come from sums.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import finite, half_even
from noctua.session import written

MAD_SIGMA = 1.4826


def _join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; other's keys are dropped."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # other is one row of totals
    names = {k: f"_{k}" for k in keys}
    other = other.withColumnsRenamed(names)
    return df.join(other, reduce(Column.__and__, [df[k].eqNullSafe(other[n]) for k, n in names.items()]), how).drop(*names.values())


def _own_names(rule: Callable) -> Callable:
    """Keys may be named like the columns that ranking makes (x, c, upto); a key named n would stand beside the count n."""

    @wraps(rule)
    def run(df: DataFrame, keys: list[str], value: str, *args, **options) -> DataFrame:
        taken = {k: f"_key{i}" for i, k in enumerate(keys) if k in ("x", "c", "upto", "n")}
        if "n" in taken:
            raise ValueError("a key named n would stand beside the count n: rename it")
        if not taken:
            return rule(df, keys, value, *args, **options)
        df = df.withColumnsRenamed(taken)
        df = df.withColumn(value, F.col(taken[value])) if value in taken else df
        return rule(df, [taken.get(k, k) for k in keys], value, *args, **options).withColumnsRenamed({v: k for k, v in taken.items()})

    return run


# --- G8, G9, G12, G13 ----------------------------------------------------------------------------------------------------


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, x, c: each finite value with the number of its rows; counted before the shuffle, so a hot value is one row."""
    return df.select(*keys, finite(F.col(value)).alias("x")).where("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("c"))


#: Distinct values of a group that one task ranks.
TASK_VALUES = 1 << 16


def ranked(values: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, x, c, upto (rows of the group up to this value, with it) and n (rows of the group), of counted values.

    Where no group has more than `most` (TASK_VALUES) distinct values a task ranks each group.  Else values are dealt over partitions by
    ranges of (keys, x) and summed there; a group's running sum goes on from one partition to the next by a table of one row
    for each group and partition.  So a group of any size, and any number of distinct values, is spread over the tasks.  The
    counted values and the dealt ones are written, since ranges are drawn anew whenever a plan runs."""
    values = written(values, "counted")
    if (values.groupBy(*keys).agg(F.count("*").alias("_v")).agg(F.max("_v")).first()[0] or 0) <= (TASK_VALUES if most is None else most):
        group = Window.partitionBy(*keys)
        return values.withColumns({"upto": F.sum("c").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("c").over(group)})
    x = written(values.repartitionByRange(*keys, "x").withColumn("_p", F.spark_partition_id()), "ranked")
    parts = x.groupBy(*keys, "_p").agg(F.sum("c").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_c")
    parts = parts.select(*keys, "_p", before.alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.sum("c").over(Window.partitionBy(*keys, "_p").orderBy("x"))
    return _join(x, parts, [*keys, "_p"]).withColumn("upto", F.col("_before") + inside).drop("_p", "_before")


def _few(values: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more rows than one task ranks."""
    return (values.groupBy(*keys).agg(F.count("*").alias("_v")).agg(F.max("_v")).first()[0] or 0) <= TASK_VALUES


#: Bins into which a pass of _middle deals the values of a group.
BINS = 1 << 14


def _middle(values: DataFrame, keys: list[str], value: str, span: DataFrame, names: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, and for each name the exact median of a function that rises with `value`, by the counts _c.  span: keys, bounds of the
    group's values (_from, _to) and its rows (_all).

    Each pass counts the values of a group by bins of equal width and goes on inside the bin that holds the middle, until that is one
    value or lies between two bins; so a group of any size is never gathered or sorted."""
    x = values.select(*keys, F.col(value).alias("_x"), "_c")
    state = span.select(*keys, "_from", "_to", F.floor((F.col("_all") - 1) / 2).alias("_a"), F.ceil((F.col("_all") - 1) / 2).alias("_b"))
    found = []
    while True:
        at = F.least(F.floor(F.try_divide(F.col("_x") - F.col("_from"), F.col("_to") - F.col("_from")) * BINS), F.lit(BINS - 1))
        inside = _join(x, state, keys).where(F.col("_x").between(F.col("_from"), F.col("_to")))
        bins = inside.groupBy(*keys, "_a", "_b", F.coalesce(at, F.lit(0)).alias("_bin")).agg(F.sum("_c").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        bins = bins.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_n"))
        hit = bins.where((F.col("_before") <= F.col("_b")) & (F.col("_before") + F.col("_n") > F.col("_a")))
        hit = hit.groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_k"), F.min("_lo").alias("_from"), F.max("_hi").alias("_to"), F.min("_hi").alias("_first"), F.max("_lo").alias("_last"), F.min("_before").alias("_before"))
        hit = written(hit, "middle")
        done = (F.col("_k") == 2) | (F.col("_from") == F.col("_to"))  # of two bins the middle lies between
        found.append(hit.where(done).select(*keys, *[((of(F.col("_first")) + of(F.col("_last"))) / 2).alias(name) for name, of in names.items()]))
        state = hit.where(~done).select(*keys, "_from", "_to", (F.col("_a") - F.col("_before")).alias("_a"), (F.col("_b") - F.col("_before")).alias("_b"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, found)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """df with the row's place in its group by `order`, from 1, and if asked the group's number of rows; spread over tasks
    as in ranked, so only rows alike in keys and order have to meet in one."""
    x = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    parts = x.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_c")
    parts = parts.select(*keys, "_p", before.alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    got = _join(x, parts, [*keys, "_p"]).withColumn(name, F.col("_before") + inside)
    return (got.withColumn(total, F.col("_all")) if total else got).drop("_p", "_before", "_all")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the last `value` that is not NULL up to each row, in its group by `order`; spread over tasks by ranges of (keys,
    order), of which each hands its last value on to the next by a table of one row for each group and range."""
    x = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "carried")
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value"))))
    ends = x.groupBy(*keys, "_p").agg(last.alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_p", before.alias("_before"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _join(x.withColumn(name, inside), ends, [*keys, "_p"]).withColumn(name, F.coalesce(name, "_before._value")).drop("_p", "_before")


def _linear(ranks: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    """keys, n and linear quantiles from ranked values."""
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("x")))
    cols = []
    for q, name in zip(qs, names, strict=True):
        place = F.lit(q) * (F.col("n") - 1)
        cols += [at(F.floor(place)).alias(f"_l_{name}"), at(F.ceil(place)).alias(f"_h_{name}")]
    got = ranks.groupBy(*keys).agg(F.first("n").alias("n"), *cols)
    share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return got.select(*keys, "n", *[(F.col(f"_l_{m}") + (F.col(f"_h_{m}") - F.col(f"_l_{m}")) * share(q)).alias(m) for q, m in zip(qs, names, strict=True)])


@_own_names
def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, median, mad and sigma = 1.4826 mad of the finite values."""
    x = counted(df, keys, value)
    centre = _linear(ranked(x, keys), keys, [0.5], ["median"])
    off = _join(x, centre.select(*keys, "median"), keys).groupBy(*keys, F.abs(F.col("x") - F.col("median")).alias("x")).agg(F.sum("c").alias("c"))
    spread = _linear(ranked(off, keys), keys, [0.5], ["mad"]).drop("n")
    return _join(centre, spread, keys).withColumn("sigma", MAD_SIGMA * F.col("mad"))


@_own_names
def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: list[float], names: list[str] | None = None) -> DataFrame:
    """Values at index round(q (n - 1)), halves to even, of the sorted finite values."""
    names = names or [f"q{round(q * 100):02d}" for q in quantiles]
    x = ranked(counted(df, keys, value), keys)
    at = [half_even(F.lit(q) * (F.col("n") - 1)) for q in quantiles]
    return x.groupBy(*keys).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > i, F.col("x"))).alias(name) for i, name in zip(at, names, strict=True)])


def medians(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """keys and for each name the median of a column's finite values (NULL without any), of groups of any size."""
    out = None
    for name, column in values.items():
        got = quantiles(df, keys, column, [0.5], [name]).drop("n")
        out = got if out is None else _join(out, got, keys)
    return out


@_own_names
def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str]) -> DataFrame:
    """Linear interpolation between order statistics of the finite values; a group without any has n = 0 and NULLs."""
    got = _linear(ranked(counted(df, keys, value), keys), keys, qs, names)
    if not keys:
        return got
    return _join(df.select(*keys).distinct(), got, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cdf(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """Sorted finite values with y from 0 to 1 in equal steps (0 for a single one)."""
    x = df.select(*keys, *tie, finite(F.col(value)).alias("x")).where("x is not null")
    x = numbered(x, keys, ["x", *tie], "_at", "_n")
    return x.select(*keys, *tie, "x", F.when(F.col("_n") > 1, (F.col("_at") - 1) / (F.col("_n") - 1)).otherwise(0.0).alias("y"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """Bin, count, log10_count (NULL for 0) and, if asked, density; the last edge belongs to the last bin and
    values outside are left out.  Bins without values are left out."""
    step = (high - low) / bins
    x = finite(F.col(value))
    at = F.least(F.floor((x - low) / step), F.lit(bins - 1))
    got = df.where((x >= low) & (x <= high)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    got = got.withColumn("left", F.lit(low) + F.col("bin") * step).withColumn("log10_count", F.log10("count"))
    if density:
        got = got.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)) / step)
    return got


# --- W1-W3 ---------------------------------------------------------------------------------------------------------------


def sub_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """sub_index from 1 by the order inside each group."""
    return numbered(df, keys, order, "sub_index").withColumn("sub_index", F.col("sub_index").cast("int"))


def normalize_by_median(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """quality_norm = value / median of the group's positive finite values; NULL in groups with fewer than `least`."""
    x = finite(F.col(value))
    centre = _linear(ranked(counted(df.where(x > 0), keys, value), keys), keys, [0.5], ["_median"]).withColumnRenamed("n", "_n")
    return _join(df, centre, keys, "left").withColumn("quality_norm", F.when((F.col("_n") >= least) & (F.col("_median") > 0), x / F.col("_median"))).drop("_median", "_n")


def percentile_rank(df: DataFrame, keys: list[str], value: str, name: str = "pct") -> DataFrame:
    """(count of values up to this one - 1) / (n - 1) over finite values, so ties take the high rank; 1 for a single
    value; NULL stays NULL."""
    ranks = ranked(counted(df, keys, value), keys).select(*keys, F.col("x").alias("_x"), F.when(F.col("n") == 1, 1.0).otherwise((F.col("upto") - 1) / (F.col("n") - 1)).alias(name))
    return _join(df.withColumn("_x", finite(F.col(value))), ranks, [*keys, "_x"], "left").drop("_x")


# --- fits ------------------------------------------------------------------------------------------------------------------


def line_fit(df: DataFrame, keys: list[str], x: str, y: str, where: Column | None = None) -> DataFrame:
    """Least squares y = slope x + intercept, with r2 and n, over rows with both values."""
    a, b = finite(F.col(x)), finite(F.col(y))
    ok = a.isNotNull() & b.isNotNull() & (F.lit(True) if where is None else where)
    return df.where(ok).groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.count("*").alias("n"))


def clipped_line_fit(df: DataFrame, keys: list[str], x: str, y: str, sigma: float = 3.0, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """A sigma-clipped line for each group: (fits: keys, slope, intercept, std, n; rows with `inlier`).

    Each round fits the inliers, takes the population standard deviation of their residuals and keeps, of all points,
    those with |residual| < sigma std.  A mask follows from the fit before it, so a round is one aggregate over the rows
    joined with the last round's few coefficients, and a repeated mask repeats its fit, so rounds end when no fit moves.  A group with a std of 0 keeps
    its fit.  The coefficients are those of the mask before the last update.
    """
    rows = df.withColumn("_x", finite(F.col(x))).withColumn("_y", finite(F.col(y))).where("_x is not null and _y is not null")
    off = F.abs(F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept"))
    fit = None
    for _ in range(rounds):
        base = rows if fit is None else _join(rows, fit, keys)
        on = F.lit(True) if fit is None else F.col("std") > 0
        mask = F.lit(True) if fit is None else off < sigma * F.col("std")
        xin, yin = F.when(mask, F.col("_x")), F.when(mask, F.col("_y"))
        kept = [] if fit is None else [F.first(c).alias(f"_{c}") for c in ("slope", "intercept", "std", "n")]
        new = base.groupBy(*keys).agg(F.regr_slope(yin, xin).alias("a"), F.regr_intercept(yin, xin).alias("b"), F.count(xin).alias("c"), F.regr_syy(yin, xin).alias("yy"), F.regr_sxx(yin, xin).alias("xx"), F.regr_sxy(yin, xin).alias("xy"), F.first(on).alias("on"), *kept)
        rest = F.greatest(F.col("yy") - F.when(F.col("xx") > 0, F.col("xy") * F.col("xy") / F.col("xx")).otherwise(0.0), F.lit(0.0))
        std = F.sqrt(rest / F.col("c"))
        std = F.when(std <= 1e-9 * F.sqrt(F.col("yy") / F.col("c")), 0.0).otherwise(std)
        pick = lambda c, old: F.when(F.col("on"), c).otherwise(F.col(old)) if kept else c  # noqa: B023, E731
        before = [f"_{c}" for c in ("slope", "intercept", "std", "n")] if kept else []
        fit = new.select(*keys, *before, pick(F.col("a"), "_slope").alias("slope"), pick(F.col("b"), "_intercept").alias("intercept"), pick(std, "_std").alias("std"), pick(F.col("c"), "_n").alias("n"))
        close = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-12 * F.abs(F.col(f"_{c}"))
        same = (F.col("n") == F.col("_n")) & close("slope") & close("intercept") & close("std") if kept else F.lit(False)
        fit = written(fit.withColumn("moved", ~F.coalesce(same, F.lit(False))), "clipped-line")
        settled = fit.where("moved and std > 0").isEmpty()
        fit = fit.drop("moved", *before)
        if settled:  # each mask would repeat itself
            break
    return fit, _join(rows, fit, keys).withColumn("inlier", F.when(F.col("std") > 0, off < sigma * F.col("std")).otherwise(off <= 1e-9 * F.abs(F.col("_y")))).drop("_x", "_y", "slope", "intercept", "std", "n")


def clipped_line_fit_grouped(df: DataFrame, keys: list[str], x: str, y: str, sigma: float = 3.0, rounds: int = 10) -> DataFrame:
    """G14 with the group in one task, for many small groups: keys, slope, intercept, std, n.  Where a group has more rows than
    a task ranks, all groups are fitted by sums."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)
        mask = np.ones(len(a), bool)
        for _ in range(rounds):
            c = np.polyfit(a[mask], b[mask], 1) if mask.sum() > 1 and np.ptp(a[mask]) > 0 else (np.nan, np.nan)
            rest = b - c[0] * a - c[1]
            n, std = int(mask.sum()), float(np.std(rest[mask]))
            if not std > 1e-9 * float(np.std(b[mask])):
                std = 0.0 if np.isfinite(std) else std
                break
            new = np.abs(rest) < sigma * std
            if (new == mask).all():
                break
            mask = new
        return pdf.head(1)[keys].assign(slope=c[0], intercept=c[1], std=std, n=n)

    rows = df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y")).where("_x is not null and _y is not null")
    if not _few(rows, keys):
        fits, _ = clipped_line_fit(rows, keys, "_x", "_y", sigma, rounds)
        return fits.select(*keys, "slope", "intercept", F.when(F.col("slope").isNotNull(), F.col("std")).alias("std"), "n")
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys)
    return rows.groupBy(*keys).applyInPandas(fit, f"{kinds}, slope double, intercept double, std double, n long")


def parabola_fit(df: DataFrame, keys: list[str], x: str, y: str, order: list[str], lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """y = a d^2 + b d + c with d = x - mean(x): vertex, a, r2, monotonic, best.

    best is the vertex of an upward parabola, clamped to [lowest, highest] where given, else the x of the least y (first
    in order); monotonic tells a series that only rises or only falls."""
    p, v = finite(F.col(x)), finite(F.col(y))
    rows = df.withColumn("_p", p).withColumn("_v", v).where("_p is not null and _v is not null")
    step = F.col("_v") - F.lag("_v").over(Window.partitionBy(*keys).orderBy("_p", *order))
    rows = rows.withColumn("_step", step)
    mean = rows.groupBy(*keys).agg(F.avg("_p").alias("_m"), F.stddev_pop("_p").alias("_s"))
    rows = _join(rows, mean, keys).withColumn("_d", (F.col("_p") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    d, w = F.col("_d"), F.col("_v")
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(F.pow(d, F.lit(float(i)))).alias(f"s{i}") for i in range(1, 5)],
        *[F.sum(w * F.pow(d, F.lit(float(i)))).alias(f"t{i}") for i in range(3)], F.sum(w * w).alias("ww"),
        F.first("_m").alias("_m"), F.first("_s").alias("_s"), F.min("_p").alias("lo"), F.max("_p").alias("hi"),
        F.min_by("_p", F.struct("_v", *order)).alias("argmin"), (F.min("_step") >= 0).alias("up"), (F.max("_step") <= 0).alias("down"),
    )
    c = F.col
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    n = c("n").cast("double")
    m = [c("s4"), c("s3"), c("s2"), c("s3"), c("s2"), c("s1"), c("s2"), c("s1"), n]
    rhs = [c("t2"), c("t1"), c("t0")]
    whole = det(m)
    col = lambda k: F.when(F.abs(whole) > 1e-9 * n * n * n, det([rhs[i // 3] if i % 3 == k else m[i] for i in range(9)]) / whole)
    s = s.withColumn("qa", col(0)).withColumn("qb", col(1)).withColumn("qc", col(2))
    left = c("ww") - c("qa") * c("t2") - c("qb") * c("t1") - c("qc") * c("t0")
    total = c("ww") - c("t0") * c("t0") / n
    s = s.withColumn("vertex", F.when(c("qa") != 0, c("_m") - c("_s") * c("qb") / (2 * c("qa")))).withColumn("r2", F.when(total > 0, 1 - F.greatest(left, F.lit(0.0)) / total))
    s = s.withColumn("monotonic", F.coalesce(c("up") | c("down"), F.lit(True)))
    inside = c("vertex")
    inside = F.greatest(inside, F.lit(float(lowest))) if lowest is not None else inside
    inside = F.least(inside, F.lit(float(highest))) if highest is not None else inside
    good = (c("qa") > 0) & c("vertex").isNotNull()
    return s.select(*keys, "n", (c("qa") / (c("_s") * c("_s"))).alias("a"), "vertex", "r2", "monotonic", F.when(F.coalesce(good, F.lit(False)), inside).otherwise(c("argmin")).alias("best"))


def power_law_fit(df: DataFrame, keys: list[str], x: str, y: str, exponents: list[float]) -> DataFrame:
    """y = a x^b + c: for each exponent a line in x^b by sums, then the exponent with the least residual.

    The exponents (a fixed, short list) are exploded beside each row, so the fit is one aggregate."""
    rows = df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y")).where("_x > 0 and _y is not null")
    rows = rows.withColumn("b", F.explode(F.array(*[F.lit(float(e)) for e in exponents]))).withColumn("_p", F.pow("_x", "b"))
    fits = rows.groupBy(*keys, "b").agg(F.regr_slope("_y", "_p").alias("a"), F.regr_intercept("_y", "_p").alias("c"), F.count("*").alias("n"), F.regr_syy("_y", "_p").alias("_yy"), F.regr_sxy("_y", "_p").alias("_xy"), F.regr_sxx("_y", "_p").alias("_xx"))
    fits = fits.withColumn("sse", F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0)))
    return fits.groupBy(*keys).agg(F.min(F.struct("sse", "b", "a", "c", "n")).alias("m")).select(*keys, "m.a", "m.b", "m.c", "m.n", "m.sse")


def size_for(fit: DataFrame, targets: list[float]) -> DataFrame:
    """The x at which the fitted y reaches each target, rounded up; NULL where it never does."""
    t = fit.withColumn("target", F.explode(F.array(*[F.lit(float(v)) for v in targets])))
    base = F.try_divide(F.col("target") - F.col("c"), F.col("a"))
    return t.withColumn("size", F.when(base > 0, F.ceil(F.pow(base, 1 / F.col("b")) - 1e-9)))


def plane_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """z = a x + b y + c by normal equations on centred sums: a, b, c, n, median, gradient_frac (corner range of the
    plane over the unit square, over the median), r2 clamped to [0, 1].  Fewer than three points or a degenerate layout: NULL."""
    rows = df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y"), finite(F.col(z)).alias("_z")).where("_x is not null and _y is not null and _z is not null")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.avg("_z").alias("mz"), F.regr_sxx("_z", "_x").alias("xx"), F.regr_sxx("_z", "_y").alias("yy"), F.regr_sxy("_y", "_x").alias("xy"), F.regr_sxy("_z", "_x").alias("xz"), F.regr_sxy("_z", "_y").alias("yz"), F.regr_syy("_z", "_x").alias("zz"))
    s = _join(s, medians(rows, keys, {"median": "_z"}), keys)
    c = F.col
    det = c("xx") * c("yy") - c("xy") * c("xy")
    ok = (c("n") >= 3) & (det > 1e-12 * c("xx") * c("yy"))
    s = s.withColumn("a", F.when(ok, (c("xz") * c("yy") - c("yz") * c("xy")) / det)).withColumn("b", F.when(ok, (c("yz") * c("xx") - c("xz") * c("xy")) / det))
    s = s.withColumn("c", c("mz") - c("a") * c("mx") - c("b") * c("my"))
    r2 = F.when(c("zz") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("a") * c("xz") + c("b") * c("yz")) / c("zz")))).when(ok, 0.0)
    return s.select(*keys, "n", "a", "b", "c", "median", F.try_divide(F.abs(c("a")) + F.abs(c("b")), F.abs(c("median"))).alias("gradient_frac"), r2.alias("r2"))


def clipped_ratio(df: DataFrame, keys: list[str], a: str, b: str, sigma: float = 3.0, least: int = 3, rounds: int = 6) -> DataFrame:
    """The robust ratio b / a: ratio (median), ratio_mad, mad of log ratios, log_sigma, used, and low and high, the
    bounds of the log ratios in use.

    All log ratios within sigma times 1.4826 MAD (the standard deviation where the MAD is 0) of the median of those in use
    are in use next; a group stops, without applying the clip, if fewer than `least` would stay, and where sigma is 0.  Rounds end
    when no group's bounds move.  Equal ratios are counted and written once, and each round scans them."""
    x, y = finite(F.col(a)), finite(F.col(b))
    rows = df.select(*keys, F.when((x > 0) & (y > 0), F.try_divide(y, x)).alias("_q")).where(finite(F.log("_q")).isNotNull())
    rows = written(rows.groupBy(*keys, "_q").agg(F.count("*").alias("_c")).withColumn("_l", F.log("_q")), "log-ratios")
    few = _few(rows, keys)
    state = written(rows.groupBy(*keys).agg(F.min("_l").alias("lo"), F.max("_l").alias("hi"), F.sum("_c").alias("used")), "clipped-ratio")  # what is kept lies between bounds
    kept = lambda of: _join(rows, of, keys).where(F.col("_l").between(F.col("lo"), F.col("hi")))
    same = lambda c: c

    def middles(of: DataFrame, *wanted: tuple[Column, Column, Column, dict[str, Callable[[Column], Column]]]) -> DataFrame:
        """of with medians of rising functions of values, which lie between bounds."""
        if few:
            return written(_join(of, kept(of).groupBy(*keys).agg(*[F.percentile(f(v), 0.5, F.col("_c")).alias(name) for v, _, _, names in wanted for name, f in names.items()]), keys), "clipped-ratio")
        got = of
        for v, low, high, names in wanted:
            got = _join(got, _middle(kept(of).withColumn("_v", v), keys, "_v", of.select(*keys, low.alias("_from"), high.alias("_to"), F.col("used").alias("_all")), names), keys)
        return written(got, "clipped-ratio")

    off = F.col("_l") - F.col("m")
    mad = F.abs(off), F.lit(0.0), F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")), {"mad": same}
    for _ in range(rounds):
        spread = middles(middles(state, (F.col("_l"), F.col("lo"), F.col("hi"), {"m": same})), mad).withColumn("sd", F.lit(None).cast("double"))
        if not spread.where("mad = 0").isEmpty():
            mean, square = F.sum(F.col("_c") * off) / F.sum("_c"), F.sum(F.col("_c") * off * off) / F.sum("_c")
            spread = _join(spread.drop("sd"), kept(spread).groupBy(*keys).agg(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd")), keys)
        scale = F.when(F.col("mad") > 0, MAD_SIGMA * F.col("mad")).otherwise(F.col("sd"))
        bound = lambda old, side: F.when(scale > 0, F.col("m") + side * sigma * scale).otherwise(F.col(old))  # noqa: B023, E731
        wide = written(spread.select(*keys, "lo", "hi", "used", bound("lo", -1).alias("nlo"), bound("hi", 1).alias("nhi")), "clipped-ratio")
        left = _join(rows, wide, keys).groupBy(*keys, "lo", "hi", "used", "nlo", "nhi").agg(F.sum(F.when(F.col("_l").between(F.col("nlo"), F.col("nhi")), F.col("_c")).otherwise(0)).alias("c"))
        moved = (F.col("c") >= least) & ((F.col("nlo") != F.col("lo")) | (F.col("nhi") != F.col("hi")))
        left = written(left.withColumn("moved", moved), "clipped-ratio")
        state = left.select(*keys, *[F.when(F.col("c") >= least, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("nlo", "lo"), ("nhi", "hi"), ("c", "used"))])
        if left.where("moved").isEmpty():
            break
    state = written(state, "clipped-ratio")
    state = written(_join(state, kept(state).groupBy(*keys).agg(F.min("_q").alias("_least"), F.max("_q").alias("_most")), keys), "clipped-ratio")
    centre = middles(state, (F.col("_q"), F.col("_least"), F.col("_most"), {"m": F.log, "ratio": same}))
    ratio_mad = F.abs(F.col("_q") - F.col("ratio")), F.lit(0.0), F.greatest(F.col("_most") - F.col("ratio"), F.col("ratio") - F.col("_least")), {"ratio_mad": same}
    got = middles(centre, mad, ratio_mad)
    return got.where(F.col("used") >= least).select(*keys, "ratio", "ratio_mad", "mad", (MAD_SIGMA * F.col("mad")).alias("log_sigma"), "used", F.col("lo").alias("low"), F.col("hi").alias("high"))


def trimmed_affine(df: DataFrame, keys: list[str], ref: str, target: str, tie: list[str], trim: float = 0.10, low: float = 0.5, high: float = 2.0, least: int = 16, background: str = "median", min_samples: int = 2000) -> DataFrame:
    """reference = scale * target + offset for each group: scale, offset, ref_bg, target_bg, used, clamped.

    A group needs `min_samples` rows.  Rows are ranked by target (ties by `tie`), floor(trim n) go at each end, and at
    least max(least, min_samples // 2) have to be left, else the group is left out.  A scale outside [low, high] gives scale 1 and the difference of the backgrounds.  Sums are
    taken about the group's means by one aggregate over the ranked rows."""
    rows = df.withColumn("_r", finite(F.col(ref))).withColumn("_t", finite(F.col(target))).where("_r is not null and _t is not null")
    rows = numbered(rows, keys, ["_t", *tie], "_k", "_n")
    cut = F.floor(F.col("_n") * trim)
    kept = rows.where((F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut))
    level = F.median if background == "median" else F.avg
    fit = kept.groupBy(*keys).agg(F.count("*").alias("used"), F.first("_n").alias("_n"), F.regr_slope("_r", "_t").alias("_s"), F.regr_intercept("_r", "_t").alias("_o"), level("_r").alias("ref_bg"), level("_t").alias("target_bg"))
    fit = fit.where((F.col("_n") >= min_samples) & (F.col("used") >= max(least, min_samples // 2)))
    good = F.coalesce(F.col("_s").between(low, high), F.lit(False))
    return fit.select(*keys, F.when(good, F.col("_s")).otherwise(1.0).alias("scale"), F.when(good, F.col("_o")).otherwise(F.col("ref_bg") - F.col("target_bg")).alias("offset"), "ref_bg", "target_bg", "used", (~good).alias("clamped"))


def additive_offset(fit: DataFrame, gain: float) -> DataFrame:
    """The scale is given; the offset follows from the backgrounds."""
    return fit.withColumn("scale", F.lit(float(gain))).withColumn("offset", F.col("ref_bg") - gain * F.col("target_bg"))


def r_squared(df: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """1 - residual sum of squares / total sum of squares; NULL without spread."""
    o, p = finite(F.col(observed)), finite(F.col(predicted))
    total = F.count(o) * F.var_pop(o)
    return df.where(o.isNotNull() & p.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.when(total > 0, 1 - F.sum((o - p) * (o - p)) / total).alias("r2"))


def star_scale_report(matches: DataFrame, keys: list[str], a: str, b: str, flags: str, sigma: float = 3.0, least: int = 8, rounds: int = 6, min_r2: float = 0.90) -> DataFrame:
    """The flux ratio of matched stars, a row for each pair (keys): ok, message, scale_b_over_a,
    target_to_reference_scale (its reciprocal), r_squared, matched, candidates (without flags), used, rejected.

    Messages: too_few_points (fewer than `least` candidates with positive fluxes), low_r_squared (below min_r2, of b
    against the ratio times a over the stars in use; without spread it is NULL and passes).  Only an ok pair has a
    target_to_reference_scale."""
    clean = matches.where((F.size(flags) == 0) & finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull())
    counts = matches.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if((F.size(flags) == 0) & finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()).alias("candidates"))
    fit = written(clipped_ratio(clean, keys, a, b, sigma, least, rounds), "star-scale")
    ratio = F.log(F.col(b) / F.col(a))
    positive = clean.where((F.col(a) > 0) & (F.col(b) > 0))
    used = _join(positive, fit.select(*keys, "ratio", "low", "high"), keys).where(ratio.between(F.col("low"), F.col("high")))
    r2 = r_squared(used.withColumn("_fitted", F.col("ratio") * F.col(a)), keys, b, "_fitted").select(*keys, "r2")
    got = _join(_join(counts, fit, keys, "left"), r2, keys, "left")
    message = F.when(F.col("ratio").isNull(), "too_few_points").when(F.col("r2") < min_r2, "low_r_squared")
    got = got.withColumn("message", message).withColumn("ok", F.col("message").isNull())
    n = F.when(F.col("ok"), F.col("used")).otherwise(F.lit(0)).cast("long")
    return got.select(*keys, "ok", "message", F.col("ratio").alias("scale_b_over_a"), F.when(F.col("ok"), 1 / F.col("ratio")).alias("target_to_reference_scale"), F.col("r2").alias("r_squared"), "matched", "candidates", n.alias("used"), (F.col("matched") - n).alias("rejected"))
