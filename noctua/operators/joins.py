"""Joins of frames with measurements, calibration frames, markers and earlier work, and nearest and range joins in the plane."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import canonical_filter
from noctua.operators.stats import carried


def with_measurements(report: DataFrame, measurements: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Report rows with their measurements, by path; a path measured twice takes the last row in `order`."""
    rest = [c for c in measurements.columns if c != path]
    last = measurements.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(path, "_last.*")
    return report.join(last, path, "left")


def captures_at(lines: DataFrame, file: str, line: str, start: str, elapsed: str) -> DataFrame:
    """Lines with `at` = start of their log + elapsed seconds; the first start line of a log counts, and logs without
    one are dropped."""
    begin = lines.where(F.col(start).isNotNull()).groupBy(file).agg(F.min_by(start, line).alias("_start"))
    got = lines.where(F.col(elapsed).isNotNull()).join(begin, file)
    return got.withColumn("at", F.timestamp_micros(F.unix_micros(F.col("_start").cast("timestamp")) + F.round(F.col(elapsed) * 1e6).cast("long"))).drop("_start")


def once_per_key(df: DataFrame, keys: dict[str, Column], compute) -> DataFrame:
    """compute(distinct keys) joined back, so that a costly function runs once for each key."""
    marked = df.withColumns(keys)
    values = compute(marked.select(*keys).distinct())
    names = {k: f"_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return marked.join(values.withColumnsRenamed(names), cond, "left").drop(*names.values())


def folder_markers(markers: DataFrame, folder: str, name: str) -> DataFrame:
    """The first valid marker (by file name) of each folder: folder, marker_filter."""
    return markers.withColumn("_f", canonical_filter(F.col(name), others=False)).where("_f is not null").groupBy(folder).agg(F.min_by("_f", name).alias("marker_filter"))


def match_dark_exact(frames: DataFrame, darks: DataFrame) -> DataFrame:
    """Frames with the dark of their mode, gain, offset, exptime and temperature, each cut to whole numbers, with
    defaults 5, 56, 20, 480, -10.  Columns of both: mode, gain, offset, exptime, temp; darks: path."""
    defaults = {"mode": 5, "gain": 56, "offset": 20, "exptime": 480, "temp": -10}
    best = darks.groupBy(*[F.col(c).cast("int").alias(f"_d_{c}") for c in defaults]).agg(F.min("path").alias("dark_path"))
    cond = F.lit(True)
    for c, v in defaults.items():
        cond = cond & (F.coalesce(F.col(c).cast("int"), F.lit(v)) == F.col(f"_d_{c}"))
    return frames.join(best, cond, "left").drop(*[f"_d_{c}" for c in defaults])


def match_nearest(left: DataFrame, right: DataFrame, left_id: str, left_value: str, right_id: str, right_value: str, keys: list[str], known: list[str] | None = None, within: float | None = None) -> DataFrame:
    """For each left row the right row with equal `keys`, `known` columns equal or unknown on the left, and the nearest
    value; ties to the smaller id; at most `within` away.  left_id, match_id, distance; rows without a match keep NULLs.

    The right side is reduced to distinct values first.  With `within` the join is on buckets of that width; without it each left
    row takes the values next to its own, below and above, from one ordered pass over both sides, so no key is compared with
    itself.  Of `known` columns, which are few, each pattern of unknown ones makes a pass of its own."""
    if within is None:
        parts = []
        for pattern in product((True, False), repeat=len(known or [])):
            has = [k for k, on in zip(known or [], pattern, strict=True) if on]
            own = [F.col(k).isNotNull() if k in has else F.col(k).isNull() for k in known or []]
            parts.append(_match_next(left.where(reduce(Column.__and__, own)) if own else left, right, left_id, left_value, right_id, right_value, [*keys, *has]))
        return reduce(DataFrame.unionByName, parts)
    r = right.select(*keys, *(known or []), F.col(right_id).alias("_rid"), F.col(right_value).cast("double").alias("_rv"))
    r = r.groupBy(*keys, *(known or []), "_rv").agg(F.min("_rid").alias("_rid")).withColumnsRenamed({k: f"_r_{k}" for k in [*keys, *(known or [])]})
    x = left.withColumn("_lv", F.col(left_value).cast("double"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    for k in known or []:
        cond = cond & (F.col(k).isNull() | (F.col(k) == F.col(f"_r_{k}")))
    if within is not None:
        r = r.withColumn("_cell", F.floor(F.col("_rv") / within))
        x = x.withColumn("_cells", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("_lv") / within) + o)))
        cond = cond & (F.col("_cells") == F.col("_cell")) & (F.abs(F.col("_lv") - F.col("_rv")) <= within)
    distance = F.abs(F.col("_lv") - F.col("_rv"))
    best = x.join(r, cond).groupBy(left_id).agg(F.min(F.struct(distance.alias("d"), F.col("_rid").alias("i"))).alias("m")).select(F.col(left_id).alias("_id"), F.col("m.i").alias("match_id"), F.col("m.d").alias("distance"))
    return left.join(best, F.col(left_id) == F.col("_id"), "left").drop("_id")


def _match_next(left: DataFrame, right: DataFrame, left_id: str, left_value: str, right_id: str, right_value: str, keys: list[str]) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    whole = lambda df: df.dropna(subset=keys) if keys else df
    r = whole(right).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(right_value).cast("double").alias("_v"), F.col(right_id).alias("_rid")).where("_v is not null")
    r = r.groupBy(*names, "_v").agg(F.min("_rid").alias("_rid")).withColumn("_near", F.struct("_v", "_rid"))
    x = whole(left).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(left_value).cast("double").alias("_v"), F.col(left_id).alias("_id")).where("_v is not null")
    both = x.withColumn("_left", F.lit(1)).unionByName(r.drop("_rid").withColumn("_left", F.lit(0)), allowMissingColumns=True)
    both = carried(both, names, ["_v", "_left"], "_near", "_below")
    both = carried(both.withColumn("_down", -F.col("_v")), names, ["_down", "_left"], "_near", "_above").where("_left = 1")
    offer = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{c}._v")).alias("d"), F.col(f"{c}._rid").alias("i")))
    best = both.groupBy("_id").agg(F.min(F.array_min(F.array_compact(F.array(offer("_below"), offer("_above"))))).alias("m"))
    best = best.select("_id", F.col("m.i").alias("match_id"), F.col("m.d").alias("distance"))
    return left.join(best, F.col(left_id) == F.col("_id"), "left").drop("_id")


def match_flat(frames: DataFrame, flats: DataFrame, name: str = "filter") -> DataFrame:
    """Frames with the first flat (by path) of their filter."""
    best = flats.groupBy(F.col(name).alias("_f")).agg(F.min("path").alias("flat_path"))
    return frames.join(best, F.col(name) == F.col("_f"), "left").drop("_f")


def unfinished(work: DataFrame, done: DataFrame, path: str, mtime: str, tolerance: float = 1e-6) -> DataFrame:
    """Work that no finished row of the same path covers, with times less than `tolerance` seconds apart."""
    d = done.select(F.col(path).alias("_p"), F.col(mtime).alias("_m"))
    return work.join(d, (F.col(path) == F.col("_p")) & (F.abs(F.col(mtime) - F.col("_m")) < tolerance), "left_anti")


def filter_offset(frames: DataFrame, offsets: DataFrame, old: str, new: str) -> DataFrame:
    """focus_delta = int(offset of the new filter - offset of the old one)."""
    o = offsets.select(F.col("filter").alias("_f"), F.col("offset").alias("_o"))
    x = frames.join(o, F.col(old) == F.col("_f"), "left").withColumnRenamed("_o", "_from").drop("_f")
    x = x.join(o, F.col(new) == F.col("_f"), "left").withColumnRenamed("_o", "_to").drop("_f")
    return x.withColumn("focus_delta", (F.col("_to") - F.col("_from")).cast("int")).drop("_from", "_to")


def require_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the wanted groups; a wanted group without rows is an error that names it."""
    missing = groups.join(rows.select(*keys).distinct(), keys, "left_anti").limit(10).collect()
    if missing:
        raise ValueError(f"no rows for {[tuple(r) for r in missing]}")
    return rows.join(groups.select(*keys).distinct(), keys, "left_semi")


# --- J17, J18, J21: points in the plane -------------------------------------------------------------------------------------


def _cells(x: Column, y: Column, size: float) -> Column:
    around = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct((F.floor(x / size) + i).alias("cx"), (F.floor(y / size) + j).alias("cy")))))


def near_points(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs (id of a, id of b, distance) at most `radius` apart; both have keys, id, x, y.

    Points meet by square cells as wide as the radius; those of a are repeated in the nine cells around, so only
    neighbours are compared.  The join is asked to be a merge join: Spark guesses a side's size by its compressed files, and would send a million
    points through the driver as a broadcast."""
    left = a.select(*keys, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(_cells(F.col("x"), F.col("y"), radius)).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    right = b.select(*keys, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return left.join(right.hint("merge"), [*keys, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select(*keys, "a_id", "b_id", "distance")


def cross_match(targets: DataFrame, references: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """One-to-one matches: each target offers its nearest reference (ties: smaller id), and each reference takes the
    nearest of the targets that offer it (ties: smaller id): keys, target_id, reference_id, distance."""
    near = near_points(targets, references, keys, radius)
    offer = near.groupBy(*keys, F.col("a_id").alias("target_id")).agg(F.min(F.struct("distance", "b_id")).alias("m"))
    taken = offer.groupBy(*keys, F.col("m.b_id").alias("reference_id")).agg(F.min(F.struct("m.distance", "target_id")).alias("t"))
    return taken.select(*keys, "t.target_id", "reference_id", "t.distance")


def isolation(stars: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """The nearest other star of the same frame within the radius; NULL means isolated."""
    near = near_points(stars, stars, keys, radius).where("a_id <> b_id").groupBy(*keys, F.col("a_id").alias("id")).agg(F.min("distance").alias("nearest"))
    return stars.join(near.hint("merge"), [*keys, "id"], "left")  # near has about as many rows as stars


def choose_convention(matches: DataFrame, keys: list[str], convention: str, distance: str) -> DataFrame:
    """Of several candidate transforms the one with the smallest median match distance; ties by name."""
    m = matches.groupBy(*keys, convention).agg(F.median(distance).alias("median_distance"))
    return m.groupBy(*keys).agg(F.min(F.struct("median_distance", convention)).alias("m")).select(*keys, f"m.{convention}", "m.median_distance")


def latest(df: DataFrame, keys: list[str], time: str, tie: str, n: int = 1) -> DataFrame:
    """The n newest rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie)))).where(F.col("_n") <= n).drop("_n")
