"""Masks of pixels: circles around stars, saturated pixels, their dilation, and a blur over tile edges.

A mask is a table of runs (keys, y, x0, x1), pixels x0 to x1 of row y, that do not touch each other: a circle of radius r
has 2 r + 1 runs where it has 3 r^2 pixels, so no image is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import finite
from noctua.operators.stats import _join
from noctua.operators.tiles import TILE


def star_radius(fwhm: Column, factor: float = 5.0, least: float = 8.0, most: float = 50.0) -> Column:
    """`factor` times the width, from `least` to `most`; without a width above 0: `least`."""
    return F.when(finite(fwhm) > 0, F.least(F.lit(most), F.greatest(F.lit(least), factor * fwhm))).otherwise(least)


def merged(runs: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Runs cut to the image, those that overlap or touch made one."""
    r = runs.select(*keys, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1")).where(f"x0 <= x1 and y >= 0 and y < {height}").distinct()
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", (before.isNull() | (F.col("x0") > before + 1)).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def star_runs(stars: DataFrame, keys: list[str], radius: Column, height: int, width: int, rows_up: bool = True, both: bool = False) -> DataFrame:
    """The runs of all pixels at most `radius` from a star (keys, x, y), edge included.  rows_up: the stars' y counts
    from the last row; both: circles at y from either edge."""
    up = height - 1 - F.col("y")
    ys = F.array(F.col("y"), up) if both else F.array(up) if rows_up else F.array(F.col("y"))
    s = stars.select(*keys, F.col("x").alias("_x"), radius.alias("_r"), F.explode(ys).alias("_y")).where("_x is not null and _y is not null")
    s = s.withColumn("y", F.explode(F.sequence(F.ceil(F.col("_y") - F.col("_r")).cast("int"), F.floor(F.col("_y") + F.col("_r")).cast("int"))))
    dy = F.col("y") - F.col("_y")
    s = s.withColumn("_h", F.sqrt(F.greatest(F.col("_r") * F.col("_r") - dy * dy, F.lit(0.0))))
    inside = lambda x: (x - F.col("_x")) * (x - F.col("_x")) + dy * dy <= F.col("_r") * F.col("_r")
    lo, hi = F.ceil(F.col("_x") - F.col("_h")).cast("int"), F.floor(F.col("_x") + F.col("_h")).cast("int")
    # a root may be rounded over a whole number: one pixel to either side is tested
    lo = F.when(inside(lo - 1), lo - 1).when(inside(lo), lo).otherwise(lo + 1)
    hi = F.when(inside(hi + 1), hi + 1).when(inside(hi), hi).otherwise(hi - 1)
    return merged(s.select(*keys, "y", lo.alias("x0"), hi.alias("x1")), keys, height, width)


def saturated_runs(px: DataFrame, keys: list[str], threshold: float, height: int, width: int) -> DataFrame:
    """Runs of pixels (keys, y, x, v) of `threshold` or more; of several images of one key, in any of them."""
    hot = px.where(finite(F.col("v")) >= threshold)
    return merged(hot.select(*keys, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), keys, height, width)


def dilated(runs: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """All pixels at most `radius` from a masked one: each run moved to the rows around and made longer there."""
    if radius <= 0:
        return runs
    disc = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(int(np.floor(np.sqrt(radius * radius - d * d)))).alias("h")) for d in range(-radius, radius + 1)])
    s = runs.select(*keys, F.col("y").alias("_y"), "x0", "x1", F.explode(disc).alias("c"))
    return merged(s.select(*keys, (F.col("_y") + F.col("c.d")).alias("y"), (F.col("x0") - F.col("c.h")).alias("x0"), (F.col("x1") + F.col("c.h")).alias("x1")), keys, height, width)


def mask_report(stars: DataFrame, saturated: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Pixels under stars, of the dilated saturation and of both together, and the share of the image."""
    size = F.sum(F.col("x1") - F.col("x0") + 1).cast("long")
    parts = {"star_masked": stars, "saturated_masked": saturated, "total_masked": merged(stars.unionByName(saturated), keys, height, width)}
    found = None
    for name, runs in parts.items():
        p = runs.groupBy(*keys).agg(size.alias("n")).withColumn("part", F.lit(name))
        found = p if found is None else found.unionByName(p)
    got = found.groupBy(*keys).pivot("part", list(parts)).agg(F.first("n")).fillna(0, list(parts))
    return got.withColumn("masked_fraction", F.col("total_masked") / (height * width))


def without_masked(px: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, v) with v NULL under the mask."""
    pixel = px.withColumn("_id", F.struct(*keys, "y", "x"))
    m = runs.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"y": "_y"})
    same = F.col("y") == F.col("_y")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    hit = pixel.join(m, same & F.col("x").between(F.col("x0"), F.col("x1")), "left")  # runs of a row are apart: one hit at most
    return hit.withColumn("v", F.when(F.col("x0").isNull(), F.col("v"))).select(*px.columns)


def blurred(tiles: DataFrame, size: int, sigma: float = 3.0, reach: int = 13) -> DataFrame:
    """Tiles of images (`size` a side, smaller at the far edges) under a normalized Gaussian of 2 reach + 1 pixels a
    side; beyond the edge is 0.  reach may not pass size.

    A blur is a sum, so every tile hands its own share to the (at most eight) tiles around it, only the part that reaches
    them, and each tile adds what it gets; no tile that does not exist gets any."""
    if reach > size:
        raise ValueError("reach passes a tile")
    d = np.arange(-reach, reach + 1)
    line = np.exp(-(d * d) / (2 * sigma * sigma))
    line /= line.sum()

    def along(v: np.ndarray, axis: int) -> np.ndarray:
        return np.apply_along_axis(np.convolve, axis, v, line)  # full: reach more on both sides

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                v = along(along(np.nan_to_num(np.asarray(r.px, float), posinf=0, neginf=0).reshape(r.h, r.w), 0), 1)
                ys, xs = r.y0 - reach + np.arange(v.shape[0]), r.x0 - reach + np.arange(v.shape[1])
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        a, b = (ys >= 0) & (ys // size == r.ty + i), (xs >= 0) & (xs // size == r.tx + j)
                        if a.any() and b.any():
                            rows.append((r.frame_id, r.ty + i, r.tx + j, int(ys[a][0]), int(xs[b][0]), int(b.sum()), v[np.ix_(a, b)].ravel()))
            yield pd.DataFrame(rows, columns=["frame_id", "ty", "tx", "py", "px0", "pw", "part"])

    parts = tiles.mapInPandas(spread, "frame_id string, ty int, tx int, py int, px0 int, pw int, part array<double>")
    place = tiles.select("frame_id", "ty", "tx", "y0", "x0", "h", "w")
    got = _join(place, parts, ["frame_id", "ty", "tx"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        v = np.zeros((r.h, r.w))
        for p in pdf.itertuples():
            part = np.asarray(p.part).reshape(-1, p.pw)
            at_y, at_x = p.py - r.y0, p.px0 - r.x0
            part = part[: r.h - at_y, : r.w - at_x]
            v[at_y : at_y + part.shape[0], at_x : at_x + part.shape[1]] += part
        return pd.DataFrame([{"frame_id": r.frame_id, "ty": r.ty, "tx": r.tx, "y0": r.y0, "x0": r.x0, "h": r.h, "w": r.w, "px": v.astype(np.float32).ravel()}])

    return got.groupBy("frame_id", "ty", "tx").applyInPandas(add, TILE)
