"""Pixel work on tiles: statistics, photometry, calibration and stacking.

Images are rows (frame_id, ty, tx, y0, x0, h, w, px array<float>) of tiles of a fixed size; a stack meets by tile, never
by whole image.  `pixels` explodes a tile to (y, x, v) rows where an aggregate over pixels is what is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import finite
from noctua.operators.stats import MAD_SIGMA, _join, numbered, plane_fit
from noctua.session import written

TILE = "frame_id string, ty int, tx int, y0 int, x0 int, h int, w int, px array<float>"


def cut_tiles(image: np.ndarray, size: int) -> Iterator[dict]:
    """Tiles of one image; a cube of planes becomes its median plane."""
    if image.ndim == 3:
        image = np.median(image, axis=0)
    for y in range(0, image.shape[0], size):
        for x in range(0, image.shape[1], size):
            part = image[y : y + size, x : x + size]
            yield {"ty": y // size, "tx": x // size, "y0": y, "x0": x, "h": part.shape[0], "w": part.shape[1], "px": part.astype(np.float32).ravel()}


def pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v of every pixel; NULL for values that are not finite."""
    p = tiles.select(*keys, "y0", "x0", "w", F.posexplode("px").alias("i", "v"))
    return p.select(*keys, (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), finite(F.col("v")).alias("v"))


def in_box(tiles: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """Block window: the tiles that meet [y0, y1) x [x0, x1)."""
    return tiles.where((F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0) & (F.col("x0") < x1) & (F.col("x0") + F.col("w") > x0))


def region_statistics(tiles: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """Mean, median, sigma, min, max and noise (1.4826 MAD) of a box of each frame.  Tiles outside are not read."""
    p = pixels(in_box(tiles, y0, x0, y1, x1), ["frame_id"]).where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1) & F.col("v").isNotNull())
    s = p.groupBy("frame_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("sigma"), F.min("v").alias("min"), F.max("v").alias("max"))
    noise = _join(p, s.select("frame_id", "median"), ["frame_id"]).groupBy("frame_id").agg((MAD_SIGMA * F.median(F.abs(F.col("v") - F.col("median")))).alias("noise"))
    return _join(s, noise, ["frame_id"])


def tile_background(tiles: DataFrame, least: int = 64, fraction: float = 0.5) -> DataFrame:
    """Background of each tile: the median of its finite pixels between the 10th and 90th percentile; tiles with fewer
    than max(least, fraction n) finite pixels have none."""
    v = F.array_sort(F.filter(F.transform("px", lambda x: x.cast("double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    t = tiles.select("frame_id", "ty", "tx", F.size("px").alias("_all"), v.alias("v"))
    n = F.size("v")
    at = lambda q: _interpolated("v", q)
    t = t.where(n >= F.greatest(F.lit(least), fraction * F.col("_all"))).withColumn("lo", at(0.1)).withColumn("hi", at(0.9))
    t = t.withColumn("v", F.filter("v", lambda x: (x >= F.col("lo")) & (x <= F.col("hi"))))
    return t.select("frame_id", "ty", "tx", _interpolated("v", 0.5).alias("background"))


def _interpolated(name: str, q: float) -> Column:
    """Linear quantile of a sorted array column."""
    v, n = F.col(name), F.size(name)
    place = (n - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(v, low), F.get(v, F.least(low + 1, n - 1))
    return a + (b - a) * (place - low)


def illumination_metrics(bg: DataFrame, rows: int, cols: int) -> DataFrame:
    """From tile backgrounds, for each frame: median, range_frac, mad_frac, gradient_frac, r2, patchiness_frac (MAD
    of the plane's residuals), quadrant_frac (spread of quadrant medians) and valid_fraction."""
    b = bg.withColumn("x", F.col("tx") / max(cols - 1, 1)).withColumn("y", F.col("ty") / max(rows - 1, 1))
    k = ["frame_id"]
    s = b.groupBy(*k).agg(F.count("*").alias("tiles"), F.percentile("background", 0.05).alias("_p5"), F.percentile("background", 0.95).alias("_p95"))
    plane = plane_fit(b, k, "x", "y", "background").drop("n")
    f = _join(b, plane.select(*k, "a", "b", "c", "median"), k)
    quadrant = F.when(F.col("ty") < rows / 2, 0).otherwise(2) + F.when(F.col("tx") < cols / 2, 0).otherwise(1)
    f = f.withColumn("_q", quadrant).withColumn("_res", F.col("background") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))
    mid = f.groupBy(*k).agg(F.median("_res").alias("_mres"))
    dev = _join(f, mid, k).groupBy(*k).agg(F.median(F.abs(F.col("background") - F.col("median"))).alias("_mad"), F.median(F.abs(F.col("_res") - F.col("_mres"))).alias("_patch"))
    quads = f.groupBy(*k, "_q").agg(F.median("background").alias("m")).groupBy(*k).agg((F.max("m") - F.min("m")).alias("_quad"))
    got = _join(_join(_join(s, plane, k), dev, k), quads, k)
    share = lambda c: F.try_divide(F.col(c), F.abs(F.col("median")))
    return got.select(*k, "median", F.try_divide(F.col("_p95") - F.col("_p5"), F.abs(F.col("median"))).alias("range_frac"), share("_mad").alias("mad_frac"), "gradient_frac", "r2", share("_patch").alias("patchiness_frac"), share("_quad").alias("quadrant_frac"), (F.col("tiles") / (rows * cols)).alias("valid_fraction"))


def flatness(px: DataFrame, keys: list[str], rows: int, cols: int, parts: int = 8) -> DataFrame:
    """Medians of parts x parts areas of each image, then their median, p05, p95, range and MAD.  px: keys, y, x, v."""
    area = [F.least(F.floor(F.col(c) * parts / n), F.lit(parts - 1)) for c, n in (("y", rows), ("x", cols))]
    m = px.where("v is not null").groupBy(*keys, area[0].alias("ay"), area[1].alias("ax")).agg(F.median("v").alias("m"))
    s = m.groupBy(*keys).agg(F.median("m").alias("median"), F.percentile("m", 0.05).alias("p05"), F.percentile("m", 0.95).alias("p95"), (F.max("m") - F.min("m")).alias("range"))
    mad = _join(m, s.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("m") - F.col("median"))).alias("mad"))
    return _join(s, mad, keys)


# --- stars --------------------------------------------------------------------------------------------------------------


def star_tiles(stars: DataFrame, tile: int, radius: Column) -> DataFrame:
    """Stars with the tiles (ty, tx) that their circle touches."""
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile).cast("int"), F.floor((F.col(c) + radius) / tile).cast("int"))
    return stars.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))


def star_pixels(tiles: DataFrame, stars: DataFrame, tile: int, radius: float) -> DataFrame:
    """frame_id, star_id, y, x, v, d of the pixels at most `radius` from a star, over tile edges."""
    s = star_tiles(stars.select("frame_id", "star_id", F.col("x").alias("sx"), F.col("y").alias("sy")).withColumnsRenamed({"sx": "x", "sy": "y"}), tile, F.lit(radius)).withColumnsRenamed({"x": "sx", "y": "sy"})
    p = tiles.join(s, ["frame_id", "ty", "tx"])
    p = pixels(p, ["frame_id", "star_id", "sx", "sy"])
    return p.withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("d") <= radius).drop("sx", "sy")


def aperture_photometry(tiles: DataFrame, stars: DataFrame, tile: int, height: int, width: int, aperture: float, inner: float, outer: float, saturation: float) -> DataFrame:
    """For each star flux (background taken off), background (median of the annulus), peak, snr (sample deviation of
    the annulus; without noise infinite for a flux above 0, else 0) and flags.

    A star whose annulus leaves the image is flagged edge and has no numbers.  Then empty_aperture and empty_annulus; without
    these nonfinite_pixel, in either; without that saturated, in either.  A star with any flag has a peak only."""
    p = star_pixels(tiles, stars, tile, outer)
    near, ring = F.col("d") <= aperture, (F.col("d") >= inner) & (F.col("d") <= outer)
    v = F.col("v")
    s = p.groupBy("frame_id", "star_id").agg(
        F.median(F.when(ring, v)).alias("background"), F.stddev_samp(F.when(ring, v)).alias("_sd"), F.sum(F.when(near, v)).alias("_sum"), F.count_if(near).alias("_n"), F.count_if(ring).alias("_m"),
        F.count_if((near | ring) & v.isNull()).alias("_bad"), F.max(F.when(near, v)).alias("peak"), F.max(F.when(near | ring, v)).alias("_top"),
    )
    s = stars.join(s, ["frame_id", "star_id"], "left").fillna(0, ["_n", "_m", "_bad"])
    edge = (F.floor(F.col("x") - outer) < 0) | (F.floor(F.col("y") - outer) < 0) | (F.ceil(F.col("x") + outer) >= width) | (F.ceil(F.col("y") + outer) >= height)
    empty = F.array_compact(F.array(F.when(F.col("_n") == 0, "empty_aperture"), F.when(F.col("_m") == 0, "empty_annulus")))
    flags = F.when(edge, F.array(F.lit("edge"))).when(F.size(empty) > 0, empty).when(F.col("_bad") > 0, F.array(F.lit("nonfinite_pixel"))).when(F.col("_top") >= saturation, F.array(F.lit("saturated"))).otherwise(F.array().cast("array<string>"))
    good, flux = F.size("flags") == 0, F.col("_sum") - F.col("_n") * F.col("background")
    snr = F.when(F.col("_sd") > 0, flux / (F.col("_sd") * F.sqrt(F.col("_n")))).when(flux > 0, float("inf")).otherwise(0.0)
    s = s.withColumn("flags", flags).withColumns({"flux": F.when(good, flux), "snr": F.when(good, snr), "peak": F.when(~F.array_contains("flags", "edge"), F.col("peak"))})
    return s.withColumn("background", F.when(good, F.col("background"))).drop("_sd", "_sum", "_n", "_m", "_bad", "_top")


def mean_star_flux(tiles: DataFrame, stars: DataFrame, tile: int, height: int, background: str, scale: float = 1.5) -> DataFrame:
    """For each frame the median over stars of mean(pixels within scale fwhm) - background, of the two vertical
    orientations the larger one.  stars: frame_id, star_id, x, y, fwhm and the frame's background."""
    found = []
    for flip in (False, True):
        s = stars.withColumn("y", height - 1 - F.col("y")) if flip else stars
        r = scale * F.col("fwhm")
        t = star_tiles(s.select("frame_id", "star_id", "x", "y", r.alias("r"), F.col(background).alias("bg")), tile, F.col("r")).withColumnsRenamed({"x": "sx", "y": "sy"})
        p = pixels(tiles.join(t, ["frame_id", "ty", "tx"]), ["frame_id", "star_id", "sx", "sy", "r", "bg"])
        p = p.where((F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= F.col("r")) & F.col("v").isNotNull())
        found.append(p.groupBy("frame_id", "star_id").agg((F.avg("v") - F.first("bg")).alias("f")).groupBy("frame_id").agg(F.median("f").alias("flux")))
    both = found[0].unionByName(found[1])
    return both.groupBy("frame_id").agg(F.max("flux").alias("median_mean_star_flux"))


def frame_features(frames: DataFrame, stats: DataFrame, fluxes: DataFrame, stars: DataFrame) -> DataFrame:
    """star_count, flux, background and bgnoise of each frame; without stars the count is 0 and the flux NULL."""
    n = stars.groupBy("frame_id").agg(F.count("*").alias("star_count"))
    got = frames.join(n, "frame_id", "left").join(fluxes, "frame_id", "left").join(stats.select("frame_id", F.col("median").alias("background"), F.col("noise").alias("bgnoise")), "frame_id", "left")
    return got.withColumn("star_count", F.coalesce("star_count", F.lit(0)))


def flag_totals(photometry: DataFrame) -> DataFrame:
    """Stars for each flag."""
    return photometry.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# --- stacks ---------------------------------------------------------------------------------------------------------------


def mean_stack(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean and count of each pixel."""
    return px.groupBy(*keys).agg(F.avg(finite(F.col(value))).alias("value"), F.count(finite(F.col(value))).alias("n"))


def rejection_stack(px: DataFrame, keys: list[str], value: str = "v", low: float = 3.0, high: float = 3.0, rounds: int = 1, weight: str | None = None, winsorize: bool = False) -> DataFrame:
    """Each pixel over frames: positive values; median and sample deviation; only values strictly between
    median - low deviations and median + high deviations stay (or those outside move to the bound), `rounds` times; then the
    (weighted) mean: value (null where none stays, as where all are equal), kept, rejected."""
    x = px.select(*keys, finite(F.col(value)).alias("_v"), (F.col(weight) if weight else F.lit(1.0)).alias("_w")).where("_v > 0").withColumn("_on", F.lit(True))
    for _ in range(rounds):
        on = F.when(F.col("_on"), F.col("_v"))
        x = _join(x, x.groupBy(*keys).agg(F.median(on).alias("_m"), F.coalesce(F.stddev_samp(on), F.lit(0.0)).alias("_s")), keys)
        lo, hi = F.col("_m") - low * F.col("_s"), F.col("_m") + high * F.col("_s")
        x = x.withColumn("_v", F.least(F.greatest(F.col("_v"), lo), hi)) if winsorize else x.withColumn("_on", F.col("_on") & (F.col("_v") > lo) & (F.col("_v") < hi))
        x = x.drop("_m", "_s")
        x = written(x, "stack-round") if rounds > 1 else x
    on, w = F.when(F.col("_on"), F.col("_v")), F.when(F.col("_on"), F.col("_w"))
    return x.groupBy(*keys).agg(F.try_divide(F.sum(on * w), F.sum(w)).alias("value"), F.count(on).alias("kept"), (F.count("*") - F.count(on)).alias("rejected"))


def stretched_range(stack: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The values of each image (keys) from its least to its largest one as 0 to 1; null where they are equal."""
    ends = stack.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return _join(stack, ends, keys).withColumn(value, F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def frame_normalization(px: DataFrame, frame: str, reference: str, value: str = "v", mode: str = "mul") -> DataFrame:
    """Scale and offset that bring each frame's median (and, for addscale, MAD) to the reference frame's."""
    x = px.select(F.col(frame).alias("_f"), finite(F.col(value)).alias("_v")).where("_v is not null")
    m = x.groupBy("_f").agg(F.median("_v").alias("m"))
    m = m.join(x.join(m, "_f").groupBy("_f").agg(F.median(F.abs(F.col("_v") - F.col("m"))).alias("d")), "_f")
    ref = m.where(F.col("_f") == reference).select(F.col("m").alias("rm"), F.col("d").alias("rd"))  # one row
    m = m.crossJoin(F.broadcast(ref))
    scale = F.when(F.lit(mode == "mul"), F.try_divide(F.col("rm"), F.col("m"))).when(F.lit(mode == "addscale"), F.try_divide(F.col("rd"), F.col("d"))).otherwise(1.0)
    offset = F.when(F.lit(mode == "addscale"), F.col("rm") - scale * F.col("m")).otherwise(0.0)
    return m.select(F.col("_f").alias(frame), scale.alias("scale"), offset.alias("offset"))


def best_share(frames: DataFrame, keys: list[str], value: str, share: float = 0.9) -> DataFrame:
    """The frames whose value is among the smallest share of their group."""
    return frames.withColumn("_p", F.percent_rank().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_p") <= share).drop("_p")


def exposure_fusion(px: DataFrame, keys: list[str], value: str, exposure: str, mask: Column, read_noise: float) -> DataFrame:
    """sum(w raw / t) / sum(w), w the mask over the flux's variance (raw + read_noise^2) / t^2."""
    t, raw = F.col(exposure), F.col(value)
    w = F.try_divide(mask * t * t, raw + read_noise * read_noise)
    return px.groupBy(*keys).agg(F.try_divide(F.sum(w * raw / t), F.sum(w)).alias("value"))


def calibrate(light: DataFrame, dark: DataFrame, flat: DataFrame, flat_median: float | None = None) -> DataFrame:
    """(light - dark) / (flat / its median), tile by tile; a flat of 0 gives NULL.  dark and flat: one master's tiles."""
    if flat_median is None:
        flat = flat.crossJoin(F.broadcast(flat.select(F.explode("px").alias("_v")).agg(F.median(finite(F.col("_v"))).alias("_level"))))  # one row
        flat = flat.withColumn("px", F.transform("px", lambda v: v / F.col("_level"))).drop("_level")
    level = F.lit(1.0 if flat_median is None else flat_median)
    joined = light.join(dark.select("ty", "tx", F.col("px").alias("_d")), ["ty", "tx"], "left").join(flat.select("ty", "tx", F.col("px").alias("_f")), ["ty", "tx"], "left")
    less = F.when(F.col("_d").isNull(), F.col("px")).otherwise(F.zip_with("px", "_d", lambda a, b: a - b))
    done = F.when(F.col("_f").isNull(), less).otherwise(F.zip_with(less, "_f", lambda a, b: F.when(b != 0, a * level / b)))
    return joined.withColumn("px", F.transform(done, lambda v: v.cast("float"))).drop("_d", "_f")


def calibrate_keyed(lights: DataFrame, darks: DataFrame, dark_keys: list[str], flats: DataFrame, flat_keys: list[str]) -> DataFrame:
    """Light tiles less the dark tile of their dark_keys, over the flat tile of their flat_keys (a master flat of
    level 1), pixel by pixel; a light without a master of a kind goes without it, and a flat of 0 gives NULL.

    darks, flats: one tile (keys, ty, tx, px) for each key and place."""
    place = ["ty", "tx"]
    d = darks.select(*[F.col(k).alias(f"_{k}") for k in [*dark_keys, *place]], F.col("px").alias("_d"))
    f = flats.select(*[F.col(k).alias(f"__{k}") for k in [*flat_keys, *place]], F.col("px").alias("_f"))
    on = lambda keys, mark: [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in [*keys, *place]]
    x = lights.join(d, on(dark_keys, "_"), "left").join(f, on(flat_keys, "__"), "left")
    less = F.when(F.col("_d").isNull(), F.col("px")).otherwise(F.zip_with("px", "_d", lambda a, b: a - b))
    done = F.when(F.col("_f").isNull(), less).otherwise(F.zip_with(less, "_f", lambda a, b: F.when(b != 0, a / b)))
    return x.withColumn("px", done).select(*lights.columns)


def masters(frames: DataFrame, keys: list[str], size: int, low: float = 3.0, high: float = 3.0, level: bool = False, weight: str | None = None) -> DataFrame:
    """Master tiles (keys, ty, tx, y0, x0, h, w, px, kept, rejected) of frames' tiles (keys, frame_id, ..., px): a rejection
    stack of each pixel over the frames with equal keys (mode, gain, offset, exposure, temperature, filter).

    level: each frame is first brought to a median of 1, as flats are; less their dark is for calibrate_keyed.  A master
    of many frames is an aggregate over pixels; only one of its tiles is brought together."""
    px = pixels(frames, [*keys, "frame_id"] + ([weight] if weight else []))
    if level:
        middle = px.groupBy(*keys, "frame_id").agg(F.median("v").alias("_level"))
        px = _join(px, middle, [*keys, "frame_id"]).withColumn("v", F.try_divide(F.col("v"), F.col("_level"))).drop("_level")
    stack = rejection_stack(px, [*keys, "y", "x"], "v", low, high, weight=weight)
    place = F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx")
    sorted_px = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    t = stack.groupBy(*keys, *place).agg(sorted_px.alias("_p"), F.sum("kept").alias("kept"), F.sum("rejected").alias("rejected"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    return t.select(*keys, "ty", "tx", "y0", "x0", "h", "w", F.transform("_p", lambda p: p["value"]).alias("px"), "kept", "rejected")


def hot_pixels(dark: DataFrame, sigma: float = 5.0) -> DataFrame:
    """(y, x) of a dark's pixels more than sigma 1.4826 MADs above its median."""
    p = pixels(dark, ["frame_id"]).where("v is not null")
    m = p.groupBy("frame_id").agg(F.median("v").alias("m"))
    d = _join(p, m, ["frame_id"])
    s = d.groupBy("frame_id").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("s"))
    return _join(d, s, ["frame_id"]).where(F.col("v") > F.col("m") + sigma * MAD_SIGMA * F.col("s")).select("frame_id", "y", "x", "v")


def repair_hot(px: DataFrame, hot: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """Pixels (keys, y, x, v) where those in `hot` (y, x) hold the median of the image's other pixels at most `reach`
    rows and columns away that are not hot (NULL without any).  Only the neighbourhoods of hot pixels are shuffled."""
    bad = hot.select("y", "x").distinct()
    near = F.sequence(F.lit(-reach), F.lit(reach))
    around = bad.select(F.col("y").alias("_hy"), F.col("x").alias("_hx"), F.explode(near).alias("_dy")).withColumn("_dx", F.explode(near))
    around = around.select("_hy", "_hx", (F.col("_hy") + F.col("_dy")).alias("y"), (F.col("_hx") + F.col("_dx")).alias("x")).join(bad, ["y", "x"], "left_anti")
    level = px.join(around, ["y", "x"]).groupBy(*keys, F.col("_hy").alias("y"), F.col("_hx").alias("x")).agg(F.median("v").alias("_new"))
    marked = px.join(bad.withColumn("_hot", F.lit(True)), ["y", "x"], "left").join(level, [*keys, "y", "x"], "left")
    return marked.withColumn("v", F.when(F.col("_hot"), F.col("_new")).otherwise(F.col("v"))).select(*px.columns)


def mask_shares(a: DataFrame, b: DataFrame, keys: list[str], hot: float, cold: float) -> DataFrame:
    """Of the differences a - b: share of hot and cold pixels, mean and deviation of the rest."""
    d = a.select(*keys, F.col("v").alias("_a")).join(b.select(*keys, F.col("v").alias("_b")), keys).select((F.col("_a") - F.col("_b")).alias("d"))
    ok = F.when(F.col("d").between(cold, hot), F.col("d"))
    return d.agg(F.avg((F.col("d") > hot).cast("double")).alias("hot_share"), F.avg((F.col("d") < cold).cast("double")).alias("cold_share"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"))


def flat_pairs(flats: DataFrame, group: list[str], frame: str, pixel: list[str], value: str) -> DataFrame:
    """For each group the frames paired in order (1-2, 3-4, ...): signal (mean of the half sum) and variance (of the
    difference, halved)."""
    n = F.dense_rank().over(Window.partitionBy(*group).orderBy(frame))
    f = flats.withColumn("_n", n).withColumn("_pair", F.floor((F.col("_n") - 1) / 2)).withColumn("_side", (F.col("_n") - 1) % 2)
    both = f.groupBy(*group, "_pair", *pixel).agg(F.max(F.when(F.col("_side") == 0, F.col(value))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col(value))).alias("_b")).where("_a is not null and _b is not null")
    return both.groupBy(*group, F.col("_pair").alias("pair")).agg(F.avg((F.col("_a") + F.col("_b")) / 2).alias("signal"), (F.var_samp(F.col("_a") - F.col("_b")) / 2).alias("variance"))


def sensor_gain(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The line variance = signal / gain + read variance: gain (electrons a count) and read_noise (counts)."""
    g = pairs.groupBy(*keys).agg(F.regr_slope("variance", "signal").alias("s"), F.regr_intercept("variance", "signal").alias("i"), F.count("*").alias("n"))
    return g.select(*keys, F.try_divide(F.lit(1.0), F.col("s")).alias("gain"), F.when(F.col("i") >= 0, F.sqrt("i")).alias("read_noise"), "n")


def gain_over_bias(pairs: DataFrame, keys: list[str], bias: float) -> DataFrame:
    """Gain as the slope through the bias level: sum((signal - bias)^2) / sum(variance (signal - bias))."""
    s = F.col("signal") - bias
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum(s * s), F.sum(F.col("variance") * s)).alias("gain"), F.count("*").alias("n"))


def bias_noise(bias: DataFrame, group: list[str], frame: str, pixel: list[str], value: str, gain: float = 1.0) -> DataFrame:
    """Read noise from bias frames: each frame's deviation from the master (the mean of its group at every pixel):
    read_noise (mean over frames) and spread (deviation over frames), in electrons by `gain`, and frames."""
    master = bias.groupBy(*group, *pixel).agg(F.avg(finite(F.col(value))).alias("_m"))
    f = _join(bias, master, [*group, *pixel]).groupBy(*group, frame).agg(F.stddev_samp(finite(F.col(value)) - F.col("_m")).alias("_s"))
    return f.groupBy(*group).agg((F.avg("_s") * gain).alias("read_noise"), (F.stddev_samp("_s") * gain).alias("spread"), F.count("_s").alias("frames"))


def dark_current(dark: DataFrame, master: DataFrame, group: list[str], pixel: list[str], value: str, seconds: Column, gain: float = 1.0, clip: float = 4.0) -> DataFrame:
    """For each dark (group) the variance of dark - master bias, without differences of `clip` deviations or more, by
    its seconds, in electrons by `gain`.  master: pixel and value; seconds: a column of dark, one value a group."""
    m = master.select(*pixel, F.col(value).alias("_m"))
    d = dark.withColumn("_t", seconds).join(m, pixel).select(*group, "_t", finite(F.col(value) - F.col("_m")).alias("_d"))
    wide = d.groupBy(*group).agg(F.stddev_samp("_d").alias("_s"))
    kept = _join(d, wide, group).where(F.abs("_d") < clip * F.col("_s"))
    return kept.groupBy(*group).agg((F.var_samp("_d") / F.first("_t") * gain).alias("current"), F.count("*").alias("used"))


def channel_medians(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Median of the positive values of each frame and channel."""
    v = finite(F.col(value))
    return px.groupBy(*keys).agg(F.median(F.when(v > 0, v)).alias("median"))


def prefix_stacks(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows (stack_size, frame) for the stacks of the first 2, 4, 8, ... frames, and of all of them."""
    x = numbered(frames, keys, order, "_k", "_n").withColumns({"_k": F.col("_k").cast("int"), "_n": F.col("_n").cast("int")})
    powers = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2("_n")).cast("int"))), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    sizes = F.array_distinct(F.concat(F.filter(powers, lambda s: s <= F.col("_n")), F.array(F.col("_n").cast("int"))))
    return x.withColumn("stack_size", F.explode(F.filter(sizes, lambda s: (s >= F.col("_k")) & (s >= 2)))).drop("_k", "_n")


def moving_stacks(frames: DataFrame, keys: list[str], order: list[str], n: int, with_last: bool = True) -> DataFrame:
    """Rows (stack, frame) of every run of n consecutive frames; stack is the place of its first frame, from 1."""
    x = numbered(frames, keys, order, "_k", "_n").withColumns({"_k": F.col("_k").cast("int"), "_n": F.col("_n").cast("int")})
    last = F.col("_n") - n + (1 if with_last else 0)
    lo, hi = F.greatest(F.lit(1), F.col("_k") - n + 1), F.least(F.col("_k"), last.cast("int"))
    return x.where(hi >= lo).withColumn("stack", F.explode(F.sequence(lo, hi))).drop("_k", "_n")
