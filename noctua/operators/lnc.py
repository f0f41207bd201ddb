"""Local normalization of frames: transforms, grid nodes, node fits, hole filling, smoothing and correction.

A grid has one row for each node, (pair_id, gy, gx, scale, offset, ref_bg, target_bg, valid); it has thousands of nodes
where the image has many millions of pixels, so a pair's grid is one group, and pixels never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import finite
from noctua.operators.stats import _join, trimmed_affine
from noctua.session import written

FIELDS = ["scale", "offset", "ref_bg", "target_bg"]
GRID = "pair_id string, gy int, gx int, scale double, offset double, ref_bg double, target_bg double, valid boolean"

# --- L1, L2: 3x3 transforms as arrays of nine, row by row --------------------------------------------------------------------


def determinant(m: Column) -> Column:
    a = [m[i] for i in range(9)]
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def inverse(m: Column, tolerance: float = 1e-12) -> Column:
    """NULL for a singular matrix."""
    a, d = [m[i] for i in range(9)], determinant(m)
    cofactors = [
        a[4] * a[8] - a[5] * a[7], a[2] * a[7] - a[1] * a[8], a[1] * a[5] - a[2] * a[4], a[5] * a[6] - a[3] * a[8], a[0] * a[8] - a[2] * a[6],
        a[2] * a[3] - a[0] * a[5], a[3] * a[7] - a[4] * a[6], a[1] * a[6] - a[0] * a[7], a[0] * a[4] - a[1] * a[3],
    ]
    return F.when(F.abs(d) > tolerance, F.array(*[c / d for c in cofactors]))


def product(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def flip_y(m: Column, height: Column) -> Column:
    """The same transform where y runs from the other edge: F M F with F: y -> height - 1 - y."""
    zero, one = F.lit(0.0), F.lit(1.0)
    f = F.array(one, zero, zero, zero, F.lit(-1.0), (height - 1).cast("double"), zero, zero, one)
    return product(product(f, m), f)


def relative_transform(reference: Column, target: Column) -> Column:
    """Target to reference: inv(Hr) Ht; NULL if either is singular."""
    return F.when(F.abs(determinant(target)) > 1e-12, product(inverse(reference), target))


def apply_transform(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a transform; NULL where its weight is near 0."""
    w = m[6] * x + m[7] * y + m[8]
    ok = F.abs(w) > 1e-12
    return F.when(ok, (m[0] * x + m[1] * y + m[2]) / w), F.when(ok, (m[3] * x + m[4] * y + m[5]) / w)


def choose_reference(frames: DataFrame, keys: list[str], index: str, usable: Column, preferred: Column) -> DataFrame:
    """L3: the preferred frame if it is usable, else the first usable one."""
    x = frames.where(usable)
    order = F.struct(F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1), F.col(index))
    return x.groupBy(*keys).agg(F.min_by(index, order).alias("reference_index"))


# --- L4, J20, G30-G32: nodes ------------------------------------------------------------------------------------------------


def grid_nodes(images: DataFrame, width: str, height: str, step: int) -> DataFrame:
    """L4: nodes gy, gx with their pixel (y, x), `step` apart from 0 on, floor((width - 1) / step) + 1 in a row."""
    n = lambda c: F.floor((F.col(c) - 1) / step).cast("int")
    x = images.withColumn("gy", F.explode(F.sequence(F.lit(0), n(height)))).withColumn("gx", F.explode(F.sequence(F.lit(0), n(width))))
    return x.withColumn("y", F.col("gy") * step).withColumn("x", F.col("gx") * step)


def frame_shapes(tiles: DataFrame, frame: str) -> DataFrame:
    """frame (the frame_id under that name), height, width; only the tiles' places are read."""
    return tiles.groupBy(F.col("frame_id").alias(frame)).agg(F.max(F.col("y0") + F.col("h")).alias("height"), F.max(F.col("x0") + F.col("w")).alias("width"))


def _overlaps(placed: DataFrame, tile: int) -> DataFrame:
    """Placed reference tiles (y0, x0, h, w, m, t_height, t_width) with each target tile (t_ty, t_tx) that their pixels can
    read: those that meet the box around the transformed corners, or all where the tile crosses the transform's horizon."""
    ends = [(F.col(y).cast("double"), F.col(x).cast("double")) for y in ("y0", "_y1") for x in ("x0", "_x1")]
    rows = placed.withColumns({"_y1": F.col("y0") + F.col("h") - 1, "_x1": F.col("x0") + F.col("w") - 1})
    corners = [apply_transform(F.col("m"), x, y) for y, x in ends]
    weights = [F.col("m")[6] * x + F.col("m")[7] * y + F.col("m")[8] for y, x in ends]
    one_side = (F.least(*weights) > 1e-12) | (F.greatest(*weights) < -1e-12)
    for axis, size, name in ((1, "t_height", "t_ty"), (0, "t_width", "t_tx")):
        low, high = (f(*[c[axis] for c in corners]) for f in (F.least, F.greatest))
        last = F.floor((F.col(size) - 1) / tile)
        # one pixel more on either side: the second corner of a bilinear read, and rounding at the box's edge
        first = F.when(one_side, F.greatest(F.floor((low - 1) / tile), F.lit(0))).otherwise(0)
        to = F.when(one_side, F.least(F.floor((high + 1) / tile), last)).otherwise(last)
        rows = rows.withColumns({f"_{name}": first.cast("int"), f"_{name}2": to.cast("int")})
    rows = rows.where("_t_ty <= _t_ty2 and _t_tx <= _t_tx2")
    return rows.withColumn("t_ty", F.explode(F.sequence("_t_ty", "_t_ty2"))).withColumn("t_tx", F.explode(F.sequence("_t_tx", "_t_tx2"))).drop("_y1", "_x1", "_t_ty", "_t_ty2", "_t_tx", "_t_tx2")


def _assembled(tiles: pd.DataFrame, y0: int, x0: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values (NaN where no tile is) and masks of target tiles on the window from (y0, x0)."""
    value, mask = np.full(shape, np.nan), np.zeros(shape, bool)
    for t in tiles.itertuples():
        v = np.asarray(t.px, float).reshape(t.h, t.w)
        m = np.zeros(v.shape, bool) if t.mask is None else np.asarray(t.mask, bool).reshape(v.shape)
        a, b = max(t.y0, y0), min(t.y0 + t.h, y0 + shape[0])
        c, d = max(t.x0, x0), min(t.x0 + t.w, x0 + shape[1])
        if a < b and c < d:
            value[a - y0 : b - y0, c - x0 : d - x0] = v[a - t.y0 : b - t.y0, c - t.x0 : d - t.x0]
            mask[a - y0 : b - y0, c - x0 : d - x0] = m[a - t.y0 : b - t.y0, c - t.x0 : d - t.x0]
    return value, mask


def _read_target(x: np.ndarray, y: np.ndarray, height: int, width: int, tiles: pd.DataFrame) -> np.ndarray:
    """Bilinear values of the target at points inside it; NaN where one of the four pixels is not finite or the nearest is masked."""
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)
    jx, jy = np.minimum(ix + 1, width - 1), np.minimum(iy + 1, height - 1)
    y0, x0 = int(iy.min()), int(ix.min())
    value, mask = _assembled(tiles, y0, x0, (int(jy.max()) - y0 + 1, int(jx.max()) - x0 + 1))
    fx, fy = x - ix, y - iy
    top = (1 - fx) * value[iy - y0, ix - x0] + fx * value[iy - y0, jx - x0]
    low = (1 - fx) * value[jy - y0, ix - x0] + fx * value[jy - y0, jx - x0]
    near = mask[np.floor(y + 0.5).astype(int) - y0, np.floor(x + 0.5).astype(int) - x0]
    return np.where(near, np.nan, (1 - fy) * top + fy * low)


def paired_samples(reference: DataFrame, target: DataFrame, pairs: DataFrame, step: int, window: int, tile: int) -> DataFrame:
    """For each node and reference tile the samples (ref, target: arrays of equal length) whose reference pixel lies in
    the node's disc of radius window // 2: pair_id, gy, gx, ref, target.

    reference, target: tiles (frame_id, ty, tx, y0, x0, h, w, px; and if wanted mask, an array of booleans), the target's on a
    grid of `tile` pixels; pairs: pair_id, reference_id, target_id, m (reference to target).  A reference pixel counts if it is
    finite, not masked, and comes to a point inside the target whose nearest pixel is not masked and whose four pixels are
    all finite; the target's value there is bilinear.

    Tiles meet by a join on the target tiles that each reference tile's transformed box covers, and one task reads one
    reference tile and those few target tiles, so pixels never become rows."""
    reference, target = (x if "mask" in x.columns else x.withColumn("mask", F.lit(None).cast("array<boolean>")) for x in (reference, target))
    placed = pairs.join(frame_shapes(reference, "reference_id"), "reference_id").join(frame_shapes(target, "target_id").withColumnsRenamed({"height": "t_height", "width": "t_width"}), "target_id")
    keys = ["pair_id", "ty", "tx"]
    where = reference.select(F.col("frame_id").alias("reference_id"), "ty", "tx", "y0", "x0", "h", "w").join(placed, "reference_id")
    wanted = _overlaps(where, tile).select(*keys, F.col("target_id").alias("frame_id"), F.col("t_ty"), F.col("t_tx"))
    source = target.select("frame_id", F.col("ty").alias("t_ty"), F.col("tx").alias("t_tx"), "y0", "x0", "h", "w", "px", "mask")
    # columns of their own, since both sides may come from one table
    right = wanted.join(source, ["frame_id", "t_ty", "t_tx"]).select(*[F.col(k).alias(f"_{k}") for k in keys], "y0", "x0", "h", "w", "px", "mask")
    left = reference.select(F.col("frame_id").alias("reference_id"), "ty", "tx", "y0", "x0", "h", "w", "px", "mask").join(placed, "reference_id").drop("reference_id", "target_id")
    radius = window // 2

    def kernel(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in own.itertuples() if len(other) else ():
            y, x = np.divmod(np.arange(r.h * r.w), r.w)
            y, x, v, m = y + r.y0, x + r.x0, np.asarray(r.px, float), np.asarray(r.m, float)
            weight = m[6] * x + m[7] * y + m[8]
            good = np.isfinite(v) & (np.abs(weight) > 1e-12)
            if r.mask is not None:
                good &= ~np.asarray(r.mask, bool)
            safe = np.where(good, weight, 1.0)
            tx, ty = (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe
            good &= (tx >= 0) & (ty >= 0) & (tx <= r.t_width - 1) & (ty <= r.t_height - 1)
            if not good.any():
                continue
            y, x, v = y[good], x[good], v[good]
            t = _read_target(tx[good], ty[good], r.t_height, r.t_width, other)
            seen = np.isfinite(t)
            y, x, v, t = y[seen], x[seen], v[seen], t[seen]
            span = lambda low, size, most: range(max(0, -((radius - low) // step)), min((most - 1) // step, (low + size - 1 + radius) // step) + 1)
            for gy in span(r.y0, r.h, r.height):
                for gx in span(r.x0, r.w, r.width):
                    inside = (y - gy * step) ** 2 + (x - gx * step) ** 2 <= radius * radius
                    if inside.any():
                        rows.append((r.pair_id, gy, gx, v[inside], t[inside]))
        return pd.DataFrame(rows, columns=["pair_id", "gy", "gx", "ref", "target"])

    kind = dict(pairs.dtypes)["pair_id"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{k}" for k in keys])).applyInPandas(kernel, f"pair_id {kind}, gy int, gx int, ref array<double>, target array<double>")


def _trimmed_fit(ref: np.ndarray, target: np.ndarray, trim: float, low: float, high: float, least: int, min_samples: int, mean: bool, gain: float | None) -> tuple | None:
    cut = int(np.floor(len(ref) * trim))
    order = np.lexsort((ref, target))[cut : len(ref) - cut]
    if len(ref) < min_samples or len(order) < max(least, min_samples // 2):
        return None
    r, t = ref[order], target[order]
    mr, mt = r.mean(), t.mean()
    level = (mr, mt) if mean else (float(np.median(r)), float(np.median(t)))
    if gain is not None:
        return gain, level[0] - gain * level[1], *level, len(r), False
    spread = ((t - mt) ** 2).sum()
    scale = ((t - mt) * (r - mr)).sum() / spread if spread > 0 else np.nan
    if low <= scale <= high:
        return scale, mr - scale * mt, *level, len(r), False
    return 1.0, level[0] - level[1], *level, len(r), True


def fit_nodes(samples: DataFrame, model: str = "affine", estimator: str = "median", gain: float = 1.0, trim: float = 0.10, low: float = 0.5, high: float = 2.0, least: int = 16, min_samples: int = 2000) -> DataFrame:
    """The fit reference = scale target + offset of every node from packed samples (paired_samples): pair_id, gy,
    gx, scale, offset, ref_bg, target_bg, used, clamped.

    model: affine, or additive, where the scale is `gain`.  estimator of the backgrounds: median or mean.  Samples are ordered by target,
    then ref; floor(trim n) go at each end.  A node with fewer than `min_samples`, or fewer than max(least, min_samples // 2)
    after the trim, is left out; a scale outside [low, high] gives 1 and the difference of the backgrounds.  A node holds at
    most the pixels of its window, which one task reads."""
    return fit_models(samples, [(model, estimator)], gain, trim, low, high, least, min_samples).drop("model", "estimator")


def fit_models(samples: DataFrame, models: list[tuple[str, str]], gain: float = 1.0, trim: float = 0.10, low: float = 0.5, high: float = 2.0, least: int = 16, min_samples: int = 2000) -> DataFrame:
    """fit_nodes by several (model, estimator) in one pass: model, estimator, and the columns of fit_nodes.

    The samples of a node are packed in one row, so tasks fit batches of nodes."""
    for model, estimator in models:
        if model not in ("affine", "additive") or estimator not in ("median", "mean"):
            raise ValueError(f"no such model or estimator: {model}, {estimator}")
    node = ["pair_id", "gy", "gx"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ref, target = np.concatenate(list(r.ref)), np.concatenate(list(r.target))
                for model, estimator in models:
                    if got := _trimmed_fit(ref, target, trim, low, high, least, min_samples, estimator == "mean", gain if model == "additive" else None):
                        rows.append((model, estimator, r.pair_id, r.gy, r.gx, *got))
            yield pd.DataFrame(rows, columns=["model", "estimator", *node, *FIELDS, "used", "clamped"])

    kind = dict(samples.dtypes)["pair_id"]
    packed = samples.groupBy(*node).agg(F.collect_list(F.struct("ref", "target")).alias("s")).select(*node, F.col("s.ref").alias("ref"), F.col("s.target").alias("target"))
    return packed.mapInPandas(fit, f"model string, estimator string, pair_id {kind}, gy int, gx int, scale double, offset double, ref_bg double, target_bg double, used long, clamped boolean")


def patch_medians(samples: DataFrame, patch: int, k: float = 2.5) -> DataFrame:
    """Samples replaced by medians of patches; patches above median + k MAD on either side are left out.  Each row
    has `accepted`, the share of the node's patches that stay."""
    n = ["pair_id", "gy", "gx"]
    p = samples.groupBy(*n, F.floor(F.col("y") / patch).alias("y"), F.floor(F.col("x") / patch).alias("x")).agg(F.median("ref").alias("ref"), F.median("target").alias("target"))
    m = p.groupBy(*n).agg(F.median("ref").alias("_mr"), F.median("target").alias("_mt"), F.count("*").alias("_n"))
    d = _join(p, m, n)
    s = d.groupBy(*n).agg(F.median(F.abs(F.col("ref") - F.col("_mr"))).alias("_sr"), F.median(F.abs(F.col("target") - F.col("_mt"))).alias("_st"))
    d = _join(d, s, n).where((F.col("ref") <= F.col("_mr") + k * F.col("_sr")) & (F.col("target") <= F.col("_mt") + k * F.col("_st")))
    return d.withColumn("accepted", F.count("*").over(Window.partitionBy(*n)) / F.col("_n")).drop("_mr", "_mt", "_n", "_sr", "_st")


def sample_median_nodes(patches: DataFrame, least: int = 8, trim: float = 0.10, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """The fit of every node over its patch medians: pair_id, gy, gx, scale, offset, ref_bg, target_bg, used, clamped,
    accepted.  At least `least` patches have to stay before and after the trim, else the node is left out; a scale outside
    [low, high] gives 1 and the difference of the means; the backgrounds are medians of all accepted patches."""
    n = ["pair_id", "gy", "gx"]
    fit = trimmed_affine(patches, n, "ref", "target", ["y", "x"], trim, low, high, least, "mean", least).drop("ref_bg", "target_bg")
    level = patches.groupBy(*n).agg(F.median("ref").alias("ref_bg"), F.median("target").alias("target_bg"), F.first("accepted").alias("accepted"))
    return _join(fit, level, n).select(*n, *FIELDS, "used", "clamped", "accepted")


def candidate_transforms(reference: Column, target: Column) -> dict[str, Column]:
    """Target to reference under the two readings of a registration's matrices; NULL where one cannot be inverted."""
    return {"image_to_internal_reference": relative_transform(reference, target), "internal_reference_to_image": F.when(F.abs(determinant(target)) > 1e-12, product(reference, inverse(target)))}


def choose_transform(pairs: DataFrame, targets: DataFrame, references: DataFrame, keys: list[str], candidates: dict[str, Column], radius: float, most: int = 500) -> DataFrame:
    """The candidate whose transform brings the first `most` target stars (by id) nearest to reference stars: keys,
    convention, median_distance, m; ties by name.

    pairs: keys and what the candidates are made of; stars: keys, id, x, y.  Distances count up to `radius`, a farther star
    as farther; a candidate whose median is beyond it is not chosen, so the choice is exact for medians within it."""
    from noctua.operators.joins import near_points

    first = targets.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= most).select(*keys, "id", "x", "y")
    named = F.array(*[F.struct(F.lit(k).alias("convention"), m.alias("m")) for k, m in candidates.items()])
    named = _join(first, pairs.select(*keys, F.explode(named).alias("c")), keys)
    x, y = apply_transform(F.col("c.m"), F.col("x"), F.col("y"))
    moved = named.select(*keys, F.struct("c.convention", "id").alias("id"), finite(x).alias("x"), finite(y).alias("y"), F.col("c.m").alias("m")).where("x is not null and y is not null")
    near = near_points(moved, references.select(*keys, "id", "x", "y"), keys, radius).groupBy(*keys, F.col("a_id").alias("id")).agg(F.min("distance").alias("_d"))
    d = moved.join(near, [*keys, "id"], "left").groupBy(*keys, "id.convention").agg(F.median(F.coalesce("_d", F.lit(1e300))).alias("_m"), F.first("m").alias("m")).where(F.col("_m") <= radius)
    return d.groupBy(*keys).agg(F.min(F.struct("_m", "convention", "m")).alias("b")).select(*keys, "b.convention", F.col("b._m").alias("median_distance"), "b.m")


def complete_grid(nodes: DataFrame, fits: DataFrame) -> DataFrame:
    """All nodes, valid where there is a finite fit."""
    f = fits.select("pair_id", "gy", "gx", *[finite(F.col(c)).alias(c) for c in FIELDS])
    return nodes.select("pair_id", "gy", "gx").join(f, ["pair_id", "gy", "gx"], "left").withColumn("valid", F.col("scale").isNotNull() & F.col("offset").isNotNull())


# --- L5-L9 --------------------------------------------------------------------------------------------------------------------


def _shifted(a: np.ndarray) -> np.ndarray:
    """The 3x3 neighbourhood of each cell, NaN beyond the edge: an array (9, ny, nx), the cell itself in the middle."""
    p = np.pad(a, 1, constant_values=np.nan)
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)])


def _fill(fields: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    others = np.arange(9) != 4
    for _ in range(sum(valid.shape)):
        around = _shifted(np.where(valid, 1.0, np.nan))[others]
        has = ~valid & np.isfinite(around).any(0)
        if not has.any():
            break
        for f in fields:
            f[has] = np.nanmean(_shifted(np.where(valid, f, np.nan))[others][:, has], 0)
        valid = valid | has
    return fields, valid


def _smooth(fields: np.ndarray, valid: np.ndarray, passes: int) -> np.ndarray:
    w = np.array([1, 2, 1, 2, 4, 2, 1, 2, 1], float)[:, None, None]
    for _ in range(passes):
        for i, f in enumerate(fields):
            near = _shifted(np.where(valid, f, np.nan))
            good = np.isfinite(near)
            total = (w * good).sum(0)
            fields[i] = np.where(valid, np.nansum(w * near, 0) / np.where(total > 0, total, 1), f)
    return fields


def fill_and_smooth(grid: DataFrame, passes: int = 2) -> DataFrame:
    """Holes take the mean of their valid neighbours, ring by ring; then `passes` rounds of a 4/2/1 kernel over
    valid nodes.  A pair's grid is one group of as many rows as it has nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(pdf.gy.max()) + 1, int(pdf.gx.max()) + 1
        fields, valid = np.full((4, ny, nx), np.nan), np.zeros((ny, nx), bool)
        at = (pdf.gy.to_numpy(), pdf.gx.to_numpy())
        for i, c in enumerate(FIELDS):
            fields[i][at] = pdf[c].to_numpy(float)
        valid[at] = pdf.valid.to_numpy(bool)
        fields, valid = _fill(fields, valid)
        fields = _smooth(fields, valid, passes)
        out = pdf[["pair_id", "gy", "gx"]].assign(**{c: fields[i][at] for i, c in enumerate(FIELDS)}, valid=valid[at])
        return out.astype(object).where(out.notna(), None)

    kind = dict(grid.dtypes)["pair_id"]
    return grid.select("pair_id", "gy", "gx", *FIELDS, "valid").groupBy("pair_id").applyInPandas(run, GRID.replace("pair_id string", f"pair_id {kind}"))


def _nearby(fields: list[np.ndarray], valid: np.ndarray, gy: np.ndarray, gx: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Means of the fields over the valid ones of the 5x5 nodes around each place, weighted by 1 / (d^2 + .25); and where
    there is any."""
    ny, nx = valid.shape
    cy, cx = (np.clip(np.floor(g + 0.5), 0, n - 1).astype(int) for g, n in ((gy, ny), (gx, nx)))
    sums, total = [np.zeros(len(gy)) for _ in fields], np.zeros(len(gy))
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            y, x = cy + dy, cx + dx
            inside = (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
            y, x = np.clip(y, 0, ny - 1), np.clip(x, 0, nx - 1)
            w = np.where(inside & valid[y, x], 1 / ((gy - y) ** 2 + (gx - x) ** 2 + 0.25), 0.0)
            total += w
            for s, f in zip(sums, fields, strict=True):
                s += w * f[y, x]
    return [s / np.where(total > 0, total, 1) for s in sums], total > 0


def grid_at(scale: np.ndarray, offset: np.ndarray, valid: np.ndarray, y: np.ndarray, x: np.ndarray, step: float, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Scale and offset at points of a frame of this shape: inside it bilinear of four valid nodes; outside it, or
    where one of the four is not valid, by inverse distance 1 / (d^2 + .25) over the valid ones of the 5x5 nodes around; else
    the identity."""
    ny, nx = valid.shape
    fields = [np.where(valid, f, 0.0) for f in (scale, offset)]
    gy, gx = y / step, x / step
    inside = (y >= 0) & (x >= 0) & (y <= shape[0] - 1) & (x <= shape[1] - 1)
    iy, ix = (np.clip(np.floor(g), 0, n - 1).astype(int) for g, n in ((gy, ny), (gx, nx)))
    jy, jx = np.minimum(iy + 1, ny - 1), np.minimum(ix + 1, nx - 1)
    fy, fx = np.where(jy > iy, gy - iy, 0.0), np.where(jx > ix, gx - ix, 0.0)
    whole = inside & valid[iy, ix] & valid[iy, jx] & valid[jy, ix] & valid[jy, jx]
    got = [(1 - fy) * ((1 - fx) * f[iy, ix] + fx * f[iy, jx]) + fy * ((1 - fx) * f[jy, ix] + fx * f[jy, jx]) for f in fields]
    rest = np.flatnonzero(~whole)
    if len(rest):
        near, some = _nearby(fields, valid, gy[rest], gx[rest])
        for g, n, none in zip(got, near, (1.0, 0.0), strict=True):
            g[rest] = np.where(some, n, none)
    return got[0], got[1]


def packed_grids(grid: DataFrame) -> DataFrame:
    """A row for each pair: its nodes as flat arrays _gy, _gx, _scale, _offset; nodes that are not valid are left out, and _ny, _nx
    count all."""
    good = F.when(F.col("valid") & F.col("scale").isNotNull() & F.col("offset").isNotNull(), F.struct("gy", "gx", "scale", "offset"))
    nodes = grid.groupBy("pair_id").agg(F.collect_list(good).alias("g"), (F.max("gy") + 1).alias("_ny"), (F.max("gx") + 1).alias("_nx"))
    return nodes.select("pair_id", "_ny", "_nx", *[F.col(f"g.{c}").alias(f"_{c}") for c in ("gy", "gx", "scale", "offset")])


def correct_tiles(tiles: DataFrame, grid: DataFrame, step: int, pairs: DataFrame) -> DataFrame:
    """Target tiles (with pair_id) times scale plus offset, pixel by pixel; values that are not finite stay, and so do
    tiles of pairs without a grid.

    pairs: pair_id, m (target to reference; NULL: the same place), height, width (of the reference).  Fields are looked up where the pixel
    falls in the reference; where it has no place there, the identity holds.  A task holds one tile and one grid."""
    own = tiles.columns
    about = pairs.select("pair_id", F.col("m").alias("_m"), F.col("height").alias("_height"), F.col("width").alias("_width")).join(packed_grids(grid), "pair_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p in range(len(pdf)):
                r = pdf.iloc[p]
                v = np.asarray(r["px"], float)
                if r["_gy"] is None or not len(r["_gy"]):
                    out.append(v.astype(np.float32))
                    continue
                shape = int(r["_ny"]), int(r["_nx"])
                scale, offset, valid = np.ones(shape), np.zeros(shape), np.zeros(shape, bool)
                at = np.asarray(r["_gy"], int), np.asarray(r["_gx"], int)
                scale[at], offset[at], valid[at] = r["_scale"], r["_offset"], True
                y, x = (a.astype(float) for a in np.divmod(np.arange(r["h"] * r["w"]), r["w"]))
                y, x = y + r["y0"], x + r["x0"]
                placed = np.ones(len(v), bool)
                if r["_m"] is not None:
                    m = np.asarray(r["_m"], float)
                    weight = m[6] * x + m[7] * y + m[8]
                    placed = np.abs(weight) > 1e-12
                    safe = np.where(placed, weight, 1.0)
                    x, y = (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe
                s, o = grid_at(scale, offset, valid, y, x, step, (int(r["_height"]), int(r["_width"])))
                out.append(np.where(np.isfinite(v) & placed, s * v + o, v).astype(np.float32))
            yield pdf[own].assign(px=out)

    return tiles.join(about, "pair_id", "left").select(*own, *[c for c in about.columns if c != "pair_id"]).mapInPandas(run, tiles.schema)


def normalized(reference: DataFrame, target: DataFrame, pairs: DataFrame, step: int, window: int, tile: int, passes: int = 2, **fit) -> DataFrame:
    """J20, G30, L4-L8 as one job: the target tiles of each pair (pair_id added) brought to the level of their reference.

    pairs: pair_id, reference_id, target_id, m (reference to target).  fit: options of fit_nodes."""
    shapes = frame_shapes(reference, "reference_id")
    placed = pairs.join(shapes, "reference_id")
    nodes = grid_nodes(placed.select("pair_id", "width", "height"), "width", "height", step)
    found = written(fit_nodes(paired_samples(reference, target, pairs, step, window, tile), **fit), "node-fits")
    grid = fill_and_smooth(complete_grid(nodes, found), passes)
    own = target.join(pairs.select("pair_id", F.col("target_id").alias("frame_id")), "frame_id").select("pair_id", *target.columns)
    return correct_tiles(own, grid, step, placed.withColumn("m", inverse(F.col("m"))))


def validity(grid: DataFrame, least: float = 0.30) -> DataFrame:
    """Nodes, valid nodes, their share, ranges of scale and offset, and whether the pair passes."""
    g = grid.groupBy("pair_id").agg(F.count("*").alias("nodes"), F.count_if("valid").alias("valid_nodes"), *[f(F.when(F.col("valid"), F.col(c))).alias(f"{n}_{c}") for c in ("scale", "offset") for n, f in (("min", F.min), ("max", F.max))])
    return g.withColumn("valid_fraction", F.col("valid_nodes") / F.col("nodes")).withColumn("passes", F.col("valid_fraction") >= least)


def run_status(pairs: DataFrame, checks: DataFrame) -> DataFrame:
    """Each pair with its status: corrected, rejected (too few valid nodes) or failed (no grid)."""
    return pairs.join(checks, "pair_id", "left").withColumn("status", F.when(F.col("nodes").isNull(), "failed").when(F.col("passes"), "corrected").otherwise("rejected"))


def outstanding(groups: DataFrame, finished: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Groups without a written master, or all of them if forced."""
    return groups if force else groups.join(finished.where("state = 'master_written'").select(*keys).distinct(), keys, "left_anti")


def group_state(stages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each group the first failed stage with the first line of its error, or the last stage's state."""
    failed = F.min(F.when(F.col("error").isNotNull(), F.struct(F.col(order).alias("o"), "stage", F.substring_index("error", "\n", 1).alias("line"))))
    return stages.groupBy(*keys).agg(failed.alias("f"), F.max_by("state", order).alias("state")).select(*keys, F.col("f.stage").alias("failed_stage"), F.col("f.line").alias("error_line"), F.when(F.col("f").isNotNull(), "failed").otherwise(F.col("state")).alias("state"))


def subtract_surface(bg: DataFrame, keys: list[str]) -> DataFrame:
    """Tile backgrounds (keys, x, y, background) less a surface of degree 2, fitted by sums to the 6 normal equations; a
    group of fewer than 6 tiles loses its mean.  `surface` and `residual` are added."""
    terms = [F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"), F.col("y") * F.col("y")]
    sums = bg.groupBy(*keys).agg(F.array(*[F.sum(a * b) for a in terms for b in terms]).alias("_a"), F.array(*[F.sum(a * F.col("background")) for a in terms]).alias("_b"), F.count("*").alias("_n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [np.linalg.lstsq(np.reshape(a, (6, 6)), b, rcond=1e-12)[0] if n >= 6 else np.array([b[0] / n, 0, 0, 0, 0, 0]) for a, b, n in zip(pdf["_a"], pdf["_b"], pdf["_n"], strict=True)]
            yield pdf[keys].assign(_c=got)

    kinds = ", ".join(f"`{k}` {t}" for k, t in bg.dtypes if k in keys)
    x = _join(bg, sums.mapInPandas(solve, f"{kinds}, _c array<double>"), keys)
    surface = sum((F.col("_c")[i] * t for i, t in enumerate(terms[1:], 1)), F.col("_c")[0])
    return x.withColumn("surface", surface).withColumn("residual", F.col("background") - F.col("surface")).drop("_c")
