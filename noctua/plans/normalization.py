"""Queries of local normalization: paired samples, node fits with their options, correction through grids with holes, and the
whole job over pairs of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.operators import lnc, tiles
from noctua.plans.base import Tables, query, r
from noctua.plans.sky import PX, _tiles

#: Reference to target: a turn, a shift and some perspective.
M = [1.02, 0.05, 0.4, -0.04, 0.98, 0.3, 0.001, 0.0, 1.0]
#: Even frames are references of the next frame; pixels above 0.25 of a reference and below -0.25 of a target are masked.
SAMPLES = f"""{PX},
c AS (SELECT vec_id AS p, y, x, v AS ref, (1.02::DOUBLE * x + 0.05::DOUBLE * y + 0.4::DOUBLE) / (0.001::DOUBLE * x + 1) AS tx, (-0.04::DOUBLE * x + 0.98::DOUBLE * y + 0.3::DOUBLE) / (0.001::DOUBLE * x + 1) AS ty FROM px WHERE vec_id % 2 = 0 AND v <= 0.25),
k AS (SELECT *, floor(tx)::INT AS x0, floor(ty)::INT AS y0, least(floor(tx) + 1, 7)::INT AS x1, least(floor(ty) + 1, 7)::INT AS y1, tx - floor(tx) AS fx, ty - floor(ty) AS fy FROM c WHERE tx BETWEEN 0 AND 7 AND ty BETWEEN 0 AND 7),
s AS (SELECT k.p, k.y, k.x, k.ref, (1 - fy) * ((1 - fx) * v00.v + fx * v10.v) + fy * ((1 - fx) * v01.v + fx * v11.v) AS target FROM k
  JOIN px v00 ON v00.vec_id = p + 1 AND v00.y = y0 AND v00.x = x0 JOIN px v10 ON v10.vec_id = p + 1 AND v10.y = y0 AND v10.x = x1 JOIN px v01 ON v01.vec_id = p + 1 AND v01.y = y1 AND v01.x = x0
  JOIN px v11 ON v11.vec_id = p + 1 AND v11.y = y1 AND v11.x = x1 JOIN px near ON near.vec_id = p + 1 AND near.y = floor(ty + 0.5) AND near.x = floor(tx + 0.5) WHERE near.v >= -0.25),
n AS (SELECT p, gy, gx, y, x, ref, target FROM s, (SELECT unnest([0, 1]) AS gy), (SELECT unnest([0, 1]) AS gx) WHERE pow(y - 4 * gy, 2) + pow(x - 4 * gx, 2) <= 9)"""
#: The trimmed fit of each node of at least 12 samples.
FITS = """k2 AS (SELECT *, row_number() OVER (PARTITION BY p, gy, gx ORDER BY target, ref) AS i, count(*) OVER (PARTITION BY p, gy, gx) AS m FROM n),
f AS (SELECT p, gy, gx, regr_slope(ref, target) AS s, regr_intercept(ref, target) AS o, median(ref) AS mr, median(target) AS mt, avg(ref) AS ar, avg(target) AS at_, count(*) AS used FROM k2 WHERE m >= 12 AND i > floor(m * 0.1) AND i <= m - floor(m * 0.1) GROUP BY 1, 2, 3 HAVING count(*) >= 8)"""


def _masked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tiles of references, whose masked pixels are NaN, and of targets, with a mask."""
    x = _tiles(t)
    even = F.col("frame_id").cast("long") % 2 == 0
    ref = x.where(even).withColumn("px", F.transform("px", lambda v: F.when(v.cast("double") <= 0.25, v).otherwise(F.lit(float("nan")).cast("float"))))
    return ref, x.where(~even).withColumn("mask", F.transform("px", lambda v: v.cast("double") < -0.25))


def _pairs(t: Tables) -> DataFrame:
    even = t.embeddings.where("vec_id % 2 = 0").select("vec_id")
    return even.select(F.col("vec_id").alias("pair_id"), F.col("vec_id").cast("string").alias("reference_id"), (F.col("vec_id") + 1).cast("string").alias("target_id"), F.array(*[F.lit(v) for v in M]).alias("m"))


@query("j20_paired_samples", f"WITH {SAMPLES} SELECT p AS pair_id, gy::INTEGER AS gy, gx::INTEGER AS gx, count(*) AS n, round(sum(ref), 5) AS ref, round(sum(target), 5) AS target, round(sum(ref * target), 5) AS both FROM n GROUP BY 1, 2, 3")
def _(t: Tables):
    ref, target = _masked(t)
    total = lambda c: F.round(F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)), 5)
    got = lnc.paired_samples(ref, target, _pairs(t), 4, 7, 4)
    return got.groupBy("pair_id", "gy", "gx").agg(F.sum(F.size("ref")).alias("n"), total("ref").alias("ref"), total("target").alias("target"), total(F.zip_with("ref", "target", lambda a, b: a * b)).alias("both"))


@query("x3_models", f"""
WITH {SAMPLES}, {FITS}, g AS (SELECT *, coalesce(s BETWEEN 0.05 AND 2, false) AS good FROM f)
SELECT * FROM (
  SELECT 'affine' AS model, 'median' AS estimator, p AS pair_id, gy::INTEGER AS gy, gx::INTEGER AS gx, round(CASE WHEN good THEN s ELSE 1 END, 5) AS scale, round(CASE WHEN good THEN o ELSE mr - mt END, 5) AS "offset", round(mr, 6) AS ref_bg, used FROM g
  UNION ALL SELECT 'affine', 'mean', p, gy, gx, round(CASE WHEN good THEN s ELSE 1 END, 5), round(CASE WHEN good THEN o ELSE ar - at_ END, 5), round(ar, 6), used FROM g
  UNION ALL SELECT 'additive', 'median', p, gy, gx, 1.1, round(mr - 1.1 * mt, 5), round(mr, 6), used FROM g
  UNION ALL SELECT 'additive', 'mean', p, gy, gx, 1.1, round(ar - 1.1 * at_, 5), round(ar, 6), used FROM g)
""")
def _(t: Tables):
    ref, target = _masked(t)
    samples = lnc.written(lnc.paired_samples(ref, target, _pairs(t), 4, 7, 4), "samples")
    fit = lnc.fit_models(samples, [(m, e) for m in ("affine", "additive") for e in ("median", "mean")], 1.1, low=0.05, least=8, min_samples=12)
    return fit.select("model", "estimator", "pair_id", "gy", "gx", r("scale", 5).alias("scale"), r("offset", 5).alias("offset"), r("ref_bg").alias("ref_bg"), "used")


#: A grid of 4 x 4 nodes, two pixels apart, for each frame of 8 x 8 pixels; nodes above 0.1 are holes.
HOLED = f"{PX}, node AS (SELECT vec_id, y // 2 AS gy, x // 2 AS gx, 1 + v AS s, 2 * v AS o, v <= 0.1 AS good FROM px WHERE y % 2 = 0 AND x % 2 = 0 AND vec_id % 3 <> 0)"


@query("l7_l8_corrected_tiles", f"""
WITH {HOLED},
q AS (SELECT vec_id, y, x, v, 1.1::DOUBLE * x - 0.5::DOUBLE AS rx, 0.9::DOUBLE * y + 0.01::DOUBLE * x + 0.3::DOUBLE AS ry FROM px),
g AS (SELECT *, rx BETWEEN 0 AND 7 AND ry BETWEEN 0 AND 7 AS inside, rx / 2 AS gx, ry / 2 AS gy, greatest(0, least(3, floor(rx / 2)))::INT AS ix, greatest(0, least(3, floor(ry / 2)))::INT AS iy FROM q),
h AS (SELECT *, least(ix + 1, 3) AS jx, least(iy + 1, 3) AS jy, CASE WHEN ix < 3 THEN gx - ix ELSE 0 END AS fx, CASE WHEN iy < 3 THEN gy - iy ELSE 0 END AS fy FROM g),
b AS (SELECT h.*, a.good AND c.good AND d.good AND e.good AS all_good,
        (1 - fy) * ((1 - fx) * a.s + fx * c.s) + fy * ((1 - fx) * d.s + fx * e.s) AS s, (1 - fy) * ((1 - fx) * a.o + fx * c.o) + fy * ((1 - fx) * d.o + fx * e.o) AS o
  FROM h LEFT JOIN node a ON a.vec_id = h.vec_id AND a.gy = iy AND a.gx = ix LEFT JOIN node c ON c.vec_id = h.vec_id AND c.gy = iy AND c.gx = jx
  LEFT JOIN node d ON d.vec_id = h.vec_id AND d.gy = jy AND d.gx = ix LEFT JOIN node e ON e.vec_id = h.vec_id AND e.gy = jy AND e.gx = jx),
w AS (SELECT b.vec_id, b.y, b.x, sum(n.s / (pow(b.gy - n.gy, 2) + pow(b.gx - n.gx, 2) + 0.25)) / sum(1 / (pow(b.gy - n.gy, 2) + pow(b.gx - n.gx, 2) + 0.25)) AS s,
        sum(n.o / (pow(b.gy - n.gy, 2) + pow(b.gx - n.gx, 2) + 0.25)) / sum(1 / (pow(b.gy - n.gy, 2) + pow(b.gx - n.gx, 2) + 0.25)) AS o
  FROM b JOIN node n ON n.vec_id = b.vec_id AND n.good AND abs(n.gy - greatest(0, least(3, floor(b.gy + 0.5)))) <= 2 AND abs(n.gx - greatest(0, least(3, floor(b.gx + 0.5)))) <= 2 GROUP BY 1, 2, 3),
r AS (SELECT b.vec_id, b.y, b.x, CASE WHEN b.v > 0.2 THEN NULL ELSE CAST(b.v * (CASE WHEN inside AND all_good THEN b.s ELSE coalesce(w.s, 1) END) + (CASE WHEN inside AND all_good THEN b.o ELSE coalesce(w.o, 0) END) AS FLOAT)::DOUBLE END AS v FROM b LEFT JOIN w USING (vec_id, y, x))
SELECT CAST(vec_id AS VARCHAR) AS frame_id, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, count(v) AS n, round(sum(v * (1 + y + 8 * x)), 3) AS moment FROM r GROUP BY 1, 2, 3
""")
def _(t: Tables):
    px = _tiles(t).withColumn("pair_id", F.col("frame_id").cast("long")).withColumn("px", F.transform("px", lambda v: F.when(v.cast("double") > 0.2, F.lit(float("nan")).cast("float")).otherwise(v)))
    v = F.col("embedding")[(F.col("gy") * 16 + F.col("gx") * 2).cast("int")].cast("double")
    node = t.embeddings.where("vec_id % 3 <> 0").withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    grid = node.select(F.col("vec_id").alias("pair_id"), "gy", "gx", (1 + v).alias("scale"), (2 * v).alias("offset"), (v <= 0.1).alias("valid"))
    m = F.array(*[F.lit(c) for c in (1.1, 0.0, -0.5, 0.01, 0.9, 0.3, 0.0, 0.0, 1.0)])
    pairs = t.embeddings.select(F.col("vec_id").alias("pair_id"), m.alias("m"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    got = tiles.pixels(lnc.correct_tiles(px, grid, 2, pairs), ["frame_id", "ty", "tx"])
    return got.groupBy("frame_id", "ty", "tx").agg(F.count("v").alias("n"), r(F.sum(F.col("v") * (1 + F.col("y") + 8 * F.col("x"))), 3).alias("moment"))


@query("l8_normalized_pairs", f"""
WITH {SAMPLES}, {FITS},
g AS (SELECT a.p, a.gy, a.gx, CASE WHEN s BETWEEN 0.05 AND 2 THEN s ELSE 1 END AS s, CASE WHEN s BETWEEN 0.05 AND 2 THEN o ELSE mr - mt END AS o, f.p IS NOT NULL AS good FROM (SELECT vec_id AS p, gy, gx FROM embeddings, (SELECT unnest([0, 1]) AS gy), (SELECT unnest([0, 1]) AS gx) WHERE vec_id % 2 = 0) a LEFT JOIN f USING (p, gy, gx)),
mean_ AS (SELECT p, avg(s) FILTER (good) AS s, avg(o) FILTER (good) AS o, count(*) FILTER (good) AS k FROM g GROUP BY 1),
h AS (SELECT p, gy, gx, CASE WHEN good THEN g.s ELSE mean_.s END AS s, CASE WHEN good THEN g.o ELSE mean_.o END AS o FROM g JOIN mean_ USING (p) WHERE k > 0),
w AS (SELECT a.p, a.gy, a.gx, sum(b.s * (4 >> (abs(a.gy - b.gy) + abs(a.gx - b.gx)))) / 9 AS s, sum(b.o * (4 >> (abs(a.gy - b.gy) + abs(a.gx - b.gx)))) / 9 AS o FROM h a JOIN h b USING (p) GROUP BY 1, 2, 3),
i AS (SELECT p, max(s) FILTER (gy = 0 AND gx = 0) AS s00, max(s) FILTER (gy = 0 AND gx = 1) AS s10, max(s) FILTER (gy = 1 AND gx = 0) AS s01, max(s) FILTER (gy = 1 AND gx = 1) AS s11,
  max(o) FILTER (gy = 0 AND gx = 0) AS o00, max(o) FILTER (gy = 0 AND gx = 1) AS o10, max(o) FILTER (gy = 1 AND gx = 0) AS o01, max(o) FILTER (gy = 1 AND gx = 1) AS o11 FROM w GROUP BY 1),
-- the inverse by cofactors; determinant d
t AS (SELECT vec_id, y, x, v, (0.98::DOUBLE * x - 0.05::DOUBLE * y + (0.05::DOUBLE * 0.3::DOUBLE - 0.4::DOUBLE * 0.98::DOUBLE)) AS a, (0.04::DOUBLE * x + (1.02::DOUBLE - 0.4::DOUBLE * 0.001::DOUBLE) * y + (0.4::DOUBLE * -0.04::DOUBLE - 1.02::DOUBLE * 0.3::DOUBLE)) AS b0,
   (0.3::DOUBLE * 0.001::DOUBLE) AS e1, (-0.98::DOUBLE * 0.001::DOUBLE * x + 0.05::DOUBLE * 0.001::DOUBLE * y + (1.02::DOUBLE * 0.98::DOUBLE + 0.05::DOUBLE * 0.04::DOUBLE)) AS c FROM px WHERE vec_id % 2 = 1),
u AS (SELECT vec_id, y, x, v, a / c AS rx, (b0 + e1 * x) / c AS ry FROM t),
z AS (SELECT *, rx BETWEEN 0 AND 7 AND ry BETWEEN 0 AND 7 AS inside, rx / 4 AS gx, ry / 4 AS gy, CASE WHEN floor(rx / 4) < 1 THEN rx / 4 ELSE 0 END AS fx, floor(rx / 4) >= 1 AS right_, CASE WHEN floor(ry / 4) < 1 THEN ry / 4 ELSE 0 END AS fy, floor(ry / 4) >= 1 AS low_ FROM u),
k4 AS (SELECT z.*, i.p IS NOT NULL AS has, 1 / (gy * gy + gx * gx + 0.25) AS w00, 1 / (gy * gy + pow(gx - 1, 2) + 0.25) AS w10, 1 / (pow(gy - 1, 2) + gx * gx + 0.25) AS w01, 1 / (pow(gy - 1, 2) + pow(gx - 1, 2) + 0.25) AS w11, i.* FROM z LEFT JOIN i ON i.p = vec_id - 1),
r AS (SELECT vec_id, y, x, CAST(CASE WHEN NOT has THEN v WHEN inside THEN
   v * ((1 - fy) * ((1 - fx) * (CASE WHEN low_ THEN CASE WHEN right_ THEN s11 ELSE s01 END ELSE CASE WHEN right_ THEN s10 ELSE s00 END END) + fx * (CASE WHEN low_ THEN s11 ELSE s10 END)) + fy * ((1 - fx) * (CASE WHEN right_ THEN s11 ELSE s01 END) + fx * s11))
   + ((1 - fy) * ((1 - fx) * (CASE WHEN low_ THEN CASE WHEN right_ THEN o11 ELSE o01 END ELSE CASE WHEN right_ THEN o10 ELSE o00 END END) + fx * (CASE WHEN low_ THEN o11 ELSE o10 END)) + fy * ((1 - fx) * (CASE WHEN right_ THEN o11 ELSE o01 END) + fx * o11))
   ELSE (v * (s00 * w00 + s10 * w10 + s01 * w01 + s11 * w11) + (o00 * w00 + o10 * w10 + o01 * w01 + o11 * w11)) / (w00 + w10 + w01 + w11) END AS FLOAT)::DOUBLE AS v FROM k4)
SELECT vec_id - 1 AS pair_id, CAST(vec_id AS VARCHAR) AS frame_id, count(*) AS n, round(sum(v), 3) AS total, round(sum(v * (1 + y + 8 * x)), 2) AS moment FROM r WHERE vec_id - 1 IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1, 2
""")
def _(t: Tables):
    ref, target = _masked(t)
    got = lnc.normalized(ref, target, _pairs(t), 4, 7, 4, passes=1, low=0.05, least=8, min_samples=12)
    p = tiles.pixels(got, ["pair_id", "frame_id"])
    return p.groupBy("pair_id", "frame_id").agg(F.count("v").alias("n"), r(F.sum("v"), 3).alias("total"), r(F.sum(F.col("v") * (1 + F.col("y") + 8 * F.col("x"))), 2).alias("moment"))
