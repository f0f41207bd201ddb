"""Queries of masks, blurs, star scales, sensor figures, transforms found from stars, and value scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators import lnc, masks, quality, stats, tiles
from noctua.plans.base import Tables, query, r, rounded
from noctua.plans.frames import POINTS, _points
from noctua.plans.sky import PX, _px, _tiles
from noctua.plans.statistics import PCT

DISC = "(SELECT unnest(generate_series(-13, 13)) AS dy), (SELECT unnest(generate_series(-13, 13)) AS dx)"


@query("j19_mask_report", f"""
WITH {POINTS}, s AS (SELECT f, x, 996 - y AS y, least(12, greatest(4, 2.0 * (id % 7))) AS rad FROM q),
m AS (SELECT DISTINCT f, yy, xx FROM (SELECT f, x, y, rad, round(y)::BIGINT + dy AS yy, round(x)::BIGINT + dx AS xx FROM s, {DISC}) WHERE pow(yy - y, 2) + pow(xx - x, 2) <= rad * rad AND yy BETWEEN 0 AND 996 AND xx BETWEEN 0 AND 1008),
h AS (SELECT DISTINCT f, y::BIGINT + dy AS yy, x::BIGINT + dx AS xx FROM p, {DISC} WHERE id % 3 = 0 AND dy * dy + dx * dx <= 4 AND y + dy BETWEEN 0 AND 996 AND x + dx BETWEEN 0 AND 1008),
n AS (SELECT f, count(*) AS n FROM (SELECT * FROM m UNION SELECT * FROM h) GROUP BY 1)
SELECT CAST(f AS INTEGER) AS f, (SELECT count(*) FROM m WHERE m.f = n.f) AS star_masked, (SELECT count(*) FROM h WHERE h.f = n.f) AS saturated_masked, n AS total_masked, round(n / (997 * 1009), 6) AS masked_fraction FROM n
""")
def _(t: Tables):
    p, q = _points(t)
    px = p.select("f", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.when(F.col("id") % 3 == 0, 65535.0).otherwise(100.0).alias("v"))
    stars = masks.star_runs(q, ["f"], masks.star_radius(F.col("id") % 7, 2.0, 4.0, 12.0), 997, 1009)
    hot = masks.dilated(masks.saturated_runs(px, ["f"], 60000, 997, 1009), ["f"], 2, 997, 1009)
    return masks.mask_report(stars, hot, ["f"], 997, 1009).withColumn("masked_fraction", r("masked_fraction"))


@query("j19_masked_pixels", f"""
WITH {PX}, h AS (SELECT vec_id, y, x FROM px WHERE v >= 0.25) SELECT p.vec_id, count(*) AS masked, round(sum(p.v), 6) AS total FROM px p WHERE EXISTS (SELECT 1 FROM h WHERE h.vec_id = p.vec_id AND pow(h.y - p.y, 2) + pow(h.x - p.x, 2) <= 1) GROUP BY 1
""")
def _(t: Tables):
    p = _px(t).select("vec_id", "y", "x", "v")
    runs = masks.dilated(masks.saturated_runs(p, ["vec_id"], 0.25, 8, 8), ["vec_id"], 1, 8, 8)
    seen = masks.without_masked(p.withColumn("was", F.col("v")), runs, ["vec_id"])
    return seen.where("v is null").groupBy("vec_id").agg(F.count("*").alias("masked"), r(F.sum("was")).alias("total"))


@query("p36_blurred_tiles", f"""
WITH {PX}, w AS (SELECT d, exp(-d * d / 2.0) AS w FROM (SELECT unnest(generate_series(-2, 2)) AS d)), k AS (SELECT d, w / (SELECT sum(w) FROM w) AS w FROM w),
b AS (SELECT p.vec_id, p.y + a.d AS y, p.x + c.d AS x, sum(p.v * a.w * c.w) AS v FROM px p, k a, k c WHERE p.y + a.d BETWEEN 0 AND 7 AND p.x + c.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
SELECT CAST(vec_id AS VARCHAR) AS frame_id, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, round(sum(v * (1 + y + 8 * x)), 3) AS moment FROM b GROUP BY 1, 2, 3
""")
def _(t: Tables):
    b = masks.blurred(_tiles(t), 4, 1.0, 2)
    return tiles.pixels(b, ["frame_id", "ty", "tx"]).groupBy("frame_id", "ty", "tx").agg(r(F.sum(F.col("v") * (1 + F.col("y") + 8 * F.col("x"))), 3).alias("moment"))


@query("g37_repaired_pixels", f"""
WITH {PX}, h AS (SELECT y, x FROM px WHERE vec_id = 1 AND v > 0.1), n AS (SELECT p.vec_id, h.y, h.x, median(p.v) AS v FROM h JOIN px p ON abs(p.y - h.y) <= 1 AND abs(p.x - h.x) <= 1 WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.y = p.y AND g.x = p.x) GROUP BY 1, 2, 3)
SELECT p.vec_id, round(sum((CASE WHEN h.y IS NULL THEN p.v ELSE n.v END) * (1 + p.y + 8 * p.x)), 4) AS moment FROM px p LEFT JOIN h ON h.y = p.y AND h.x = p.x LEFT JOIN n ON n.vec_id = p.vec_id AND n.y = p.y AND n.x = p.x GROUP BY 1
""")
def _(t: Tables):
    p = _px(t).select("vec_id", "y", "x", "v")
    fixed = tiles.repair_hot(p, p.where("vec_id = 1 and v > 0.1"), ["vec_id"], 1)
    return fixed.groupBy("vec_id").agg(r(F.sum(F.col("v") * (1 + F.col("y") + 8 * F.col("x"))), 4).alias("moment"))


@query("g28_star_scale_report", """
WITH c AS (SELECT l_suppkey AS pair, l_quantity AS a, l_extendedprice AS b FROM lineitem WHERE l_discount < 0.09), m AS (SELECT l_suppkey AS pair, count(*) AS matched, count(*) FILTER (l_discount < 0.09) AS candidates FROM lineitem GROUP BY 1),
e AS (SELECT pair, median(b / a) AS s, count(*) AS n, count(*) FILTER (a > 0) AS used, avg(b) AS mean FROM c GROUP BY 1 HAVING count(*) >= 8), q AS (SELECT pair, 1 - sum(pow(b - s * a, 2)) / sum(pow(b - mean, 2)) AS r2 FROM c JOIN e USING (pair) GROUP BY 1)
SELECT pair, s IS NOT NULL AND NOT coalesce(r2 < 0.9, false) AS ok, CASE WHEN s IS NULL THEN 'too_few_points' WHEN r2 < 0.9 THEN 'low_r_squared' END AS message, round(s, 4) AS scale_b_over_a, round(r2, 6) AS r_squared, matched, candidates, CASE WHEN s IS NOT NULL AND NOT coalesce(r2 < 0.9, false) THEN used ELSE 0 END AS used FROM m LEFT JOIN e USING (pair) LEFT JOIN q USING (pair)
""")
def _(t: Tables):
    flags = F.when(F.col("l_discount") >= 0.09, F.array(F.lit("a_low_snr"))).otherwise(F.array().cast("array<string>"))
    m = t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), flags.alias("flags"))
    got = stats.star_scale_report(m, ["pair"], "a", "b", "flags", sigma=1000.0, least=8, rounds=1)
    return got.select("pair", "ok", "message", r("scale_b_over_a", 4).alias("scale_b_over_a"), r("r_squared").alias("r_squared"), "matched", "candidates", "used")


@query("g32_sample_median_nodes", f"""
WITH {PX}, s AS (SELECT label AS p, vec_id % 3 AS gy, vec_id, v AS ref, 1.25 * v + 0.001 * (y + x) AS target FROM px), m AS (SELECT p, gy, vec_id, median(ref) AS r, median(target) AS t FROM s GROUP BY 1, 2, 3), c AS (SELECT p, gy, median(r) AS mr, median(t) AS mt, count(*) AS n FROM m GROUP BY 1, 2),
d AS (SELECT p, gy, median(abs(r - mr)) AS sr, median(abs(t - mt)) AS st FROM m JOIN c USING (p, gy) GROUP BY 1, 2), k AS (SELECT p, gy, vec_id, r, t, count(*) OVER w AS a, any_value(n) OVER w AS n, row_number() OVER (PARTITION BY p, gy ORDER BY t, vec_id) AS k FROM m JOIN c USING (p, gy) JOIN d USING (p, gy) WHERE r <= mr + 2.5 * sr AND t <= mt + 2.5 * st WINDOW w AS (PARTITION BY p, gy)),
f AS (SELECT p, gy, regr_slope(r, t) AS s, regr_intercept(r, t) AS o, avg(r) - avg(t) AS d, count(*) AS used FROM k WHERE k > floor(a * 0.1) AND k <= a - floor(a * 0.1) GROUP BY 1, 2 HAVING any_value(a) >= 4 AND count(*) >= 4), g AS (SELECT p, gy, median(r) AS ref_bg, any_value(a) / any_value(n) AS accepted FROM k GROUP BY 1, 2)
SELECT CAST(p AS VARCHAR) AS pair_id, CAST(gy AS INTEGER) AS gy, round(CASE WHEN s BETWEEN 0.5 AND 2 THEN s ELSE 1 END, 5) AS scale, round(CASE WHEN s BETWEEN 0.5 AND 2 THEN o ELSE d END, 5) AS "offset", round(ref_bg, 6) AS ref_bg, used, round(accepted, 6) AS accepted FROM f JOIN g USING (p, gy)
""")
def _(t: Tables):
    patch = F.col("vec_id") * 8
    s = _px(t).select(F.col("label").cast("string").alias("pair_id"), (F.col("vec_id") % 3).cast("int").alias("gy"), F.lit(0).alias("gx"), (patch + F.col("y")).alias("y"), "x", F.col("v").alias("ref"), (1.25 * F.col("v") + 0.001 * (F.col("y") + F.col("x"))).alias("target"))
    got = lnc.sample_median_nodes(lnc.patch_medians(s, 8), least=4)
    return got.select("pair_id", "gy", r("scale", 5).alias("scale"), r("offset", 5).alias("offset"), r("ref_bg").alias("ref_bg"), "used", r("accepted").alias("accepted"))


@query("g39_gain_over_bias", f"""
WITH {PX}, f AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM px), p AS (SELECT label, n // 2 AS pair, y, x, max(v) FILTER (n % 2 = 0) AS a, max(v) FILTER (n % 2 = 1) AS b FROM f GROUP BY 1, 2, 3, 4),
g AS (SELECT label, pair, avg((a + b) / 2) AS s, var_samp(a - b) / 2 AS v FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) SELECT label, round(sum(pow(s + 0.5, 2)) / sum(v * (s + 0.5)), 4) AS gain, count(*) AS n FROM g GROUP BY 1
""")
def _(t: Tables):
    return rounded(tiles.gain_over_bias(tiles.flat_pairs(_px(t), ["label"], "vec_id", ["y", "x"], "v"), ["label"], -0.5), 4)


@query("g39_bias_noise", f"""
WITH {PX}, m AS (SELECT label, y, x, avg(v) AS m FROM px GROUP BY 1, 2, 3), s AS (SELECT label, vec_id, stddev_samp(v - m) AS s FROM px JOIN m USING (label, y, x) GROUP BY 1, 2) SELECT label, round(avg(s) * 2, 6) AS read_noise, round(stddev_samp(s) * 2, 6) AS spread, count(s) AS frames FROM s GROUP BY 1
""")
def _(t: Tables):
    return rounded(tiles.bias_noise(_px(t), ["label"], "vec_id", ["y", "x"], "v", 2.0))


@query("g39_dark_current", f"""
WITH {PX}, m AS (SELECT y, x, avg(v) AS m FROM px GROUP BY 1, 2), d AS (SELECT vec_id, v - m AS d FROM px JOIN m USING (y, x)), s AS (SELECT vec_id, stddev_samp(d) AS s FROM d GROUP BY 1)
SELECT vec_id, round(var_samp(d) / (60 + vec_id % 5) * 1000, 6) AS current, count(*) AS used FROM d JOIN s USING (vec_id) WHERE abs(d) < 1.5 * s GROUP BY 1
""")
def _(t: Tables):
    p = _px(t)
    master = tiles.mean_stack(p, ["y", "x"]).withColumnRenamed("value", "v")
    return rounded(tiles.dark_current(p, master, ["vec_id"], ["y", "x"], "v", 60 + F.col("vec_id") % 5, 1000.0, 1.5))


@query("j21_transform_from_stars", f"""
WITH {POINTS}, t AS (SELECT f, id, x, y, row_number() OVER (PARTITION BY f ORDER BY id) AS k FROM q), c AS (SELECT f, id, unnest(['image_to_internal_reference', 'internal_reference_to_image']) AS convention, unnest([x + 3, x - 3]) AS x, unnest([y - 2, y + 2]) AS y FROM t WHERE k <= 20),
n AS (SELECT c.f, c.id, convention, min(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2))) AS d FROM c JOIN p ON p.f = c.f GROUP BY 1, 2, 3), m AS (SELECT f, convention, median(CASE WHEN d <= 40 THEN d ELSE 1e300 END) AS m FROM n GROUP BY 1, 2)
SELECT CAST(f AS INTEGER) AS f, arg_min(convention, (m, convention)) AS convention, round(min(m), 6) AS median_distance FROM m WHERE m <= 40 GROUP BY 1
""")
def _(t: Tables):
    p, q = _points(t)
    matrix = lambda dx, dy: F.array(*[F.lit(float(v)) for v in (1, 0, dx, 0, 1, dy, 0, 0, 1)])
    pairs = p.select("f").distinct().withColumn("reference", matrix(10, 5)).withColumn("target", matrix(13, 3))
    got = lnc.choose_transform(pairs, q, p, ["f"], lnc.candidate_transforms(F.col("reference"), F.col("target")), 40.0, 20)
    return got.select("f", "convention", r("median_distance").alias("median_distance"))


@query("p25_pair_scales", f"""
WITH {PX}, s AS (SELECT vec_id, quantile_cont(v * (1 + vec_id % 3 * 20), 0.999) <= 1.5 AND median(v * (1 + vec_id % 3 * 20)) <= 1 AND min(v * (1 + vec_id % 3 * 20)) >= -0.25 AS n FROM px GROUP BY 1)
SELECT a.vec_id, CASE WHEN a.n = b.n THEN CASE WHEN a.n THEN 'normalized' ELSE 'adu' END END AS scale FROM s a JOIN s b ON b.vec_id = a.vec_id + 1
""")
def _(t: Tables):
    v = F.col("v") * (1 + F.col("vec_id") % 3 * 20)
    s = _px(t).groupBy("vec_id").agg(S.is_normalized(F.percentile(v, 0.999), F.median(v), F.min(v)).alias("n"))
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("n").alias("other"))
    return s.join(b, "vec_id").select("vec_id", S.agreed_scale(F.col("n"), F.col("other")).alias("scale"))


@query("p25_counts", """
SELECT vec_id, round(list_sum(list_transform(px, lambda x: CASE WHEN list_min(px) >= -0.1 AND list_max(px) <= 1.1 THEN x * 65535 ELSE x END)), 2) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * (1 + vec_id % 2 * 9)) AS px FROM embeddings)
""")
def _(t: Tables):
    x = t.embeddings.select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double")) * (1 + F.col("vec_id") % 2 * 9)).alias("px"))
    return x.select("vec_id", r(F.aggregate(S.to_counts(F.col("px"), F.array_min("px"), F.array_max("px")), F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("p26_unit_range", "SELECT vec_id, round(list_sum(list_transform(px, lambda x: (x - list_min(px)) / (list_max(px) - list_min(px)))), 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS px FROM embeddings)")
def _(t: Tables):
    x = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    return x.select("vec_id", r(F.aggregate(S.unit_range(F.col("px"), F.array_min("px"), F.array_max("px")), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("o4_target_strength", """
WITH g AS (SELECT l_suppkey AS g, max(greatest((l_suppkey + l_orderkey) % 29 / 28, l_tax * 12, (l_orderkey % 71) / 70, 0.5 * l_discount * 10 + 0.5 * l_tax * 12)) AS m FROM lineitem GROUP BY 1 ORDER BY round(m, 9) DESC, g DESC LIMIT 5) SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT g FROM g)
""")
def _(t: Tables):
    x = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12).alias("e"), ((F.col("l_orderkey") % 71) / 70).alias("g"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 29 / 28).alias("h"))
    pct = {k: v for k, v in PCT.items() if k in ("range", "gradient", "patchiness", "background")}
    return quality.top_groups(x.withColumn("s", F.round(quality.target_strength(pct), 9)), "l_suppkey", "s", 5).select("l_suppkey", "l_orderkey", "l_linenumber")
