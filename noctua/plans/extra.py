"""Queries of headers, texts and states that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators import lnc, quality, sessions, tiles
from noctua.plans import statistics  # noqa: F401  whose SQL is used here
from noctua.plans.base import ORACLE_SQL, Tables, query, r, rounded
from noctua.plans.sky import NODES, PX, _px, _tiles


@query("p1_p2_header_values", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END AS object, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 7.5 END AS exptime FROM part")
def _(t: Tables):
    k = F.col("p_partkey")
    hdr = F.map_from_arrays(F.array(F.when(k % 3 == 0, "OBJECT").when(k % 3 == 1, "Ob-Ject").otherwise("x"), F.when(k % 2 == 0, "Exposure").otherwise("y")), F.array(F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.col("p_retailprice").cast("string")))
    return t.part.withColumn("hdr", hdr).select("p_partkey", S.header_value(F.col("hdr"), "OBJECT").alias("object"), S.first_number(F.col("hdr"), "EXPTIME", "EXPOSURE", default=7.5).alias("exptime"))


@query("p25_value_scale", "SELECT label, quantile_cont(v, 0.999) <= 1.5 AND median(v) <= 1 AND min(v) >= -0.25 AS normalized FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def _(t: Tables):
    s = _px(t).groupBy("label").agg(F.percentile("v", 0.999).alias("p"), F.median("v").alias("m"), F.min("v").alias("lo"))
    return s.select("label", S.is_normalized(F.col("p"), F.col("m"), F.col("lo")).alias("normalized"))


@query("p28_illumination", "SELECT event_id, round(50 * (1 - cos(radians(value))), 6) AS percent FROM events")
def _(t: Tables):
    return t.events.select("event_id", r(S.illumination(F.radians("value"))).alias("percent"))


@query("p29_message_text", "SELECT conv_id, turn, trim(concat_ws(chr(10), nullif(role, ''), 'T', CASE WHEN turn % 2 = 0 THEN 'n' END, CASE WHEN turn % 2 = 0 THEN 'v' END, 'me')) AS text FROM conversations")
def _(t: Tables):
    field = F.struct(F.lit("n").alias("name"), F.lit("v").alias("value"))
    fields = F.when(F.col("turn") % 2 == 0, F.array(field))
    embed = F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("description"), fields.alias("fields"), F.lit("").alias("footer"), F.lit("me").alias("author"))
    return t.conversations.withColumn("embeds", F.array(embed)).select("conv_id", "turn", S.message_text(F.col("role"), F.col("embeds")).alias("text"))


@query("p32_hours_to_flip", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linestatus = 'F' THEN 12 + 0.25 - ha ELSE greatest(0, 0.25 - ha) END, 6) AS hours FROM (SELECT *, CASE WHEN h > 12 THEN h - 24 ELSE h END AS ha FROM (SELECT *, l_linenumber * 3.3 - l_quantity / 2.1 AS h FROM lineitem))")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", r(S.hours_to_flip(F.col("l_quantity") / 2.1, F.col("l_linenumber") * 3.3, F.col("l_linestatus") == "F", 0.25)).alias("hours"))


@query("p38_unquoted_values", "SELECT c_custkey, c_name || '''s' AS name FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", S.unquote(F.concat(F.lit(" '"), "c_name", F.lit("''s' "))).alias("name"))


@query("p39_dark_fields", "SELECT p_partkey, p_size AS mode, 56 AS gain, CAST(-1 * p_size AS INTEGER) AS temp FROM part")
def _(t: Tables):
    size = F.col("p_size").cast("string")
    f = S.dark_fields(F.concat(F.lit("Master_Dark_MODE"), size, F.lit("_GAIN56_OFFSET20_EXPTIME480_TEMP-"), size, F.lit(".fit")))
    return t.part.select("p_partkey", *[f[k].alias(k) for k in ("mode", "gain", "temp")])


@query("p41_primary_role", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'reference_rank_2' WHEN p_partkey % 4 = 1 THEN 'score_p10' ELSE 'other' END AS role FROM part")
def _(t: Tables):
    first = F.when(F.col("p_partkey") % 4 == 0, "reference_rank_2").when(F.col("p_partkey") % 4 == 1, "score_p10").otherwise("zzz")
    return t.part.select("p_partkey", S.primary_role(F.array(F.lit("other"), first)).alias("role"))


@query("u4_kept_frames", f"SELECT event_type, event_id, sequence_index FROM ({ORACLE_SQL['w5_drop_policy']}) WHERE drop_status IN ('reference', 'kept')")
def _(t: Tables):
    status = quality.drop_policy(t.events.withColumn("score", -F.col("value")), ["event_type"], "score", "event_id")
    return quality.kept_frames(status).select("event_type", "event_id", F.col("sequence_index").cast("long").alias("sequence_index"))


@query("t10_log_tail", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query("s13_region_texts", "SELECT event_id, round(value, 3) AS mean, 0.25::DOUBLE AS bgnoise FROM events WHERE event_id % 2 = 0")
def _(t: Tables):
    from noctua.sources.files import region_texts

    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Mean: "), F.format_string("%.3f", "value"), F.lit(", Sigma: 1.5, bgnoise: 2.5e-1"))).otherwise("nothing")
    return region_texts(t.events.select("event_id", text.alias("value"))).select("event_id", r("mean", 3).alias("mean"), "bgnoise")


@query("g32_patch_medians", """
WITH s AS (SELECT label AS p, vec_id % 2 AS gy, CAST((i - 1) // 8 AS INTEGER) // 4 AS y, CAST((i - 1) % 8 AS INTEGER) // 4 AS x, vec_id, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
m AS (SELECT p, gy, y, x, median(v) AS ref, median(v * 2 + 1) AS target FROM s GROUP BY 1, 2, 3, 4), c AS (SELECT p, gy, median(ref) AS mr, median(target) AS mt, count(*) AS n FROM m GROUP BY 1, 2),
d AS (SELECT p, gy, median(abs(ref - mr)) AS sr, median(abs(target - mt)) AS st FROM m JOIN c USING (p, gy) GROUP BY 1, 2)
SELECT CAST(p AS VARCHAR) AS pair_id, CAST(gy AS INTEGER) AS gy, round(sum(ref), 6) AS ref, round(count(*) / any_value(n), 6) AS accepted FROM m JOIN c USING (p, gy) JOIN d USING (p, gy) WHERE ref <= mr + sr AND target <= mt + st GROUP BY p, gy
""")
def _(t: Tables):
    s = _px(t).select(F.col("label").cast("string").alias("pair_id"), (F.col("vec_id") % 2).cast("int").alias("gy"), F.lit(0).alias("gx"), "y", "x", F.col("v").alias("ref"), (F.col("v") * 2 + 1).alias("target"))
    return lnc.patch_medians(s, 4, 1.0).groupBy("pair_id", "gy").agg(r(F.sum("ref")).alias("ref"), r(F.first("accepted")).alias("accepted"))


@query("l11_background_surface", """
WITH b AS (SELECT vec_id, ((i - 1) // 8) / 7.0 AS y, ((i - 1) % 8) / 7.0 AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)) SELECT vec_id, round(sum(1 + x + 2 * y + 3 * x * x + x * y - y * y), 3) AS surface, count(*) AS n FROM b GROUP BY 1
""")
def _(t: Tables):
    x, y = F.col("x") / 7, F.col("y") / 7
    b = _px(t).select("vec_id", x.alias("x"), y.alias("y"), (1 + x + 2 * y + 3 * x * x + x * y - y * y).alias("background"))
    return lnc.subtract_surface(b, ["vec_id"]).groupBy("vec_id").agg(r(F.sum("surface"), 3).alias("surface"), F.count("*").alias("n"))


@query("g24_aperture_photometry", f"""
WITH {PX}, d AS (SELECT vec_id, v, sqrt(pow(y - 3, 2) + pow(x - 4, 2)) AS d FROM px), a AS (SELECT vec_id, median(v) FILTER (d BETWEEN 2 AND 3) AS bg, stddev_samp(v) FILTER (d BETWEEN 2 AND 3) AS sd, sum(v) FILTER (d <= 1) AS s, count(*) FILTER (d <= 1) AS n, max(v) FILTER (d <= 1) AS peak, max(v) FILTER (d <= 1 OR d >= 2) >= 0.25 AS sat FROM d WHERE d <= 3 GROUP BY 1)
SELECT CAST(vec_id AS VARCHAR) AS frame_id, CASE WHEN NOT sat THEN round(s - n * bg, 5) END AS flux, CASE WHEN NOT sat THEN round(bg, 6) END AS background, round(peak, 6) AS peak, CASE WHEN NOT sat THEN round((s - n * bg) / (sd * sqrt(n)), 5) END AS snr, CASE WHEN sat THEN 'saturated' ELSE '' END AS flags FROM a
""")
def _(t: Tables):
    stars = t.embeddings.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(1).alias("star_id"), F.lit(4.0).alias("x"), F.lit(3.0).alias("y"))
    got = tiles.aperture_photometry(_tiles(t), stars, 4, 8, 8, 1.0, 2.0, 3.0, 0.25)
    return got.select("frame_id", r("flux", 5).alias("flux"), r("snr", 5).alias("snr"), r("background").alias("background"), r("peak").alias("peak"), F.array_join("flags", ",").alias("flags"))


@query("g29_flag_totals", f"WITH {PX}, a AS (SELECT vec_id, max(v) AS top FROM (SELECT *, sqrt(pow(y - 3, 2) + pow(x - 4, 2)) AS d FROM px) WHERE d <= 1 OR d BETWEEN 2 AND 3 GROUP BY 1) SELECT 'saturated' AS flag, count(*) AS n FROM a WHERE top >= 0.25")
def _(t: Tables):
    stars = t.embeddings.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(1).alias("star_id"), F.lit(4.0).alias("x"), F.lit(3.0).alias("y"))
    return tiles.flag_totals(tiles.aperture_photometry(_tiles(t), stars, 4, 8, 8, 1.0, 2.0, 3.0, 0.25))


@query("g25_g26_frame_features", f"""
WITH {PX}, f AS (SELECT vec_id, max(m) AS flux FROM (SELECT vec_id, avg(v) - 0.01 AS m FROM px WHERE sqrt(pow(y - 3, 2) + pow(x - 4, 2)) <= 1.5 GROUP BY 1 UNION ALL SELECT vec_id, avg(v) - 0.01 FROM px WHERE sqrt(pow(y - 4, 2) + pow(x - 4, 2)) <= 1.5 GROUP BY 1) GROUP BY 1),
m AS (SELECT vec_id, median(v) AS b FROM px GROUP BY 1) SELECT CAST(vec_id AS VARCHAR) AS frame_id, 1::BIGINT AS star_count, round(flux, 6) AS median_mean_star_flux, round(b, 6) AS background FROM f JOIN m USING (vec_id)
""")
def _(t: Tables):
    stars = t.embeddings.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(1).alias("star_id"), F.lit(4.0).alias("x"), F.lit(3.0).alias("y"), F.lit(1.0).alias("fwhm"), F.lit(0.01).alias("bg"))
    flux = tiles.mean_star_flux(_tiles(t), stars, 4, 8, "bg")
    got = tiles.frame_features(stars.select("frame_id"), tiles.region_statistics(_tiles(t), 0, 0, 8, 8), flux, stars)
    return rounded(got.drop("bgnoise"))


@query("l5_l6_fill_and_smooth", f"""
WITH {NODES}, g AS (SELECT vec_id, gy, gx, s FROM n), w AS (SELECT a.vec_id, a.gy, a.gx, sum(b.s * (4 >> (abs(a.gy - b.gy) + abs(a.gx - b.gx)))) / sum(4 >> (abs(a.gy - b.gy) + abs(a.gx - b.gx))) AS scale FROM g a JOIN g b ON b.vec_id = a.vec_id AND abs(a.gy - b.gy) <= 1 AND abs(a.gx - b.gx) <= 1 GROUP BY 1, 2, 3)
SELECT CAST(vec_id AS VARCHAR) AS pair_id, gy, gx, round(scale, 6) AS scale FROM w
""")
def _(t: Tables):
    p = _px(t)
    g = p.select(F.col("vec_id").cast("string").alias("pair_id"), F.col("y").alias("gy"), F.col("x").alias("gx"), (1 + F.col("v")).alias("scale"), *[F.lit(0.0).alias(c) for c in ("offset", "ref_bg", "target_bg")], F.lit(True).alias("valid"))
    return lnc.fill_and_smooth(g, 1).select("pair_id", "gy", "gx", r("scale").alias("scale"))


@query("l10_run_status", "SELECT p_partkey AS pair_id, CASE WHEN p_size % 4 = 0 THEN 'failed' WHEN p_size > 20 THEN 'corrected' ELSE 'rejected' END AS status FROM part")
def _(t: Tables):
    pairs = t.part.select(F.col("p_partkey").alias("pair_id"))
    checks = t.part.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("pair_id"), F.lit(1).alias("nodes"), (F.col("p_size") > 20).alias("passes"))
    return lnc.run_status(pairs, checks).select("pair_id", "status")


@query("j22_o5_plan_totals_left", "SELECT o_custkey, CAST(sum(greatest(0, 2 - l)) AS BIGINT) AS remaining FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    done = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    work = sessions.remaining(t.orders.withColumn("n", F.lit(2)), done, ["o_orderkey"], "n", "c")
    return work.groupBy("o_custkey").agg(F.sum("remaining").cast("long").alias("remaining"))


@query("x1_registered_metric", "SELECT p_partkey AS id, round(p_retailprice / p_size, 6) AS star_yield FROM part")
def _(t: Tables):
    x = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s"), F.lit(1.0).alias("f"), F.lit(1.0).alias("b"), F.col("p_size").cast("double").alias("n"))
    return rounded(quality.metric_scores(x, "s", "f", "b", "n", ["star_yield"]).select("id", "star_yield"))
