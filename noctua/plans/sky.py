"""Queries of planning, pixels, grids and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noctua.operators import lnc, logs, planning, tiles
from noctua.plans.base import Tables, query, r, rounded
from noctua.sources.files import event_log
from noctua.streaming import telemetry

# --- planning -------------------------------------------------------------------------------------------------------------

ISLANDS = """
f AS (SELECT user_id, event_id, ts, value, value > 50 AS ok, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
i AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
"""


@query("w9_eligibility_windows", f"WITH {ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS slot, epoch_us(min(ts)) AS slot_start, epoch_us(max(ts)) AS slot_end, count(*) AS steps FROM i WHERE ok GROUP BY 1, 2")
def _(t: Tables):
    x = planning.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("value") > 50)
    return x.groupBy("user_id", F.col("island").alias("slot")).agg(F.unix_micros(F.min("ts")).alias("slot_start"), F.unix_micros(F.max("ts")).alias("slot_end"), F.count("*").alias("steps"))


@query("w9_time_grid", """
WITH g AS (SELECT o_orderkey, unnest(generate_series(o_orderdate - INTERVAL 60 MINUTE, o_orderdate + INTERVAL 120 MINUTE, INTERVAL 30 MINUTE)) AS t FROM orders) SELECT o_orderkey, epoch_us(t) AS t FROM g
""")
def _(t: Tables):
    x = t.orders.withColumn("end", F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(1)))
    return planning.time_grid(x, "o_orderdate", "end", 30).select("o_orderkey", F.unix_micros("t").alias("t"))


@query("w10_moonless_run", """
WITH e AS (SELECT user_id, ts, value - 50 AS alt, max(ts) OVER (PARTITION BY user_id) AS last FROM (SELECT user_id, ts, min(value) AS value FROM events GROUP BY 1, 2)),
f AS (SELECT *, alt < 0 AS ok, lag(alt < 0) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM e), i AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT user_id, island, epoch_us(min(ts)) AS s, CASE WHEN max(ts) = any_value(last) THEN epoch_us(any_value(last)) + 600000000 ELSE epoch_us(max(ts)) END AS e FROM i WHERE ok GROUP BY 1, 2)
SELECT user_id, s AS run_start, e AS run_end, (e - s) / 1e6 AS seconds FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e - s DESC, s) = 1
""")
def _(t: Tables):
    e = t.events.groupBy("user_id", "ts").agg(F.min("value").alias("value")).withColumn("alt", F.col("value") - 50)
    e = e.withColumn("dawn", F.max("ts").over(Window.partitionBy("user_id")) + F.make_dt_interval(mins=F.lit(10)))
    got = planning.moonless_run(e, ["user_id"], "ts", "alt", "dawn")
    return got.select("user_id", F.unix_micros("run_start").alias("run_start"), F.unix_micros("run_end").alias("run_end"), "seconds")


@query("g43_moonless_total", "WITH x AS (SELECT o_custkey, o_totalprice / 50 AS s FROM orders) SELECT o_custkey, count(*) AS nights, round(sum(s), 4) AS seconds FROM x WHERE s >= 3600 GROUP BY 1")
def _(t: Tables):
    return rounded(planning.moonless_total(t.orders.select("o_custkey", (F.col("o_totalprice") / 50).alias("seconds")), ["o_custkey"]), 4)


@query("g42_visible_hours", "SELECT user_id, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END)::DOUBLE * 8.5, 6) AS visible_hours FROM events GROUP BY 1")
def _(t: Tables):
    return rounded(planning.visible_hours(t.events.withColumn("hours", F.lit(8.5)), ["user_id"], "value", 30, "hours"))


@query("w11_rising_day", """
WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2), x AS (SELECT *, lag(a) OVER (PARTITION BY l_suppkey ORDER BY day) AS p FROM d),
f AS (SELECT l_suppkey, min(day) FILTER (p < 25 AND a >= 25) AS first, arg_min(day, (-a, day)) AS best FROM x GROUP BY 1) SELECT l_suppkey, coalesce(first, best) AS day, first IS NOT NULL AS rises FROM f
""")
def _(t: Tables):
    d = t.lineitem.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_quantity").alias("a"))
    return planning.rising_day(d, ["l_suppkey"], "day", "a", 25)


@query("o5_pick_next", """
WITH s AS (SELECT o_custkey AS k, epoch_us(min(o_orderdate)) AS slot_end FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' GROUP BY 1)
SELECT c_custkey, slot_end FROM customer JOIN s ON s.k = c_custkey WHERE c_acctbal > 0 ORDER BY slot_end, c_nationkey DESC, c_acctbal DESC, c_custkey LIMIT 1
""")
def _(t: Tables):
    ses = t.customer.select("c_custkey", F.col("c_acctbal").alias("remaining"), F.lit(False).alias("complete"), F.col("c_nationkey").alias("priority"))
    slots = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("slot_start"), F.col("o_orderdate").alias("slot_end"))
    return planning.pick_next(ses, slots, "c_custkey", F.to_timestamp(F.lit("1996-06-01"))).select("c_custkey", F.unix_micros("slot_end").alias("slot_end"))


DAYS = "(epoch_us(ts) / 86400e6 - 10957.5)"


@query("p27_sun_moon_context", f"""
WITH d AS (SELECT event_id, {DAYS} AS d FROM events), m AS (SELECT event_id, d, d / 36525 AS c, radians(357.528 + 0.9856003 * d) AS g FROM d),
e AS (SELECT event_id, radians(280.460 + 0.9856474 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS sl,
  radians(218.32 + 481267.881 * c + 6.29 * sin(radians(135.0 + 477198.87 * c)) - 1.27 * sin(radians(259.3 - 413335.36 * c)) + 0.66 * sin(radians(235.7 + 890534.22 * c)) + 0.21 * sin(radians(269.9 + 954397.74 * c)) - 0.19 * sin(radians(357.5 + 35999.05 * c)) - 0.11 * sin(radians(186.5 + 966404.03 * c))) AS ml,
  radians(5.13 * sin(radians(93.3 + 483202.02 * c)) + 0.28 * sin(radians(228.2 + 960400.89 * c)) - 0.28 * sin(radians(318.3 + 6003.15 * c)) - 0.17 * sin(radians(217.6 - 407332.21 * c))) AS mb FROM m)
SELECT event_id, round(50 * (1 - cos(acos(cos(mb) * cos(ml - sl)))), 4) AS illumination FROM e
""")
def _(t: Tables):
    return t.events.select("event_id", r(planning.moon_illumination(F.col("ts")), 4).alias("illumination"))


@query("p27_object_altitude", f"""
WITH d AS (SELECT event_id, radians(((280.46061837 + 360.98564736629 * {DAYS} - 99.4) % 360 + 360) % 360 - (user_id % 360)) AS h, radians(value - 50) AS dec FROM events)
SELECT event_id, round(degrees(asin(sin(radians(31.5)) * sin(dec) + cos(radians(31.5)) * cos(dec) * cos(h))), 4) AS altitude FROM d
""")
def _(t: Tables):
    return t.events.select("event_id", r(planning.altitude((F.col("user_id") % 360).cast("double"), F.col("value") - 50, F.col("ts"), F.lit(31.5), F.lit(-99.4)), 4).alias("altitude"))


# --- pixels: embeddings as frames of 8 x 8 -------------------------------------------------------------------------------------

PX = "px AS (SELECT label, vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


def _px(t: Tables):
    frames = t.embeddings.select("label", "vec_id", F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.lit(8).alias("w"), F.col("embedding").alias("px"))
    return tiles.pixels(frames, ["label", "vec_id"])


def _tiles(t: Tables):
    """Each vector as four tiles of 4 x 4 pixels."""
    p = _px(t)
    k = F.floor(F.col("y") / 4).cast("int").alias("ty"), F.floor(F.col("x") / 4).cast("int").alias("tx")
    g = p.groupBy(F.col("vec_id").cast("string").alias("frame_id"), *k).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("float")).alias("px"))
    return g.select("frame_id", "ty", "tx", (F.col("ty") * 4).alias("y0"), (F.col("tx") * 4).alias("x0"), F.lit(4).alias("h"), F.lit(4).alias("w"), "px")


@query("g19_region_statistics", f"""
WITH {PX}, b AS (SELECT * FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6), m AS (SELECT vec_id, median(v) AS m FROM b GROUP BY 1)
SELECT CAST(vec_id AS VARCHAR) AS frame_id, count(*) AS n, round(avg(v), 6) AS mean, round(any_value(m), 6) AS median, round(stddev_pop(v), 6) AS sigma, round(min(v), 6) AS min, round(max(v), 6) AS max, round(1.4826 * median(abs(v - m)), 6) AS noise FROM b JOIN m USING (vec_id) GROUP BY vec_id
""")
def _(t: Tables):
    return rounded(tiles.region_statistics(_tiles(t), 1, 2, 6, 7))


@query("g20_tile_background", f"""
WITH {PX}, q AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY 1, 2, 3)
SELECT CAST(px.vec_id AS VARCHAR) AS frame_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(median(v), 6) AS background FROM px JOIN q ON q.vec_id = px.vec_id AND ty = y // 4 AND tx = x // 4 WHERE v BETWEEN lo AND hi GROUP BY 1, 2, 3
""")
def _(t: Tables):
    return rounded(tiles.tile_background(_tiles(t), least=8))


@query("g22_illumination_metrics", f"""
WITH {PX}, b AS (SELECT vec_id, y, x, v + 2 AS v FROM px), s AS (SELECT vec_id, median(v) AS med, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS rg FROM b GROUP BY 1),
qd AS (SELECT vec_id, CASE WHEN y < 4 THEN 0 ELSE 2 END + CASE WHEN x < 4 THEN 0 ELSE 1 END AS q, median(v) AS m FROM b GROUP BY 1, 2), qs AS (SELECT vec_id, max(m) - min(m) AS qr FROM qd GROUP BY 1)
SELECT CAST(b.vec_id AS VARCHAR) AS frame_id, round(any_value(med), 6) AS median, round(any_value(rg / med), 6) AS range_frac, round(median(abs(v - med)) / any_value(med), 6) AS mad_frac, round(any_value(qr / med), 6) AS quadrant_frac, 1.0::DOUBLE AS valid_fraction FROM b JOIN s USING (vec_id) JOIN qs USING (vec_id) GROUP BY b.vec_id
""")
def _(t: Tables):
    bg = _px(t).select(F.col("vec_id").cast("string").alias("frame_id"), F.col("y").alias("ty"), F.col("x").alias("tx"), (F.col("v") + 2).alias("background"))
    return rounded(tiles.illumination_metrics(bg, 8, 8).select("frame_id", "median", "range_frac", "mad_frac", "quadrant_frac", "valid_fraction"))


@query("g23_flatness", f"""
WITH {PX}, m AS (SELECT label, (y * 4) // 8 AS ay, (x * 4) // 8 AS ax, median(v) AS m FROM px GROUP BY 1, 2, 3), s AS (SELECT label, median(m) AS med FROM m GROUP BY 1)
SELECT label, round(any_value(med), 6) AS median, round(quantile_cont(m, 0.05), 6) AS p05, round(quantile_cont(m, 0.95), 6) AS p95, round(max(m) - min(m), 6) AS range, round(median(abs(m - med)), 6) AS mad FROM m JOIN s USING (label) GROUP BY label
""")
def _(t: Tables):
    return rounded(tiles.flatness(_px(t), ["label"], 8, 8, 4))


@query("g18_snr", "SELECT vec_id, round(CASE WHEN s = 0 THEN 0 ELSE (m - 0.01) / s END, 6) AS snr FROM (SELECT vec_id, list_avg(embedding) AS m, list_stddev_pop(embedding) AS s FROM embeddings)")
def _(t: Tables):
    x = _px(t).groupBy("vec_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).withColumn("b", F.lit(0.01))
    return rounded(logs.snr(x, "m", "b", "s").select("vec_id", "snr"))


@query("g33_rejection_stack", f"""
WITH {PX}, p AS (SELECT * FROM px WHERE v > 0), m AS (SELECT label, y, x, median(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM p GROUP BY 1, 2, 3),
k AS (SELECT label, y, x, avg(v) FILTER (v > m - 1.5 * s AND v < m + 1.5 * s) AS value, count(*) FILTER (v > m - 1.5 * s AND v < m + 1.5 * s) AS kept, count(*) FILTER (NOT (v > m - 1.5 * s AND v < m + 1.5 * s)) AS rejected FROM p JOIN m USING (label, y, x) GROUP BY 1, 2, 3)
SELECT label, y, x, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS value, kept, rejected FROM k WINDOW w AS (PARTITION BY label)
""")
def _(t: Tables):
    return rounded(tiles.stretched_range(tiles.rejection_stack(_px(t), ["label", "y", "x"], low=1.5, high=1.5), ["label"]))


@query("g34_winsorized_weighted_stack", f"""
WITH {PX}, p AS (SELECT *, 1.0 + vec_id % 3 AS w FROM px WHERE v > 0), m AS (SELECT label, y, x, median(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM p GROUP BY 1, 2, 3)
SELECT label, y, x, round(sum(w * least(greatest(v, m - 2 * s), m + 2 * s)) / sum(w), 6) AS value, count(*) AS kept, 0::BIGINT AS rejected FROM p JOIN m USING (label, y, x) GROUP BY 1, 2, 3
""")
def _(t: Tables):
    x = _px(t).withColumn("wt", 1.0 + F.col("vec_id") % 3)
    return rounded(tiles.rejection_stack(x, ["label", "y", "x"], low=2, high=2, weight="wt", winsorize=True))


@query("g34_frame_normalization", f"""
WITH {PX}, p AS (SELECT vec_id, v + 1 AS v FROM px), m AS (SELECT vec_id, median(v) AS m FROM p GROUP BY 1), d AS (SELECT vec_id, any_value(m) AS m, median(abs(v - m)) AS d FROM p JOIN m USING (vec_id) GROUP BY 1), z AS (SELECT m AS rm, d AS rd FROM d WHERE vec_id = 0)
SELECT vec_id, round(rd / d, 6) AS scale, round(rm - rd / d * m, 6) AS "offset" FROM d, z
""")
def _(t: Tables):
    return rounded(tiles.frame_normalization(_px(t).withColumn("v", F.col("v") + 1), "vec_id", 0, mode="addscale"))


@query("g35_mean_stack", f"WITH {PX} SELECT label, y, x, round(avg(v), 6) AS value, count(*) AS n FROM px GROUP BY 1, 2, 3")
def _(t: Tables):
    return rounded(tiles.mean_stack(_px(t), ["label", "y", "x"]))


@query("g36_exposure_fusion", f"WITH {PX}, p AS (SELECT label, y, x, v + 1 AS raw, 1.0 + vec_id % 4 AS t, CASE WHEN abs(v) < 0.2 THEN 1 ELSE 0.5 END AS mask FROM px), w AS (SELECT *, mask / (raw / (t * t) + 0.3 * 0.3 / (t * t)) AS w FROM p) SELECT label, y, x, round(sum(w * raw / t) / sum(w), 6) AS value FROM w GROUP BY 1, 2, 3")
def _(t: Tables):
    x = _px(t).withColumn("t", 1.0 + F.col("vec_id") % 4)
    x = x.withColumn("mask", F.when(F.abs("v") < 0.2, 1.0).otherwise(0.5)).withColumn("v", F.col("v") + 1)
    return rounded(tiles.exposure_fusion(x, ["label", "y", "x"], "v", "t", F.col("mask"), 0.3))


@query("g37_calibration", "SELECT CAST(e.vec_id AS VARCHAR) AS frame_id, round(list_sum(list_transform(list_zip(e.embedding, d.embedding, f.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) / ((2 + CAST(z[3] AS DOUBLE)) / m))), 3) AS total FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) d, (SELECT embedding, 2 + list_median(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings WHERE vec_id = 2) f")
def _(t: Tables):
    x = t.embeddings.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(0).alias("ty"), F.lit(0).alias("tx"), F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    dark, flat = x.where("frame_id = '1'"), x.where("frame_id = '2'").withColumn("px", F.transform("px", lambda v: v + 2))
    return tiles.calibrate(x, dark, flat).select("frame_id", r(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("g38_masters", f"WITH {PX} SELECT label % 3 AS gain, y, x, round(avg(v), 6) AS value, count(*) AS n FROM px GROUP BY 1, 2, 3")
def _(t: Tables):
    return rounded(tiles.mean_stack(_px(t).withColumn("gain", F.col("label") % 3), ["gain", "y", "x"]))


@query("g39_sensor_gain", f"""
WITH {PX}, f AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM px), p AS (SELECT label, n // 2 AS pair, y, x, max(v) FILTER (n % 2 = 0) AS a, max(v) FILTER (n % 2 = 1) AS b FROM f GROUP BY 1, 2, 3, 4),
g AS (SELECT label, pair, avg((a + b) / 2) AS signal, var_samp(a - b) / 2 AS variance FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)
SELECT label, round(1 / regr_slope(variance, signal), 4) AS gain, count(*) AS n FROM g GROUP BY 1
""")
def _(t: Tables):
    return rounded(tiles.sensor_gain(tiles.flat_pairs(_px(t), ["label"], "vec_id", ["y", "x"], "v"), ["label"]).select("label", "gain", "n"), 4)


@query("g40_mask_shares", f"""
WITH {PX}, d AS (SELECT a.v - b.v AS d FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.y = a.y AND b.x = a.x WHERE a.vec_id % 2 = 0)
SELECT round(avg(CASE WHEN d > 0.2 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS hot_share, round(avg(CASE WHEN d < -0.2 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS cold_share, round(avg(d) FILTER (d BETWEEN -0.2 AND 0.2), 6) AS mean, round(stddev_samp(d) FILTER (d BETWEEN -0.2 AND 0.2), 6) AS std FROM d
""")
def _(t: Tables):
    p = _px(t)
    a, b = p.where("vec_id % 2 = 0"), p.withColumn("vec_id", F.col("vec_id") - 1).where("vec_id % 2 = 0")
    return rounded(tiles.mask_shares(a, b, ["vec_id", "y", "x"], 0.2, -0.2))


@query("g41_channel_medians", f"WITH {PX} SELECT vec_id, y % 3 AS channel, round(median(v) FILTER (v > 0), 6) AS median FROM px GROUP BY 1, 2")
def _(t: Tables):
    return rounded(tiles.channel_medians(_px(t).withColumn("channel", F.col("y") % 3), ["vec_id", "channel"]))


@query("w12_prefix_stacks", """
WITH k AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), z AS (SELECT unnest([2, 4, 8, 16, 32, 64, 128]) AS size)
SELECT DISTINCT s_nationkey, s_suppkey, CAST(size AS INTEGER) AS stack_size FROM (SELECT s_nationkey, s_suppkey, size FROM k, z WHERE size <= n AND k <= size UNION ALL SELECT s_nationkey, s_suppkey, n FROM k WHERE n >= 2)
""")
def _(t: Tables):
    return tiles.prefix_stacks(t.supplier.select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"])


@query("w13_moving_stacks", """
WITH k AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, s_suppkey, CAST(unnest(generate_series(greatest(1, k - 2), least(k, n - 2))) AS INTEGER) AS stack FROM k WHERE least(k, n - 2) >= greatest(1, k - 2)
""")
def _(t: Tables):
    return tiles.moving_stacks(t.supplier.select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"], 3).withColumn("stack", F.col("stack").cast("int"))


# --- grids --------------------------------------------------------------------------------------------------------------------

NODES = "n AS (SELECT CAST(label AS VARCHAR) AS pair_id, CAST((i - 1) // 8 AS INTEGER) AS gy, CAST((i - 1) % 8 AS INTEGER) AS gx, 1 + CAST(embedding[i] AS DOUBLE) AS s, vec_id FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


@query("l4_grid_nodes", """
SELECT p_partkey, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, CAST(gy * 16 AS INTEGER) AS y, CAST(gx * 16 AS INTEGER) AS x
FROM (SELECT p_partkey, p_size, gy, unnest(generate_series(0, (p_size * 3 - 1) // 16)) AS gx FROM (SELECT p_partkey, p_size, unnest(generate_series(0, (p_size * 2 - 1) // 16)) AS gy FROM part))
""")
def _(t: Tables):
    x = t.part.select("p_partkey", (F.col("p_size") * 3).alias("w"), (F.col("p_size") * 2).alias("h"))
    return lnc.grid_nodes(x, "w", "h", 16).select("p_partkey", "gy", "gx", "y", "x")


@query("l2_l1_transforms", """
SELECT l_orderkey, l_linenumber, round((1.0 * x + 0.1 * y + 5) / (0.001 * x + 1), 6) AS tx, round((-0.1 * x + 1.1 * y - 3) / (0.001 * x + 1), 6) AS ty FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y FROM lineitem)
""")
def _(t: Tables):
    m = F.array(*[F.lit(v) for v in (1.0, 0.1, 5.0, -0.1, 1.1, -3.0, 0.001, 0.0, 1.0)])
    x, y = lnc.apply_transform(F.col("m"), F.col("l_quantity"), F.col("l_discount") * 100)
    return t.lineitem.withColumn("m", m).select("l_orderkey", "l_linenumber", r(x).alias("tx"), r(y).alias("ty"))


@query("l3_reference_choice", "SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'O'), min(o_orderkey)) AS reference_index FROM orders WHERE o_totalprice > 20000 GROUP BY 1")
def _(t: Tables):
    return lnc.choose_reference(t.orders, ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 20000, F.col("o_orderstatus") == "O")


@query("l9_validity", """
WITH g AS (SELECT CAST(vec_id AS VARCHAR) AS pair_id, unnest(embedding)::DOUBLE AS s FROM embeddings)
SELECT pair_id, count(*) AS nodes, count(*) FILTER (s > 0) AS valid_nodes, round(min(s) FILTER (s > 0), 6) AS min_scale, round(max(s) FILTER (s > 0), 6) AS max_scale, round(count(*) FILTER (s > 0) / count(*), 6) AS valid_fraction, count(*) FILTER (s > 0) / count(*) >= 0.5 AS passes FROM g GROUP BY 1
""")
def _(t: Tables):
    g = t.embeddings.select(F.col("vec_id").cast("string").alias("pair_id"), F.explode("embedding").alias("scale")).withColumn("scale", F.col("scale").cast("double")).withColumn("offset", F.lit(0.0)).withColumn("valid", F.col("scale") > 0)
    return rounded(lnc.validity(g, 0.5).drop("min_offset", "max_offset"))


@query("l13_outstanding_groups", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t: Tables):
    done = t.orders.withColumn("state", F.when(F.col("o_orderstatus") == "F", "master_written"))
    return lnc.outstanding(t.orders.select("o_custkey").distinct(), done, ["o_custkey"])


# --- telemetry ------------------------------------------------------------------------------------------------------------------


@query("t1_sliding_rms", """
SELECT event_id, round(sqrt(avg(value * value) OVER w), 6) AS rms_ra, round(sqrt(avg((value - 50) * (value - 50)) OVER w), 6) AS rms_dec FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
""")
def _(t: Tables):
    e = t.events.withColumn("dec", F.col("value") - 50)
    return rounded(telemetry.sliding_rms(e, ["user_id"], "ts", "value", "dec", 86400).select("event_id", "rms_ra", "rms_dec"))


@query("t1_windowed_rms", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms_ra FROM events GROUP BY 1, 2
""")
def _(t: Tables):
    got = telemetry.windowed_rms(t.events, ["event_type"], "ts", "value", "value", "1 hour", "1 hour")
    return rounded(got.select("event_type", F.unix_micros("start").alias("start"), "n", "rms_ra"))


@query("t2_drift_alerts", f"""
WITH RECURSIVE {ISLANDS}, o AS (SELECT user_id, island, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS n FROM i WHERE ok),
c AS (SELECT user_id, island, n, t, t AS since, false AS hit FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.island, o.n, o.t, CASE WHEN o.t - c.since > 3600000000 THEN o.t ELSE c.since END, o.t - c.since > 3600000000 FROM c JOIN o ON o.user_id = c.user_id AND o.island = c.island AND o.n = c.n + 1)
SELECT user_id, t AS alert_at FROM c WHERE hit
""")
def _(t: Tables):
    return telemetry.drift_alerts(t.events, "user_id", "ts", "value", 50, 3600, "event_id").select("user_id", F.unix_micros("alert_at").alias("alert_at"))


@query("t3_event_alerts", "WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events) SELECT event_id, 'WARNING' AS level FROM events WHERE event_type = 'click'")
def _(t: Tables):
    return telemetry.event_alerts(t.events, "event_type", {"click": "WARNING"}).select("event_id", "level")


@query("t4_throttled_log", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) = 1")
def _(t: Tables):
    return telemetry.throttled(t.events, ["user_id"], "ts", "event_id", 3600).select("event_id")


@query("t4_exact_throttle", """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, t AS given, true AS hit FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - c.given >= 36000000000 THEN o.t ELSE c.given END, o.t - c.given >= 36000000000 FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1)
SELECT event_id FROM c WHERE hit
""")
def _(t: Tables):
    return telemetry.throttled_exactly(t.events, "user_id", "ts", "event_id", 36000).select("event_id")


STATE = "CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN value > 50 THEN 'OPEN' ELSE 'CLOSED' END"


def _states(t: Tables):
    return t.events.withColumn("state", F.when(F.col("event_id") % 5 == 0, "UNKNOWN").when(F.col("value") > 50, "OPEN").otherwise("CLOSED"))


@query("t5_roof_transitions", f"""
WITH s AS (SELECT *, {STATE} AS st FROM events), p AS (SELECT *, last_value(CASE WHEN st <> 'UNKNOWN' THEN st END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT event_id FROM p WHERE b = 'OPEN' AND st = 'CLOSED'
""")
def _(t: Tables):
    return telemetry.transitions(_states(t), "user_id", ["ts", "event_id"], "state").select("event_id")


@query("w16_direct_transitions", f"WITH s AS (SELECT *, {STATE} AS st FROM events), p AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s) SELECT event_id FROM p WHERE b = 'OPEN' AND st = 'CLOSED'")
def _(t: Tables):
    return telemetry.transitions(_states(t), "user_id", ["ts", "event_id"], "state", ignore_unknown=False).select("event_id")


@query("t6_unknown_warnings", """
WITH s AS (SELECT user_id, event_id, ts, value < 60 AS ok, max(CASE WHEN value >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen, lag(value < 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
i AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s), f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, island) AS since FROM i WHERE ok)
SELECT user_id, epoch_us(since) AS since, epoch_us(min(ts)) AS warned_at FROM f WHERE epoch_us(ts) - epoch_us(since) >= 7200000000 AND seen = 1 GROUP BY user_id, island, since
""")
def _(t: Tables):
    e = t.events.withColumn("state", F.when(F.col("value") < 60, "UNKNOWN").otherwise("OPEN"))
    return telemetry.unknown_warnings(e, "user_id", "ts", "event_id", "state", 7200).select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("warned_at").alias("warned_at"))


@query("t7_newest_message", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM l WHERE n <= 5 AND value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1")
def _(t: Tables):
    return telemetry.newest_message(t.events, ["user_id"], "ts", "event_id", 5, F.col("value") > 50).select("user_id", "event_id")


@query("t8_latched_levels", """
WITH x AS (SELECT user_id, min(ts) FILTER (value < 5) AS c, min(ts) FILTER (value < 20) AS w FROM events GROUP BY 1)
SELECT user_id, 'CRITICAL' AS level, epoch_us(c) AS at FROM x WHERE c IS NOT NULL UNION ALL SELECT user_id, 'WARNING', epoch_us(w) FROM x WHERE w IS NOT NULL AND (c IS NULL OR w < c)
""")
def _(t: Tables):
    return telemetry.latched_levels(t.events, "user_id", "ts", "value", 20, 5).withColumn("at", F.unix_micros("at"))


@query("t9_alert_history", "SELECT event_id FROM events WHERE value > 90 ORDER BY ts DESC, event_type, event_id LIMIT 200")
def _(t: Tables):
    a = t.events.where("value > 90").select(F.col("event_type").alias("source"), F.lit("WARNING").alias("level"), F.col("event_id").alias("code"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return telemetry.history(telemetry.alert_stream([a]))[0].select(F.col("code").alias("event_id"))


@query("t11_stable_files", "SELECT user_id, event_type, epoch_us(min(ts) FILTER (epoch_us(ts) - epoch_us(f) >= 3600000000)) AS ready_at FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS f FROM events) GROUP BY 1, 2 HAVING ready_at IS NOT NULL")
def _(t: Tables):
    x = t.events.withColumn("one", F.lit(1))
    return telemetry.stable_files(x, "user_id", "event_type", "one", "ts", 3600).select("user_id", "event_type", F.unix_micros("ready_at").alias("ready_at"))


@query("t13_status_snapshot", "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{k}') AS \"{k}\"" for k in ("click", "view", "purchase")) + " FROM events GROUP BY 1")
def _(t: Tables):
    return telemetry.snapshot(t.events, "user_id", "event_type", "ts", "event_id", "value", ["click", "view", "purchase"])


@query("t14_stale_status", """
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events), l AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS last_good, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS at_ FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, last_good, coalesce((epoch_us(ts) - epoch_us(at_)) / 1e6 > 7200, true) AS stale FROM l
""")
def _(t: Tables):
    e = t.events.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return telemetry.with_stale(e, "user_id", ["ts", "event_id"], "ts", "v", 7200).select("event_id", "last_good", "stale")


@query("t15_failure_limits", f"WITH {ISLANDS} SELECT event_id FROM i WHERE ok QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) = 3")
def _(t: Tables):
    return telemetry.failure_limits(t.events, "user_id", ["ts", "event_id"], F.col("value") > 50, 3).select("event_id")


@query("s17_event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(t: Tables):
    line = F.concat(F.lit('{"event": "'), F.col("event_id").cast("string"), F.lit('", "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    got = event_log(t.events.select(line.alias("value")))
    return got.select(F.col("event").cast("long").alias("event_id"), F.try_variant_get("data", "$.props.k", "bigint").alias("k")).where("k is not null")
