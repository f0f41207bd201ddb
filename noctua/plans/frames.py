"""Queries of frame catalogs: names, gates, sessions, totals, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators import joins, quality, sessions
from noctua.plans.base import Tables, query, r, rounded

# --- scalar functions -------------------------------------------------------------------------------------------------------

KEY = "regexp_replace(upper(trim({x})), '[^A-Z0-9]', '', 'g')"
ALIASES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.FILTER_ALIASES.items()) + ") al(k, v)"
#: Raw filter names derived from rows.
RAW = "list_extract(['Ha', 'H-alpha', ' oiii ', 'SII', 'Lum', 'red', 'Clear 2', '', 'UV/IR cut', 'blue'], 1 + CAST(p_partkey % 10 AS INTEGER))"


def _raw(c="p_partkey"):
    return F.element_at(F.array(*[F.lit(x) for x in ("Ha", "H-alpha", " oiii ", "SII", "Lum", "red", "Clear 2", "", "UV/IR cut", "blue")]), (F.col(c) % 10 + 1).cast("int"))


@query("p3_canonical_filter", f"""
SELECT p_partkey, coalesce(al.v, nullif(regexp_replace(regexp_replace(nullif(trim(x), ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), '')) AS filter
FROM (SELECT p_partkey, {RAW} AS x FROM part) LEFT JOIN {ALIASES} ON al.k = {KEY.format(x="x")}
""")
def _(t: Tables):
    return t.part.select("p_partkey", S.canonical_filter(_raw()).alias("filter"))


@query("p4_filter_from_name", "SELECT page_id, CASE " + " ".join(f"WHEN contains(k, '{h}') THEN '{f}'" for h, f in S.FILE_NAME_HINTS) + " END AS filter, CASE " + " ".join(f"WHEN contains(k, '{h}') THEN '{h}'" for h, _ in S.FILE_NAME_HINTS) + f" ELSE 'NO_MATCH' END AS hint FROM (SELECT page_id, {KEY.format(x=chr(39) + 'x' + chr(39) + ' || url')} AS k FROM (SELECT page_id, replace(replace(list_extract(string_split(url, '/'), -1), '?', '_'), '.', '_') || list_extract(['_lum', '_SII', '', '_red'], 1 + CAST(page_id % 4 AS INTEGER)) AS url FROM pages))")
def _(t: Tables):
    last = F.replace(F.replace(F.element_at(F.split("url", "/"), -1), F.lit("?"), F.lit("_")), F.lit("."), F.lit("_"))
    name = F.concat(F.lit("/d/x"), last, F.element_at(F.array(F.lit("_lum"), F.lit("_SII"), F.lit(""), F.lit("_red")), (F.col("page_id") % 4 + 1).cast("int")), F.lit(".fits"))
    f, h = S.filter_from_name(name)
    return t.pages.select("page_id", f.alias("filter"), h.alias("hint"))


@query("p5_filter_chain", f"""
WITH x AS (SELECT p_partkey, al.v AS own, CASE WHEN p_partkey % 3 = 0 THEN 'R' END AS named, CASE WHEN p_partkey % 2 = 0 THEN 'G' END AS marker FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {RAW} END AS x FROM part WHERE p_partkey % 10 NOT IN (6, 8)) LEFT JOIN {ALIASES} ON al.k = {KEY.format(x="x")})
SELECT p_partkey, coalesce(own, named, marker) AS filter, CASE WHEN own IS NOT NULL THEN 'header' WHEN named IS NOT NULL THEN 'filename' WHEN marker IS NOT NULL THEN 'folder_marker' ELSE 'failed' END AS lookup_status FROM x
""")
def _(t: Tables):
    p = t.part.where(~(F.col("p_partkey") % 10).isin(6, 8))
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.lit("/u/n_red.fits")).otherwise(F.lit("/u/n.fits"))
    f, s = S.filter_chain(F.when(k % 4 == 0, _raw()), path, F.when(k % 2 == 0, F.lit("G")))
    return p.select("p_partkey", f.alias("filter"), s.alias("lookup_status"))


@query("p6_session_filter", "SELECT p_partkey, CASE upper(left(trim(x), 1)) WHEN 'L' THEN 1 WHEN 'R' THEN 2 WHEN 'O' THEN 6 WHEN 'S' THEN 7 ELSE 5 END AS id FROM (SELECT p_partkey, " + RAW + " AS x FROM part)")
def _(t: Tables):
    return t.part.select("p_partkey", S.session_filter_id(_raw(), {"L": 1, "R": 2, "H": 5, "O": 6, "S": 7}).alias("id"))


@query("p7_parse_dates", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS slashed, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS zoned FROM events
""")
def _(t: Tables):
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    text = lambda f: F.date_format(F.col("ts"), f)
    zoned = F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-02:00"))
    return t.events.select("event_id", show(S.parse_date_obs(text("yyyy-MM-dd'T'HH:mm:ss"))).alias("iso"), show(S.parse_date_obs(text("yyyy/MM/dd HH:mm:ss"))).alias("slashed"), show(S.parse_date_obs(zoned)).alias("zoned"))


KIND = "list_extract(['/x/DarkFlat/a', '/LIGHT/flat', '/flats/dark', '/dark', '/bias', '/other'], 1 + CAST({k} % 6 AS INTEGER))"


@query("p8_frame_kind", "SELECT o_orderkey, list_extract(['darkflat', 'light', 'flat', 'dark', 'bias', 'other'], 1 + CAST(o_orderkey % 6 AS INTEGER)) AS kind FROM orders")
def _(t: Tables):
    paths = F.array(*[F.lit(x) for x in ("/x/DarkFlat/a", "/LIGHT/flat", "/flats/dark", "/dark", "/bias", "/other")])
    return t.orders.select("o_orderkey", S.frame_kind(F.element_at(paths, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("kind"))


@query("p9_user_equipment", """
SELECT c_custkey, c_mktsegment AS "user", CASE WHEN c_custkey % 3 = 0 THEN 'default' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'default' ELSE 'rig' END ELSE 'Lum' END AS equipment FROM customer
""")
def _(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tail = F.when(k % 3 == 0, "/a.fits").when(k % 3 == 1, F.when(n % 2 == 0, "/Lum/a.fits").otherwise("/rig/a.fits")).otherwise("/Lum/sub/a.fits")
    u, e = S.user_and_equipment(F.concat("c_mktsegment", tail), F.lit("L"))
    return t.customer.select("c_custkey", u.alias("user"), e.alias("equipment"))


@query("p10_p11_gates", """
SELECT l_orderkey, l_linenumber, (x IS NULL OR x BETWEEN 10 AND 40) AS exposure_ok, coalesce(a <= 0.05, false) AS altitude_ok, (coalesce(a <= 0.05, false) OR coalesce(p <= 0.03, false)) AS either_ok
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 > 0 THEN l_quantity END AS x, CASE WHEN l_partkey % 5 > 0 THEN l_discount END AS a, l_tax AS p FROM lineitem)
""")
def _(t: Tables):
    x, a = F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity")), F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.exposure_gate(x, 10, 40).alias("exposure_ok"), S.moon_gate(a, F.col("l_tax"), 0.05).alias("altitude_ok"), S.moon_gate(a, F.col("l_tax"), 0.05, 0.03).alias("either_ok"))


@query("p12_round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) * 2 AS q FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.round_to(F.col("l_quantity"), 2).alias("q"))


@query("p13_months_ago", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST((1999 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS INTEGER) AS ago FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", S.month_key(F.col("o_orderdate")).alias("month"), S.months_ago(F.col("o_orderdate"), F.to_timestamp(F.lit("1999-01-15"))).cast("int").alias("ago"))


@query("p14_finite", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN value END AS x FROM events")
def _(t: Tables):
    bad = F.element_at(F.array(F.lit("NaN"), F.lit("abc"), F.lit("Infinity"), F.col("value").cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", S.finite(bad).alias("x"))


@query("p15_group_key", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') || '_' || p_size || 'x' || (p_size * 2) AS key FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", S.group_key(F.col("p_name"), F.col("p_size"), F.col("p_size") * 2).alias("key"))


@query("p16_sexagesimal", """
SELECT s_suppkey, round(s_acctbal / 100, 4) AS deg FROM supplier
""")
def _(t: Tables):
    x = F.col("s_acctbal") / 100
    s = F.round(F.abs(x) * 36000).cast("long")  # tenths of seconds
    text = F.concat(F.when(x < 0, "-").otherwise("+"), F.format_string("%02d %02d %.1f", F.floor(s / 36000), F.floor(s % 36000 / 600), s % 600 / 10))
    return t.supplier.select("s_suppkey", r(S.sexagesimal(text), 4).alias("deg"))


@query("p17_pointing_error", "SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_tax / 24 * 360 * 3600, 2) + pow(l_discount * 3600, 2)), 6) AS arcsec FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", r(S.pointing_error(F.col("l_tax"), F.col("l_discount"))).alias("arcsec"))


@query("p18_sanitized_names", """
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS label, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS project FROM pages
""")
def _(t: Tables):
    return t.pages.select("page_id", S.sanitize(F.col("url"), "label").alias("label"), S.sanitize(F.col("url"), "project").alias("project"))


@query("p19_content_names", "SELECT page_id, left(sha1(url), 16) AS short, left(sha256(url), 10) AS other FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", S.content_name(F.col("url")).alias("short"), S.content_name(F.col("url"), method="sha256", digits=10).alias("other"))


@query("p26_clip_unit", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: least(greatest(CAST(x AS DOUBLE) / 0.25, 0), 1))), 4) AS total FROM embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", "label", r(F.aggregate(S.clip_unit(F.col("embedding"), 0.25), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("p30_roof_state", "SELECT conv_id, turn, 'UNKNOWN' AS state, false AS is_roof FROM conversations WHERE turn % 4 = 0 UNION ALL SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'OPEN' WHEN 2 THEN 'CLOSED' ELSE 'UNKNOWN' END, turn % 4 < 3 FROM conversations WHERE turn % 4 > 0")
def _(t: Tables):
    text = F.element_at(F.array(F.lit("open sky"), F.lit("The ROOF is opening, was closed"), F.lit("Roof closed"), F.lit("roof stuck")), (F.col("turn") % 4 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", S.roof_state(text).alias("state"), S.is_roof_text(text).alias("is_roof"))


@query("p31_site_state", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ROOF_UNKNOWN' WHEN user_id % 3 = 0 THEN 'ROOF_UNSAFE' WHEN event_id % 4 = 0 THEN 'WEATHER_UNAVAILABLE' ELSE 'SAFE' END AS state, CASE WHEN value >= 10 AND event_id % 4 <> 0 THEN round(value, 6) END AS humidity FROM events
""")
def _(t: Tables):
    states = F.array(F.struct(F.when(F.col("event_id") % 4 == 0, "Pressure").otherwise("HUMIDITY").alias("Name"), F.when(F.col("value") >= 10, F.col("value")).alias("Value")))
    w = S.weather_values(states)
    return t.events.select("event_id", S.site_state(F.col("event_id") % 5 != 0, F.col("user_id") % 3 != 0, S.condition_count(states)).alias("state"), r(w["humidity"]).alias("humidity"))


@query("p33_refocus_due", """
WITH x AS (SELECT event_id, ts - lag(ts) OVER w AS age, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, age IS NULL OR epoch_us(age) / 1e6 > 86400 OR abs(d) >= 30 AS due FROM x
""".replace("epoch_us(age)", "epoch_us(age)"))
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    age = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    return t.events.withColumn("age", age).withColumn("d", F.col("value") - F.lag("value").over(w)).select("event_id", S.refocus_due(F.col("age"), F.col("d"), 86400, 30).alias("due"))


@query("p34_focus_position", "SELECT l_orderkey, l_linenumber, CAST(trunc(-12.5 * l_quantity + 100 * l_tax) AS INTEGER) AS position FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.focus_position(F.lit(-12.5), F.col("l_quantity"), 100 * F.col("l_tax")).alias("position"))


@query("p35_chromaticity", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12 AS b FROM lineitem), x AS (SELECT *, 0.4124*r + 0.3576*g + 0.1805*b AS bx, 0.2126*r + 0.7152*g + 0.0722*b AS bY2, 0.0193*r + 0.1192*g + 0.9505*b AS bz FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN round(bY2, 9) BETWEEN 0.2 AND 0.99 THEN round(bx / (bx + bY2 + bz), 6) END AS x FROM x
""")
def _(t: Tables):
    x, _y, big = S.chromaticity(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12)
    return t.lineitem.select("l_orderkey", "l_linenumber", r(F.when(F.round(big, 9).between(0.2, 0.99), x)).alias("x"))


@query("p26_uint16", "SELECT vec_id, CAST(list_sum(px) AS BIGINT) AS total, list_max(px) AS most FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(least(greatest(CAST(x AS DOUBLE), 0), 1) * 65535, 0) AS INTEGER)) AS px FROM embeddings)")
def _(t: Tables):
    px = S.to_uint16(F.transform("embedding", lambda v: v.cast("double")))
    return t.embeddings.select("vec_id", px.alias("px")).select("vec_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("px").alias("most"))


@query("p36_stretch_and_mask", """
WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round(ln(1 + 1000 * (value - lo)) / ln(1 + 1000 * (hi - lo)), 6) AS stretched, round(greatest(0, least(1, ((value - lo) / (hi - lo)) / 0.01, (1 - (value - lo) / (hi - lo)) / 0.1)), 6) AS mask FROM events, m
""")
def _(t: Tables):
    m = t.events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    x = t.events.crossJoin(F.broadcast(m))
    return x.select("event_id", r(S.log_stretch(F.col("value"), F.col("lo"), F.col("hi"))).alias("stretched"), r(S.clip_mask((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("mask"))


@query("p37_burst_sets", "WITH e AS (SELECT 100 + (max(o_orderkey) - 99) // 21 * 21 AS past FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey >= 100 AND o_orderkey < past THEN (o_orderkey - 100) // 21 END AS burst, CAST(CASE WHEN o_orderkey >= 100 AND o_orderkey < past THEN (o_orderkey - 100) % 21 END AS INTEGER) AS place FROM orders, e")
def _(t: Tables):
    s, p = S.burst_set(F.concat(F.lit("/l/IMG_"), F.col("o_orderkey").cast("string"), F.lit(".fit")), 100, F.col("last"))
    last = t.orders.agg(F.max("o_orderkey").alias("last"))  # one row
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", s.alias("burst"), p.alias("place"))


@query("p40_time_texts", "SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d', CAST(s // 3600 AS INTEGER), CAST((s % 3600) // 60 AS INTEGER), CAST(s % 60 AS INTEGER)) AS hms FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS s FROM lineitem)")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.hms(F.col("l_extendedprice")).alias("hms"))


@query("p42_plan_violations", """
WITH p AS (SELECT p_partkey, p_name, p_brand || p_type || p_size AS safe, p_retailprice - 905 AS exposure, p_size - 1 AS frames, p_partkey % 9 AS dither FROM part)
SELECT p_name AS identity, 'duplicate_identity' AS rule FROM p QUALIFY count(*) OVER (PARTITION BY p_name) > 1 UNION ALL SELECT p_name, 'duplicate_name' FROM p QUALIFY count(*) OVER (PARTITION BY safe) > 1
UNION ALL SELECT p_name, 'exposure' FROM p WHERE exposure <= 0 UNION ALL SELECT p_name, 'frames' FROM p WHERE frames <= 0 UNION ALL SELECT p_name, 'dither' FROM p WHERE dither < 1
""")
def _(t: Tables):
    p = t.part.withColumn("safe", F.concat("p_brand", "p_type", F.col("p_size").cast("string"))).withColumn("exposure", F.col("p_retailprice") - 905).withColumn("frames", F.col("p_size") - 1).withColumn("dither", F.col("p_partkey") % 9)
    return sessions.plan_violations(p, "p_name", "safe", "exposure", "frames", "dither")


# --- sessions and totals -----------------------------------------------------------------------------------------------------


@query("g1_sessions", """
SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag, l_quantity, l_linestatus, count(*) AS number, CAST(trunc(arg_min(l_discount * 100 - 5, l_orderkey * 10 + l_linenumber) + 0.5) AS INTEGER) AS cooling, arg_min(l_tax, l_orderkey * 10 + l_linenumber) AS tax FROM lineitem GROUP BY 1, 2, 3, 4
""")
def _(t: Tables):
    x = t.lineitem.withColumn("date", F.col("l_shipdate").cast("date")).withColumn("path", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sessions.sessions(x, ["date", "l_returnflag", "l_quantity", "l_linestatus"], "path", {"cooling": sessions.sensor_cooling(F.col("l_discount") * 100 - 5), "tax": F.col("l_tax")})


@query("g2_filter_totals", "SELECT l_returnflag, CAST(sum(CAST(trunc(l_linenumber * l_quantity) AS BIGINT)) AS BIGINT) AS seconds, CAST(grouping(l_returnflag) AS INTEGER) AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(t: Tables):
    return sessions.filter_totals(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity")


@query("g3_temperature_counts", "SELECT CAST(l_shipdate AS DATE) AS date, round_even(l_quantity / 5, 0) * 5 AS temperature, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    return sessions.counts_by(t.lineitem, [F.col("l_shipdate").cast("date").alias("date"), S.round_to(F.col("l_quantity"), 5).alias("temperature")])


@query("g4_month_by_kind", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS k, o_totalprice AS s FROM orders), u AS (SELECT * FROM m UNION ALL SELECT 'TOTAL', k, s FROM m)
SELECT month, round(coalesce(sum(s) FILTER (k = 'F'), 0) / 3600, 2) AS "F", round(coalesce(sum(s) FILTER (k = 'O'), 0) / 3600, 2) AS "O", round(coalesce(sum(s) FILTER (k = 'P'), 0) / 3600, 2) AS "P" FROM u GROUP BY 1
""")
def _(t: Tables):
    x = t.orders.withColumn("month", S.month_key(F.col("o_orderdate")))
    return rounded(sessions.month_by_kind(x, "month", "o_orderstatus", "o_totalprice", ["F", "O", "P"]), 2)


@query("g5_user_formats", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS fits, count(*) FILTER (o_orderstatus <> 'F') AS xisf, CAST(grouping(o_orderpriority) AS INTEGER) AS is_total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def _(t: Tables):
    return sessions.flag_counts(t.orders, "o_orderpriority", {"fits": F.col("o_orderstatus") == "F", "xisf": F.col("o_orderstatus") != "F"})


@query("g6_cube_seconds", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS seconds, CAST(grouping(o_orderpriority, o_orderstatus) AS INTEGER) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(t: Tables):
    return rounded(sessions.cube_seconds(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice"), 2)


@query("g7_status_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def _(t: Tables):
    return sessions.status_counts(t.orders, "o_orderstatus", ["F", "O", "P"])


@query("g11_filter_matrix", "SELECT s_nationkey, count(*) FILTER (s_suppkey % 3 = 0) AS \"L\", count(*) FILTER (s_suppkey % 3 = 1) AS \"R\", count(*) FILTER (s_suppkey % 3 = 2) AS \"H\", count(*) AS total FROM supplier GROUP BY 1")
def _(t: Tables):
    names = F.array(F.lit("L"), F.lit("R"), F.lit("H"))
    x = t.supplier.withColumn("filter", F.element_at(names, (F.col("s_suppkey") % 3 + 1).cast("int")))
    return sessions.filter_matrix(x, "s_nationkey", "filter", ["L", "R", "H"])


WORK = "WITH d AS (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), w AS (SELECT o_custkey, o_orderkey, coalesce(c, 0) AS accepted, greatest(0, 3 - coalesce(c, 0)) AS remaining FROM orders LEFT JOIN d ON o_orderkey = l_orderkey)"


def _work(t: Tables):
    done = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    return sessions.remaining(t.orders.withColumn("target_frames", F.lit(3)), done, ["o_orderkey"], "target_frames", "c")


@query("j22_remaining_work", WORK + " SELECT o_orderkey, accepted, remaining FROM w")
def _(t: Tables):
    return _work(t).select("o_orderkey", "accepted", F.col("remaining").cast("long").alias("remaining"))


@query("g44_progress", WORK + " SELECT o_custkey, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(remaining) AS BIGINT) AS remaining, bool_and(remaining = 0) AS complete FROM w GROUP BY 1")
def _(t: Tables):
    return sessions.progress(_work(t), "o_custkey")


@query("g44_next_index", "SELECT l_returnflag, l_linestatus, max(l_orderkey) + 1 AS next_index FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    return sessions.next_index(t.lineitem, ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("g45_plan_totals", "SELECT l_orderkey, round(sum(l_quantity * l_linenumber), 4) AS seconds, CAST(sum(l_linenumber) AS BIGINT) AS frames FROM lineitem GROUP BY 1")
def _(t: Tables):
    return rounded(sessions.plan_totals(t.lineitem, ["l_orderkey"], "l_quantity", "l_linenumber"), 4)


@query("w14_renumber", "SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS number, printf('%05d', n) AS number_text FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)")
def _(t: Tables):
    return sessions.renumber(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number", "number_text")


@query("w15_unique_names", """
SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN p_brand ELSE p_brand || '__' || left(sha1(CAST(p_partkey AS VARCHAR)), 10) END AS link_name FROM part
""")
def _(t: Tables):
    return sessions.unique_names(t.part.withColumn("one", F.lit(1)), ["one"], "p_brand", "p_partkey").select("p_partkey", "link_name")


# --- joins and set operations -------------------------------------------------------------------------------------------------


@query("j1_with_measurements", "SELECT d.doc_id, toxic, quality FROM documents d LEFT JOIN (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) = 1) l ON l.doc_id = d.doc_id")
def _(t: Tables):
    return joins.with_measurements(t.documents.select("doc_id"), t.labels, "doc_id", ["quality", "toxic"]).select("doc_id", "toxic", "quality")


@query("j2_captures_at", """
WITH s AS (SELECT user_id, arg_min(ts, event_id) AS s FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1)
SELECT event_id, epoch_us(s) + CAST(round(value * 1e6) AS BIGINT) AS at FROM events JOIN s USING (user_id)
""")
def _(t: Tables):
    first = t.events.agg(F.min("event_type").alias("k"))  # one row
    x = t.events.crossJoin(F.broadcast(first)).withColumn("start", F.when(F.col("event_type") == F.col("k"), F.col("ts")))
    return joins.captures_at(x, "user_id", "event_id", "start", "value").select("event_id", F.unix_micros("at").alias("at"))


@query("j3_once_per_key", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity) + l_discount, 6) AS metric FROM lineitem")
def _(t: Tables):
    keys = {"q": F.round("l_quantity", 6), "d": F.round("l_discount", 6)}
    got = joins.once_per_key(t.lineitem, keys, lambda k: k.withColumn("metric", F.sin("q") + F.col("d")))
    return got.select("l_orderkey", "l_linenumber", r("metric").alias("metric"))


@query("j4_sequential_pairs", "SELECT event_type, event_id AS left_path, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS right_path FROM events QUALIFY right_path IS NOT NULL")
def _(t: Tables):
    return quality.sequential_pairs(t.events, ["event_type"], "event_id")


@query("j5_candidate_pairs", "SELECT a.s_nationkey, a.s_suppkey AS left_path, b.s_suppkey AS right_path FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _(t: Tables):
    return quality.candidate_pairs(t.supplier, ["s_nationkey"], "s_suppkey", 7).drop("shuffle_key")


@query("j6_unlabelled_pairs", """
SELECT a.s_nationkey, a.s_suppkey AS left_path, b.s_suppkey AS right_path FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE (a.s_suppkey + b.s_suppkey) % 3 <> 0
""")
def _(t: Tables):
    pairs = quality.candidate_pairs(t.supplier, ["s_nationkey"], "s_suppkey", 7).drop("shuffle_key")
    labels = pairs.where((F.col("left_path") + F.col("right_path")) % 3 == 0).select(F.col("right_path").alias("left_path"), F.col("left_path").alias("right_path"))
    return quality.unlabelled(pairs, labels)


@query("j7_reference_pairs", "SELECT a.p_brand, a.p_partkey AS reference_path, b.p_partkey AS target_path FROM part a JOIN part b USING (p_brand) WHERE a.p_partkey % 50 = 0 AND b.p_partkey % 50 <> 0")
def _(t: Tables):
    return quality.role_pairs(t.part, ["p_brand"], "p_partkey", F.col("p_partkey") % 50 == 0)


@query("j8_folder_markers", "WITH m AS (SELECT p_brand, arg_min(v, " + RAW + ") AS marker_filter FROM (SELECT *, " + KEY.format(x=RAW) + f" AS kk FROM part) JOIN {ALIASES} ON al.k = kk GROUP BY 1) SELECT p_partkey, marker_filter FROM part LEFT JOIN m USING (p_brand)")
def _(t: Tables):
    m = joins.folder_markers(t.part.select("p_brand", _raw().alias("raw")), "p_brand", "raw")
    return t.part.join(m, "p_brand", "left").select("p_partkey", "marker_filter")


@query("j9_exact_darks", """
WITH d AS (SELECT p_size AS gain, CAST(p_partkey % 3 AS INTEGER) AS mode, min(p_partkey) AS path FROM part GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, d.path AS dark_path FROM lineitem LEFT JOIN d ON d.gain = coalesce(CAST(trunc(CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END) AS INTEGER), 56) AND d.mode = l_linenumber % 3
""")
def _(t: Tables):
    darks = t.part.select((F.col("p_partkey") % 3).cast("int").alias("mode"), F.col("p_size").alias("gain"), F.lit(20).alias("offset"), F.lit(480).alias("exptime"), F.lit(-10).alias("temp"), F.col("p_partkey").alias("path"))
    none = F.lit(None).cast("double")
    frames = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("mode"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("gain"), none.alias("offset"), none.alias("exptime"), none.alias("temp"))
    return joins.match_dark_exact(frames, darks).select("l_orderkey", "l_linenumber", "dark_path")


@query("j10_nearest_dark", """
WITH x AS (SELECT p.p_partkey, s.s_suppkey, abs(p.p_retailprice - s.s_acctbal) AS d, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(p.p_retailprice - s.s_acctbal), s.s_suppkey) AS k FROM part p JOIN supplier s ON s.s_nationkey = p.p_size % 25)
SELECT p.p_partkey, s_suppkey AS match_id, round(d, 6) AS distance FROM part p LEFT JOIN x ON x.p_partkey = p.p_partkey AND k = 1
""")
def _(t: Tables):
    left = t.part.withColumn("s_nationkey", F.col("p_size") % 25)
    got = joins.match_nearest(left, t.supplier, "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal", ["s_nationkey"])
    return got.select("p_partkey", "match_id", r("distance").alias("distance"))


@query("j10_nearest_known", """
WITH l AS (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 2 END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 3 END AS b FROM part),
x AS (SELECT l.p_partkey, s.s_suppkey, abs(p_retailprice - s_acctbal) AS d, row_number() OVER (PARTITION BY l.p_partkey ORDER BY abs(p_retailprice - s_acctbal), s_suppkey) AS k FROM l JOIN supplier s ON s_nationkey % 5 = p_size % 5 AND (a IS NULL OR a = s_suppkey % 2) AND (b IS NULL OR b = s_suppkey % 3))
SELECT l.p_partkey, s_suppkey AS match_id, round(d, 6) AS distance FROM l LEFT JOIN x ON x.p_partkey = l.p_partkey AND k = 1
""")
def _(t: Tables):
    n = F.col("p_partkey")
    left = t.part.withColumns({"g": F.col("p_size") % 5, "a": F.when(n % 3 != 0, n % 2), "b": F.when(n % 5 != 0, F.col("p_size") % 3)})
    right = t.supplier.withColumns({"g": F.col("s_nationkey") % 5, "a": F.col("s_suppkey") % 2, "b": F.col("s_suppkey") % 3})
    got = joins.match_nearest(left, right, "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal", ["g"], ["a", "b"])
    return got.select("p_partkey", "match_id", r("distance").alias("distance"))


@query("j10_nearest_within", """
WITH x AS (SELECT p.p_partkey, s.s_suppkey, abs(p.p_retailprice - s.s_acctbal) AS d, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(p.p_retailprice - s.s_acctbal), s.s_suppkey) AS k FROM part p JOIN supplier s ON abs(p.p_retailprice - s.s_acctbal) <= 5)
SELECT p.p_partkey, s_suppkey AS match_id, round(d, 6) AS distance FROM part p LEFT JOIN x ON x.p_partkey = p.p_partkey AND k = 1
""")
def _(t: Tables):
    got = joins.match_nearest(t.part, t.supplier, "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal", [], within=5.0)
    return got.select("p_partkey", "match_id", r("distance").alias("distance"))


@query("j11_flat_by_filter", "WITH f AS (SELECT p_brand, min(p_partkey) AS flat_path FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_partkey, flat_path FROM part LEFT JOIN f USING (p_brand)")
def _(t: Tables):
    flats = t.part.where("p_size > 10").select(F.col("p_brand").alias("filter"), F.col("p_partkey").alias("path"))
    return joins.match_flat(t.part.withColumn("filter", F.col("p_brand")), flats).select("p_partkey", "flat_path")


@query("j12_unfinished_work", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_quantity < 25)")
def _(t: Tables):
    done = t.lineitem.where("l_quantity < 25").select(F.col("l_orderkey").alias("path"), F.lit(1.0).alias("mtime"))
    return joins.unfinished(t.orders.select(F.col("o_orderkey").alias("path"), F.lit(1.0000000001).alias("mtime")), done, "path", "mtime").select(F.col("path").alias("o_orderkey"))


@query("j13_labels_with_scores", "SELECT l_orderkey AS left_path, l_partkey AS right_path, a.n AS left_score, b.n AS right_score FROM lineitem LEFT JOIN (SELECT doc_id, n_chars::DOUBLE AS n FROM documents) a ON a.doc_id = l_orderkey LEFT JOIN (SELECT doc_id, n_chars::DOUBLE AS n FROM documents) b ON b.doc_id = l_partkey")
def _(t: Tables):
    labels = t.lineitem.select(F.col("l_orderkey").alias("left_path"), F.col("l_partkey").alias("right_path"))
    return quality.with_scores(labels, t.documents, "doc_id", "n_chars")


@query("j14_models_side_by_side", "WITH s AS (SELECT l_partkey, min(l_extendedprice) FILTER (l_linestatus = 'F') AS f, min(l_extendedprice) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1) SELECT count(*) AS pairs, count(*) FILTER (f < o) AS \"wins_F\", count(*) FILTER (o < f) AS \"wins_O\", round(median(f), 6) AS \"median_F\", round(median(o), 6) AS \"median_O\" FROM s WHERE f IS NOT NULL AND o IS NOT NULL")
def _(t: Tables):
    runs = t.lineitem.groupBy("l_partkey", "l_linestatus").agg(F.min("l_extendedprice").alias("v"))
    return rounded(quality.ab_summary(runs, ["l_partkey"], "l_linestatus", "v", ["F", "O"]))


@query("j15_before_after", """
SELECT e.event_id, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS delta, round(CASE WHEN b.value <> 0 THEN (b.value - a.value) / b.value END, 6) AS reduction FROM events e LEFT JOIN events b ON b.event_id = e.event_id LEFT JOIN events a ON a.event_id = e.event_id + 7
""")
def _(t: Tables):
    pairs = t.events.select("event_id", F.col("event_id").alias("b"), (F.col("event_id") + 7).alias("a"))
    got = quality.before_after(pairs, t.events.select(F.col("event_id").alias("k"), "value"), "b", "a", "k", "value")
    return got.select("event_id", "before", "after", r("delta").alias("delta"), r("reduction").alias("reduction"))


@query("j16_filter_offsets", """
WITH o AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS o FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, CAST(trunc(b.o - a.o) AS INTEGER) AS focus_delta FROM lineitem LEFT JOIN o a ON a.f = l_returnflag LEFT JOIN o b ON b.f = CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END
""")
def _(t: Tables):
    o = t.lineitem.groupBy(F.col("l_returnflag").alias("filter")).agg(F.avg("l_extendedprice").alias("offset"))
    x = t.lineitem.withColumn("next", F.when(F.col("l_linestatus") == "F", "A").otherwise("N"))
    return joins.filter_offset(x, o, "l_returnflag", "next").select("l_orderkey", "l_linenumber", "focus_delta")


POINTS = "p AS (SELECT p_size % 5 AS f, p_partkey AS id, (p_partkey * 37 % 1009) * 1.0 AS x, (p_partkey * 101 % 997) * 1.0 AS y FROM part), q AS (SELECT f, id, x + 0.25 * (id % 9) AS x, y - 0.5 * (id % 5) AS y FROM p)"


def _points(t: Tables):
    k = F.col("p_partkey")
    p = t.part.select((F.col("p_size") % 5).alias("f"), k.alias("id"), (k * 37 % 1009).cast("double").alias("x"), (k * 101 % 997).cast("double").alias("y"))
    return p, p.withColumn("x", F.col("x") + 0.25 * (F.col("id") % 9)).withColumn("y", F.col("y") - 0.5 * (F.col("id") % 5))


@query("j17_star_cross_match", f"""WITH {POINTS},
n AS (SELECT q.f, q.id AS target_id, p.id AS reference_id, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS d FROM q JOIN p ON p.f = q.f AND abs(p.x - q.x) <= 12 AND abs(p.y - q.y) <= 12 AND sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) <= 12),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY f, target_id ORDER BY round(d, 9), reference_id) = 1), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY f, reference_id ORDER BY round(d, 9), target_id) = 1)
SELECT CAST(f AS INTEGER) AS f, target_id, reference_id, round(d, 6) AS distance FROM m
""")
def _(t: Tables):
    p, q = _points(t)
    return joins.cross_match(q, p, ["f"], 12.0).withColumn("distance", r("distance"))


@query("j18_isolation", f"WITH {POINTS} SELECT CAST(a.f AS INTEGER) AS f, a.id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS nearest FROM p a LEFT JOIN p b ON b.f = a.f AND b.id <> a.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 20 GROUP BY 1, 2")
def _(t: Tables):
    return joins.isolation(_points(t)[0], ["f"], 20.0).select("f", "id", r("nearest").alias("nearest"))


@query("j21_choose_convention", f"""WITH {POINTS}, d AS (SELECT f, unnest(['a', 'b']) AS c, unnest([x % 7, y % 5]) AS d FROM p), m AS (SELECT f, c, median(d) AS m FROM d GROUP BY 1, 2)
SELECT CAST(f AS INTEGER) AS f, arg_min(c, (m, c)) AS convention, CAST(min(m) AS DOUBLE) AS median_distance FROM m GROUP BY f""")
def _(t: Tables):
    p, _q = _points(t)
    d = p.select("f", F.explode(F.array(F.struct(F.lit("a").alias("convention"), (F.col("x") % 7).alias("d")), F.struct(F.lit("b").alias("convention"), (F.col("y") % 5).alias("d")))).alias("s")).select("f", "s.*")
    return joins.choose_convention(d, ["f"], "convention", "d")


@query("j23_required_groups", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 40 = 0)")
def _(t: Tables):
    groups = t.part.where("p_partkey % 40 = 0").select("p_brand").distinct()
    return joins.require_groups(t.part, groups, ["p_brand"]).select("p_partkey")


@query("g49_unique_work", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates()


@query("o4_top_groups", """
WITH g AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY max(p_retailprice) DESC, p_brand DESC LIMIT 3) SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM g)
""")
def _(t: Tables):
    return quality.top_groups(t.part, "p_brand", "p_retailprice", 3).select("p_partkey", "p_brand")


@query("o6_recent_frames", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def _(t: Tables):
    return joins.latest(t.events, ["user_id"], "ts", "event_id", 3).select("user_id", "event_id")


@query("o7_filter_order", "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name), CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 99 END, s_suppkey) AS INTEGER) AS place FROM supplier")
def _(t: Tables):
    names = F.element_at(F.array(F.lit("L"), F.lit("H"), F.lit("X")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    order = [F.lower("s_name"), S.filter_rank(names), F.col("s_suppkey")]
    return t.supplier.withColumn("place", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order))).select("s_suppkey", "place")


@query("o9_cull_list", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_retailprice > 1500")
def _(t: Tables):
    from noctua.sources.files import cull_list

    bad, _share = cull_list(t.part.select("p_partkey", F.col("p_size").alias("stars"), F.col("p_retailprice").alias("fwhm")), 5, 1500.0)
    return bad.select("p_partkey")


@query("u1_union_of_listings", "SELECT o_custkey AS path FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(t: Tables):
    a, b = t.orders.select(F.col("o_custkey").alias("path")), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    return a.unionByName(b).dropDuplicates(["path"])


@query("u3_manifest_rows", "SELECT s_suppkey AS id, 'prepared' AS state, NULL::VARCHAR AS reason FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, 'skipped', 'low' FROM supplier WHERE s_acctbal < 0")
def _(t: Tables):
    a = t.supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"), F.lit("prepared").alias("state"))
    b = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"), F.lit("skipped").alias("state"), F.lit("low").alias("reason"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u5_label_subsets", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'clear' ELSE 'tie' END AS kind FROM labels WHERE toxic = 1 OR quality IS NOT NULL")
def _(t: Tables):
    return t.labels.where("toxic = 1 or quality is not null").select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "clear").otherwise("tie").alias("kind"))
