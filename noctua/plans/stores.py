"""Queries of headers read by range, tool logs, resumable and gated tables, measures, masters and incremental calibration,
over files and streams that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators import measures, planning, quality, tiles
from noctua.plans.base import Tables, query, r
from noctua.plans.files import _by_image, _image, _path
from noctua.plans.sky import DAYS, PX, _px, _tiles
from noctua.session import written
from noctua.sources import files, headers, sinks, store
from noctua.streaming import telemetry

# --- headers and logs ---------------------------------------------------------------------------------------------------------


@query("s2_headers_of_large_images", """
SELECT s_suppkey::BIGINT AS image, 'B' || s_nationkey AS filter, round(s_acctbal, 2) AS exptime, CASE WHEN s_suppkey % 3 = 0 THEN 5760 ELSE 2880 END::BIGINT AS bytes_read FROM supplier
""")
def _(t: Tables):
    """An image of 40 kB for each supplier; a header of two blocks where the key is a multiple of three."""
    card = lambda k, v: F.rpad(F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), v), 80, " ")
    more = F.when(F.col("s_suppkey") % 3 == 0, F.repeat(card("COMMENT0", F.lit("1")), 40)).otherwise("")
    cards = F.concat(card("SIMPLE", F.lit("T")), more, card("FILTER", F.concat(F.lit("'B"), F.col("s_nationkey").cast("string"), F.lit("'"))), card("EXPTIME", F.format_string("%.2f", "s_acctbal")), F.lit("END"))
    blocks = F.rpad(cards, F.when(F.col("s_suppkey") % 3 == 0, 5760).otherwise(2880), F.lit(" "))
    path = _path(t, "large-images")
    _by_image(t.supplier.select(F.col("s_suppkey").alias("image"), F.concat(blocks, F.repeat(F.lit("p"), 40_000)).alias("value")), path)
    h = written(headers.scan_headers(t.spark, path, r"\.txt$", 64), "headers")
    frames = files.typed_frames(h).select("path", "filter", "exptime")
    return h.join(frames, "path").select(_image("path"), "filter", r("exptime", 2).alias("exptime"), "bytes_read")


@query("s12_tool_logs", """
SELECT s_suppkey::BIGINT AS image, CAST(greatest(s_suppkey, s_nationkey * 10) AS INTEGER) AS stars, round(s_acctbal / 100, 2) AS bgnoise, CASE WHEN s_suppkey % 4 <> 0 THEN 2.5 END AS fwhm, CASE WHEN s_suppkey % 4 <> 0 THEN round((s_suppkey % 24) + 0.5, 6) END AS ra_hours, CASE WHEN s_suppkey % 4 <> 0 THEN 12.25 END AS dec_degrees FROM supplier
""")
def _(t: Tables):
    found = lambda c: F.concat(F.lit("log: Found "), c.cast("string"), F.lit(" stars\n"))
    noise = lambda c: F.concat(F.lit("bgnoise: "), F.format_string("%.2f", c), F.lit("\n"))
    solved = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("FWHMx: 2.5\nImage center: RA: "), F.format_string("%02dh30m00s", F.col("s_suppkey") % 24), F.lit(", Dec: +12 15 00\n"))).otherwise("not solved\n")
    text = F.concat(found(F.col("s_suppkey")), noise(F.lit(1.0)), found(F.col("s_nationkey") * 10), noise(F.col("s_acctbal") / 100), solved)
    path = _path(t, "tool-logs")
    _by_image(t.supplier.select(F.col("s_suppkey").alias("image"), text.alias("value")), path)
    return files.scan_tool_logs(t.spark, path).select(_image("file"), "stars", r("bgnoise", 2).alias("bgnoise"), "fwhm", r("ra_hours").alias("ra_hours"), r("dec_degrees").alias("dec_degrees"))


# --- number texts -------------------------------------------------------------------------------------------------------------

GENERAL = """CASE WHEN e < -4 OR e >= 8 THEN m || CASE WHEN e < 0 THEN 'e-' ELSE 'e+' END || lpad(abs(e)::VARCHAR, 2, '0')
  ELSE regexp_replace(regexp_replace(printf('%.' || (7 - e) || 'f', x), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END"""


@query("k1_eight_digits", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN l_quantity * 10000 WHEN 3 THEN l_discount / 1000 WHEN 4 THEN l_extendedprice * 1e8 WHEN 5 THEN (l_tax + 0.01) / 1e6 ELSE l_discount END AS x FROM lineitem WHERE l_linenumber < 7),
e AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE CAST(regexp_extract(printf('%.7e', x), 'e(.*)$', 1) AS INTEGER) END AS e, regexp_replace(regexp_replace(regexp_extract(printf('%.7e', x), '^(.*)e', 1), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS m FROM v)
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, {GENERAL} AS x FROM e UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), NULL FROM lineitem WHERE l_linenumber = 7
""")
def _(t: Tables):
    n = F.col("l_linenumber")
    x = F.when(n == 1, F.col("l_extendedprice")).when(n == 2, F.col("l_quantity") * 10000).when(n == 3, F.col("l_discount") / 1000).when(n == 4, F.col("l_extendedprice") * 1e8).when(n == 5, (F.col("l_tax") + 0.01) / 1e6).when(n == 6, F.col("l_discount")).otherwise(float("nan"))
    path = _path(t, "eight-digits")
    sinks.write_csv(t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")), path)
    return t.spark.read.csv(path, header=True)


@query("k4_light_frames", "SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS VARCHAR) AS gain, printf('%.3f', l_extendedprice) AS exptime, CASE WHEN l_linenumber <> 2 THEN printf('%.3f', l_discount * 10) END AS temperature FROM lineitem")
def _(t: Tables):
    path = _path(t, "lights")
    temperature = F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 10).otherwise(float("inf"))
    x = t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("gain"), F.col("l_extendedprice").alias("exptime"), temperature.alias("temperature"), "l_returnflag")
    sinks.write_csv(x, path, ["path", "gain", "exptime", "temperature"], fixed=3)
    return t.spark.read.csv(path, header=True)


@query("p15_candidate_key", """
SELECT p_partkey, regexp_replace(regexp_replace('in/' || p_name || '_' || (p_size % 4) || '_' || CASE WHEN p_size % 5 = 0 THEN '1' WHEN p_size % 5 = 1 THEN p_size * 60 || '' ELSE regexp_replace(printf('%.1f', p_size + 0.5), '\\.0$', '') END || '_' || p_size || 'x' || p_size * 2, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_]+|[_]+$', '', 'g') AS key FROM part
""")
def _(t: Tables):
    n = F.col("p_size")
    exposure = F.when(n % 5 == 0, -1.0).when(n % 5 == 1, n * 60.0).otherwise(n + 0.5)
    return t.part.select("p_partkey", S.candidate_key(F.concat(F.lit("in/"), "p_name"), n % 4, exposure, n, n * 2).alias("key"))


# --- orders and layouts -------------------------------------------------------------------------------------------------------


@query("w4_quality_order", """
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 1) DESC, event_id) AS quality_rank FROM events WHERE value IS NOT NULL
""")
def _(t: Tables):
    """Rounded scores, so that many are equal."""
    got = quality.drop_policy(t.events.withColumn("score", F.round("value", 1)), ["event_type"], "score", "event_id")
    return got.where("value is not null").select("event_type", "event_id", F.col("quality_rank").cast("long").alias("quality_rank"))


@query("k7_collected_frames", """
WITH k AS (SELECT DISTINCT l_returnflag AS filter, l_linenumber AS "user", l_orderkey % 100 AS name, l_orderkey || '/' || l_linenumber || '/' || (l_orderkey % 100) AS path FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT *, row_number() OVER (PARTITION BY filter, "user", name ORDER BY path) AS k FROM k)
SELECT path, 'out/' || filter || '/' || "user" || '/rig/' || name || CASE WHEN k > 1 THEN '__' || substr(sha1(path), 1, 10) ELSE '' END AS target FROM n
""")
def _(t: Tables):
    state = F.when(F.col("l_linestatus") == "F", "kept").otherwise("dropped_quality_outlier")
    name = (F.col("l_orderkey") % 100).cast("string")
    x = t.lineitem.select(F.col("l_returnflag").alias("filter"), F.col("l_linenumber").alias("user"), F.lit("rig").alias("equipment"), state.alias("drop_status"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), name).alias("path")).distinct()
    return sinks.collected_frames(x, "out").select("path", "target")


# --- resuming and gates --------------------------------------------------------------------------------------------------------


@query("k10_resumed_cache", "SELECT p_partkey AS path, round(p_retailprice * 2, 4) AS score, CAST(CASE WHEN p_size % 5 = 0 THEN 4 ELSE p_partkey % 4 END AS INTEGER) AS \"commit\" FROM part")
def _(t: Tables):
    """Four batches, of which the first run makes two; the second run makes the others; then a fifth of the files change."""
    cache = store.MeasurementCache(t.spark, _path(t, "cache"))
    work = t.part.select(F.col("p_partkey").alias("path"), F.lit(1.5).alias("mtime"), "p_size", "p_retailprice")
    measure = lambda part: part.select("path", "mtime", F.round(F.col("p_retailprice") * 2, 4).alias("score"))
    bucket = F.col("path") % 4
    cache.fill(work, measure, 4, bucket, most=2)
    cache.fill(work, measure, 4, bucket)
    changed = work.withColumn("mtime", F.when(F.col("p_size") % 5 == 0, 2.5).otherwise(F.col("mtime")))
    cache.fill(changed, measure)
    return cache.read().select("path", "score", F.col("commit").cast("int").alias("commit"))


@query("k9_gated_tiles", "SELECT CAST(vec_id AS VARCHAR) AS frame_id, count(*) AS tiles, 30.0::DOUBLE AS exposure, CAST(label % 3 AS INTEGER) AS mode FROM embeddings, (SELECT unnest([1, 2, 3, 4])) GROUP BY vec_id, label")
def _(t: Tables):
    path = _path(t, "gated")
    mode = t.embeddings.select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("label") % 3).cast("int").alias("mode"))
    store.write_gated(_tiles(t).join(mode, "frame_id").withColumn("exposure", F.lit(30.0)), path)
    return t.spark.read.parquet(path).groupBy("frame_id", "exposure", "mode").agg(F.count("*").alias("tiles"))


# --- pixels ---------------------------------------------------------------------------------------------------------------------


@query("x2_measured_tiles", f"""
WITH {PX}, p AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, CASE WHEN vec_id % 7 <> 0 THEN v END AS v FROM px), m AS (SELECT vec_id, ty, tx, median(v) AS m FROM p GROUP BY 1, 2, 3),
n AS (SELECT vec_id, ty, tx, any_value(m) AS median, 1.4826 * median(abs(v - m)) AS noise, min(v) AS low, max(v) AS high FROM p JOIN m USING (vec_id, ty, tx) GROUP BY 1, 2, 3)
SELECT CAST(vec_id AS VARCHAR) AS frame_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, unnest(['local_noise', 'extremes']) AS measure, round(unnest([median, low]), 6) AS first, round(unnest([noise, high]), 6) AS second, CASE WHEN median IS NULL THEN 'ValueError: no finite pixel' END AS error FROM n
""")
def _(t: Tables):
    nothing = F.when(F.col("frame_id").cast("long") % 7 != 0, F.lit(0.0))
    x = _tiles(t).withColumn("px", F.transform("px", lambda v: (v + F.coalesce(nothing, F.lit(float("nan")))).cast("float")))
    got = measures.measured(x, ["local_noise", "extremes"])
    return got.select("frame_id", "ty", "tx", "measure", r(F.coalesce(F.col("result")["median"], F.col("result")["low"])).alias("first"), r(F.coalesce(F.col("result")["noise"], F.col("result")["high"])).alias("second"), "error")


#: Masters of the darks (vec_id % 4 = 1) by gain and of the flats (vec_id % 4 = 2) by filter, of 8 x 8 pixels.
MASTERS = f"""{PX}, dv AS (SELECT label % 3 AS gain, y, x, v + 1 AS v FROM px WHERE vec_id % 4 = 1), dm AS (SELECT *, median(v) OVER w AS m, coalesce(stddev_samp(v) OVER w, 0) AS s FROM dv WINDOW w AS (PARTITION BY gain, y, x)),
dark AS (SELECT gain, y, x, avg(v) FILTER (v > m - 2 * s AND v < m + 2 * s) AS v, count(*) FILTER (v > m - 2 * s AND v < m + 2 * s) AS kept, count(*) AS n FROM dm GROUP BY 1, 2, 3),
fl AS (SELECT vec_id, median(v + 2) AS l FROM px WHERE vec_id % 4 = 2 GROUP BY 1), fv AS (SELECT label % 2 AS f, y, x, (v + 2) / l AS v FROM px JOIN fl USING (vec_id)), fm AS (SELECT *, median(v) OVER w AS m, coalesce(stddev_samp(v) OVER w, 0) AS s FROM fv WINDOW w AS (PARTITION BY f, y, x)),
flat AS (SELECT f, y, x, avg(v) FILTER (v > m - 2 * s AND v < m + 2 * s) AS v FROM fm GROUP BY 1, 2, 3)"""


def _frames(t: Tables, rest: int, plus: float) -> DataFrame:
    """Frames of one kind as tiles of 8 x 8, with their header's keys."""
    x = t.embeddings.where(F.col("vec_id") % 4 == rest)
    px = F.transform("embedding", lambda v: v.cast("double") + plus)
    return x.select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("label") % 3).cast("int").alias("gain"), (F.col("label") % 2).cast("string").alias("filter"), *[F.lit(v).alias(c) for c, v in (("ty", 0), ("tx", 0), ("y0", 0), ("x0", 0), ("h", 8), ("w", 8))], px.alias("px"))


@query("g38_keyed_masters", f"WITH {MASTERS} SELECT CAST(gain AS INTEGER) AS gain, CAST(y // 4 AS INTEGER) AS ty, CAST(x // 4 AS INTEGER) AS tx, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(n - kept) AS BIGINT) AS rejected, round(sum(v * (1 + y + 8 * x)), 4) AS moment FROM dark GROUP BY 1, 2, 3")
def _(t: Tables):
    m = tiles.masters(_frames(t, 1, 1.0), ["gain"], 4, 2.0, 2.0)
    p = tiles.pixels(m, ["gain", "ty", "tx", "kept", "rejected"])
    return p.groupBy("gain", "ty", "tx", "kept", "rejected").agg(r(F.sum(F.col("v") * (1 + F.col("y") + 8 * F.col("x"))), 4).alias("moment"))


def _table(df: DataFrame) -> DataFrame:
    """Masters, which every batch reads, as a table."""
    return written(df, "masters")


@query("t12_incremental_calibration", f"""
WITH {MASTERS} SELECT CAST(vec_id AS VARCHAR) AS frame_id, round(sum((p.v + 5 - d.v) / f.v), 3) AS total FROM px p JOIN dark d ON d.gain = p.label % 3 AND d.y = p.y AND d.x = p.x JOIN flat f ON f.f = p.label % 2 AND f.y = p.y AND f.x = p.x WHERE vec_id % 4 = 0 GROUP BY 1
""")
def _(t: Tables):
    """Lights come in two parts, of which the second holds some of the first again."""
    dark = _table(tiles.masters(_frames(t, 1, 1.0), ["gain"], 8, 2.0, 2.0))
    flat = _table(tiles.masters(_frames(t, 2, 2.0), ["filter"], 8, 2.0, 2.0, level=True))
    lights = _frames(t, 0, 5.0)
    home = _path(t, "calibration")
    run = telemetry.Calibration(t.spark, f"{home}/out", dark, ["gain"], flat, ["filter"])
    n = F.col("frame_id").cast("long") % 16
    for part in (lights.where(n <= 8), lights.where(n >= 8)):
        part.write.mode("append").parquet(f"{home}/in")
        telemetry.run_available(t.spark.readStream.schema(lights.schema).parquet(f"{home}/in"), run.add, f"{home}/state").awaitTermination()
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return run.read().select("frame_id", r(total, 3).alias("total"))


@query("g34_best_frames", f"""
WITH {PX}, w AS (SELECT label, vec_id, max(v) - min(v) AS fwhm FROM px GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY fwhm) AS p FROM w) WHERE p <= 0.9),
v AS (SELECT p.label, y, x, v + 1 AS v, 1 / fwhm AS w FROM px p JOIN b USING (vec_id)), m AS (SELECT *, median(v) OVER k AS m, coalesce(stddev_samp(v) OVER k, 0) AS s FROM v WINDOW k AS (PARTITION BY label, y, x))
SELECT label, y, x, round(sum(v * w) FILTER (v > m - 3 * s AND v < m + 3 * s) / sum(w) FILTER (v > m - 3 * s AND v < m + 3 * s), 6) AS value, count(*) FILTER (v > m - 3 * s AND v < m + 3 * s) AS kept FROM m GROUP BY 1, 2, 3
""")
def _(t: Tables):
    """The best nine tenths of the frames by width, weighted by its inverse."""
    p = _px(t)
    width = p.groupBy("label", "vec_id").agg((F.max("v") - F.min("v")).alias("fwhm"))
    best = tiles.best_share(width, ["label"], "fwhm", 0.9).select("vec_id", (1 / F.col("fwhm")).alias("weight"))
    got = tiles.rejection_stack(p.join(best, "vec_id").withColumn("v", F.col("v") + 1), ["label", "y", "x"], "v", weight="weight")
    return got.select("label", "y", "x", r("value").alias("value"), "kept")


@query("p27_moon_places", f"""
WITH d AS (SELECT event_id, user_id, value, {DAYS} AS d FROM events), m AS (SELECT *, d / 36525 AS c FROM d),
e AS (SELECT *, radians(218.32 + 481267.881 * c + 6.29 * sin(radians(135.0 + 477198.87 * c)) - 1.27 * sin(radians(259.3 - 413335.36 * c)) + 0.66 * sin(radians(235.7 + 890534.22 * c)) + 0.21 * sin(radians(269.9 + 954397.74 * c)) - 0.19 * sin(radians(357.5 + 35999.05 * c)) - 0.11 * sin(radians(186.5 + 966404.03 * c))) AS l,
  radians(5.13 * sin(radians(93.3 + 483202.02 * c)) + 0.28 * sin(radians(228.2 + 960400.89 * c)) - 0.28 * sin(radians(318.3 + 6003.15 * c)) - 0.17 * sin(radians(217.6 - 407332.21 * c))) AS b, radians(23.439 - 0.0000004 * d) AS o FROM m),
-- a unit vector to the Moon, turned from the ecliptic to the equator; the frame's place as a unit vector; the zenith
v AS (SELECT *, cos(b) * cos(l) AS x, cos(o) * cos(b) * sin(l) - sin(o) * sin(b) AS y, sin(o) * cos(b) * sin(l) + cos(o) * sin(b) AS z, radians(user_id % 360) AS ra, radians(value - 50) AS dec, radians(280.46061837 + 360.98564736629 * d - 99.4) AS st, radians(31.5) AS la FROM e)
SELECT event_id, round(degrees(asin(z * sin(la) + cos(la) * (x * cos(st) + y * sin(st)))), 3) AS moon_altitude, round(degrees(acos(least(1, greatest(-1, x * cos(dec) * cos(ra) + y * cos(dec) * sin(ra) + z * sin(dec))))), 3) AS moon_separation FROM v
""")
def _(t: Tables):
    e = t.events.select("event_id", "ts", F.lit(31.5).alias("la"), F.lit(-99.4).alias("lo"), (F.col("user_id") % 360).cast("double").alias("ra"), (F.col("value") - 50).alias("dec"))
    return planning.sky_context(e, "ts", "la", "lo", "ra", "dec").select("event_id", r("moon_altitude", 3).alias("moon_altitude"), r("moon_separation", 3).alias("moon_separation"))
