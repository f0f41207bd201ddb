"""Queries of sources and sinks: the given tables are written as files of each form below the shared folder, by Spark, and
scanned again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.operators import logs
from noctua.plans.base import Tables, query, r, rounded
from noctua.session import shared_dir, written
from noctua.sources import files, headers, sinks


def _path(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _text(t: Tables, df: DataFrame, name: str) -> str:
    """The path of text files that hold the column `value`."""
    path = _path(t, name)
    df.select("value").write.text(path)
    return path


#: Files that one task writes, and folders over which the images' own folders are spread: more than Spark lists in the driver.
FILES_A_TASK, FOLDERS = 512, 64


def _by_image(df: DataFrame, path: str) -> None:
    """A text file for each image, from columns image and value.  A few compressed rows make many files, so they are dealt out to
    tasks first; each task moves its own files into place, which the driver would do one by one.  Folders of many images each make
    listing a task for each of them, not one for each image."""
    parts = max(1, -(-df.count() // FILES_A_TASK))
    df = df.withColumn("folder", F.pmod(F.col("image"), F.lit(FOLDERS))).repartition(parts, "image")
    df.write.partitionBy("folder", "image").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def _documents(t: Tables, df: DataFrame, name: str) -> str:
    """The path of JSON files, each an array of one partition's rows."""

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [v for pdf in frames for v in pdf.value]
        if rows:
            yield pd.DataFrame({"value": ["[" + ",\n".join(rows) + "]"]})

    return _text(t, df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(joined, "value string"), name)


# --- sources --------------------------------------------------------------------------------------------------------------


@query("s6_focus_log", """
SELECT l_returnflag AS filter, round(l_discount * 100, 6) AS temperature, l_orderkey::DOUBLE AS initial_focus, round(l_quantity, 6) AS best_focus, round(l_tax, 6) AS r_squared FROM lineitem WHERE l_linenumber <> 7 AND l_tax >= 0.02
""")
def _(t: Tables):
    names = ["datetime", "filter", "temperature", "initial_focus", "best_focus", "num_stars", "fwhm", "r_squared", "num_samples", "focus_min", "focus_max"]
    best = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("string")).otherwise("none")
    x = t.lineitem.select(F.lit("2024-01-01 00:00:00"), "l_returnflag", F.col("l_discount") * 100, "l_orderkey", best, "l_linenumber", F.lit("2.5"), "l_tax", F.lit(9), F.lit(""), F.lit("nan"))
    path = _path(t, "focus")
    x.toDF(*[f" {n}" for n in names]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rounded(files.scan_focus_log(t.spark, path, 0.02).select("filter", "temperature", "initial_focus", "best_focus", "r_squared"))


@query("s7_measurements", "SELECT CAST(p_partkey AS VARCHAR) AS sub_path, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice, 6) END AS score FROM part")
def _(t: Tables):
    path = _path(t, "metrics")
    t.part.select(F.col("p_partkey").alias("sub_path"), F.when(F.col("p_size") % 5 == 0, "nan").otherwise(F.col("p_retailprice").cast("string")).alias("score")).write.csv(path, header=True)
    return rounded(files.scan_measurements(t.spark, path, ["sub_path"], ["score"]))


@query("s8_report", """
SELECT '/in/' || s_nationkey AS input_dir, s_name || k AS source_file, CASE WHEN k = '.a' THEN 'L' END AS final_filter FROM supplier, (SELECT unnest(['.a', '.b']) AS k)
""")
def _(t: Tables):
    row = lambda k, f: F.struct(F.concat("s_name", F.lit(k)).alias("source_file"), F.lit(f).alias("final_filter"))
    x = t.supplier.select(F.concat(F.lit("/in/"), F.col("s_nationkey").cast("string")).alias("input_dir"), F.array(row(".a", "L"), row(".b", None)).alias("rows"))
    return files.scan_report(t.spark, _documents(t, x, "report")).select("input_dir", "source_file", "final_filter")


@query("s9_comparisons", """
SELECT CAST(l_orderkey AS VARCHAR) AS left_path, CAST(l_partkey AS VARCHAR) AS right_path, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'N' THEN 'tie' ELSE 'reject' END AS winner FROM lineitem
""")
def _(t: Tables):
    winner = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "N", "tie").otherwise("reject")
    path = _path(t, "labels")
    t.lineitem.select(F.lit(1).alias("version"), F.col("l_orderkey").cast("string").alias("left_path"), F.col("l_partkey").cast("string").alias("right_path"), winner.alias("winner")).write.json(path)
    return files.scan_comparisons(t.spark, path).select("left_path", "right_path", "winner")


@query("s10_star_lists", "SELECT round(p_retailprice, 6) AS x, p_size::DOUBLE AS y, CASE WHEN p_size % 3 = 0 THEN 2.5 ELSE 3.25 END::DOUBLE AS fwhm FROM part WHERE p_partkey % 5 <> 0")
def _(t: Tables):
    wide = F.when(F.col("p_size") % 3 == 0, "0").otherwise("4")
    columns = F.concat_ws(" ", *[F.lit("0")] * 5, F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.lit("2.5"), wide)
    broken = F.col("p_partkey") % 5 == 0
    stars = files.scan_star_lists(t.spark, _text(t, t.part.select(F.when(broken, "1 2 three").otherwise(columns).alias("value")), "stars"))
    return rounded(stars.select("x", "y", "fwhm"))


@query("s11_sequences", "SELECT CAST(o_orderkey AS INTEGER) AS \"index\", o_custkey % 2 = 1 AS included, 80 AS height, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey + 0.5 END::DOUBLE AS shift FROM orders")
def _(t: Tables):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    numbers = F.when(F.col("o_custkey") % 3 == 0, "H 1 0").otherwise(F.concat(F.lit("H 1 0 "), customer, F.lit(".5 0 1 -3 0 0 1")))
    value = F.concat(F.lit("I "), key, F.lit(" "), (F.col("o_custkey") % 2).cast("string"), F.lit(" 100,80\nR0 2.1 3.0 0.9 0 10 25 "), numbers)
    _, frames = files.scan_sequences(files.numbered_lines(t.spark, _text(t, t.orders.select(value.alias("value")), "seq")))
    return frames.select("index", "included", "height", F.get("m", F.lit(2)).alias("shift"))


@query("s5_analyze_log", """
SELECT 'CaptureComplete' AS event, round(l_quantity, 6)::DOUBLE AS elapsed, '/img/' || l_orderkey || '.fits' AS path, NULL::BIGINT AS started FROM lineitem UNION ALL SELECT 'AnalyzeStartTime', NULL, NULL, 1714600800 + r_regionkey FROM region
""")
def _(t: Tables):
    lines = t.lineitem.select(F.concat(F.lit("CaptureComplete,"), F.col("l_quantity").cast("string"), F.lit(",300,L,2.5,/img/"), F.col("l_orderkey").cast("string"), F.lit(".fits")).alias("value"))
    start = t.region.select(F.concat(F.lit("AnalyzeStartTime,2024-05-01 22:00:0"), F.col("r_regionkey").cast("string"), F.lit(".000,UTC")).alias("value"))
    got = logs.analyze_events(files.numbered_lines(t.spark, _text(t, start.union(lines), "analyze")))
    return got.select("event", r("elapsed").alias("elapsed"), "path", F.unix_seconds("started").alias("started"))


@query("s14_projects", """
SELECT c_name AS target, f AS filter, CASE f WHEN 'L' THEN 300 ELSE 60 END::DOUBLE AS exposure, CASE f WHEN 'L' THEN c_nationkey ELSE 1 END::INTEGER AS target_frames, CASE WHEN f = 'R' THEN 7 WHEN c_custkey % 2 = 0 THEN 100 ELSE 56 END::INTEGER AS gain FROM customer, (SELECT unnest(['L', 'R']) AS f)
""")
def _(t: Tables):
    plan = lambda e, n, g: F.struct(F.lit(float(e)).alias("exposure"), n.cast("int").alias("target_frames"), F.lit(g).cast("int").alias("gain"))
    filters = F.create_map(F.lit("L"), plan(300, F.col("c_nationkey"), None), F.lit("R"), plan(60, F.lit(1), 7))
    x = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, 100).alias("gain"), F.array(F.struct(F.col("c_name").alias("target"), filters.alias("filters"))).alias("targets"))
    return files.scan_projects(t.spark, _documents(t, x, "projects")).select("target", "filter", "exposure", "target_frames", "gain")


@query("s15_night_plan", "SELECT s_name AS target, 'L' AS filter, 120::DOUBLE AS exposure, CAST(s_nationkey + 1 AS INTEGER) AS count, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 56 END::INTEGER AS gain, 5 AS mode FROM supplier")
def _(t: Tables):
    sequences = F.create_map(F.lit("L"), F.array(F.lit(120.0), (F.col("s_nationkey") + 1).cast("double")))
    session = F.struct(F.col("s_name").alias("target"), F.when(F.col("s_suppkey") % 2 == 0, 10).alias("gain"), sequences.alias("sequences"))
    return files.scan_night_plan(t.spark, _documents(t, t.supplier.select(F.array(session).alias("sessions")), "night")).select("target", "filter", "exposure", "count", "gain", "mode")


@query("s16_target_catalog", "SELECT c_name AS name, round(c_nationkey % 24 + 30 / 60.0, 6) AS ra_hours, round(-(c_nationkey + 15 / 60.0), 6) AS dec_degrees, len(c_mktsegment) AS marks FROM customer WHERE c_custkey % 4 <> 0")
def _(t: Tables):
    number = F.col("c_nationkey").cast("string")
    dec = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("-"), number, F.lit(":15:00")))
    x = t.customer.select(F.col("c_name").alias("name"), F.concat((F.col("c_nationkey") % 24).cast("string"), F.lit(":30:00")).alias("ra"), dec.alias("dec"), F.col("c_mktsegment").alias("notes"))
    got = files.scan_target_catalog(t.spark, _documents(t, x, "catalog"))
    return got.select("name", r("ra_hours").alias("ra_hours"), r("dec_degrees").alias("dec_degrees"), F.length("notes").cast("long").alias("marks"))


@query("s18_progress_files", "SELECT '/p/M31-L-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '.fits' AS path, 'L' AS filter, CAST(o_orderkey % 100000 AS INTEGER) AS \"index\" FROM orders WHERE o_custkey % 3 <> 0")
def _(t: Tables):
    path = F.concat(F.lit("/p/M31-L-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit(".fits"))
    return files.progress_files(t.orders.select(path.alias("path"), (F.col("o_custkey") % 3).alias("length")), "M31")


@query("s19_previous_results", "SELECT p_name AS file, p_size::INTEGER AS stars, round(p_retailprice, 6) AS fwhm FROM part")
def _(t: Tables):
    path = _path(t, "solved")
    t.part.select(F.col("p_name").alias("file"), F.lit("1:2:3").alias("ra"), F.lit("4:5:6").alias("dec"), F.col("p_size").cast("int").alias("stars"), F.col("p_retailprice").alias("fwhm"), F.lit(0.5).alias("angle"), F.lit("ok").alias("status")).write.csv(path, header=True)
    return rounded(files.scan_previous_results(t.spark, path).select("file", "stars", "fwhm"))


def _images(t: Tables) -> str:
    """The path of one image for each supplier: FITS of 3 rows and 4 columns of bytes, XISF where the key is a multiple of
    five, and broken ones where it is a multiple of seven."""
    key = F.col("s_suppkey")
    card = lambda k, v: F.rpad(F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), v), 80, " ")
    fixed = {"SIMPLE": "T", "BITPIX": "8", "NAXIS": "2", "NAXIS1": "4", "NAXIS2": "3"}
    cards = [card(k, F.lit(v)) for k, v in fixed.items()] + [card("FILTER", F.lit("'L''s'  / band")), card("GAIN", F.col("s_nationkey").cast("string"))]
    end = F.when(key % 7 == 0, "").otherwise("END")
    data = F.concat(*[F.chr((key + i) % 100 + 20) for i in range(12)])
    fits = F.concat(F.rpad(F.concat(*cards, end), 2880, " "), data)
    xml = F.concat(F.lit('<xisf><Property id="Instrument:Filter:Name" value="R"/><FITSKeyword name="GAIN" value="'), F.lpad((F.col("s_nationkey")).cast("string"), 2, "0"), F.lit('"/></xisf>'))
    xisf = F.concat(F.lit("XISF0100"), F.chr(F.length(xml)), F.lit("\0" * 7), xml)
    path = _path(t, "images")
    x = t.supplier.select(F.col("s_suppkey").alias("image"), F.when(key % 5 == 0, xisf).otherwise(fits).alias("value"))
    _by_image(x, path)
    return path


def _image(column: str):
    return F.regexp_extract(column, r"image=(\d+)/", 1).cast("long").alias("image")


@query("s1_discovered_images", "SELECT s_suppkey::BIGINT AS image, s_suppkey % 5 = 0 AS small FROM supplier")
def _(t: Tables):
    return files.discover_images(t.spark, _images(t), r"\.txt$").select(_image("path"), (F.col("length") < 2880).alias("small"))


@query("s2_s3_image_headers", """
SELECT s_suppkey::BIGINT AS image, CASE WHEN s_suppkey % 5 = 0 THEN 'R' WHEN s_suppkey % 7 <> 0 THEN 'L''s' END AS filter, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS gain, s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 AS broken FROM supplier
""")
def _(t: Tables):
    h = written(headers.scan_headers(t.spark, _images(t), r"\.txt$"), "headers")
    frames = files.typed_frames(h).select("path", F.col("filter"), "gain")
    return h.select("path", F.col("err").isNotNull().alias("broken")).join(frames, "path", "left").select(_image("path"), "filter", "gain", "broken")


@query("s4_image_tiles", """
SELECT s_suppkey::BIGINT AS image, ty, tx, CAST(sum((s_suppkey + i) % 100 + 20) AS BIGINT) AS total FROM supplier, (SELECT unnest(generate_series(0, 11)) AS i), (SELECT unnest([0, 0, 1, 1]) AS ty, unnest([0, 1, 0, 1]) AS tx)
WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND (i // 4) // 2 = ty AND (i % 4) // 2 = tx GROUP BY 1, 2, 3 UNION ALL SELECT s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0
""")
def _(t: Tables):
    content = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_images(t)).where("path like '%.txt'")
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v).cast("long")
    return files.scan_tiles(files.packed(content), 2).select(_image("frame_id"), "ty", "tx", total.alias("total"))


# --- sinks ----------------------------------------------------------------------------------------------------------------


@query("k1_significant_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size % 7 <> 0 THEN printf('%.4f', p_retailprice) END AS price FROM part")
def _(t: Tables):
    path = _path(t, "csv")
    price = F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    sinks.write_csv(t.part.select("p_partkey", price.alias("price"), "p_name"), path, ["p_partkey", "price"], fixed=4)
    return t.spark.read.csv(path, header=True)


@query("k2_score_rows", "SELECT p_partkey, round(p_retailprice, 6) AS score FROM part")
def _(t: Tables):
    path = _path(t, "jsonl")
    sinks.write_jsonl(t.part.select("p_partkey", F.col("p_retailprice").alias("score"), "p_name"), path, ["p_partkey", "score"])
    return rounded(t.spark.read.schema("p_partkey long, score double").json(path))


@query("k3_rewritten_table", "SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, -1 FROM part WHERE p_size < 10")
def _(t: Tables):
    path = _path(t, "table")
    sinks.append_rows(t.part.select("p_partkey", F.lit(0).cast("int").alias("p_size")), path)
    sinks.rewrite_table(t.part.select("p_partkey", F.col("p_size").cast("int").alias("p_size")), path)
    sinks.append_rows(t.part.where("p_size < 10").select("p_partkey", F.lit(-1).alias("p_size")), path)
    return t.spark.read.parquet(path)


@query("k5_manifests", "SELECT CAST(l_linenumber AS VARCHAR) AS \"user\", l_returnflag AS equipment, l_linestatus AS filter, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2, 3")
def _(t: Tables):
    path = _path(t, "manifests")
    sinks.write_manifests(t.lineitem.select(F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("user"), F.col("l_returnflag").alias("equipment"), F.col("l_linestatus").alias("filter"), "l_orderkey"), path)
    got = t.spark.read.parquet(path).groupBy(F.substring("user", 2, 9).alias("user"), "equipment", "filter")
    return got.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@query("k6_calibration_document", "SELECT 'N' AS reference_filter, l_returnflag AS filter, count(*) AS n FROM lineitem GROUP BY 2")
def _(t: Tables):
    models = t.lineitem.groupBy(F.col("l_returnflag").alias("filter")).agg(F.count("*").alias("n"))
    document = sinks.calibration_document(models, "N", "2024-01-01")
    parsed = F.from_json("document", "reference_filter string, filters map<string,struct<n:long>>")
    return document.select(parsed.alias("d")).select("d.reference_filter", F.explode("d.filters").alias("filter", "v")).select("reference_filter", "filter", F.col("v.n").alias("n"))


@query("k8_masters_index", "SELECT CAST(l_orderkey AS VARCHAR) AS \"user\", l_returnflag AS filter FROM lineitem WHERE l_linestatus = 'F'")
def _(t: Tables):
    state = F.when(F.col("l_linestatus") == "F", "master_written").otherwise("planned")
    x = t.lineitem.select(F.col("l_orderkey").cast("string").alias("user"), F.lit("rig").alias("equipment"), F.col("l_returnflag").alias("filter"), state.alias("state"))
    return sinks.masters_index(x).select("user", "filter")
