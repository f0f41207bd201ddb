"""Sources: image headers and tiles, logs, star lists, sequences, reports and plans, as DataFrames.

Files are found and read by Spark's readers, so any store works; bytes are parsed in the tasks that read them.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import finite, parse_date_obs, sexagesimal
from noctua.operators.tiles import TILE, cut_tiles
from noctua.session import written

# --- images ---------------------------------------------------------------------------------------------------------------


#: Splits of small files that one task reads: Spark packs few files in a split, since it counts 4 MB for opening each.
SPLITS_A_TASK = 64


def packed(files: DataFrame) -> DataFrame:
    """files, a scan of many small files, with up to SPLITS_A_TASK splits in a task, but no fewer tasks than two for each core."""
    splits = files.rdd.getNumPartitions()
    return files.coalesce(max(-(-splits // SPLITS_A_TASK), min(splits, 2 * files.sparkSession.sparkContext.defaultParallelism)))


def discover_images(spark: SparkSession, root: str, pattern: str = r"(?i)\.(fits?|xisf)$") -> DataFrame:
    """Path, modificationTime, length of image files under root; hidden files and folders are skipped, each path once.

    The bytes are not read: only the columns of the listing are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    inside = F.substring_index(F.col("path"), root.rstrip("/"), -1)
    return packed(files).where(F.col("path").rlike(pattern) & ~inside.rlike(r"/\.")).dropDuplicates(["path"])


def _card(card: str) -> tuple[str, str] | None:
    key, value = card[:8].strip(), card[10:]
    if card[8:10] != "= " or not key:
        return None
    value = value.strip()
    if value.startswith("'"):
        end = 1
        while True:
            end = value.find("'", end)
            if end < 0:
                return key, value[1:].rstrip()
            if value[end + 1 : end + 2] != "'":
                return key, value[1:end].replace("''", "'").rstrip()
            end += 2
    return key, value.split("/")[0].strip()


def fits_header(data: bytes) -> tuple[dict[str, str], int]:
    """Cards of the primary header and where its data begins; blocks are read up to END."""
    header: dict[str, str] = {}
    for at in range(0, len(data), 80):
        card = data[at : at + 80].decode("ascii", "replace")
        if card.rstrip() == "END":
            return header, -(-(at + 80) // 2880) * 2880
        if found := _card(card):
            header.setdefault(*found)
    raise ValueError("no END card")


def xisf_header(data: bytes) -> dict[str, str]:
    """Properties and keywords of an XISF header, by id and name; values lose their quotes."""
    if data[:8] != b"XISF0100":
        raise ValueError("no XISF signature")
    (size,) = struct.unpack("<I", data[8:12])
    header: dict[str, str] = {}
    for node in ET.fromstring(data[16 : 16 + size].rstrip(b"\0").decode("utf-8")).iter():
        kind = node.tag.rpartition("}")[2]
        name = node.get("id") if kind == "Property" else node.get("name") if kind == "FITSKeyword" else None
        if name:
            header.setdefault(name, node.get("value") if node.get("value") is not None else (node.text or ""))
    return header


IMAGES = r"(?i)\.(fits?|xisf)$"


#: Header key -> the other names under which images carry it.
XISF_ALIASES = {
    "DATE-OBS": ("DATEOBS", "OBSERVATION:TIME:START", "OBSERVATION:STARTTIME"),
    "FILTER": ("INSTRUMENT:FILTER:NAME", "OBSERVATION:FILTER", "OBSERVATION:FILTER:NAME"),
    "EXPTIME": ("EXPOSURE", "EXPOSURETIME", "OBSERVATION:EXPOSURETIME", "INSTRUMENT:EXPOSURETIME"),
    "GAIN": ("CCD:GAIN", "INSTRUMENT:CAMERA:GAIN"),
    "CCD-TEMP": ("CCD:TEMPERATURE", "INSTRUMENT:SENSOR:TEMPERATURE"),
    "FOCUSTEM": ("FOCUS:TEMPERATURE", "TEMPERATURE:FOCUS", "FOCTEMP"),
    "OBJECT": ("OBSERVATION:OBJECT:NAME",),
}


def typed_frames(headers: DataFrame) -> DataFrame:
    """Frame records from headers: path, date_obs, filter, exptime, gain, ccd_temp, focus_temp, object, width, height."""
    from noctua.functions.scalar import first_number, header_value

    text = lambda k: header_value(F.col("hdr"), k, *XISF_ALIASES.get(k, ()))
    number = lambda k: first_number(F.col("hdr"), k, *XISF_ALIASES.get(k, ()))
    return headers.where("err is null").select(
        "path", parse_date_obs(text("DATE-OBS")).alias("date_obs"), text("FILTER").alias("filter"), number("EXPTIME").alias("exptime"), number("GAIN").cast("int").alias("gain"),
        number("CCD-TEMP").alias("ccd_temp"), number("FOCUSTEM").alias("focus_temp"), text("OBJECT").alias("object"), number("NAXIS1").cast("int").alias("width"), number("NAXIS2").cast("int").alias("height"),
    )


def fits_pixels(data: bytes) -> np.ndarray:
    header, at = fits_header(data)
    kind = {"8": ">u1", "16": ">i2", "32": ">i4", "64": ">i8", "-32": ">f4", "-64": ">f8"}[header["BITPIX"]]
    shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
    v = np.frombuffer(data, kind, int(np.prod(shape)), at).astype(float)
    return (v * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))).reshape(shape)


def scan_tiles(files: DataFrame, size: int = 256) -> DataFrame:
    """Tiles of FITS images (path, content): one row for each block of size x size pixels; cubes become their median.  A
    file that cannot be read is one row with the error as err and nothing else."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows = [{"frame_id": path, "err": None} | t for t in cut_tiles(fits_pixels(content), size)]
                except (ValueError, KeyError) as e:
                    rows = [{"frame_id": path, "err": f"{type(e).__name__}: {e}"} | dict.fromkeys(("ty", "tx", "y0", "x0", "h", "w", "px"))]
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(read, TILE + ", err string")


# --- texts ----------------------------------------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of text files; a file of any size is read in splits, of which no task holds more than a line.

    Lines come in order inside a split, and splits are known by where they begin, so a line's number is its place in the split and
    the lines of the splits before, which a table of one row for each split tells.  Lines are written first, since splits may be
    cut anew whenever a plan runs."""
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    inside = F.regexp_replace("file", "^.*?://", "")
    lines = written(lines.where(~inside.rlike(r"/\.")), "lines")
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")
    splits = written(splits.select("file", "_start", (before - F.col("_first")).alias("_shift")), "splits")
    return lines.where("value <> ''").join(splits, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def scan_focus_log(spark: SparkSession, path: str, r2_min: float | None = None) -> DataFrame:
    """Focus rows; rows that are short, lack best_focus or do not parse are left out."""
    names = ("temperature", "initial_focus", "best_focus", "num_stars", "fwhm", "r_squared", "num_samples", "focus_min", "focus_max")
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    got = raw.select(F.try_to_timestamp("datetime").alias("datetime"), "filter", *[finite(F.col(n)).alias(n) for n in names])
    got = got.where("best_focus is not null and temperature is not null and filter is not null")
    return got.where(F.coalesce(F.col("r_squared") >= r2_min, F.lit(False))) if r2_min is not None else got


def scan_measurements(spark: SparkSession, path: str, text: list[str], numbers: list[str]) -> DataFrame:
    """A metrics CSV with cleaned numbers."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*text, *[finite(F.col(n)).alias(n) for n in numbers])


REPORT_FIELDS = ("source_file", "collection_file", "sequence_input_file", "user", "equipment", "raw_filter", "normalized_filter", "final_filter", "filter_source", "lookup_status", "hint", "reason")


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of report documents with their input_dir; fields that a document lacks are NULL."""
    row = ", ".join(f"{n}: string" for n in REPORT_FIELDS)
    return spark.read.schema(f"input_dir string, rows array<struct<{row}>>").json(path, multiLine=True).select("input_dir", F.inline("rows"))


def scan_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """Comparison labels; a winner other than left, right, tie or reject is an error that names it."""
    kinds = "version int, timestamp string, group string, left_path string, right_path string, winner string, left_preview string, right_preview string, note string"
    rows = spark.read.schema(kinds).json(path, mode="FAILFAST")
    bad = F.raise_error(F.concat(F.lit("bad winner "), F.coalesce("winner", F.lit("NULL")), F.lit(" for "), F.coalesce("left_path", F.lit("?"))))
    return rows.withColumn("winner", F.when(F.col("winner").isin("left", "right", "tie", "reject"), F.col("winner")).otherwise(bad))


def scan_star_lists(spark: SparkSession, path: str) -> DataFrame:
    """File, star_id, x, y, fwhm of star tables.  With a header line (# or words) columns are found by name; without
    one x, y and two widths are the 6th to 9th column.  Rows that do not parse are left out; fwhm is the mean of the
    positive widths."""
    lines = numbered_lines(spark, path).withColumn("f", F.split(F.trim(F.regexp_replace("value", "^#", "")), r"[\s,]+"))
    head = lines.where(F.exists("f", lambda c: F.lower(c) == "x")).groupBy("file").agg(F.min_by(F.transform("f", lambda c: F.lower(c)), "line").alias("h"))
    x = lines.join(head, "file", "left")
    named = lambda *names: F.coalesce(*[F.when(F.array_position("h", n) > 0, F.get("f", (F.array_position("h", n) - 1).cast("int")).try_cast("double")) for n in names])
    at = lambda i: F.get("f", F.lit(i)).try_cast("double")
    mean = lambda a, b: F.when((a > 0) & (b > 0), (a + b) / 2).when(a > 0, a).when(b > 0, b)
    no_head = F.col("h").isNull()
    got = x.select("file", "line", F.when(no_head, at(5)).otherwise(named("x")).alias("x"), F.when(no_head, at(6)).otherwise(named("y")).alias("y"), F.when(no_head, mean(at(7), at(8))).otherwise(F.coalesce(named("fwhm"), mean(named("fwhmx"), named("fwhmy")))).alias("fwhm"))
    return got.where("x is not null and y is not null and fwhm is not null").withColumn("star_id", F.col("line")).drop("line")


def scan_sequences(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From numbered lines of sequence files: (sequences: file, name, start, number, reference; frames: file, place,
    index, included, width, height, m as nine numbers or NULL).  The k-th R line belongs to the k-th I line."""
    seq = lines.where(F.col("value").rlike("^S ")).select("file", F.regexp_extract("value", r"^S\s+'?([^']*?)'?\s+-?\d", 1).alias("name"), F.split(F.regexp_extract("value", r"^S\s+(?:'[^']*'|\S+)\s+(.*)$", 1), r"\s+").alias("n"))
    seq = seq.select("file", "name", F.get("n", F.lit(0)).try_cast("int").alias("start"), F.get("n", F.lit(1)).try_cast("int").alias("number"), F.get("n", F.lit(4)).try_cast("int").alias("reference"))
    w = Window.partitionBy("file").orderBy("line")
    i = lines.where(F.col("value").rlike("^I ")).select("file", F.row_number().over(w).alias("place"), F.split("value", r"[\s,]+").alias("f"))
    i = i.select("file", "place", F.get("f", F.lit(1)).try_cast("int").alias("index"), (F.get("f", F.lit(2)) == "1").alias("included"), F.get("f", F.lit(3)).try_cast("int").alias("width"), F.get("f", F.lit(4)).try_cast("int").alias("height"))
    numbers = F.transform(F.slice(F.split(F.trim(F.regexp_extract("value", r"H\s+(.*)$", 1)), r"\s+"), 1, 9), lambda v: v.try_cast("double"))
    r = lines.where(F.col("value").rlike(r"^R\d?\s")).select("file", F.row_number().over(w).alias("place"), F.when(F.size(numbers) == 9, numbers).alias("m"))
    return seq, i.join(r, ["file", "place"], "left")


def scan_tool_logs(spark: SparkSession, path: str) -> DataFrame:
    """File, stars (most found), bgnoise, median, fwhm (last of each), ra, dec and angle of captured tool output."""
    t = packed(spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value"))
    number = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
    every = lambda p: F.transform(F.regexp_extract_all("value", F.lit(p), F.lit(1)), lambda v: v.try_cast("double"))
    last = lambda p: F.try_element_at(every(p), F.lit(-1))
    place = r"(?i)center:?\s*ra:?\s*([0-9hms:. ]+?)\s*,?\s*dec:?\s*([-+0-9d°'\":. ]+)"
    return t.select("file", F.array_max(every(rf"(?i)found\s+{number}")).cast("int").alias("stars"), last(rf"(?i)bgnoise:?\s*{number}").alias("bgnoise"), last(rf"(?i)median:?\s*{number}").alias("median"), last(rf"(?i)fwhm\w*:?\s*{number}").alias("fwhm"), sexagesimal(F.regexp_extract("value", place, 1)).alias("ra_hours"), sexagesimal(F.regexp_extract("value", place, 2)).alias("dec_degrees"), last(rf"(?i)(?:rotation|angle):?\s*{number}").alias("angle"))


def region_texts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Mean, median, sigma, min, max and bgnoise of statistics lines."""
    of = lambda k: finite(F.regexp_extract(value, rf"(?i){k}:?\s*([-+]?[0-9.]+(?:e[-+]?\d+)?)", 1)).alias(k)
    return lines.where(F.col(value).rlike("(?i)mean")).select("*", *[of(k) for k in ("mean", "median", "sigma", "min", "max", "bgnoise")])


# --- plans ----------------------------------------------------------------------------------------------------------------

FILTER_PLAN = "struct<exposure:double,target_frames:int,gain:int,offset:int,mode:int>"
PROJECT = f"latitude double, longitude double, gain int, offset int, mode int, targets array<struct<target:string,ra:string,dec:string,priority:int,min_altitude:double,dither_every:int,gain:int,offset:int,mode:int,filters:map<string,{FILTER_PLAN}>>>"


def scan_projects(spark: SparkSession, path: str, defaults: dict[str, int] | None = None) -> DataFrame:
    """File, target, filter, exposure, target_frames and settings; of the filter, else the target, else the project,
    else the defaults (gain 56, offset 20, mode 5)."""
    d = {"gain": 56, "offset": 20, "mode": 5} | (defaults or {})
    p = spark.read.schema(PROJECT).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file")).withColumn("t", F.explode("targets"))
    p = p.select("file", "latitude", "longitude", *d, "t", F.explode("t.filters").alias("filter", "plan"))
    return p.select("file", "latitude", "longitude", F.col("t.target").alias("target"), F.col("t.ra").alias("ra"), F.col("t.dec").alias("dec"), F.coalesce("t.priority", F.lit(0)).alias("priority"), F.coalesce("t.min_altitude", F.lit(0.0)).alias("min_altitude"), F.coalesce("t.dither_every", F.lit(1)).alias("dither_every"), "filter", "plan.exposure", "plan.target_frames", *[F.coalesce(f"plan.{k}", f"t.{k}", k, F.lit(v)).alias(k) for k, v in d.items()])


def scan_night_plan(spark: SparkSession, path: str) -> DataFrame:
    """Target, filter, exposure, count, gain, offset, mode of each sequence of a night plan."""
    kinds = "sessions array<struct<target:string,gain:int,offset:int,mode:int,sequences:map<string,array<double>>>>"
    s = spark.read.schema(kinds).json(path, multiLine=True).select(F.posexplode("sessions").alias("session", "s")).select("session", "s", F.explode("s.sequences").alias("filter", "v"))
    return s.select("session", F.col("s.target").alias("target"), "filter", F.get("v", F.lit(0)).alias("exposure"), F.get("v", F.lit(1)).cast("int").alias("count"), *[F.coalesce(f"s.{k}", F.lit(v)).alias(k) for k, v in (("gain", 56), ("offset", 20), ("mode", 5))])


def scan_target_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Name, ra_hours, dec_degrees, start, end, bookmarks, notes; entries without a name or place are left out."""
    kinds = "name string, ra string, dec string, start_date string, end_date string, bookmarks array<string>, notes string"
    t = spark.read.schema(kinds).json(path, multiLine=True)
    got = t.select("name", sexagesimal(F.col("ra")).alias("ra_hours"), sexagesimal(F.col("dec")).alias("dec_degrees"), F.try_to_timestamp("start_date", F.lit("yyyy-MM-dd")).cast("date").alias("start"), F.try_to_timestamp("end_date", F.lit("yyyy-MM-dd")).cast("date").alias("end"), F.coalesce("bookmarks", F.array().cast("array<string>")).alias("bookmarks"), "notes")
    return got.where("name is not null and ra_hours is not null and dec_degrees is not null")


def event_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Timestamp, subsystem, event and the open rest as VARIANT; lines that are no JSON object are left out."""
    v = F.try_parse_json(value)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return lines.select(F.try_to_timestamp(text("timestamp")).alias("timestamp"), text("subsystem").alias("subsystem"), text("event").alias("event"), v.alias("data")).where("event is not null")


def progress_files(files: DataFrame, project: str) -> DataFrame:
    """Filter and index of non-empty files project-FILTER-NNNNN.fits."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = rf"^{project}-([A-Za-z0-9]+)-(\d{{5}})\.fits$"
    return files.where((F.col("length") > 0) & name.rlike(pattern)).select("path", F.regexp_extract(name, pattern, 1).alias("filter"), F.regexp_extract(name, pattern, 2).cast("int").alias("index"))


def scan_previous_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a solve CSV."""
    return spark.read.csv(path, header=True, schema="file string, ra string, dec string, stars int, fwhm double, angle double, status string")


def cull_list(results: DataFrame, min_stars: int, max_fwhm: float) -> tuple[DataFrame, Column]:
    """Results with too few stars or too wide ones; and the aggregate that gives their share."""
    bad = F.coalesce(F.col("stars") < min_stars, F.lit(True)) | F.coalesce(F.col("fwhm") > max_fwhm, F.lit(True))
    return results.where(bad), F.avg(bad.cast("double")).alias("share")
