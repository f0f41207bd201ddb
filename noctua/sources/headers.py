"""Headers of images by ranged reads: of a FITS file the 2,880-byte blocks up to END, of an XISF file its signature and XML."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.functions.scalar import unquote
from noctua.session import written
from noctua.sources.files import IMAGES, discover_images, fits_header, xisf_header

#: Bytes of a FITS block, and blocks that a header may have before it counts as broken.
BLOCK, MOST_BLOCKS = 2880, 4096
SCHEMA = "path string, hdr map<string,string>, err string, bytes_read long"


def read_header(read: Callable[[int, int], bytes], path: str) -> tuple[dict[str, str], int]:
    """The header of one image and the bytes that were read for it.  read(at, n): n bytes from a place, fewer at the end."""
    first = read(0, BLOCK)
    if path.lower().endswith(".xisf") or first[:4] == b"XISF":
        (size,) = struct.unpack("<I", first[8:12])
        rest = read(BLOCK, 16 + size - BLOCK) if 16 + size > BLOCK else b""
        return xisf_header(first + rest), len(first) + len(rest)
    data = first
    for at in range(1, MOST_BLOCKS + 1):
        block = data[-BLOCK:]
        if not block or any(block[i : i + 80].rstrip() == b"END" for i in range(0, len(block), 80)):
            break
        more = read(at * BLOCK, BLOCK)
        if not more:
            break
        data += more
    try:
        return fits_header(data)[0], len(data)
    except ValueError as e:
        raise ValueError(f"{e} in {len(data)} bytes") from None


def _opened(path: str) -> Callable[[int, int], bytes]:
    """Reads of a file by its address, by Arrow's file systems."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    handle = system.open_input_file(inner)
    return lambda at, n: handle.read_at(n, at) if at < handle.size() else b""


def _reads_by_range(spark: SparkSession, root: str) -> bool:
    """Whether tasks can open files of this place themselves."""
    jvm = spark._jvm
    scheme = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    return scheme in ("file", "hdfs", "s3", "s3a", "gs")


def _rows(read: Callable[[str, bytes | None], tuple[dict[str, str], int]], paths, contents) -> pd.DataFrame:
    rows = []
    for path, content in zip(paths, contents, strict=True):
        try:
            hdr, n = read(path, content)
            rows.append((path, hdr, None, n))
        except (ValueError, ET.ParseError, struct.error, OSError) as e:
            rows.append((path, {}, str(e), None))
    return pd.DataFrame(rows, columns=["path", "hdr", "err", "bytes_read"])


def scan_headers(spark: SparkSession, root: str, pattern: str = IMAGES, files_a_task: int = 512) -> DataFrame:
    """Path, hdr (map), err and bytes_read of each image under root; a file that cannot be read is a row with err.
    XISF files are known by their name or first bytes; empty files are not listed.

    Spark lists the files (of which `pattern` chooses), and tasks of about `files_a_task` files read no more of each than its header.  In a
    store that only Spark can open, its binary reader is used, which reads files whole (bytes_read then counts the header)."""
    listing = discover_images(spark, root, pattern)

    def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _rows(lambda path, _: read_header(_opened(path.replace("s3a://", "s3://")), path), pdf.path, [None] * len(pdf))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _rows(lambda path, content: read_header(lambda at, n: content[at : at + n], path), pdf.path, pdf.content)

    if _reads_by_range(spark, root):
        # paths are listed once and dealt out, so that many tasks wait for the store at once
        listing = written(listing.select("path"), "listing")
        parts = max(1, -(-listing.count() // files_a_task))
        got = listing.select("path").repartition(parts).mapInPandas(by_range, SCHEMA)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).join(listing.select("path"), "path", "left_semi")
        got = files.select("path", "content").mapInPandas(whole, SCHEMA)
    return got.withColumn("hdr", F.transform_values("hdr", lambda k, v: unquote(v)))
