"""Lines that many documents share: each is dropped from all of them but the one with the largest doc_id.

Only DataFrame functions.  Lines meet others by two 64-bit hashes of their keys, never as text, and texts are shuffled once,
beside the positions of their dropped lines.  A line of very many documents is counted before its shuffle; the join that
brings its verdict back is one that Spark splits where a key is hot.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import fresh_names
from noctua.session import written

#: White space that ends and begins lines without counting.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose positions are not in `gone` (rising, from 0): the slices between, so the work follows the lines."""
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text.

    A text is cut at \\n; a null or empty one is one empty line.  The key of a line is the line without white space at both
    ends and with A-Z lower-cased.  A key of at least `least_chars` code points that stands in at least `least_docs`
    documents loses its lines everywhere but in the largest doc_id that holds it.  Repeats of a key in one document count
    once and go or stay together.  A document is a doc_id: rows that share one count once and are treated alike; rows
    without a doc_id are together one document, below all others.  Any other columns stay; new ones replace those of the
    same name.  An empty table gives an empty one."""
    own, first, second, gone, kept, *other = fresh_names(docs, "own", "first", "second", "gone", "kept", "id", "t", "u")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.withColumns({own: F.col(doc_id).cast("long"), first: F.xxhash64(whole), second: F.xxhash64(F.lit(1), whole)})

    cut = F.transform(F.split(whole, "\n", -1), lambda line, at: F.struct(line_key(line).alias("key"), at.alias("at")))
    long = F.filter(cut, lambda x: F.char_length(x["key"]) >= least_chars)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g"), x["at"].alias("at")))
    lines = base.select(F.col(own).alias("id"), F.col(first).alias("t"), F.col(second).alias("u"), F.explode(hashed).alias("x")).select("id", "t", "u", "x.*")

    # Keys on so many rows at least; the rows that hold them, with exact numbers of documents.  What a join has on its right is
    # written: dealt out by its own grouping, it would keep Spark from splitting the rows of a hot key on the left.
    often = written(lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("h"), "frequent-lines")
    shared = written(lines.join(often, "h", "left_semi"), "shared-lines")
    in_docs = shared.groupBy("h", "g", "id").agg(F.lit(1).alias("one"))
    counts = in_docs.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("top")).where(F.col("n") >= least_docs).select("h", "g", "top")
    drop = shared.join(written(counts, "repeated-lines"), ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("top")))
    places = drop.groupBy("id", "t", "u").agg(F.sort_array(F.collect_set("at")).alias(gone)).withColumnsRenamed(dict(zip(("id", "t", "u"), other, strict=True)))

    met = base.join(written(places, "dropped-lines"), F.col(own).eqNullSafe(F.col(other[0])) & (F.col(first) == F.col(other[1])) & (F.col(second) == F.col(other[2])), "left")
    at = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    once = F.transform(F.array(F.split(whole, "\n", -1)), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.array_join(_without(x, at), "\n").alias("text")))[0]
    new = {"n_lines": F.col(f"`{kept}`.n"), "n_dropped": F.size(at).cast("long"), "kept_text": F.col(f"`{kept}`.text")}
    return met.withColumn(kept, once).withColumns(new).drop(own, first, second, gone, kept, *other)
