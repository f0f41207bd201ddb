"""URL filtering: a URL's host suffixes and path prefixes are looked up among rules by short hashes, then confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import fresh_names
from pyspark.sql import types as T

#: Copies of each verdict, and so tasks that share the pages of one URL.
SALTS = 16
RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("action", T.StringType())])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a URL; both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of those names in pages are replaced).

    A rule fits its host and every subdomain where the path starts with the rule's path; of the fitting rules the one
    with the longest host and path together wins, on equal length the one that sorts first, and block before allow if
    a rule is given twice.  Rules with a null field are ignored.  No fitting rule: rule null, verdict `default`.

    Each distinct URL is expanded into (host suffix, path prefix) expressions; prefixes are taken only at the lengths
    that rule paths have.  Expressions and rules meet on the first `prefix_hex` hex digits of a SHA-256, whose whole
    value then has to agree.  Distinct URLs are judged once; their verdicts go back to the pages in SALTS copies, so that
    the pages of one URL, or without one, are dealt over as many tasks.
    """
    host, path = url_parts(F.col("_url"))
    key = lambda h, p: F.sha2(F.concat_ws("\n", h, p), 256)
    known = (
        rules.select("host", "path", "action").where("host is not null and path is not null and action is not null")
        .groupBy("host", "path").agg(F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("_block"))
        .select(key(F.col("host"), F.col("path")).alias("_digest"), F.concat("host", "path").alias("_rule"),
                F.when(F.col("_block") == 1, "block").otherwise("allow").alias("_action"), F.length("path").alias("_length"))
        .withColumn("_short", F.substring("_digest", 1, prefix_hex))
    )
    lengths = known.agg(F.sort_array(F.collect_set("_length")).alias("_lengths"))
    urls = pages.select(F.col(url).alias("_url")).where(F.col(url).isNotNull()).distinct()
    labels = F.split("_host", r"\.")
    seen = (
        urls.select("_url", host.alias("_host"), path.alias("_path")).join(F.broadcast(lengths))
        .select("_url", "_path", "_lengths", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_suffix"))
        .select("_url", "_suffix", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("_prefix"))
        .select("_url", key(F.col("_suffix"), F.col("_prefix")).alias("_full"))
        .withColumn("_short", F.substring("_full", 1, prefix_hex))
    )
    best = (
        seen.join(known, "_short").where(F.col("_full") == F.col("_digest"))
        .groupBy("_url").agg(F.min(F.struct(-F.length("_rule"), F.col("_rule"), F.col("_action").alias("_verdict"))).alias("_best"))
        .select("_url", F.col("_best._rule").alias("_won"), F.col("_best._verdict").alias("_verdict"))
    )
    salt, own, copy, won, verdict = fresh_names(pages, "salt", "url", "copy", "won", "verdict")
    best = best.withColumnsRenamed({"_url": own, "_won": won, "_verdict": verdict}).withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(own, copy)
    salted = pages.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return (
        salted.join(best, (salted[url] == best[own]) & (salted[salt] == best[copy]), "left")
        .select(*[salted[c] for c in kept], host.alias("host"), path.alias("path"), F.col(won).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
    )
