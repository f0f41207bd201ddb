"""Sessions, totals and progress of observing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions.scalar import FILTER_ORDER, content_name
from noctua.operators.stats import numbered


def sessions(frames: DataFrame, keys: list[str], order: str, others: dict[str, Column]) -> DataFrame:
    """G1: one row for each key with the number of frames; other columns from the first frame in order."""
    named = frames.withColumns({f"_{n}": c for n, c in others.items()})
    return named.groupBy(*keys).agg(F.count("*").alias("number"), *[F.min_by(f"_{n}", order).alias(n) for n in others])


def sensor_cooling(temperature: Column) -> Column:
    """G1: whole degrees, int(t + 0.5) toward zero; unknown is 0."""
    return F.coalesce((temperature + 0.5).cast("int"), F.lit(0))


def filter_totals(sessions_: DataFrame, name: str, number: str, duration: str) -> DataFrame:
    """Whole seconds for each filter, and a row with a null filter for all."""
    return sessions_.rollup(name).agg(F.sum((F.col(number) * F.col(duration)).cast("long")).alias("seconds"), F.grouping(name).cast("int").alias("is_total"))


def counts_by(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows for each combination, in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def month_by_kind(df: DataFrame, month: str, kind: str, seconds: str, kinds: list[str]) -> DataFrame:
    """Hours for each month with kinds as columns, and a TOTAL row."""
    one = df.groupBy(month).pivot(kind, kinds).agg(F.sum(seconds) / 3600)
    total = df.withColumn(month, F.lit("TOTAL")).groupBy(month).pivot(kind, kinds).agg(F.sum(seconds) / 3600)
    return one.union(total).na.fill(0.0, kinds)


def flag_counts(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """count_if of each flag for each key and, with a null key, for all."""
    return df.rollup(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.grouping(key).cast("int").alias("is_total"))


def cube_seconds(df: DataFrame, a: str, b: str, seconds: str) -> DataFrame:
    """Count and seconds for each pair with row, column and grand totals."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.grouping_id().cast("int").alias("level"))


def status_counts(df: DataFrame, status: str, names: list[str]) -> DataFrame:
    """One row of counters."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def filter_matrix(df: DataFrame, key: str, name: str, order: list[str] = FILTER_ORDER) -> DataFrame:
    """Frames of each user as rows and filters as columns, with a total."""
    got = df.groupBy(key).pivot(name, order).agg(F.count(F.lit(1))).na.fill(0, order)
    return got.withColumn("total", sum((F.col(f"`{c}`") for c in order), F.lit(0)))


def remaining(plan: DataFrame, done: DataFrame, keys: list[str], target: str, count: str) -> DataFrame:
    """Plan rows with accepted frames and what is left, never below 0."""
    return plan.join(done.select(*keys, F.col(count).alias("accepted")), keys, "left").withColumn("accepted", F.coalesce("accepted", F.lit(0))).withColumn("remaining", F.greatest(F.lit(0), F.col(target) - F.col("accepted")))


def progress(work: DataFrame, key: str) -> DataFrame:
    """Accepted, remaining and complete for each target."""
    return work.groupBy(key).agg(F.sum("accepted").alias("accepted"), F.sum("remaining").alias("remaining"), F.bool_and(F.col("remaining") == 0).alias("complete"))


def next_index(files: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The number for the next file."""
    return files.groupBy(*keys).agg((F.coalesce(F.max(index), F.lit(0)) + 1).alias("next_index"))


def plan_totals(plan: DataFrame, keys: list[str], exposure: str, count: str) -> DataFrame:
    """Exposure time and frames of each session."""
    return plan.groupBy(*keys).agg(F.sum(F.col(exposure) * F.col(count)).alias("seconds"), F.sum(count).alias("frames"))


def renumber(files: DataFrame, keys: list[str], order: list[str], width: int = 5) -> DataFrame:
    """Consecutive numbers from 1 over all directories of a key, as text of a fixed width."""
    return numbered(files, keys, order, "number").withColumn("number", F.col("number").cast("int")).withColumn("number_text", F.format_string(f"%0{width}d", "number"))


def unique_names(files: DataFrame, keys: list[str], base: str, path: str) -> DataFrame:
    """Base for the first file of a name, base__hash for others, base__hash_k where even that is taken."""
    digest = content_name(F.col(path), digits=10)
    first = F.row_number().over(Window.partitionBy(*keys, base).orderBy(path))
    files = files.withColumn("_first", first).withColumn("_hash", digest)
    again = F.row_number().over(Window.partitionBy(*keys, base, "_hash", F.col("_first") == 1).orderBy(path))
    tail = F.when(again > 1, F.concat(F.lit("_"), (again - 1).cast("string"))).otherwise("")
    name = F.when(F.col("_first") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("__"), F.col("_hash"), tail))
    return files.withColumn("link_name", name).drop("_first", "_hash")


def plan_violations(plan: DataFrame, identity: str, safe_name: str, exposure: str, frames: str, dither: str) -> DataFrame:
    """(identity, rule) for each broken rule: duplicates, no exposure, no frames, dither below 1."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    rules = {
        "duplicate_identity": n(identity) > 1, "duplicate_name": n(safe_name) > 1, "exposure": F.coalesce(F.col(exposure) <= 0, F.lit(True)),
        "frames": F.coalesce(F.col(frames) <= 0, F.lit(True)), "dither": F.coalesce(F.col(dither) < 1, F.lit(False)),
    }
    marks = F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])
    return plan.withColumn("_rules", marks).select(F.col(identity).alias("identity"), F.explode(F.array_compact("_rules")).alias("rule"))
