"""Observing logs: capture and autofocus lines, focus models, image noise texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions.scalar import finite, frame_kind, half_even, months_ago
from noctua.operators.joins import captures_at
from noctua.operators.stats import clipped_line_fit, line_fit


def analyze_events(lines: DataFrame) -> DataFrame:
    """Typed events of log lines (file, line, value): file, line, event, started, elapsed, and the event's fields.

    Lines of other kinds, and values that do not parse, give NULLs rather than errors."""
    f = F.split("value", ",")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    event = at(0)
    started = F.when(event == "AnalyzeStartTime", F.try_to_timestamp(F.regexp_extract(at(1), r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?", 0)))
    capture, focus = event == "CaptureComplete", event == "AutofocusComplete"
    return lines.where(event.isin("AnalyzeStartTime", "CaptureComplete", "AutofocusComplete")).select(
        "file", "line", event.alias("event"), started.alias("started"), F.when(capture | focus, finite(at(1))).alias("elapsed"),
        F.when(capture, finite(at(2))).alias("exposure_s"), F.when(capture, at(3)).when(focus, at(4)).alias("filter"),
        F.when(capture, finite(at(4))).alias("hfr"), F.when(capture, at(5)).alias("path"),
        F.when(focus, finite(at(2))).alias("temperature"), F.when(focus, at(5)).alias("points"),
    )


def captures(events: DataFrame, now=None, months: int | None = None) -> DataFrame:
    """Captures with their time and kind; of the last `months` calendar months if asked for."""
    got = captures_at(events.withColumn("elapsed", F.when(F.col("event") == "CaptureComplete", F.col("elapsed"))), "file", "line", "started", "elapsed")
    got = got.withColumn("kind", frame_kind(F.col("path")))
    return got.where(months_ago(F.col("at"), now) < months) if months else got


def focus_results(events: DataFrame) -> DataFrame:
    """Autofocus lines with the position of the smallest radius among `position|radius|...` points."""
    p = F.split("points", r"\|")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: F.struct(F.get(p, 2 * i + 1).try_cast("double").alias("hfr"), F.get(p, 2 * i).try_cast("double").alias("position")))
    best = F.array_min(F.filter(F.when(F.size(p) >= 2, pairs), lambda s: s["hfr"].isNotNull()))
    got = captures_at(events.withColumn("elapsed", F.when(F.col("event") == "AutofocusComplete", F.col("elapsed"))), "file", "line", "started", "elapsed")
    return got.select("file", "at", "filter", "temperature", best["position"].alias("focus_position"), best["hfr"].alias("hfr"))


def focus_model(rows: DataFrame, name: str, temperature: str, position: str, reference: str, least: int = 5, sigma: float = 3.0, r2_min: float | None = None) -> DataFrame:
    """A clipped line for each filter with at least `least` rows: slope (2 digits), intercept (1), r2 (4) of the
    inliers, n, and the offset of the intercept to the reference filter's (to 0 if that is missing)."""
    few = rows.groupBy(name).agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select(F.col(name).alias("_f"))
    _, marked = clipped_line_fit(rows.join(few, F.col(name) == F.col("_f")).drop("_f"), [name], temperature, position, sigma)
    fit = line_fit(marked, [name], temperature, position, F.col("inlier"))
    base = fit.where(F.col(name) == reference).agg(F.coalesce(F.max("intercept"), F.lit(0.0)).alias("_base"))  # one row
    got = fit.crossJoin(F.broadcast(base)).select(name, half_even(F.col("slope"), 2).alias("slope"), half_even(F.col("intercept"), 1).alias("intercept"), half_even(F.col("r2"), 4).alias("r2"), "n", half_even(F.col("intercept") - F.col("_base"), 1).alias("offset"))
    return got.where(F.col("r2") >= r2_min) if r2_min is not None else got


def snr(rows: DataFrame, mean: str, background: str, sigma: str) -> DataFrame:
    """(mean - background) / sigma, 0 where sigma is 0."""
    return rows.withColumn("snr", F.when(F.col(sigma) == 0, 0.0).otherwise((F.col(mean) - F.col(background)) / F.col(sigma)))
