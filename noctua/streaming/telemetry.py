"""Live telemetry: guide error, drift, roof, safety and file streams.

Each rule has a batch form over stored events (windows and islands) and, where it needs state, a stream form (ordered.py)
that reads a key's rows by event time when the watermark has passed them; both give the same rows for the same events.  Rows
behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.operators.stats import carried
from noctua.streaming.ordered import Drift, Failures, Latch, SlidingRms, StableFile, Transition, Unknown, in_order, late_rows  # noqa: F401

# --- T1: guide error ---------------------------------------------------------------------------------------------------------


def sliding_rms(events: DataFrame, keys: list[str], t: str, ra: str, dec: str, seconds: int = 60) -> DataFrame:
    """rms_ra, rms_dec and rms_total over [t - seconds, t] at every event; events of one instant count together."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(t).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    a, d = F.avg(F.col(ra) * F.col(ra)).over(w), F.avg(F.col(dec) * F.col(dec)).over(w)
    return events.withColumns({"rms_ra": F.sqrt(a), "rms_dec": F.sqrt(d), "rms_total": F.sqrt(a + d)})


def windowed_rms(events: DataFrame, keys: list[str], t: str, ra: str, dec: str, length: str = "60 seconds", slide: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """T1, coarse, for batch and stream: the same in sliding windows; late rows are those behind the watermark."""
    e = events.withWatermark(t, delay) if events.isStreaming else events
    g = e.groupBy(*keys, F.window(t, length, slide)).agg(F.avg(F.col(ra) * F.col(ra)).alias("_a"), F.avg(F.col(dec) * F.col(dec)).alias("_d"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", F.sqrt("_a").alias("rms_ra"), F.sqrt("_d").alias("rms_dec"), F.sqrt(F.col("_a") + F.col("_d")).alias("rms_total"))


def rms_stream(events: DataFrame, key: str, t: str, ra: str, dec: str, seconds: int = 60, delay: str = "30 seconds") -> DataFrame:
    """T1, exact, as a stream: key, at, rms_ra, rms_dec, rms_total of every event, when the watermark has passed it; the
    state of a key is its events of the last `seconds`, and goes when they are over."""
    return in_order(events, SlidingRms(seconds * 1_000_000), key, t, [ra, dec], [], delay)


# --- T2: sustained drift -------------------------------------------------------------------------------------------------------


class DriftClock:
    """An alert when the value stays above the threshold for more than the timeout; the clock starts at the first such
    sample, starts again at an alert's sample, and any sample at or below the threshold clears it."""

    def __init__(self, threshold: float, timeout: float, since: float | None = None):
        self.threshold, self.timeout, self.since = threshold, timeout, since

    def add(self, t: float, value: float | None) -> bool:
        if value is None or not value > self.threshold:
            self.since = None
            return False
        if self.since is None:
            self.since = t
            return False
        if t - self.since > self.timeout:
            self.since = t
            return True
        return False


def _numbers(pdf: pd.DataFrame, t: str) -> list[float]:
    return (pd.to_datetime(pdf[t]).astype("int64") / _unit(pdf[t])).tolist()


def _unit(s: pd.Series) -> float:
    return {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(s.dtype, "unit", "ns")]


def drift_alerts(events: DataFrame, key: str, t: str, value: str, threshold: float, timeout: float, tie: str) -> DataFrame:
    """T2 over stored events: key, alert_at.  Each alert restarts the clock at its own sample, so a key's rows are folded in
    order; they stream through a task, which holds one clock and one batch whatever the key's number of rows."""
    rows = events.select(key, t, value, tie).repartition(key).sortWithinPartitions(key, t, tie).drop(tie)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, clock = object(), DriftClock(threshold, timeout)
        for pdf in frames:
            hits = []
            for k, a, b in zip(pdf[key].tolist(), _numbers(pdf, t), pdf[value].tolist(), strict=True):
                if k != last:
                    last, clock = k, DriftClock(threshold, timeout)
                hits.append(clock.add(a, b))
            yield pdf.loc[hits, [key, t]].rename(columns={t: "alert_at"})

    kind = dict(events.dtypes)
    return rows.mapInPandas(fold, f"{key} {kind[key]}, alert_at {kind[t]}")


def drift_stream(events: DataFrame, key: str, t: str, value: str, threshold: float, timeout: float, delay: str = "30 seconds", tie: str | None = None) -> DataFrame:
    """T2 as a stream: key, alert_at; the state of a key is the start of its clock, if it runs."""
    return in_order(events, Drift(threshold, timeout * 1e6), key, t, [value], [tie] if tie else [], delay)


# --- T3, T4 ----------------------------------------------------------------------------------------------------------------------


def event_alerts(events: DataFrame, event: str, mapping: dict[str, str]) -> DataFrame:
    """Events that mean an alert, with its level."""
    level = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(event)]
    return events.withColumn("level", level).where("level is not null")


def throttled(events: DataFrame, keys: list[str], t: str, tie: str, seconds: int = 10) -> DataFrame:
    """T4, coarse: the first row of every `seconds` of the clock for each key."""
    w = Window.partitionBy(*keys, F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (seconds * 1_000_000))).orderBy(t, tie)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def throttled_exactly(events: DataFrame, key: str, t: str, tie: str, seconds: float = 10) -> DataFrame:
    """T4: key, t, tie of each key's first row and of every row `seconds` or more after the last one given.  What is given
    depends on what was given before, so a key's rows are folded in order, of which a task holds one time and one batch."""
    kind = dict(events.dtypes)
    rows = events.select(key, t, tie).repartition(key).sortWithinPartitions(key, t, tie)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, given = object(), None
        for pdf in frames:
            hits = []
            for k, at in zip(pdf[key].tolist(), _numbers(pdf, t), strict=True):
                if k != last:
                    last, given = k, None
                hits.append(given is None or at - given >= seconds)
                given = at if hits[-1] else given
            yield pdf.loc[hits]

    return rows.mapInPandas(fold, f"{key} {kind[key]}, {t} {kind[t]}, {tie} {kind[tie]}")


# --- T5, T6, W16: states -----------------------------------------------------------------------------------------------------------


def transitions(events: DataFrame, key: str, order: list[str], state: str, before: str = "OPEN", after: str = "CLOSED", ignore_unknown: bool = True) -> DataFrame:
    """Rows where the state goes from `before` to `after`.  With ignore_unknown the last known state counts, so
    OPEN, UNKNOWN, CLOSED is a transition; without, only a direct step is."""
    w = Window.partitionBy(key).orderBy(*order)
    known = F.when(F.col(state) != "UNKNOWN", F.col(state))
    last = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if ignore_unknown else F.lag(state).over(w)
    return events.withColumn("previous_state", last).where((F.col("previous_state") == before) & (F.col(state) == after))


def transition_stream(events: DataFrame, key: str, t: str, state: str, before: str = "OPEN", after: str = "CLOSED", ignore_unknown: bool = True, delay: str = "30 seconds", tie: str | None = None) -> DataFrame:
    """T5 as a stream: key, at; the state of a key is its last state."""
    return in_order(events, Transition(before, after, ignore_unknown), key, t, [state], [tie] if tie else [], delay)


def unknown_warnings(events: DataFrame, key: str, t: str, tie: str, state: str, timeout: float, from_start: bool = False) -> DataFrame:
    """One warning for each run of UNKNOWN that lasts `timeout` seconds or more by a later sample of the run: key,
    since, warned_at.  A key that was never known before warns only with from_start."""
    from noctua.operators.planning import islands

    w = Window.partitionBy(key).orderBy(t, tie)
    seen = F.max((F.col(state) != "UNKNOWN").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = islands(events.withColumn("_seen", seen), [key], [t, tie], F.col(state) == "UNKNOWN")
    start = F.min(t).over(Window.partitionBy(key, "island"))
    late = runs.withColumn("since", start).where(((F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) >= timeout * 1e6) & (F.lit(from_start) | (F.col("_seen") == 1)))
    return late.groupBy(key, "island", "since").agg(F.min(t).alias("warned_at")).drop("island")


def unknown_stream(events: DataFrame, key: str, t: str, state: str, timeout: float, delay: str = "30 seconds", from_start: bool = False, tie: str | None = None) -> DataFrame:
    """T6 as a stream: key, since, warned_at: one warning for each run of UNKNOWN (or NULL) in which no known state comes for
    `timeout` seconds.  An event-time timer gives it, at since + timeout, so it also comes where no later row does.  A
    key that was never known before warns only with from_start."""
    return in_order(events, Unknown(int(timeout * 1e6), from_start), key, t, [state], [tie] if tie else [], delay)


# --- T8, T15 -------------------------------------------------------------------------------------------------------------------------


def latched_levels(events: DataFrame, key: str, t: str, value: str, warning: float, critical: float) -> DataFrame:
    """For each key the first critical time, and the first warning time if it is earlier (below the thresholds is bad);
    the latch never clears: key, level, at."""
    x = events.groupBy(key).agg(F.min(F.when(F.col(value) < critical, F.col(t))).alias("c"), F.min(F.when(F.col(value) < warning, F.col(t))).alias("w"))
    early = F.when(F.col("w").isNotNull() & (F.col("c").isNull() | (F.col("w") < F.col("c"))), F.struct(F.lit("WARNING").alias("level"), F.col("w").alias("at")))
    return x.select(key, F.explode(F.array_compact(F.array(early, F.when(F.col("c").isNotNull(), F.struct(F.lit("CRITICAL").alias("level"), F.col("c").alias("at")))))).alias("a")).select(key, "a.*")


def latch_stream(events: DataFrame, key: str, t: str, value: str, warning: float, critical: float, delay: str = "30 seconds") -> DataFrame:
    """T8 as a stream: key, level, at; the state of a key is its level, which never falls."""
    return in_order(events, Latch(warning, critical), key, t, [value], [], delay)


def failure_limits(events: DataFrame, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """Rows at which the `limit`-th failure in a row happens."""
    from noctua.operators.planning import islands

    runs = islands(events, [key], order, failed)
    n = F.row_number().over(Window.partitionBy(key, "island").orderBy(*order))
    return runs.withColumn("failures", n).where(F.col("failures") == limit)


def failure_stream(events: DataFrame, key: str, t: str, failed: str, limit: int, delay: str = "30 seconds", tie: str | None = None) -> DataFrame:
    """T15 as a stream: key, at of every `limit`-th failure in a row; failed: a boolean column.  The state of a key is its
    number of failures in a row, if any."""
    return in_order(events, Failures(limit), key, t, [failed], [tie] if tie else [], delay)


# --- T7, T9-T14 ----------------------------------------------------------------------------------------------------------------------


def newest_message(messages: DataFrame, keys: list[str], t: str, tie: str, k: int, wanted: Column) -> DataFrame:
    """Of the last k messages of each key the newest wanted one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(t), F.desc(tie))
    x = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).where(wanted)
    return x.withColumn("_m", F.row_number().over(w)).where("_m = 1").drop("_n", "_m")


def alert_stream(parts: Iterable[DataFrame]) -> DataFrame:
    """One table of alerts (source, level, code, message, at) from several."""
    cols = ["source", "level", "code", "message", "at"]
    out = None
    for p in parts:
        out = p.select(*cols) if out is None else out.unionByName(p.select(*cols))
    return out


def history(alerts: DataFrame, n: int = 200, emergency: str = "EMERGENCY") -> tuple[DataFrame, DataFrame]:
    """The last n alerts, and one row that says whether there is an emergency."""
    return alerts.orderBy(F.desc("at"), "source", "code").limit(n), alerts.agg(F.coalesce(F.bool_or(F.col("level") == emergency), F.lit(False)).alias("emergency"))


def stable_files(sightings: DataFrame, path: str, length: str, mtime: str, t: str, seconds: float = 2.0) -> DataFrame:
    """(path, length, mtime) seen unchanged for `seconds`: path, length, mtime, ready_at, once each."""
    first = F.min(t).over(Window.partitionBy(path, length, mtime))
    age = (F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
    return sightings.withColumn("_age", age).where(F.col("_age") >= seconds).groupBy(path, length, mtime).agg(F.min(t).alias("ready_at"))


def stable_file_stream(sightings: DataFrame, path: str, length: str, mtime: str, t: str, seconds: float = 2.0, delay: str = "2 seconds", tie: str | None = None) -> DataFrame:
    """T11 as a stream: path, length, mtime, ready_at of every (path, length, mtime) that was seen and then not replaced by
    another one for `seconds`; each once, by a timer, so a file that rests needs no second sighting."""
    return in_order(sightings, StableFile(int(seconds * 1e6)), path, t, [length, mtime], [tie] if tie else [], delay)


def record_sightings(spark: SparkSession, root: str, store: str, at: Column | None = None) -> None:
    """Append a listing of the image files under root to a Parquet folder, as path, length, modificationTime, seen_at: what
    stable_file_stream reads.  Spark's own file stream lists a path once, so it would not see a file grow."""
    from noctua.sources.files import discover_images

    listing = discover_images(spark, root).select("path", "length", "modificationTime", (F.current_timestamp() if at is None else at).alias("seen_at"))
    listing.write.mode("append").parquet(store)


def run_available(stream: DataFrame, write, checkpoint: str):
    """Process what is new since the last run and stop; write(batch, id) is called for each batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Calibration:
    """Lights calibrated as they come, each tile once.  `add` is for foreachBatch (run_available): tiles that no other
    batch has calibrated are calibrated with the masters and written as the batch's own folder, so a batch that is run again
    writes the same rows in the same place, and a light that comes again is left out."""

    def __init__(self, spark: SparkSession, path: str, darks: DataFrame, dark_keys: list[str], flats: DataFrame, flat_keys: list[str]):
        self.spark, self.path = spark, path
        self.darks, self.dark_keys, self.flats, self.flat_keys = darks, dark_keys, flats, flat_keys

    def read(self, but: int | None = None) -> DataFrame | None:
        """All calibrated tiles, or those of all batches but one; None without any."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        done = sorted(n for n in found if n != f"batch={but}" and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in done]) if done else None

    def add(self, batch: DataFrame, number: int) -> None:
        from noctua.operators.tiles import calibrate_keyed

        tile = ["frame_id", "ty", "tx"]
        new, done = batch.dropDuplicates(tile), self.read(but=number)
        if done is not None:
            new = new.join(done.select(*tile), tile, "left_anti").select(*batch.columns)
        calibrate_keyed(new, self.darks, self.dark_keys, self.flats, self.flat_keys).write.mode("overwrite").parquet(f"{self.path}/batch={number}")


class LatestTable:
    """The newest value of each key, kept up by batches of a stream.  `upsert` is for foreachBatch: the newest rows of
    the batch and of the table become the table's next version, a folder with the batch's number, so a batch that is run
    again gives the same version and readers of the last one are not disturbed; older ones go."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], value: str):
        self.spark, self.path, self.keys, self.order, self.value = spark, path, keys, order, value

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName()) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, below: int | None = None) -> DataFrame | None:
        """The newest version, or the newest before a batch; None without one."""
        found = [v for v in self._versions() if below is None or v < below]
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def upsert(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(*self.keys, *self.order, self.value)
        before = self.read(number)
        rows = rows if before is None else before.unionByName(rows)
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, self.value)).alias("_m"))
        newest.select(*self.keys, *[f"_m.{c}" for c in (*self.order, self.value)]).write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in [v for v in self._versions() if v <= number][:-2]:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def snapshot(updates: DataFrame, key: str, source: str, t: str, tie: str, value: str, sources: list[str]) -> DataFrame:
    """The latest value of every source for each key, as columns."""
    return updates.groupBy(key).pivot(source, sources).agg(F.max_by(value, F.struct(t, tie)))


def with_stale(status: DataFrame, key: str, order: list[str], t: str, value: str, seconds: float) -> DataFrame:
    """last_good, the newest value so far, and stale, if that is older than `seconds`."""
    good = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.unix_micros(F.col(t).cast("timestamp")).alias("us")))
    x = carried(status.withColumn("_good", good), [key], order, "_good", "_last")
    age = (F.unix_micros(F.col(t).cast("timestamp")) - F.col("_last.us")) / 1e6
    return x.withColumns({"last_good": F.col("_last.v"), "stale": F.coalesce(age > seconds, F.lit(True))}).drop("_good", "_last")
