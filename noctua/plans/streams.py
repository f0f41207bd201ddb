"""Queries of streams.  The events arrive as files in parts that overlap in time, with late rows among them; each part is
processed with what is then available and stops, and the state lives on in the checkpoint between the runs.  The rows are
those of the rule's SQL over all events that were not late."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.plans.base import ORACLE_SQL, Tables, query
from noctua.plans.sky import _states
from noctua.session import shared_dir
from noctua.streaming import telemetry

HOUR = 3_600_000_000
#: Events that come after the watermark has passed them: those of every eleventh id from before two days before the middle.
MIDDLE = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)"
ON_TIME = f"timely AS (SELECT * FROM events WHERE NOT (event_id % 11 = 0 AND epoch_us(ts) < {MIDDLE} - 48 * {HOUR}))"


def on_time(sql: str) -> str:
    """The SQL over the events that are not late."""
    sql = re.sub(r"\bFROM events\b", "FROM timely", sql).strip()
    head, rest = next(((h, "," + sql.removeprefix(h)) for h in ("WITH RECURSIVE", "WITH") if sql.startswith(h)), ("WITH", sql))
    return f"{head} {ON_TIME} {rest}"


def _streamed(t: Tables, events: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `rule` gives, with a delay of a day, for events that come in two parts: rows of the last hours before the middle of
    their time come only with the second part, out of order, and so do rows that are too late by then.  A last
    event, of no user, ends the wait for all others."""
    home = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    at = F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    middle = (low + high) // 2
    disordered = (F.col("event_id") % 7 == 0) & (at >= middle - 12 * HOUR)
    late = (F.col("event_id") % 11 == 0) & (at < middle - 48 * HOUR)
    first = (at < middle) & ~disordered & ~late
    end = events.limit(1).select(*[F.timestamp_micros(F.lit(high + 2400 * HOUR)).alias(c) if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
    for part in (events.where(first), events.where(~first), end):
        part.write.mode("append").parquet(f"{home}/in")
        found = rule(t.spark.readStream.schema(events.schema).parquet(f"{home}/in"))
        run = found.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{home}/out").where("user_id is not null")


@query("t2_drift_stream", on_time(ORACLE_SQL["t2_drift_alerts"]))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", "value")
    got = _streamed(t, e, lambda s: telemetry.drift_stream(s, "user_id", "ts", "value", 50, 3600, "1 day", "event_id"))
    return got.select("user_id", F.unix_micros("alert_at").alias("alert_at"))


@query("t5_transition_stream", on_time(ORACLE_SQL["t5_roof_transitions"].replace("SELECT event_id FROM p", "SELECT user_id, epoch_us(ts) AS at FROM p")))
def _(t: Tables):
    e = _states(t).select("user_id", "event_id", "ts", "state")
    return _streamed(t, e, lambda s: telemetry.transition_stream(s, "user_id", "ts", "state", delay="1 day", tie="event_id")).select("user_id", F.unix_micros("at").alias("at"))


@query("t6_unknown_stream", on_time("""
WITH s AS (SELECT *, value < 60 AS bad, lag(value < 60) OVER w AS before, max(CASE WHEN value >= 60 THEN 1 ELSE 0 END) OVER w AS seen,
  min(CASE WHEN value >= 60 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS known_again
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, epoch_us(ts) AS since, epoch_us(ts) + 7200000000 AS warned_at FROM s WHERE bad AND NOT coalesce(before, true) AND seen = 1 AND (known_again IS NULL OR known_again > epoch_us(ts) + 7200000000)
"""))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", F.when(F.col("value") < 60, "UNKNOWN").otherwise("OPEN").alias("state"))
    got = _streamed(t, e, lambda s: telemetry.unknown_stream(s, "user_id", "ts", "state", 7200, "1 day", tie="event_id"))
    return got.select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("warned_at").alias("warned_at"))


@query("t8_latch_stream", on_time(ORACLE_SQL["t8_latched_levels"]))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", "value")
    return _streamed(t, e, lambda s: telemetry.latch_stream(s, "user_id", "ts", "value", 20, 5, "1 day")).withColumn("at", F.unix_micros("at"))


@query("t15_failure_stream", on_time(ORACLE_SQL["t15_failure_limits"].replace("SELECT event_id FROM i", "SELECT user_id, epoch_us(ts) AS at FROM i")))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", (F.col("value") > 50).alias("failed"))
    return _streamed(t, e, lambda s: telemetry.failure_stream(s, "user_id", "ts", "failed", 3, "1 day", "event_id")).select("user_id", F.unix_micros("at").alias("at"))


@query("t1_rms_stream", on_time(ORACLE_SQL["t1_sliding_rms"].replace("SELECT event_id,", "SELECT user_id, epoch_us(ts) AS at,")))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", "value", (F.col("value") - 50).alias("dec"))
    got = _streamed(t, e, lambda s: telemetry.rms_stream(s, "user_id", "ts", "value", "dec", 86400, "1 day"))
    return got.select("user_id", F.unix_micros("at").alias("at"), F.round("rms_ra", 6).alias("rms_ra"), F.round("rms_dec", 6).alias("rms_dec"))


#: A file's length is what its user had bought by then, rounded; each event is a sighting of the user's file.
@query("t11_stable_file_stream", on_time("""
WITH g AS (SELECT *, CAST(floor(value / 20) AS BIGINT) AS length FROM events), s AS (SELECT *, lag(length) OVER w AS before FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM s WHERE length IS DISTINCT FROM before OR before IS NULL)
SELECT user_id, length, epoch_us(ts) + 14400000000 AS ready_at FROM c WHERE next IS NULL OR next > epoch_us(ts) + 14400000000
"""))
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "ts", F.floor(F.col("value") / 20).cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("mtime"))
    got = _streamed(t, e, lambda s: telemetry.stable_file_stream(s, "user_id", "length", "mtime", "ts", 14400, "1 day", "event_id"))
    return got.select("user_id", "length", F.unix_micros("ready_at").alias("ready_at"))


@query("t13_latest_stream", "SELECT user_id, event_type AS source, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def _(t: Tables):
    home = f"{shared_dir(t.spark)}/status-{uuid.uuid4().hex}"
    e = t.events.select("user_id", F.col("event_type").alias("source"), "ts", "event_id", "value")
    store = telemetry.LatestTable(t.spark, f"{home}/status", ["user_id", "source"], ["ts", "event_id"], "value")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        part.write.mode("append").parquet(f"{home}/in")
        telemetry.run_available(t.spark.readStream.schema(e.schema).parquet(f"{home}/in"), store.upsert, f"{home}/state").awaitTermination()
    return store.read().select("user_id", "source", "value")
