"""Rules over streams in order of event time.

Rows of a key wait as state until the watermark has passed them; an event-time timer then hands them to the rule by time
and ties, whatever the order and the batches they came in.  A rule is a fold: its state after the rows of an instant follows from the
state before.  Rows behind the watermark are dropped before they get here (late_rows counts them), so for the rows that are
not late a stream gives what the batch form of the rule gives.

A key's waiting rows are bounded by what arrives within the watermark's delay.  A rule says when its state says nothing any
more; it then goes, and with it all that is kept of a silent key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """A fold over a key's rows.  state: DDL of its columns; out: DDL of what it gives, without the key."""

    state: str
    out: str

    def rows(self, state: tuple | None, us: int, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        """The state after the rows (values in order of ties) of one instant, in microseconds, and what they give.  A state
        of None says nothing."""
        raise NotImplementedError

    def wake(self, state: tuple) -> int | None:
        """When the state changes by itself."""
        return None

    def pass_time(self, state: tuple, us: int) -> tuple[tuple | None, list[tuple]]:
        """The state, and what it gives, when no row came up to this time."""
        return state, []


class Ordered(StatefulProcessor):
    def __init__(self, rule: Rule, key: str, ties: int, names: list[str], held: str):
        self.rule, self.key, self.ties, self.names, self.schema = rule, key, ties, names, held
        self.columns = [key, *[c.split()[0] for c in rule.out.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.state = handle.getValueState("state", self.rule.state)
        self.timer = handle.getValueState("timer", "at long")

    def _wake_at(self, us: int | None) -> None:
        """A timer for this time, unless there is an earlier one."""
        if us is None:
            return
        ms = -(-us // 1000)
        if not self.timer.exists() or self.timer.get()[0] > ms:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            values = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in self.names]
            self.held.appendList(list(zip(*values, strict=True)))
            first = min(values[0]) if first is None else min(first, *values[0])
        self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        if self.timer.exists() and self.timer.get()[0] * 1000 <= limit:
            self.timer.clear()
        waiting = list(self.held.get()) if self.held.exists() else []
        due, rest = [], []
        for r in waiting:
            (due if r[0] <= limit else rest).append(tuple(r))
        if due:
            self.held.put(rest) if rest else self.held.clear()
        due.sort(key=lambda r: tuple((v is not None, v) for v in r[: 1 + self.ties]))
        state = tuple(self.state.get()) if self.state.exists() else None
        had, given = state is not None, []
        for us, same in groupby(due, key=lambda r: r[0]):
            state, more = self.rule.rows(*self._passed(state, us - 1, given), us, [r[1 + self.ties :] for r in same])
            given += more
        (state,) = self._passed(state, limit, given)
        if state is not None:
            self.state.update(state)
        elif had:
            self.state.clear()
        self._wake_at(min((r[0] for r in rest), default=None))
        self._wake_at(None if state is None else self.rule.wake(state))
        if given:
            yield pd.DataFrame([(key[0], *g) for g in given], columns=self.columns)

    def _passed(self, state: tuple | None, us: int, given: list[tuple]) -> tuple[tuple | None]:
        at = None if state is None else self.rule.wake(state)
        if at is not None and at <= us:
            state, more = self.rule.pass_time(state, us)
            given += more
        return (state,)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, rule: Rule, key: str, t: str, values: list[str], ties: list[str], delay: str) -> DataFrame:
    """key and the rule's columns, for the stream `events`.  values: what the rule reads; ties: the order of rows of one instant."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)  # timers and lists need it
    rows = events.withWatermark(t, delay).select(key, t, F.unix_micros(F.col(t).cast("timestamp")).alias("held_us"), *[F.col(c).alias(f"held_{i}") for i, c in enumerate([*ties, *values])]).where("held_us is not null")
    kinds = dict(rows.dtypes)
    names = ["held_us", *[f"held_{i}" for i in range(len(ties) + len(values))]]
    held = ", ".join(f"{c} {kinds[c]}" for c in names)
    out = f"{key} {kinds[key]}, {rule.out}"
    return rows.groupBy(key).transformWithStateInPandas(Ordered(rule, key, len(ties), names, held), out, "append", "eventTime")


def late_rows(query) -> int:
    """Rows that the runs of a stream have dropped behind its watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


# --- the rules --------------------------------------------------------------------------------------------------------------------


def stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class SlidingRms(Rule):
    """The samples of the last `us` microseconds are the state."""

    state = "at array<long>, ra array<double>, dec array<double>"
    out = "at timestamp, rms_ra double, rms_dec double, rms_total double"

    def __init__(self, us: int):
        self.us = us

    def rows(self, state, us, rows):
        at, ra, dec = ([*x] for x in state) if state else ([], [], [])
        keep = next((i for i, a in enumerate(at) if a >= us - self.us), len(at))
        at, ra, dec = at[keep:] + [us] * len(rows), ra[keep:] + [r[0] for r in rows], dec[keep:] + [r[1] for r in rows]
        means = [(sum(v * v for v in x if v is not None) / n) if (n := sum(v is not None for v in x)) else None for x in (ra, dec)]
        roots = [None if m is None else m**0.5 for m in means]
        both = None if None in means else (means[0] + means[1]) ** 0.5
        return (at, ra, dec), [(stamp(us), *roots, both)] * len(rows)

    def wake(self, state):
        return state[0][-1] + self.us + 1

    def pass_time(self, state, us):
        return None, []  # no sample is near enough to count again


class Drift(Rule):
    """An alert when the value stays above the threshold for more than the timeout, which starts again at the alert."""

    state = "since long"
    out = "alert_at timestamp"

    def __init__(self, threshold: float, timeout_us: float):
        self.threshold, self.timeout = threshold, timeout_us

    def rows(self, state, us, rows):
        since, out = state[0] if state else None, []
        for (value,) in rows:
            if value is None or not value > self.threshold:
                since = None
            elif since is None:
                since = us
            elif us - since > self.timeout:
                since = us
                out.append((stamp(us),))
        return None if since is None else (since,), out


class Transition(Rule):
    """T5: from `before` to `after`."""

    state = "last string"
    out = "at timestamp"

    def __init__(self, before: str, after: str, ignore_unknown: bool):
        self.before, self.after, self.ignore = before, after, ignore_unknown

    def rows(self, state, us, rows):
        last, out = state[0] if state else None, []
        for (now,) in rows:
            if last == self.before and now == self.after:
                out.append((stamp(us),))
            if not self.ignore or (now is not None and now != "UNKNOWN"):
                last = now
        return None if last is None else (last,), out


class Unknown(Rule):
    """A warning when a state has been unknown for the timeout; by time alone, so no later row is needed."""

    state = "since long, warned boolean, seen boolean"
    out = "since timestamp, warned_at timestamp"

    def __init__(self, timeout_us: int, from_start: bool):
        self.timeout, self.from_start = timeout_us, from_start

    def rows(self, state, us, rows):
        since, warned, seen = state or (None, False, self.from_start)
        for (now,) in rows:
            if now is not None and now != "UNKNOWN":
                since, warned, seen = None, False, True
            elif seen and since is None:
                since = us
        return (since, warned, seen), []

    def wake(self, state):
        return None if state[0] is None or state[1] else state[0] + self.timeout

    def pass_time(self, state, us):
        return (state[0], True, state[2]), [(stamp(state[0]), stamp(state[0] + self.timeout))]


class Latch(Rule):
    """The first time below `warning` and the first below `critical`; nothing after it is critical."""

    state = "level int"
    out = "level string, at timestamp"

    def __init__(self, warning: float, critical: float):
        self.warning, self.critical = warning, critical

    def rows(self, state, us, rows):
        level = state[0] if state else 0
        now = max((2 if v < self.critical else 1 if v < self.warning else 0 for (v,) in rows if v is not None), default=0)
        given = [(("", "WARNING", "CRITICAL")[now], stamp(us))] if now > level else []
        return (max(level, now),) if max(level, now) else None, given


class Failures(Rule):
    """The `limit`-th failure in a row."""

    state = "n long"
    out = "at timestamp"

    def __init__(self, limit: int):
        self.limit = limit

    def rows(self, state, us, rows):
        n, out = state[0] if state else 0, []
        for (bad,) in rows:
            n = n + 1 if bad else 0
            if n == self.limit:
                out.append((stamp(us),))
        return (n,) if n else None, out


class StableFile(Rule):
    """A (length, time) of a file that no other followed for a while; each once."""

    state = "length long, mtime timestamp, since long, given boolean"
    out = "length long, mtime timestamp, ready_at timestamp"

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def rows(self, state, us, rows):
        state = tuple(state) if state else None
        for length, mtime in rows:
            if state is None or (state[0], state[1]) != (length, mtime):
                state = (length, mtime, us, False)
        return state, []

    def wake(self, state):
        return None if state[3] else state[2] + self.quiet

    def pass_time(self, state, us):
        return (*state[:3], True), [(state[0], state[1], stamp(state[2] + self.quiet))]
