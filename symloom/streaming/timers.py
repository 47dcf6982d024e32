"""Progress streams with state and timers: stalls and throttling, decided while they happen.

Each file's state is a few numbers; timers end what no further event ends. Streams with these
processors need the RocksDB state store (``use_timers`` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from symloom.streaming.progress import THROTTLE_MS, stall_timeout

STALLED = "path string, stalled_from timestamp, seconds double, n_events long, closed boolean"
KEPT = "path string, ts timestamp, seq long, last boolean"


def use_timers(spark: SparkSession) -> None:
    """Have the session's streams keep state where timers are possible."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(times: pd.Series) -> list[int]:
    # timestamps come without a zone, in the session's; differences are all that counts
    return (pd.to_datetime(times).astype("datetime64[us]").astype("int64")).tolist()


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Stalls(StatefulProcessor):
    """Last event, its timeout and the events so far; a timer runs from each batch of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ts long, timeout_ms long, n long, stalled boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        times, limits = _micros(frame["ts"]), (frame["timeout_s"] * 1000).astype("int64").tolist()
        last, limit, n, stalled = self.state.get() if self.state.exists() else (None, None, 0, False)
        out = []
        for t, own in zip(times, limits, strict=True):
            # a gap in the events themselves is a stall that is over; one that a timer told is told
            if last is not None and t - last > limit * 1000 and not stalled:
                out.append((key[0], _time(last), (t - last) / 1e6, n, True))
            if last is None or t >= last:
                last, limit, stalled = t, own, False
            n += 1
        self.state.update((last, limit, n, stalled))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + limit)
        yield pd.DataFrame(out, columns=["path", "stalled_from", "seconds", "n_events", "closed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, limit, n, _ = self.state.get()
        self.state.update((last, limit, n, True))
        yield pd.DataFrame([(key[0], _time(last), limit / 1000, n, False)], columns=["path", "stalled_from", "seconds", "n_events", "closed"])

    def close(self) -> None:
        pass


def stall_alerts(events: DataFrame, files: DataFrame | None = None, given: float = 300.0) -> DataFrame:
    """Stalls of a stream ``events(path, ts)``, as they happen: ``path, stalled_from, seconds,
    n_events, closed``.

    A file whose last event is longer ago than its timeout has a row by a timer (``closed`` false),
    also if nothing comes any more; a gap that only shows once both its events are there has one
    with ``closed`` true. ``files(path, chars)`` gives timeouts by size (``stall_timeout``), else
    all have ``given`` seconds.
    """
    rows = events.select("path", "ts")
    if files is None:
        rows = rows.withColumn("timeout_s", F.lit(float(given)))
    else:
        rows = rows.join(files.select("path", "chars"), "path", "left").select("path", "ts", stall_timeout(F.coalesce("chars", F.lit(0)), given).alias("timeout_s"))
    return rows.groupBy("path").transformWithStateInPandas(_Stalls(), T._parse_datatype_string(STALLED), "append", "processingTime")


class _Throttle(StatefulProcessor):
    """The last kept time and the event that waits; it is let go if nothing comes after it."""

    def __init__(self, step_ms: int, quiet_ms: int):
        self.step, self.quiet = step_ms * 1000, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "kept long, ts long, seq long, waits boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        kept, ts, seq, waits = self.state.get() if self.state.exists() else (None, None, None, False)
        out = []
        for t, own in zip(_micros(frame["ts"]), frame["seq"].tolist(), strict=True):
            if ts is not None and t < ts:
                continue  # late: what comes after it is told already
            ts, seq, waits = t, own, True
            if kept is None or t - kept >= self.step:
                out.append((key[0], _time(t), own, False))
                kept, waits = t, False
        self.state.update((kept, ts, seq, waits))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame(out, columns=["path", "ts", "seq", "last"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, ts, seq, waits = self.state.get()
        if waits:  # a file's last event is always told
            self.state.update((ts, ts, seq, False))
            yield pd.DataFrame([(key[0], _time(ts), seq, True)], columns=["path", "ts", "seq", "last"])
        else:
            yield pd.DataFrame([], columns=["path", "ts", "seq", "last"])

    def close(self) -> None:
        pass


def throttled(events: DataFrame, step_ms: int = THROTTLE_MS, quiet_ms: int = 2000) -> DataFrame:
    """A stream's events ``path, ts, seq`` thinned out as ``throttle`` does: the first, those
    ``step_ms`` or more after the last kept one, and, after ``quiet_ms`` without another, the last
    (``last`` is true)."""
    return events.select("path", "ts", F.col("seq").cast("long").alias("seq")).groupBy("path").transformWithStateInPandas(_Throttle(step_ms, quiet_ms), T._parse_datatype_string(KEPT), "append", "processingTime")
