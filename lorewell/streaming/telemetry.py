"""Streaming forms: bucket means with late data, and job transitions with kept state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that timers need, by the name of its setting.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def bucket_means(samples: DataFrame, bucket: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(series, start, value, n) of (ts timestamp, series, value); buckets close when the watermark passes them."""
    windows = samples.withWatermark("ts", late).groupBy(F.window("ts", bucket), "series").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return windows.select("series", F.col("window.start").alias("start"), "value", "n")


def transitions(states: DataFrame) -> DataFrame:
    """(job, ts, kind): start and end where a job's running mark changes, across micro-batches whose rows come in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, running in zip(rows["ts"], rows["running"], strict=True):
            if running != was:
                out.append((key[0], ts, "start" if running else "end"))
            was = bool(running)
        state.update((was,))
        yield pd.DataFrame(out, columns=["job", "ts", "kind"])

    return states.groupBy("job").applyInPandasWithState(step, "job string, ts double, kind string", "running boolean", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Holds a job's rows until the watermark passes them, then takes them by time; a timer a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "ts timestamp, running boolean")
        self.was = handle.getValueState("was", "running boolean")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts.to_pydatetime(), bool(r.running)) for part in rows for r in part.itertuples()]
        self.rows.appendList(new)
        for ts in {ts for ts, _ in new}:
            self.handle.registerTimer(_millis(ts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.rows.get())
        due, later = [r for r in rows if _millis(r[0]) <= passed], [r for r in rows if _millis(r[0]) > passed]
        out, was = [], self.was.get()[0] if self.was.exists() else False
        for ts, running in due:
            if running != was:
                out.append((key[0], ts, "start" if running else "end"))
            was = running
        if due:
            self.was.update((was,))
            if later:
                self.rows.put(later)
            else:
                self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["job", "ts", "kind"])

    def close(self) -> None:
        pass


def _millis(ts) -> int:
    """Milliseconds of a time, rounded up, so that a timer is not due before its row."""
    return math.ceil(pd.Timestamp(ts).value / 1e6)


def ordered_transitions(states: DataFrame, late: str = "1 minute") -> DataFrame:
    """(job, ts, kind) as the batch form gives it for (job, ts timestamp, running), in whatever order rows arrive within ``late``.

    A row waits until the watermark passes it, so that the last ones of a stream come out once later
    rows, of any job, have moved the watermark.  Of rows of one time, false comes before true.  Rows later than the
    watermark are dropped, as by any watermark.  State is a job's rows of ``late`` and one mark; it lives in RocksDB,
    which the session must name as its state store (``ROCKS``).
    """
    return states.select("job", "ts", "running").withWatermark("ts", late).groupBy("job").transformWithStateInPandas(statefulProcessor=_InOrder(), outputStructType="job string, ts timestamp, kind string", outputMode="append", timeMode="EventTime")


def write_idempotently(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of a micro-batch whose key is not written yet: a replayed batch adds nothing."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")
