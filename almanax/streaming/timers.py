"""State that ends by event time: ephemerides that expire, epochs that are closed, statistics by the second, and the live sky.

All need the RocksDB state store. Streams carry their arrival as the event time, with a watermark; timers fire as it passes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from almanax.functions.timescales import VALIDITY_MS
from almanax.sources import bits

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(times: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in pd.to_datetime(times, utc=True)]


class Validity(StatefulProcessor):
    """A satellite is valid from an ephemeris on until its system's validity has passed since the last one came.

    Repeated and older ephemerides change nothing. A later one moves the end. The state is removed with the end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "arrival_ms long, until_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        newest = max((t for part in rows for t in _millis(part["arrival"])), default=None)
        known = self.last.get() if self.last.exists() else None
        if newest is None or (known and newest <= known[0]):
            return
        until = newest + VALIDITY_MS.get(key[0][:1], 7_200_000)
        if known:
            self.handle.deleteTimer(known[1])
        self.last.update((newest, until))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"prn": [key[0]], "state": ["valid"], "at_ms": [newest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and self.last.get()[1] == until:
            self.last.clear()
            yield pd.DataFrame({"prn": [key[0]], "state": ["expired"], "at_ms": [until]})

    def close(self) -> None:
        pass


def validity(ephemerides: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """prn, state and at_ms: a row as a satellite's ephemeris comes, and one as the last of them expires. ephemerides: prn and arrival."""
    rows = ephemerides.select("prn", "arrival").withWatermark("arrival", lateness)
    return rows.groupBy("prn").transformWithStateInPandas(Validity(), "prn string, state string, at_ms long", "Append", "EventTime")


class Epochs(StatefulProcessor):
    """The messages of an epoch, which is closed by a message that says none follows, or when none has come for a while.

    A message of another epoch closes the one at hand as well. A message that comes twice counts once.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "epoch_ms long, messages array<int>, signals int, until_ms long")

    def _closed(self, key, how: str) -> pd.DataFrame:
        epoch, messages, signals, until = self.open.get()
        self.handle.deleteTimer(until)
        self.open.clear()
        return pd.DataFrame({"mountpoint": [key[0]], "system": [key[1]], "epoch_ms": [epoch], "messages": [len(messages)], "signals": [signals], "closed_by": [how]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for arrival, epoch, message, signals, more in zip(_millis(every["arrival"]), every["epoch_ms"], every["message_type"], every["n_signals"], every["more"], strict=True):
            if self.open.exists() and self.open.get()[0] != epoch:
                yield self._closed(key, "next")
            known = self.open.get() if self.open.exists() else (int(epoch), [], 0, 0)
            if message not in known[1]:
                if known[3]:
                    self.handle.deleteTimer(known[3])
                until = arrival + self.wait_ms
                self.open.update((int(epoch), [*known[1], int(message)], known[2] + int(signals), until))
                self.handle.registerTimer(until)
            if not more:
                yield self._closed(key, "last")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists() and self.open.get()[3] == expiredTimerInfo.getExpiryTimeInMs():
            yield self._closed(key, "timer")

    def close(self) -> None:
        pass


def more_follows(payload):
    """The bit of an observation message that says that others of its epoch follow."""
    return bits.bit_field(payload, 54, 1) == 1


def closed_epochs(messages: DataFrame, wait_ms: int = 2000, lateness: str = "10 seconds") -> DataFrame:
    """mountpoint, system, epoch_ms, messages, signals and closed_by (last, next or timer) of each epoch of a system.

    messages: mountpoint, system, arrival, epoch_ms, message_type, n_signals and more (see more_follows).
    """
    rows = messages.withWatermark("arrival", lateness)
    return rows.groupBy("mountpoint", "system").transformWithStateInPandas(Epochs(wait_ms), "mountpoint string, system string, epoch_ms long, messages int, signals int, closed_by string", "Append", "EventTime")


class Snapshots(StatefulProcessor):
    """Running totals of a mountpoint, told at the end of each second in which frames came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.total = handle, handle.getValueState("total", "frames long, bytes long")
        self.seconds = handle.getMapState("seconds", "second long", "frames long, bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            part = part.assign(second=[t // 1000 for t in _millis(part["arrival"])])
            for second, some in part.groupby("second"):
                # what is later than its second's snapshot is in the next
                at = max(int(second), timerValues.getCurrentWatermarkInMs() // 1000)
                frames, size = self.seconds.getValue((at,)) if self.seconds.containsKey((at,)) else (0, 0)
                self.seconds.updateValue((at,), (frames + len(some), size + int(some["length"].sum()) + 6 * len(some)))
                self.handle.registerTimer(1000 * (at + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        second = (end // 1000 - 1,)
        if self.seconds.containsKey(second):
            frames, size = self.seconds.getValue(second)
            self.seconds.removeKey(second)
            before = self.total.get() if self.total.exists() else (0, 0)
            now = (before[0] + frames, before[1] + size)
            self.total.update(now)
            yield pd.DataFrame({"mountpoint": [key[0]], "at_ms": [end], "frames": [now[0]], "bytes": [now[1]]})

    def close(self) -> None:
        pass


def snapshots(frames: DataFrame, lateness: str = "2 seconds") -> DataFrame:
    """mountpoint, at_ms, frames and bytes so far, at the end of each second with frames. frames: mountpoint, arrival and length."""
    rows = frames.select("mountpoint", "arrival", "length").withWatermark("arrival", lateness)
    return rows.groupBy("mountpoint").transformWithStateInPandas(Snapshots(), "mountpoint string, at_ms long, frames long, bytes long", "Append", "EventTime")


def live_sky(ephemerides: DataFrame, signals: DataFrame, lateness: str = "10 seconds", payload: str = "e") -> DataFrame:
    """prn, ts, cn0, arrival and payload: each signal with the last ephemeris of its satellite that had come, and isn't expired.

    ephemerides: prn, arrival and payload; signals: prn, ts and cn0, one per satellite and time. On streams a join of both by
    intervals, whose state ends with the watermarks: a row comes out when these have passed it by the longest validity, as till then
    an ephemeris is kept, and what is later than the lateness is dropped. On tables the same rows at once. Signals without an
    ephemeris have no row.
    """
    e = ephemerides.select(F.col("prn").alias("_prn"), "arrival", payload).withWatermark("arrival", lateness)
    s = signals.select("prn", "ts", "cn0").withWatermark("ts", lateness)
    longest = max(VALIDITY_MS.values()) // 1000
    limit = F.lit(7_200_000)
    for system, ms in VALIDITY_MS.items():
        limit = F.when(F.substring("prn", 1, 1) == system, F.lit(ms)).otherwise(limit)
    both = s.join(e, (F.col("prn") == F.col("_prn")) & (F.col("arrival") <= F.col("ts")) & (F.col("arrival") >= F.col("ts") - F.expr(f"interval {longest} seconds")))
    both = both.where(F.unix_millis("ts") - F.unix_millis("arrival") <= limit)
    last = both.groupBy("prn", "ts").agg(F.max_by(F.struct("cn0", "arrival", payload), "arrival").alias("m"))
    return last.select("prn", "ts", "m.cn0", "m.arrival", f"m.{payload}")
