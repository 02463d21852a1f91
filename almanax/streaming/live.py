"""Structured Streaming: framing of byte streams, running statistics, latest ephemerides, recording and windows.

chunks is a stream of mountpoint, seq, arrival (timestamp) and data (binary).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almanax.sources import rtcm
from almanax.sources.files import filesystem

POINTER = "_latest"
FRAME = "mountpoint string, arrival timestamp, message_type int, length int, payload binary"


def _framed(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bytes that may begin a frame wait in the state for the next chunk."""
    rest = state.get[0] if state.exists else b""
    chunks = pd.concat(list(groups)).sort_values("seq")
    rows = []
    for arrival, data in zip(chunks["arrival"], chunks["data"], strict=True):
        found, rest = rtcm.frames(rest + bytes(data))
        rows += [(key[0], arrival, rtcm.message_type(p), len(p), p) for p in found]
    yield pd.DataFrame(rows, columns=["mountpoint", "arrival", "message_type", "length", "payload"])
    state.update((rest,))


def framed(chunks: DataFrame) -> DataFrame:
    """Frames of every mountpoint's bytes, carried over from chunk to chunk."""
    return chunks.groupBy("mountpoint").applyInPandasWithState(_framed, FRAME, "rest binary", "append", GroupStateTimeout.NoTimeout)


def statistics(frames: DataFrame) -> DataFrame:
    """Per mountpoint and message type: frames, bytes, first and last arrival and frames per second."""
    out = frames.groupBy("mountpoint", "message_type").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("length") + 6).alias("bytes"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
    seconds = (F.unix_millis("last") - F.unix_millis("first")) / 1000
    return out.withColumn("rate", F.when(seconds > 0, F.col("frames") / seconds))


def signals(frames: DataFrame) -> DataFrame:
    """Signals of observation messages: mountpoint, arrival, system, epoch_ms and a signal's fields."""
    m = frames.select("mountpoint", "arrival", rtcm.msm("payload").alias("m")).where("m is not null")
    return m.select("mountpoint", "arrival", "m.message_type", "m.system", "m.epoch_ms", F.explode("m.signals").alias("s")).select("mountpoint", "arrival", "message_type", "system", "epoch_ms", "s.*")


def ephemerides(frames: DataFrame) -> DataFrame:
    return rtcm.expanded(frames, rtcm.ephemeris(F.col("payload")), "arrival")


def latest_ephemerides(frames: DataFrame) -> DataFrame:
    """The last ephemeris of each satellite; for update or complete mode."""
    e = ephemerides(frames)
    rest = [c for c in e.columns if c != "prn"]
    return e.groupBy("prn").agg(F.max_by(F.struct(*rest), "arrival").alias("e")).select("prn", "e.*")


def stations(frames: DataFrame) -> DataFrame:
    """The last reference point and description of each mountpoint's stations; for update or complete mode."""
    both = F.struct(rtcm.station(F.col("payload")).alias("p"), rtcm.description(F.col("payload")).alias("d"))
    # a generator, as Spark else decodes both once more for the filter
    rows = frames.select("mountpoint", "arrival", F.inline(F.filter(F.array(both), lambda m: m["p"].isNotNull() | m["d"].isNotNull())))
    number = F.coalesce("p.station", "d.station").alias("station")
    last = rows.groupBy("mountpoint", number).agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("arrival"))).alias("p"), F.max_by("d", F.when(F.col("d").isNotNull(), F.col("arrival"))).alias("d"))
    return last.select("mountpoint", "station", *[f"p.{c}" for c in ("itrf", "x", "y", "z", "height")], *[f"d.{c}" for c in (*rtcm.DESCRIPTION, "setup")])


def recorded(signal_rows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Epochs to the nearest 10 ms, each counted once however many messages it has."""
    key = (F.floor(F.col("epoch_ms") / 10 + 0.5) * 10).alias("epoch_ms")
    return signal_rows.select("mountpoint", "arrival", key).withWatermark("arrival", lateness).dropDuplicatesWithinWatermark(["mountpoint", "epoch_ms"])


def publish_status(latest: DataFrame, path: str, checkpoint: str):
    """Keep the latest ephemeris table as a folder per batch and a pointer to the last: readers never see half a table.

    The folder of the batch before stays for those who still read it; older ones are removed.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        files, root, _ = filesystem(path)
        with files.open_output_stream(f"{root}/{POINTER}", compression=None) as out:
            out.write(str(number).encode())
        for old in files.get_file_info(fs.FileSelector(root)):
            if old.base_name.startswith("batch=") and int(old.base_name.removeprefix("batch=")) < number - 1:
                files.delete_dir(old.path)

    return latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The table that publish_status wrote last."""
    files, root, _ = filesystem(path)
    with files.open_input_stream(f"{root}/{POINTER}", compression=None) as src:
        return spark.read.parquet(f"{path}/batch={int(src.read())}")


def retry_wait(failures: int, most_s: int = 60) -> int:
    """Seconds before the next attempt of a source to connect: doubling, bounded."""
    return min(2 * 2**failures, most_s)


class ChannelCache(StatefulProcessor):
    """Last known GLONASS channel of each satellite of a connection; a new connection starts anew, as its key differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.channel = handle.getValueState("channel", "channel int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        known = self.channel.get()[0] if self.channel.exists() else None
        for chunk in rows:
            for value in chunk["channel"].dropna():
                known = int(value)
        if known is not None:
            self.channel.update((known,))
            yield pd.DataFrame({"connection": [key[0]], "prn": [key[1]], "channel": [known]})

    def close(self) -> None:
        pass


def channels(rows: DataFrame) -> DataFrame:
    """connection, prn and channel, from a stream with nullable channels."""
    return rows.groupBy("connection", "prn").transformWithStateInPandas(ChannelCache(), "connection string, prn string, channel int", "Update", "None")


def windowed(rows: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes", at: str = "ts", value: str = "value", key: str = "event_type") -> DataFrame:
    """Counts and sums by event time, tumbling or sliding; late rows within the lateness count. An extension of our own."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.withWatermark(at, lateness).groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", key, "n", "total")


def sessions(rows: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes", at: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key, ended by a gap. An extension of our own."""
    return rows.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
