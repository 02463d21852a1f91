"""Streams replayed from files."""

import random
import struct
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from almanax.sources import chunks, rtcm
from almanax.streaming import live, timers


def frame(kind, size=30):
    payload = bytes([kind >> 4, (kind & 15) << 4]) + bytes(size - 2)
    head = bytes([0xD3, size >> 8, size & 255]) + payload
    return head + struct.pack(">I", rtcm.crc24q(head))[1:]


def replay(spark, tmp_path, rows, schema, build, mode="append"):
    """Write each list of rows as a file, stream them one by one, and return what the query gave."""
    folder = tmp_path / "in"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


CHUNK = "mountpoint string, seq long, arrival timestamp, data binary"


def test_frames_cross_chunks(spark, tmp_path):
    whole = frame(1077) + frame(1087, 40) + b"noise" + frame(1005, 20)
    t = datetime(2024, 1, 1)
    cuts = [0, 10, 40, 70, len(whole)]
    rows = [[("M", i, t + timedelta(seconds=i), whole[a:b])] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = replay(spark, tmp_path, rows, CHUNK, live.framed)
    assert sorted(r.message_type for r in got) == [1005, 1077, 1087]


def test_statistics(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[("M", t + timedelta(seconds=i), 1077, 50, b"")] for i in range(3)]
    got = replay(spark, tmp_path, rows, live.FRAME, live.statistics, "complete")
    assert [(r.frames, r.bytes, r.rate) for r in got] == [(3, 168, 1.5)]


def test_windows_drop_late_rows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[(t, "a", 1.0)], [(t + timedelta(minutes=30), "a", 2.0)], [(t + timedelta(minutes=31), "b", 0.0)], [(t, "a", 5.0)], [(t + timedelta(hours=2), "a", 0.0)]]
    got = replay(spark, tmp_path, rows, "ts timestamp, event_type string, value double", live.windowed)
    assert sum(r.total for r in got) == 3.0


def test_status_is_published(spark, tmp_path):
    folder, place = tmp_path / "in", str(tmp_path / "status")
    for i in range(4):
        spark.createDataFrame([(f"G{i:02d}", i), ("G99", i)], "prn string, n int").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("prn string, n int").option("maxFilesPerTrigger", 1).parquet(str(folder)).groupBy("prn").agg({"n": "max"})
    query = live.publish_status(stream.toDF("prn", "n"), place, str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.prn, r.n) for r in live.read_status(spark, place).collect()} == {("G00", 0), ("G01", 1), ("G02", 2), ("G03", 3), ("G99", 3)}
    assert sorted(p.name for p in (tmp_path / "status").glob("batch=*")) == ["batch=2", "batch=3"]


def test_epochs_are_recorded_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[("M", t, 1000), ("M", t, 1004), ("M", t, 1009)], [("M", t + timedelta(seconds=1), 1001), ("N", t + timedelta(seconds=1), 1001)]]
    got = replay(spark, tmp_path, rows, "mountpoint string, arrival timestamp, epoch_ms long", live.recorded)
    assert sorted((r.mountpoint, r.epoch_ms) for r in got) == [("M", 1000), ("M", 1010), ("N", 1000)]


def test_sessions_end_by_a_gap(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[(t, 1), (t + timedelta(minutes=4), 1), (t + timedelta(minutes=10), 1), (t, 2)], [(t + timedelta(hours=3), 9)], [(t + timedelta(hours=6), 9)]]
    got = replay(spark, tmp_path, rows, "ts timestamp, user_id long", live.sessions)
    assert sorted((r.user_id, r.n) for r in got if r.user_id < 9) == [(1, 1), (1, 2), (2, 1)]


def test_channels(spark, tmp_path):
    rows = [[("c1", "R01", 5)], [("c1", "R01", None)], [("c2", "R01", None)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = replay(spark, tmp_path, rows, "connection string, prn string, channel int", live.channels, "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(r.connection, r.channel) for r in got} == {("c1", 5)}


def test_retry_wait():
    assert [live.retry_wait(k) for k in (0, 1, 2, 10)] == [2, 4, 8, 60]


def run_for(build, place, batches=None):
    """Start a query to Parquet files and stop it, after so many batches or when all is done."""
    query = build.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp").start()
    if batches is None:
        query.processAllAvailable()
    else:
        while query.isActive and (query.lastProgress or {"batchId": -1})["batchId"] < batches:
            time.sleep(0.2)
    query.stop()


def test_recorded_chunks_over_restarts(spark, tmp_path):
    """Frames that cross chunks, read by two chunks a batch; the query is stopped twice, and chunks come late and out of order."""
    rng = random.Random(3)
    path, place = str(tmp_path / "chunks"), str(tmp_path)
    sent = {m: [(1001 + k, rng.randrange(2, 60)) for k in range(40)] for m in ("A", "B")}
    cuts, whole = {}, {m: b"".join(frame(k, n) + b"\x00" * (k % 3) for k, n in rows) for m, rows in sent.items()}
    for m, data in whole.items():
        at = sorted({0, len(data), *rng.sample(range(len(data)), 17)})
        cuts[m] = [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def put(m, numbers):
        for n in numbers:
            chunks.record(path, m, n, 1_704_067_200_000 + 1000 * n, cuts[m][n])

    def stream():
        return live.framed(chunks.stream_chunks(spark, path, 2, f"{place}/progress.json")).drop("payload")

    put("A", range(8))
    run_for(stream(), place, 1)
    put("B", [1, 2, 3])  # 0 is missing yet, and its mountpoint begins with what there is
    put("A", [9, 10, 11])
    run_for(stream(), place)
    put("A", [8, *range(12, len(cuts["A"]))])
    run_for(stream(), place, 1)
    put("B", range(4, len(cuts["B"])))
    run_for(stream(), place)
    got = spark.read.parquet(f"{place}/out").collect()
    assert sorted((r.message_type, r.length) for r in got if r.mountpoint == "A") == sorted(sent["A"])
    assert [rtcm.message_type(p) for p in rtcm.frames(b"".join(cuts["B"][1:]))[0]] == sorted(r.message_type for r in got if r.mountpoint == "B")
    whole_read = {(r.mountpoint, r.seq): bytes(r.data) for r in chunks.read_chunks(spark, path).collect()}
    assert whole_read == {(m, n): c for m in cuts for n, c in enumerate(cuts[m]) if (m, n) != ("B", 0)}
    assert [p.name for p in (tmp_path / "chunks").rglob("*.part")] == []


def test_chunks_are_cleaned_when_done(spark, tmp_path):
    path = str(tmp_path / "chunks")
    for n in range(6):
        chunks.record(path, "M", n, n, bytes([n]))
    run_for(chunks.stream_chunks(spark, path, 2, str(tmp_path / "p"), clean=True), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, bytes(r.data), r.arrival.microsecond) for r in got) == [(n, bytes([n]), n * 1000) for n in range(6)]
    assert len(list((tmp_path / "chunks").rglob("*.chunk"))) <= 2
    assert chunks.read_chunks(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
MS = int(T0.timestamp() * 1000)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_ephemerides_expire(rocks, tmp_path):
    """One that is renewed, one that is repeated and older, and a later one of another satellite that moves the time on."""
    rows = [[("R01", at(0)), ("G05", at(0))], [("R01", at(1000)), ("R01", at(900))], [("R01", at(1000)), ("R01", at(500))], [("E11", at(2900))], [("E11", at(9000))], [("E11", at(9001))]]
    got = replay(rocks, tmp_path, rows, "prn string, arrival timestamp", timers.validity)
    seen = sorted((r.prn, r.state, (r.at_ms - MS) // 1000) for r in got if r.prn != "E11")
    assert seen == [("G05", "expired", 7200), ("G05", "valid", 0), ("R01", "expired", 2800), ("R01", "valid", 0), ("R01", "valid", 1000)]


def test_epochs_are_closed(rocks, tmp_path):
    """By the bit, by the next epoch and by the timer; a message that comes twice counts once."""
    row = lambda t, epoch, kind, more, m="M": (m, "G", at(t), epoch, kind, 5, more)
    rows = [[row(0, 0, 1077, True), row(0.1, 0, 1077, True)], [row(0.2, 0, 1078, False)], [row(1, 1000, 1077, True)], [row(2, 2000, 1077, True)], [row(60, 0, 1077, False, "N")], [row(120, 0, 1077, False, "N")]]
    got = replay(rocks, tmp_path, rows, "mountpoint string, system string, arrival timestamp, epoch_ms long, message_type int, n_signals int, more boolean", timers.closed_epochs)
    assert sorted((r.epoch_ms, r.messages, r.signals, r.closed_by) for r in got if r.mountpoint == "M") == [(0, 2, 10, "last"), (1000, 1, 5, "next"), (2000, 1, 5, "timer")]
    bit = rocks.createDataFrame([(bytes(6) + b"\x02",), (bytes(7),)], "p binary").select(timers.more_follows(F.col("p")).alias("m")).collect()
    assert [r.m for r in bit] == [True, False]


def test_snapshots_by_the_second(rocks, tmp_path):
    rows = [[("M", at(0.1), 10), ("M", at(0.9), 20), ("M", at(1.5), 30)], [("M", at(5.5), 1)], [("M", at(30), 0)], [("M", at(60), 0)], [("M", at(90), 0)]]
    got = replay(rocks, tmp_path, rows, "mountpoint string, arrival timestamp, length int", timers.snapshots)
    assert sorted(((r.at_ms - MS) // 1000, r.frames, r.bytes) for r in got)[:3] == [(1, 2, 42), (2, 3, 78), (6, 4, 85)]


def test_live_sky_is_the_nearest_join(rocks, tmp_path):
    """The stream gives the rows of the tables, but for those that are later than the watermark allows."""
    eph = [[("G01", at(0), "a"), ("R02", at(0), "r")], [("G01", at(600), "b")], [("G01", at(610), "c")], [("G01", at(9000), "d")], [("C01", at(40000), "-")], [("C01", at(40001), "-")]]
    sig = [[("G01", at(1), 40.0), ("R02", at(2), 30.0), ("E09", at(3), 1.0)], [("G01", at(605), 41.0), ("R02", at(1799), 31.0), ("R02", at(1801), 32.0)], [("G01", at(1900), 42.0)], [("E09", at(30000), 0.0)], [("E09", at(40000), 0.0)], [("E09", at(40001), 0.0)], [("G01", at(1500), 9.0)]]
    spec = {"eph": (eph, "prn string, arrival timestamp, e string"), "sig": (sig, "prn string, ts timestamp, cn0 double")}
    for name, (rows, schema) in spec.items():
        for part in rows:
            rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
    stream = {n: rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, (_, schema) in spec.items()}
    query = timers.live_sky(stream["eph"], stream["sig"], "1 hour").writeStream.format("memory").queryName("sky_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.prn, r.ts, r.cn0, r.arrival, r.e)
    table = {n: rocks.read.schema(schema).parquet(str(tmp_path / n)) for n, (_, schema) in spec.items()}
    batch = {key(r) for r in timers.live_sky(table["eph"], table["sig"]).collect()}
    assert sorted((p, c, e) for p, _, c, _, e in batch) == [("G01", 9.0, "c"), ("G01", 40.0, "a"), ("G01", 41.0, "b"), ("G01", 42.0, "c"), ("R02", 30.0, "r"), ("R02", 31.0, "r")]
    assert {key(r) for r in rocks.table("sky_rows").collect()} == {r for r in batch if r[2] != 9.0}
