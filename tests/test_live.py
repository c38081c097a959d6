"""Streams over two micro-batches: late rows, state that expires, alarms that are sent once, newest frames, lifecycle rows."""

import time

import pytest
from pyspark.sql import functions as F

from boxwright.streaming import live
from boxwright.streaming.metrics import Lifecycle

OBS = "stream_id bigint, track_id bigint, frame_no bigint, frame bigint, cx double, cy double, angle double"


@pytest.fixture
def feed(spark, tmp_path):
    """Add rows to a folder and run a stream over it, batch by batch."""
    live.use_rocksdb(spark)
    made = []

    def add(rows, run):
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(str(tmp_path / "in" / str(len(made))))
        made.append(rows)
        run(spark.readStream.schema(OBS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), str(tmp_path / "out"))

    return add


def obs(frame, track=1, stream=0, x=0.0, angle=120.0):
    return (stream, track, frame, frame // 10, x, 50.0, angle)


def test_late_rows_reach_the_side_table(spark, feed, tmp_path):
    feed([obs(f) for f in (1, 2, 9)], live.split_late)
    feed([obs(5), obs(9), obs(10), obs(3, stream=1)], live.split_late)
    feed([obs(10), obs(11), obs(2, stream=1)], live.split_late)
    rows = sorted((r["batch"], r.stream_id, r.frame_no, str(r.late)) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect())
    assert rows == [
        (0, 0, 1, "false"), (0, 0, 2, "false"), (0, 0, 9, "false"), (1, 0, 5, "true"), (1, 0, 9, "true"), (1, 0, 10, "false"), (1, 1, 3, "false"),
        (2, 0, 10, "true"), (2, 0, 11, "false"), (2, 1, 2, "true"),
    ]


def events(spark, tmp_path, schema, part):
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / "events")).collect())


def test_counter_keeps_late_rows_and_counts_once(spark, feed, tmp_path):
    box = [(10, 0), (30, 0), (30, 100), (10, 100)]

    def run(stream, out):
        live.run_once(live.live_area_counter(stream, box), f"{out}/events", f"{out}/state", ("direction",))

    feed([obs(1, x=0.0), obs(4, x=20.0)], run)
    feed([obs(2, x=15.0), obs(5, x=0.0), obs(6, x=20.0)], run)
    # the region is higher than wide, so the walk is along x
    assert events(spark, tmp_path, live.COUNTS, "direction") == [(0, 1, 2, "LATE"), (0, 1, 4, "IN")]


def test_counter_state_expires(spark, feed, tmp_path):
    box = [(10, 0), (30, 0), (30, 100), (10, 100)]

    def run(stream, out):
        live.run_once(live.live_area_counter(stream, box, ttl_ms=500), f"{out}/events", f"{out}/state", ("direction",))

    feed([obs(1, x=0.0), obs(4, x=20.0)], run)
    time.sleep(1)
    feed([obs(2, x=0.0), obs(3, x=20.0)], run)
    # the track was forgotten: its old frames are not late and it counts again
    assert events(spark, tmp_path, live.COUNTS, "direction") == [(0, 1, 3, "IN"), (0, 1, 4, "IN")]


def test_speed_reps_and_the_end_of_a_track(spark, feed, tmp_path):
    def run(stream, out):
        live.run_once(live.live_speed_reps(stream, idle_ms=200), f"{out}/events", f"{out}/state", ("kind",))

    feed([obs(f, x=10.0 * f, angle=a) for f, a in enumerate((160.0, 80.0, 100.0))], run)
    feed([obs(f, x=10.0 * f, angle=a) for f, a in ((3, 150.0), (4, 85.0))] + [obs(1)], run)
    time.sleep(1)
    feed([obs(0, track=2)], run)
    assert events(spark, tmp_path, live.EVENTS, "kind") == sorted(
        [(0, 1, 1, "REP", 1), (0, 1, 4, "REP", 2), (0, 1, 4, "SPEED", 54), (0, 1, 4, "END", 2), (0, 1, 1, "LATE", None)], key=lambda r: (r[:3], r[3])
    )


def test_alarm_is_sent_once(spark, feed, tmp_path):
    def run(stream, out):
        live.alarm_once(stream, 3, out)

    feed([obs(f) for f in (10, 11)] + [obs(20)], run)
    feed([obs(12), obs(21), obs(22), obs(23)] + [obs(1, stream=1)] * 3, run)
    feed([obs(f) for f in (30, 31, 32)], run)
    sent = spark.read.schema(live.ALARMS).option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "alarms"))
    assert sorted(tuple(r) for r in sent.collect()) == [(0, 1, 3), (1, 0, 3)]


def test_newest_frame_of_every_trigger(spark, feed, tmp_path):
    def run(stream, out):
        live.newest_per_trigger(stream, out, 2)

    feed([obs(f, stream=s) for f in (1, 2, 4, 5) for s in (0, 1)], run)
    feed([obs(f, stream=s) for f in (6, 7) for s in (0, 1)], run)
    rows = spark.read.parquet(str(tmp_path / "out" / "newest")).groupBy("trigger", "stream_id").agg(F.max("frame_no").alias("f"), F.count("*").alias("n"))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0, 4, 1), (0, 1, 4, 1), (1, 0, 6, 1), (1, 1, 6, 1)]


def test_listener_rows_and_hooks(spark, feed, tmp_path):
    seen = []
    listener = Lifecycle(("job",), {"progress": [lambda row: seen.append(row[3])]})
    spark.streams.addListener(listener)

    def run(stream, out):
        job = stream.writeStream.queryName("job").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        job.trigger(availableNow=True).start().awaitTermination()

    feed([obs(1), obs(2)], run)
    for _ in range(100):
        if any(r[1] == "ended" for r in listener.rows):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    by_event = {r.event: r for r in listener.table(spark).collect()}
    assert set(by_event) == {"started", "progress", "ended"} and by_event["progress"].rows == 2 and 2 in seen


def test_alarm_counts_frames_of_no_stream_apart(spark, feed, tmp_path):
    """Rows without a stream or a frame stand between those of others; frames of two blocks and two batches keep their own counts."""

    def run(stream, out):
        live.alarm_once(stream, 3, out)

    none = [(None, 1, 1, None, 0.0, 50.0, 120.0)] * 2
    feed([*[obs(10)] * 2, *none, *[obs(10, stream=1)] * 2, *[obs(9000, stream=2)] * 2], run)
    feed([obs(10), *[obs(9000, stream=2)] * 2, obs(20, stream=1)], run)
    sent = spark.read.schema(live.ALARMS).option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "alarms"))
    assert sorted(map(tuple, sent.collect())) == [(0, 1, 3), (2, 900, 4)]
