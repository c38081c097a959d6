"""Tracker and streaming queries."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.plans.bridge import table, v_track
from boxwright.plans.registry import query
from boxwright.plans.tracking import _P as SPEED_P
from boxwright.plans.tracking import POLYGON, SQUARES, in_polygon_sql
from boxwright.session import shared_folder
from boxwright.streaming import live, tracker
from boxwright.streaming.metrics import Lifecycle


def frame_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections of four streams whose objects drift slowly; a new video starts every hundred frames."""
    return v_track(spark, d).selectExpr(
        "stream_id", "frame_no div 4000 as video_id", "frame_no div 40 as frame", "frame_no as det_id", "cls",
        "(track_id % 97) * 6D + (frame_no % 4000) / 200D as x1", "(track_id % 89) * 4D + (frame_no % 4000) / 300D as y1",
        "0.05D + (frame_no * 37 % 90) / 100D as conf", "40D + track_id % 30 as w", "50D + track_id % 20 as h",
    ).selectExpr("stream_id", "video_id", "frame", "det_id", "cls", "conf", "x1", "y1", "x1 + w as x2", "y1 + h as y2")


@query("str_01_tracker")
def tracker_batch(spark: SparkSession, d: str) -> DataFrame:
    return tracker.track_batch(frame_detections(spark, d))


@query("str_02_appearance_tracker")
def appearance_tracker(spark: SparkSession, d: str) -> DataFrame:
    """The same job with width-height motion and an appearance vector per detection."""
    det = frame_detections(spark, d).selectExpr("*", "array(cos(x2 - x1), sin(x2 - x1), cast(cls as double)) as feature")
    return tracker.track_batch(det, tracker.Settings(appearance=True))


@query("str_03_track_smoothing")
def track_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return tracker.smooth_tracks(v_track(spark, d))


@query("str_04_tracker_lifecycle")
def tracker_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Each (stream, video) starts fresh: first id, last id and frames per key."""
    return tracker.track_batch(frame_detections(spark, d)).groupBy("stream_id", "video_id").agg(
        F.expr("min(track_id) as first_id"), F.expr("max(track_id) as last_id"), F.expr("count(distinct frame) as frames")
    )


_P = "p AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM v_track WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_no))"


@query("str_05_live_counter", f"""WITH {_P}, h AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS k FROM p WHERE px IS NOT NULL AND {in_polygon_sql(POLYGON, False)})
SELECT track_id, frame_no, CASE WHEN cy > py THEN 'IN' ELSE 'OUT' END AS direction FROM h WHERE k = 1""")
def live_counter(spark: SparkSession, d: str) -> DataFrame:
    """Keyed-state counter drained over the event table as a stream."""
    live.use_rocksdb(spark)
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    live.run_once(live.live_area_counter(live_track(spark, d), POLYGON), f"{base}/out", f"{base}/state", ("direction",))
    counted = spark.read.schema(live.COUNTS).parquet(f"{base}/out")
    return counted.where("direction <> 'LATE'").select("track_id", "frame_no", "direction")


def live_track(spark: SparkSession, d: str) -> DataFrame:
    """The track observations as a stream, with their event time."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.selectExpr(
        "user_id % 4 as stream_id", "user_id as track_id", "event_id as frame_no", "event_id div 40 as frame", "event_id * 67 % 181 as angle", "cast(ts as timestamp) as ts",
        "cast((event_id * 37 + user_id * 13) % 640 as double) as cx", "cast((event_id * 91 + user_id * 29) % 480 as double) as cy",
    )


@query("str_07_live_speed_reps", f"""WITH {SPEED_P},
e AS (SELECT track_id, arg_min(cx, obs_no) AS ax, arg_min(cy, obs_no) AS ay, min(frame_no) AS af, arg_max(cx, obs_no) AS ex, arg_max(cy, obs_no) AS ey, max(frame_no) AS bf FROM p WHERE obs_no IN (1, 5) GROUP BY track_id HAVING count(*) = 2),
s AS (SELECT track_id, frame_no, last_value(CASE WHEN frame_no * 67 % 181 < 90 THEN 'down' WHEN frame_no * 67 % 181 > 145 THEN 'up' END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame_no) AS stage FROM v_track),
t AS (SELECT *, lag(stage) OVER (PARTITION BY track_id ORDER BY frame_no) AS prev FROM s),
r AS (SELECT track_id, count(*) FILTER (stage = 'down' AND prev = 'up') AS reps FROM t GROUP BY track_id)
SELECT track_id, CAST(trunc(least(sqrt((ex - ax) ** 2 + (ey - ay) ** 2) * 0.05E0 / ((bf - af) / 30.0E0) * 3.6E0, 120)) AS INT) AS speed, reps FROM e JOIN r USING (track_id)""")
def live_speed_reps(spark: SparkSession, d: str) -> DataFrame:
    """Locked speed and repetitions of each track, from the keyed state of a drained stream."""
    live.use_rocksdb(spark)
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    live.run_once(live.live_speed_reps(live_track(spark, d)), f"{base}/out", f"{base}/state", ("kind",))
    events = spark.read.schema(live.EVENTS).parquet(f"{base}/out")
    return events.groupBy("track_id").agg(
        F.expr("max(case when kind = 'SPEED' then cast(value as int) end) as speed"), F.expr("count_if(kind = 'REP') as reps")
    ).where("speed is not null")


@query("str_08_live_alarm", """WITH t AS (SELECT stream_id, frame_no // 40 AS frame, count(*) AS total FROM v_track GROUP BY ALL HAVING count(*) >= 14)
SELECT stream_id, min(frame) AS frame, arg_min(total, frame) AS total FROM t GROUP BY stream_id""")
def live_alarm(spark: SparkSession, d: str) -> DataFrame:
    """One alarm a stream, sent by a drained stream with the flag in its state."""
    live.use_rocksdb(spark)
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    live.alarm_once(live_track(spark, d), 14, base)
    return spark.read.schema(live.ALARMS).option("recursiveFileLookup", True).parquet(f"{base}/alarms")


_T = "t AS (SELECT v.*, ts FROM v_track v JOIN events e ON e.event_id = v.frame_no)"


@query("str_06_live_gauges", f"WITH {_T} SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, stream_id, region, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT ts, stream_id, '{n}' AS region FROM t WHERE {in_polygon_sql(p, False)}" for n, p in SQUARES.items()) + ") GROUP BY ALL")
def live_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Region gauges per hour of event time, from a drained stream."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = live.gauges_table(live_track(spark, d), SQUARES, base)
    return out.selectExpr("unix_seconds(window_start) as start_s", "stream_id", "region", "n")


def in_two_parts(spark: SparkSession, d: str, first: str, run) -> str:
    """Write the observations where ``first`` holds, run a stream over the folder, write the others, run it again; the folder of results."""
    base, obs = f"{shared_folder(spark)}/{uuid.uuid4().hex}", v_track(spark, d)
    for number, test in enumerate((first, f"not ({first})")):
        obs.where(test).write.parquet(f"{base}/in/{number}")
        run(spark.readStream.schema(obs.schema).option("recursiveFileLookup", True).parquet(f"{base}/in"), base)
    return base


@query("str_13_late_frames", """
WITH h AS (SELECT stream_id, max(frame_no) AS last FROM v_track WHERE frame_no % 10 < 7 GROUP BY stream_id)
SELECT stream_id, frame_no % 10 >= 7 AND frame_no <= coalesce(last, -1) AS late, count(*) AS n FROM v_track LEFT JOIN h USING (stream_id) GROUP BY ALL""")
def late_frames(spark: SparkSession, d: str) -> DataFrame:
    """Three of ten frames come a micro-batch later; those behind their stream's horizon lie in the side table, none is lost."""
    base = in_two_parts(spark, d, "frame_no % 10 < 7", live.split_late)
    return spark.read.parquet(f"{base}/rows").groupBy("stream_id", F.expr("cast(late as boolean) as late")).agg(F.expr("count(*) as n"))


@query("src_16_newest_per_trigger", """
SELECT t AS trigger, stream_id, max(frame_no) AS frame_no, arg_max(track_id, frame_no) AS track_id
FROM (SELECT *, CASE WHEN frame_no % 1000 < 600 THEN 0 ELSE 1 END AS t FROM v_track WHERE frame_no % 3 = 0) GROUP BY ALL""")
def newest_per_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Newest sampled frame of every camera in each of two triggers."""
    base = in_two_parts(spark, d, "frame_no % 1000 < 600", lambda stream, base: live.newest_per_trigger(stream, base, 3))
    return spark.read.parquet(f"{base}/newest").select("trigger", "stream_id", "frame_no", "track_id")


@query("udf_03_lifecycle", """
SELECT 'started' AS event, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'progress', 1, count(*) FROM events UNION ALL SELECT 'ended', 1, NULL""")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Start, progress and end of a drained stream, as the listener's table holds them."""
    base, name = f"{shared_folder(spark)}/{uuid.uuid4().hex}", f"lifecycle-{uuid.uuid4().hex}"
    listener = Lifecycle((name,))
    spark.streams.addListener(listener)
    job = live_track(spark, d).writeStream.queryName(name).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    job.trigger(availableNow=True).start().awaitTermination()
    for _ in range(300):  # events come on a thread of their own
        if any(r[1] == "ended" for r in listener.rows):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    return listener.table(spark).groupBy("event").agg(F.expr("count_if(event <> 'progress' or rows > 0) as n"), F.expr("sum(rows) as rows"))
