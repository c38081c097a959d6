"""Live counters, gauges, alarms and late frames on streaming observations.

Keyed state has a time to live, so a track that never comes back costs nothing for ever. No row is dropped silently: what comes behind the state of
its key leaves as a row of kind LATE, and what comes behind the horizon of its stream goes to a side table.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.tracks import in_regions

COUNTS = "stream_id bigint, track_id bigint, frame_no bigint, direction string"
EVENTS = "stream_id bigint, track_id bigint, frame_no bigint, kind string, value bigint"
ALARMS = "stream_id bigint, frame bigint, total bigint"
TTL_MS = 7 * 24 * 3600 * 1000
IDLE_MS = 3600 * 1000
FRAMES = 256  # frames that share a state row
NULL_KEY = "(-9223372036854775807L)"


def _keyed(obs: DataFrame, keys, processor, schema: str) -> DataFrame:
    return obs.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def live_area_counter(obs: DataFrame, region, ttl_ms: int = TTL_MS) -> DataFrame:
    """In / out events of a polygon, once per track for good: state is the last point and a counted flag. Rows behind a track's last frame are LATE."""
    from pyspark.sql.streaming import StatefulProcessor

    from boxwright.functions.geometry import in_polygon

    xs, ys = [p[0] for p in region], [p[1] for p in region]
    axis = "cx" if max(xs) - min(xs) < max(ys) - min(ys) else "cy"

    class Counter(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "v double, frame bigint, counted boolean", ttl_ms)

        def handleInputRows(self, key, rows, timers):
            before, frame, counted = self.last.get() if self.last.exists() else (None, -1, False)
            out = []
            for row in pd.concat(list(rows)).sort_values("frame_no").itertuples(index=False):
                if row.frame_no <= frame:
                    out.append((int(key[0]), int(key[1]), int(row.frame_no), "LATE"))
                    continue
                now = getattr(row, axis)
                if before is not None and not counted and row.inside:
                    counted = True
                    out.append((int(key[0]), int(key[1]), int(row.frame_no), "IN" if now > before else "OUT"))
                before, frame = float(now), int(row.frame_no)
            self.last.update((before, frame, counted))
            yield pd.DataFrame(out, columns=["stream_id", "track_id", "frame_no", "direction"])

        def close(self) -> None:
            pass

    flagged = obs.selectExpr("stream_id", "track_id", "frame_no", "cx", "cy", f"{in_polygon('cx', 'cy', region)} as inside")
    return _keyed(flagged, ["stream_id", "track_id"], Counter(), COUNTS)


def live_speed_reps(
    obs: DataFrame, points: int = 5, fps: float = 30.0, metre_per_pixel: float = 0.05, top: float = 120, up: float = 145, down: float = 90,
    ttl_ms: int = TTL_MS, idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Per track (rows carry cx, cy, angle): one SPEED event when its speed is locked, a REP event for every up-to-down change, LATE rows.

    State is the first point, the number of points, the stage and the repetitions. A timer ends a track that stays away for ``idle_ms``: it
    emits END with the repetitions and clears the state.
    """
    from pyspark.sql.streaming import StatefulProcessor

    columns = ["stream_id", "track_id", "frame_no", "kind", "value"]

    class Motion(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.track = handle.getValueState("track", "x double, y double, first bigint, n bigint, stage string, reps bigint, frame bigint, timer bigint", ttl_ms)

        def handleInputRows(self, key, rows, timers):
            x, y, first, n, stage, reps, frame, timer = self.track.get() if self.track.exists() else (0.0, 0.0, 0, 0, None, 0, -1, None)
            ids, out = (int(key[0]), int(key[1])), []
            for row in pd.concat(list(rows)).sort_values("frame_no").itertuples(index=False):
                at = int(row.frame_no)
                if at <= frame:
                    out.append((*ids, at, "LATE", None))
                    continue
                n += 1
                if n == 1:
                    x, y, first = float(row.cx), float(row.cy), at
                elif n == points:
                    metres = ((row.cx - x) ** 2 + (row.cy - y) ** 2) ** 0.5 * metre_per_pixel
                    out.append((*ids, at, "SPEED", int(min(metres / ((at - first) / fps) * 3.6, top))))
                new = "down" if row.angle < down else "up" if row.angle > up else stage
                if stage == "up" and new == "down":
                    reps += 1
                    out.append((*ids, at, "REP", reps))
                stage, frame = new, at
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timers.getCurrentProcessingTimeInMs() + idle_ms
            self.handle.registerTimer(timer)
            self.track.update((x, y, first, n, stage, reps, frame, timer))
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.track.exists():
                state = self.track.get()
                self.track.clear()
                yield pd.DataFrame([(int(key[0]), int(key[1]), state[6], "END", state[5])], columns=columns)

        def close(self) -> None:
            pass

    return _keyed(obs.select("stream_id", "track_id", "frame_no", "cx", "cy", "angle"), ["stream_id", "track_id"], Motion(), EVENTS)


def full_frames(obs: DataFrame, records: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """(stream_id, frame, total) the first time a frame holds ``records`` objects; the once-only flag is in the frame's state.

    The key is a block of frames, not the stream, so a busy stream is spread over tasks, and a block's state is read and written once a batch.
    A frame is forgotten ``ttl_ms`` after its last row.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Frame(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "frames array<bigint>, n array<bigint>, sent array<boolean>, at array<bigint>", ttl_ms)

        def handleInputRows(self, key, rows, timers):
            now, fired = timers.getCurrentProcessingTimeInMs(), []
            held = zip(*self.seen.get()) if self.seen.exists() else ()
            seen = {frame: (n, sent, at) for frame, n, sent, at in held if now - at < ttl_ms}
            counts: Counter = Counter()
            for batch in rows:
                counts.update(batch["frame"].tolist())
            for frame, more in counts.items():
                n, sent, _ = seen.get(frame, (0, False, now))
                if n + more >= records and not sent:
                    fired.append((int(key[0]), frame, n + more))
                    sent = True
                seen[frame] = (n + more, sent, now)
            self.seen.update((list(seen), *(list(column) for column in zip(*seen.values()))))
            yield pd.DataFrame(fired, columns=["stream_id", "frame", "total"])

        def close(self) -> None:
            pass

    # The keys of a batch are told apart as numbers, which null is not: it travels as a number of its own.
    rows = obs.selectExpr(*[f"coalesce({c}, {NULL_KEY}) as {c}" for c in ("stream_id", "frame")]).selectExpr("*", f"frame div {FRAMES} as block")
    fired = _keyed(rows, ["stream_id", "block"], Frame(), ALARMS)
    return fired.selectExpr(*[f"nullif({c}, {NULL_KEY}) as {c}" for c in ("stream_id", "frame")], "total")


def alarm_once(obs: DataFrame, records: int, base: str) -> None:
    """Drain a stream into ``base``/alarms: the first alarm of each stream and no other, whatever comes later.

    A micro-batch holds a few full frames; streams that have had their alarm are a table of one row per stream.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        first = batch.groupBy("stream_id").agg(F.expr("min(frame) as frame"), F.expr("min_by(total, frame) as total"))
        for before in versions(session, f"{base}/alarms", batch_id):
            first = first.join(before, "stream_id", "left_anti")
        first.select("stream_id", "frame", "total").write.mode("overwrite").parquet(f"{base}/alarms/{batch_id}")

    drain(full_frames(obs, records), send, f"{base}/state")


def live_gauges(obs: DataFrame, regions, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Objects per region and tumbling window of event time ``ts``; works on streams and tables alike."""
    inside = in_regions(obs.withWatermark("ts", late), regions)
    counted = inside.groupBy(F.window("ts", window).alias("w"), "stream_id", "region").agg(F.expr("count(*) as n"))
    return counted.selectExpr("w.start as window_start", "stream_id", "region", "n")


def gauges_table(obs: DataFrame, regions, base: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Drain gauges in update mode and read the newest value of each window; open windows count as well."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.selectExpr("*", f"{batch_id}L as batch").write.mode("overwrite").parquet(f"{base}/gauges/{batch_id}")

    drain(live_gauges(obs, regions, window, late), keep, f"{base}/state", "update")
    rows = obs.sparkSession.read.option("recursiveFileLookup", True).schema("window_start timestamp, stream_id bigint, region string, n bigint, batch bigint").parquet(f"{base}/gauges")
    return rows.groupBy("window_start", "stream_id", "region").agg(F.expr("max_by(n, batch) as n"))


def dwell_sessions(obs: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Dwell time of tracks by event-time sessions."""
    grouped = obs.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "stream_id", "track_id").agg(F.expr("count(*) as n"))
    return grouped.selectExpr("stream_id", "track_id", "s.start as session_start", "n")


def versions(spark: SparkSession, folder: str, before: int) -> list[DataFrame]:
    """Tables that earlier micro-batches wrote to a folder, as a list of at most one."""
    return [spark.read.parquet(*[f"{folder}/{i}" for i in range(before)])] if before else []


def split_late(stream: DataFrame, base: str, allowed: int = 0) -> None:
    """Drain (stream_id, frame_no, ...) rows into ``base``/rows, parted by ``late``: a row is late if its stream was more than ``allowed`` frames
    past it before its micro-batch. The horizon moves with the batches, as a watermark does, but nothing is lost.

    Each micro-batch writes the horizons it leaves, one row a stream, under its number; a repeated batch overwrites its own files.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/batch/{batch_id}")
        rows = session.read.schema(batch.schema).parquet(f"{base}/batch/{batch_id}")
        own = rows.groupBy("stream_id").agg(F.expr("max(frame_no) as last"))
        if batch_id:
            before = session.read.parquet(f"{base}/horizon/{batch_id - 1}")
            rows = rows.join(before, "stream_id", "left").selectExpr(*batch.columns, f"coalesce(frame_no <= last - {allowed}, false) as late")
            own = own.union(before).groupBy("stream_id").agg(F.expr("max(last) as last"))
        else:
            rows = rows.selectExpr("*", "false as late")
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/batch={batch_id}")
        own.write.mode("overwrite").parquet(f"{base}/horizon/{batch_id}")

    drain(stream, route, f"{base}/state")


def newest_per_trigger(stream: DataFrame, base: str, stride: int = 1) -> None:
    """Drain frames of many cameras: of every ``stride``-th frame, each trigger keeps the newest of each stream (map-side combined)."""
    from boxwright.sources.media import every_kth, newest_only

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest_only(every_kth(batch, stride)).write.mode("overwrite").parquet(f"{base}/newest/trigger={batch_id}")

    drain(stream, keep, f"{base}/state")


def use_rocksdb(spark) -> None:
    """Keyed state lives in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _drained(writer, spark: SparkSession) -> None:
    """Run a writer until its source is empty. Processing-time state would ask for empty micro-batches for ever, so those are off."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        job = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    job.awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str, parts: tuple[str, ...] = ()) -> None:
    """Drain what is available into a parquet folder, parted by the columns named."""
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    _drained(sink.partitionBy(*parts) if parts else sink, stream.sparkSession)


def drain(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available, one call of ``write(batch, number)`` a micro-batch."""
    _drained(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode), stream.sparkSession)
