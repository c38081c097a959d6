"""Tracker invariants, and the stream job against its batch twin."""

import numpy as np

from boxwright.streaming import live, motion, plugins, tracker

DET = "stream_id bigint, video_id bigint, frame bigint, det_id bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def moving(frames=12):
    rows = []
    for f in range(frames):
        for k in range(3):
            if k == 2 and 4 <= f < 7:
                continue
            x, y = 50.0 * k + 2 * f, 40.0 * k
            rows.append((0, 0, f, f * 10 + k, k, 0.15 if k == 1 and f % 3 == 2 else 0.9, x, y, x + 30, y + 30))
    return rows


def test_identity_is_kept(spark):
    rows = tracker.track_batch(spark.createDataFrame(moving(), DET)).collect()
    by_class = {}
    for r in rows:
        by_class.setdefault(r.cls, set()).add(r.track_id)
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == 3
    assert len({(r.frame, r.track_id) for r in rows}) == len(rows)


def test_stream_equals_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    det = spark.createDataFrame(moving(), DET)
    for name, test in (("a", "frame < 6"), ("b", "frame >= 6")):
        det.where(test).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(DET).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_once(tracker.track_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.frame, r.det_id, r.track_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.frame, r.det_id, r.track_id) for r in tracker.track_batch(det).collect())
    assert got == want


def test_hooks_run_around_a_batch():
    seen = []
    run = plugins.with_hooks(lambda df, e: seen.append(("write", e)), {"batch_start": [lambda e: seen.append(("start", e))], "batch_end": [lambda e: seen.append(("end", e))]})
    run(None, 7)
    assert seen == [("start", 7), ("write", 7), ("end", 7)]


def test_motion_equals_the_matrix_form():
    """Four two-term filters against one filter of eight terms with diagonal noise."""
    rng = np.random.default_rng(3)
    for aspect in (True, False):
        side = lambda b: b[[3, 3, 3, 3]] if aspect else b[[2, 3, 2, 3]]
        pick = lambda v, fixed: np.where(np.arange(4) == 2, fixed, v) if aspect else v
        box = np.array([50.0, 40.0, 0.5, 30.0])
        s = motion.begin(box, aspect)
        m, p = np.r_[box, np.zeros(4)], np.diag(np.r_[pick(side(box) / 10, 1e-2), pick(side(box) / 16, 1e-5)] ** 2)
        f = np.block([[np.eye(4), np.eye(4)], [np.zeros((4, 4)), np.eye(4)]])
        for _ in range(6):
            q = np.r_[pick(side(m[:4]) / 20, 1e-2), pick(side(m[:4]) / 160, 1e-5)]
            m, p, s = f @ m, f @ p @ f.T + np.diag(q**2), motion.advance(s, aspect)
            box = box + rng.normal(size=4) * [3, 3, 0.01, 1]
            total = p[:4, :4] + np.diag(pick(side(m[:4]) / 20, 1e-1) ** 2)
            assert np.isclose(motion.surprise(s, box, aspect), (box - m[:4]) @ np.linalg.inv(total) @ (box - m[:4]))
            k = p[:, :4] @ np.linalg.inv(total)
            m, p, s = m + k @ (box - m[:4]), p - k @ total @ k.T, motion.blend(s, box, aspect)
            assert np.allclose(np.r_[s.at, s.speed], m) and np.allclose(s.cross, np.diag(p[:4, 4:])) and np.allclose(s.speed_var, np.diag(p[4:, 4:]))


def test_a_long_gap_ends_a_track(spark):
    """Frames without detections count: after thirty of them a track is gone."""
    rows = [(0, 0, f, f, 0, 0.9, 10.0, 10.0, 40.0, 40.0) for f in (0, 1, 2, 20, 21, 500, 501, 502)]
    got = {r.frame: r.track_id for r in tracker.track_batch(spark.createDataFrame(rows, DET)).collect()}
    assert got[0] == got[2] == got[21] and 500 not in got and got[501] == got[502] != got[0]
