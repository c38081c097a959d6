"""Two-stage box tracker with keyed state: stream job and batch twin share the per-frame step.

State is keyed by (stream, video), so each video starts fresh and ids are unique inside its key. A stream is
sequential by nature; scale comes from the number of keys, and a key holds its live tracks only.
"""

from __future__ import annotations

import pickle
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from boxwright.operators.assignment import solve
from boxwright.operators.scans import ordered_map
from boxwright.streaming.motion import State, advance, begin, blend, halted, surprise

OUTPUT = "stream_id bigint, video_id bigint, frame bigint, det_id bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


@dataclass
class Settings:
    """Association thresholds and buffer length in frames."""

    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    match: float = 0.8
    second: float = 0.5
    tentative: float = 0.7
    buffer: int = 30
    fuse: bool = True
    duplicate: float = 0.15
    appearance: bool = False
    proximity: float = 0.5
    similarity: float = 0.8
    smoothing: float = 0.9


@dataclass
class Track:
    track_id: int
    state: State
    det: dict
    started: int
    seen: int
    confirmed: bool
    lost: bool = False
    feature: np.ndarray | None = None


@dataclass
class Tracker:
    """State of one (stream, video)."""

    settings: Settings = field(default_factory=Settings)
    frame: int = 0
    next_id: int = 1
    live: list[Track] = field(default_factory=list)
    lost: list[Track] = field(default_factory=list)

    @property
    def aspect(self) -> bool:
        """Whether motion is over aspect ratios rather than widths."""
        return not self.settings.appearance

    def _measure(self, det: dict) -> np.ndarray:
        w, h = det["x2"] - det["x1"], det["y2"] - det["y1"]
        third = w / h if self.aspect else w
        return np.array([(det["x1"] + det["x2"]) / 2, (det["y1"] + det["y2"]) / 2, third, h])

    def _corners(self, t: Track) -> np.ndarray:
        x, y, third, h = t.state.at
        w = third * h if self.aspect else third
        return np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2])

    def _cost(self, tracks: list[Track], dets: list[dict], fuse: bool, appearance: bool = True) -> np.ndarray:
        """One minus overlap, optionally weighted by score or lowered by appearance."""
        a = np.array([self._corners(t) for t in tracks]).reshape(-1, 4)
        b = np.array([[d["x1"], d["y1"], d["x2"], d["y2"]] for d in dets]).reshape(-1, 4)
        cost = 1 - pairwise_iou(a, b)
        if not cost.size:
            return cost
        near = cost <= 1 - self.settings.proximity
        if fuse:
            cost = 1 - (1 - cost) * np.array([d["conf"] for d in dets])[None]
        if appearance and self.settings.appearance and all(t.feature is not None for t in tracks) and all(d.get("feature") is not None for d in dets):
            look = 1 - np.array([t.feature for t in tracks]) @ np.array([unit(d["feature"]) for d in dets]).T
            look = np.maximum(look, 0) / 2
            look[(look > 1 - self.settings.similarity) | ~near] = 1.0
            cost = np.minimum(cost, look)
        return cost

    def _hit(self, t: Track, det: dict) -> None:
        t.state = blend(t.state, self._measure(det), self.aspect)
        t.det, t.seen, t.confirmed, t.lost = det, self.frame, True, False
        self._look(t, det)

    def _look(self, t: Track, det: dict) -> None:
        if det.get("feature") is None:
            return
        f = unit(det["feature"])
        t.feature = f if t.feature is None else unit(self.settings.smoothing * t.feature + (1 - self.settings.smoothing) * f)

    def update(self, dets: list[dict]) -> list[Track]:
        """One frame: associate strong, weak and tentative, then births, expiry and duplicates."""
        s = self.settings
        self.frame += 1
        strong = [d for d in dets if d["conf"] >= s.high]
        weak = [d for d in dets if s.low < d["conf"] < s.high]
        firm = [t for t in self.live if t.confirmed]
        tentative = [t for t in self.live if not t.confirmed]
        pool = firm + self.lost
        for t in pool:
            if t.lost:  # a lost track keeps its size
                t.state = halted(t.state, *((3,) if self.aspect else (2, 3)))
            t.state = advance(t.state, self.aspect)
        hits = solve(self._cost(pool, strong, s.fuse), s.match)
        for i, j in hits:
            self._hit(pool[i], strong[j])
        used, taken = {i for i, _ in hits}, {j for _, j in hits}
        missed = [t for i, t in enumerate(pool) if i not in used and not t.lost]
        second = solve(self._cost(missed, weak, s.fuse, appearance=False), s.second)
        for i, j in second:
            self._hit(missed[i], weak[j])
        for i, t in enumerate(missed):
            if i not in {a for a, _ in second}:
                t.lost = True
        rest = [d for j, d in enumerate(strong) if j not in taken]
        third = solve(self._cost(tentative, rest, s.fuse), s.tentative)
        for i, j in third:
            self._hit(tentative[i], rest[j])
        kept = [t for i, t in enumerate(tentative) if i in {a for a, _ in third}]
        for j, d in enumerate(rest):
            if j in {b for _, b in third} or d["conf"] < s.new:
                continue
            born = Track(self.next_id, begin(self._measure(d), self.aspect), d, self.frame, self.frame, confirmed=self.frame == 1)
            self._look(born, d)
            self.next_id += 1
            kept.append(born)
        everyone = pool + kept
        self.live = [t for t in everyone if not t.lost]
        self.lost = [t for t in everyone if t.lost and self.frame - t.seen <= s.buffer]
        self._drop_duplicates()
        return [t for t in self.live if t.confirmed]

    def _drop_duplicates(self) -> None:
        """A live and a lost track that nearly coincide: the longer-lived stays, a tie drops the live one."""
        a = np.array([self._corners(t) for t in self.live]).reshape(-1, 4)
        b = np.array([self._corners(t) for t in self.lost]).reshape(-1, 4)
        drop_live, drop_lost = set(), set()
        for i, j in np.argwhere(1 - pairwise_iou(a, b) < self.settings.duplicate):
            longer = self.live[i].seen - self.live[i].started > self.lost[j].seen - self.lost[j].started
            (drop_lost.add(j) if longer else drop_live.add(i))
        self.live = [t for i, t in enumerate(self.live) if i not in drop_live]
        self.lost = [t for j, t in enumerate(self.lost) if j not in drop_lost]

    def pass_empty(self, frames: int) -> None:
        """Frames without a detection; once every track has expired, more of them change nothing but the count."""
        for _ in range(min(frames, self.settings.buffer + 2)):
            self.update([])

    def dump(self) -> bytes:
        """The state as plain values, so it can be read by a worker that got this code another way."""
        return pickle.dumps((self.frame, self.next_id, [asdict(t) for t in self.live], [asdict(t) for t in self.lost]))

    @staticmethod
    def load(blob: bytes, settings: Settings) -> Tracker:
        frame, next_id, *lists = pickle.loads(blob)
        live, lost = ([Track(**{**t, "state": State(**t["state"])}) for t in ts] for ts in lists)
        return Tracker(settings, frame, next_id, live, lost)

    def rows(self, key: tuple, frame_no: int) -> list[tuple]:
        out = []
        for t in self.live:
            if t.confirmed:
                x1, y1, x2, y2 = (float(v) for v in self._corners(t))
                out.append((*key, frame_no, int(t.det["det_id"]), t.track_id, x1, y1, x2, y2, float(t.det["conf"]), int(t.det["cls"])))
        return out


def unit(v) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    return v / max(np.linalg.norm(v), 1e-12)


def pairwise_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    side = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None)
    inter = side.prod(-1)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inter / (area(a)[:, None] + area(b)[None] - inter + 1e-7)


def track_batch(det: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Batch twin: rows (stream_id, video_id, frame, det_id, x1.., conf, cls[, feature]) in frame order per key."""
    settings = settings or Settings()

    def start(key: tuple) -> dict:
        return {"key": tuple(int(k) for k in key), "tracker": Tracker(settings), "frame": None, "dets": []}

    def finish(state: dict) -> list[tuple]:
        if state["frame"] is None:
            return []
        state["tracker"].update(state["dets"])
        return state["tracker"].rows(state["key"], state["frame"])

    def step(state: dict, row) -> list[tuple]:
        out = []
        if row.frame != state["frame"]:
            out = finish(state)
            if state["frame"] is not None:
                state["tracker"].pass_empty(int(row.frame) - state["frame"] - 1)
            state["frame"], state["dets"] = int(row.frame), []
        state["dets"].append(row._asdict())
        return out

    # Detections below the low threshold never matter; the filter stays outside the Python step.
    return ordered_map(det.where(f"conf > {settings.low}D"), ["stream_id", "video_id"], ["frame", "det_id"], start, step, OUTPUT, finish)


def track_stream(det: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Stream job: tracks in keyed state, frames of a micro-batch in order, frames already passed are skipped.

    A frame's detections must arrive in one micro-batch (one message per frame does that). Needs the RocksDB
    state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor

    settings = settings or Settings()

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.blob = handle.getValueState("tracker", "blob binary, last bigint")

        def handleInputRows(self, key, rows, timers):
            key = tuple(int(k) for k in key)
            tracker, last = (Tracker(settings), -1)
            if self.blob.exists():
                blob, last = self.blob.get()
                tracker = Tracker.load(bytes(blob), settings)
            frames = pd.concat(list(rows)).sort_values(["frame", "det_id"])
            out = []
            for frame, group in frames[frames["frame"] > last].groupby("frame", sort=True):
                if last >= 0:
                    tracker.pass_empty(int(frame) - last - 1)
                tracker.update(group.to_dict("records"))
                out.extend(tracker.rows(key, int(frame)))
                last = int(frame)
            self.blob.update((tracker.dump(), last))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUTPUT.split(",")])

        def close(self) -> None:
            pass

    return det.where(f"conf > {settings.low}D").groupBy("stream_id", "video_id").transformWithStateInPandas(
        statefulProcessor=Processor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def smooth_tracks(obs: DataFrame, aspect: bool = False) -> DataFrame:
    """Filtered and predicted centre per observation of each track; gaps are predicted through."""
    schema = "stream_id bigint, track_id bigint, frame_no bigint, px double, py double, sx double, sy double, gate double"

    def step(state: dict, row) -> list[tuple]:
        box = np.array([row.cx, row.cy, row.w / row.h if aspect else row.w, row.h])
        if "motion" not in state:
            state["motion"], px, py, gate = begin(box, aspect), row.cx, row.cy, 0.0
        else:
            ahead = advance(state["motion"], aspect)
            px, py, gate = float(ahead.at[0]), float(ahead.at[1]), surprise(ahead, box, aspect)
            state["motion"] = blend(ahead, box, aspect)
        x, y = state["motion"].at[:2]
        return [(row.stream_id, row.track_id, row.frame_no, px, py, float(x), float(y), gate)]

    return ordered_map(obs, ["stream_id", "track_id"], ["frame_no"], lambda key: {}, step, schema)
