"""Keyed stream operators on Structured Streaming, event time throughout.

The state of a key is small and fixed in size; a watermark bounds how late an
event may come, and drops the state of keys that fell silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cooled_down(events: DataFrame, keys: list[str], ts: str, seconds: float, order: str, lateness: str = "10 minutes") -> DataFrame:
    """A stream's events that the cooldown of their key admits: the first, and each `seconds` after the last admitted.

    Suppressed events do not extend the cooldown. Events of one batch are taken
    in order of time, then `order`. A key's state goes once the watermark has
    passed its cooldown.
    """
    schema = events.schema

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, order])
        take = []
        for at in rows[ts]:
            ok = last is None or (at - last).total_seconds() >= seconds
            take.append(ok)
            last = at if ok else last
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[take][schema.names]

    return events.withWatermark(ts, lateness).groupBy(*keys).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


TRACKED = "camera string, at timestamp, track long, box array<double>, first boolean"


def iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / whole if whole > 0 else 0.0


def centre_distance(a: list[float], b: list[float]) -> float:
    return (((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) ** 2 + ((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) ** 2) ** 0.5


def match(tracks: dict[int, list[float]], boxes: list[list[float]], least_iou: float, most_distance: float) -> dict[int, int]:
    """Box to track, greedily: best overlaps first, then nearest centres."""
    out: dict[int, int] = {}
    left = set(tracks)
    for score, least in ((iou, least_iou), (lambda a, b: -centre_distance(a, b), -most_distance)):
        pairs = sorted(((-score(tracks[t], b), t, k) for t in left for k, b in enumerate(boxes) if k not in out and score(tracks[t], b) >= least))
        for _, t, k in pairs:
            if t in left and k not in out:
                out[k] = t
                left.discard(t)
    return out


def tracked(frames: DataFrame, least_iou: float = 0.20, most_distance: float = 0.18, expiry: float = 1.5, lateness: str = "10 seconds") -> DataFrame:
    """Tracks of boxes for each camera: frames (camera, at, boxes) become rows (camera, at, track, box, first).

    A track that no box met for `expiry` seconds ends. The state of a camera is
    its live tracks: id, box and last time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_id, ids, seen, flat = state.get if state.exists else (1, [], [], [])
        live = {i: (s, list(flat[4 * k : 4 * k + 4])) for k, (i, s) in enumerate(zip(ids, seen, strict=True))}
        rows, now = [], 0
        for frame in pd.concat(list(batches)).sort_values("at").itertuples():
            now = int(frame.at.value // 1_000_000)
            live = {i: x for i, x in live.items() if now - x[0] <= expiry * 1000}
            boxes = [[float(x) for x in b] for b in frame.boxes]
            found = match({i: b for i, (_, b) in live.items()}, boxes, least_iou, most_distance)
            for k, box in enumerate(boxes):
                track = found.get(k)
                new = track is None
                if new:
                    track, next_id = next_id, next_id + 1
                live[track] = (now, box)
                rows.append((key[0], frame.at, track, box, new))
        order = sorted(live)
        state.update((next_id, order, [live[i][0] for i in order], [x for i in order for x in live[i][1]]))
        state.setTimeoutTimestamp(max(now + int(expiry * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["camera", "at", "track", "box", "first"])

    return frames.withWatermark("at", lateness).groupBy("camera").applyInPandasWithState(step, TRACKED, "next long, ids array<long>, seen array<long>, boxes array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def once_per_sequence(clips: DataFrame, ts: str = "captured_at", lateness: str = "1 hour") -> DataFrame:
    """Clips without repetitions: the device's sequence number is the key."""
    return clips.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["device_id", "seq"])


def zone_events(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Persons whose foot lies in a restricted or lifting zone of their camera; stateless, for streams and tables.

    detections: camera, at, kind, box; zones (a configuration table of a camera each): camera, zone, zone_type, polygon.
    """
    from ..functions.geometry import foot, point_in_polygon

    persons = detections.where("kind = 'person'").withColumn("foot", foot("box")).withColumns({"x": F.col("foot.x"), "y": F.col("foot.y")})
    risky = zones.where(F.col("zone_type").isin("restricted", "lifting"))
    return persons.join(risky, "camera").where(point_in_polygon("x", "y", "polygon")).select("camera", "at", "zone", F.when(F.col("zone_type") == "lifting", "high").otherwise("medium").alias("severity"))
