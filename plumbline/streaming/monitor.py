"""Folds over a key's rows in order of time, with a state of bounded size: the same step on a stream and on a table.

A step takes a state (a tuple of the schema's fields) and the next rows, and
gives the state and what they cause. On a stream the state lives in Spark's
state store and goes with event-time timers; on a table rows are dealt by key
and sorted, and a task carries one key's state along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scene import FallParams
from .state import centre_distance, iou


@dataclass(frozen=True)
class Fold:
    #: (state, row) to (state, results); `closed` gives what is left when nothing more comes.
    step: Callable[[tuple, object], tuple[tuple, list[tuple]]]
    start: tuple
    closed: Callable[[tuple], list[tuple]]
    #: Milliseconds of event time, from the state, when nothing that comes can meet it any more.
    until: Callable[[tuple], int]
    results: str
    state: str


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def folded(rows: DataFrame, key: str, ts: str, order: list[str], fold: Fold) -> DataFrame:
    """The fold over a table: (key, results). Null keys are one key; keys are dealt to tasks, each sorted."""
    names = names_of(fold.results)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, any_row = None, fold.start, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if any_row and k != own:
                    out += [(own, *r) for r in fold.closed(state)]
                    state = fold.start
                own, any_row = k, True
                state, found = fold.step(state, row)
                out += [(own, *r) for r in found]
            if out:
                yield pd.DataFrame(out, columns=[key, *names])
        if any_row and (out := [(own, *r) for r in fold.closed(state)]):
            yield pd.DataFrame(out, columns=[key, *names])

    dealt = rows.repartition(key).sortWithinPartitions(key, ts, *order)
    return dealt.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {fold.results}")


def folded_stream(rows: DataFrame, key: str, ts: str, order: list[str], fold: Fold, lateness: str) -> DataFrame:
    """The fold over a stream, in append mode. Rows of one batch are taken in order; what a key leaves behind comes when the watermark has passed its time."""
    names = names_of(fold.results)

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else fold.start
        out: list[tuple] = []
        if held.hasTimedOut:
            out = fold.closed(state)
            held.remove()
        else:
            for row in pd.concat(list(batches)).sort_values([ts, *order]).itertuples(index=False):
                state, found = fold.step(state, row)
                out += found
            held.update(state)
            held.setTimeoutTimestamp(max(fold.until(state), held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(k[0], *r) for r in out], columns=[key, *names])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {fold.results}"
    return rows.withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(run, schema, fold.state, "append", GroupStateTimeout.EventTimeTimeout)


# ---- tracks of persons: falls, and who stays down

#: Least overlap, and greatest distance of centres, by which a box belongs to a track: of a person, of anything else.
GATES = {"person": (0.20, 0.22)}
OTHER_GATE = (0.20, 0.18)
#: Seconds after which a track that no box met ends.
EXPIRY = 1.5


def followed(tracks: dict[int, dict], kind: str, box: list[float], free: set[int]) -> int | None:
    """The free track of its kind that a box belongs to: the best overlap, or else the nearest centre."""
    least, reach = GATES.get(kind, OTHER_GATE)
    same = [t for t in sorted(free) if tracks[t]["kind"] == kind]
    best = max(same, key=lambda t: iou(tracks[t]["box"], box), default=None)
    if best is not None and (score := iou(tracks[best]["box"], box)) > 0 and score >= least:
        return best
    near = min(same, key=lambda t: centre_distance(tracks[t]["box"], box), default=None)
    return near if near is not None and centre_distance(tracks[near]["box"], box) < reach else None


def verdict(track: dict, p: FallParams) -> tuple | None:
    """(event, confidence, drop speed, aspect before, aspect after) of a track's newest sample, by the rules of posture()."""
    samples = track["samples"]
    t, x, y, aspect = samples[-1]
    ref = next((s for s in reversed(samples[:-1]) if round(p.youngest * 1e6) <= t - s[0] <= round(p.oldest * 1e6)), None)
    if ref is None:
        return None
    speed = (y - ref[2]) / max((t - ref[0]) / 1e6, 1e-3)
    collapse = ref[3] >= p.upright and aspect <= p.prone
    if not track["fallen"] and (collapse or (aspect < ref[3] * p.shrink and speed >= p.drop) or speed >= p.fast_drop):
        track["fallen"] = t
        sure = (0.90 if speed >= p.drop else 0.80) if collapse else 0.72 if speed >= p.fast_drop else 0.55
        return "fall", sure, round(speed, 3), round(ref[3], 2), round(aspect, 2)
    if track["fallen"] and not track["still"] and t - track["fallen"] >= round(p.still_seconds * 1e6):
        recent = [s for s in samples if t - s[0] <= round(p.still_seconds * 1e6)]
        if len(recent) >= 2 and all(((s[1] - recent[0][1]) ** 2 + (s[2] - recent[0][2]) ** 2) ** 0.5 <= p.still_reach for s in recent):
            track["still"] = True
            return "immobile", 0.85, 0.0, round(ref[3], 2), round(aspect, 2)
    return None


def person_fold(p: FallParams = FallParams(), expiry: float = EXPIRY) -> Fold:
    """Rows (camera, at, kinds, boxes) to (at, track, kind, box, event, confidence, drop_speed, aspect_before, aspect_after).

    A row for every box, with its track; event is null but for the first fall of
    a person's track and, behind it, the first time that it has not moved since.
    Boxes take their tracks one after another. The state of a camera is its live
    tracks with their last samples: no track keeps more than `history`.
    """

    def unpack(state: tuple) -> tuple[int, dict[int, dict]]:
        next_id, ids, kinds, seen, fallen, still, boxes, counts, samples = state
        tracks, at = {}, 0
        for k, i in enumerate(ids):
            own = [tuple(samples[4 * j : 4 * j + 4]) for j in range(at, at + counts[k])]
            at += counts[k]
            tracks[i] = {"kind": kinds[k], "seen": seen[k], "fallen": fallen[k], "still": bool(still[k]), "box": list(boxes[4 * k : 4 * k + 4]), "samples": own}
        return next_id, tracks

    def pack(next_id: int, tracks: dict[int, dict]) -> tuple:
        ids = sorted(tracks)
        of = lambda c: [tracks[i][c] for i in ids]
        return next_id, ids, of("kind"), of("seen"), of("fallen"), of("still"), [v for b in of("box") for v in b], [len(s) for s in of("samples")], [float(v) for s in of("samples") for x in s for v in x]

    def step(state: tuple, row) -> tuple[tuple, list[tuple]]:
        next_id, tracks = unpack(state)
        now = row.at.value // 1000
        tracks = {i: t for i, t in tracks.items() if now - t["seen"] <= round(expiry * 1e6)}
        free, out = set(tracks), []
        for kind, box in zip(row.kinds, row.boxes, strict=True):
            box = [float(v) for v in box]
            i = followed(tracks, kind, box, free)
            if i is None:
                i, next_id = next_id, next_id + 1
                tracks[i] = {"kind": kind, "fallen": 0, "still": False, "samples": []}
            free.discard(i)
            t = tracks[i]
            t["box"], t["seen"] = box, now
            width, height = box[2] - box[0], box[3] - box[1]
            t["samples"] = [*t["samples"][1 - p.history :], (now, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, height / max(width, 1e-4))]
            said = verdict(t, p) if kind == "person" else None
            out.append((row.at, i, kind, box, *(said or (None,) * 5)))
        return pack(next_id, tracks), out

    return Fold(
        step,
        (1, [], [], [], [], [], [], [], []),
        lambda state: [],
        lambda state: max(state[3], default=0) // 1000 + int(expiry * 1000) + 1,
        "at timestamp, track long, kind string, box array<double>, event string, confidence double, drop_speed double, aspect_before double, aspect_after double",
        "next long, ids array<long>, kinds array<string>, seen array<long>, fallen array<long>, still array<boolean>, boxes array<double>, counts array<int>, samples array<double>",
    )


def person_events(frames: DataFrame, params: FallParams = FallParams(), expiry: float = EXPIRY, lateness: str = "10 seconds") -> DataFrame:
    """Tracks, falls and immobility of a stream or a table of frames (camera, at, kinds, boxes)."""
    fold = person_fold(params, expiry)
    return folded_stream(frames, "camera", "at", [], fold, lateness) if frames.isStreaming else folded(frames, "camera", "at", [], fold)


# ---- clips of speech


def clip_fold(voice: float = 380, least_ms: int = 2000, silence_ms: int = 2500, longest_ms: int = 30_000) -> Fold:
    """Rows (device, at, rms) to (start, end, blocks, voiced): a clip begins with a voiced block.

    It ends `longest_ms` after its beginning, or with silence_ms of silence, but
    not before least_ms have passed. Times are compared where a block comes, as
    a recorder does that is asked at every block; blocks counts those within.
    """

    def clip(start: int, end: int, blocks: int, voiced: int) -> tuple:
        return pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), blocks, voiced

    def due(state: tuple) -> int:
        start, last, _, _ = state
        return min(start + longest_ms * 1000, max(start + least_ms * 1000, last + silence_ms * 1000))

    def step(state: tuple, row) -> tuple[tuple, list[tuple]]:
        now, loud, out = row.at.value // 1000, row.rms is not None and row.rms >= voice, []
        if state[0] >= 0 and now >= due(state):
            out.append(clip(state[0], due(state), state[2], state[3]))
            state = (-1, -1, 0, 0)
        if state[0] < 0:
            return ((now, now, 1, 1) if loud else state), out
        return (state[0], now if loud else state[1], state[2] + 1, state[3] + loud), out

    return Fold(step, (-1, -1, 0, 0), lambda s: [clip(s[0], due(s), s[2], s[3])] if s[0] >= 0 else [], lambda s: due(s) // 1000 + 1 if s[0] >= 0 else 0, "start timestamp, end timestamp, blocks long, voiced long", "start long, last long, blocks long, voiced long")


def clips(blocks: DataFrame, lateness: str = "10 seconds", **params) -> DataFrame:
    """Clips of a stream or a table of sound blocks (device, at, rms)."""
    fold = clip_fold(**params)
    return folded_stream(blocks, "device", "at", [], fold, lateness) if blocks.isStreaming else folded(blocks, "device", "at", [], fold)
