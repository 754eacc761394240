"""Folds on streams and tables: the same rows, and what plain loops give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import scene
from plumbline.streaming import monitor

START = datetime(2024, 1, 1)
UPRIGHT, PRONE = [0.42, 0.20, 0.54, 0.75], [0.40, 0.56, 0.70, 0.74]


def on_stream(spark, df, run, path, name, files=3):
    """The rows of a streaming run over df, cut into files by time, and a late row that moves the watermark on."""
    rows = sorted(df.collect(), key=lambda r: r.at)
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}-in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}-in")
    q = run(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def frames(spark, rows):
    return spark.createDataFrame([(c, START + timedelta(seconds=s), k, b) for c, s, k, b in rows], "camera string, at timestamp, kinds array<string>, boxes array<array<double>>")


def test_person_falls_then_lies_still(spark, tmp_path):
    lying = [UPRIGHT] * 3 + [PRONE] * 9
    standing = [UPRIGHT] * 12
    rows = [("a", 0.4 * k, ["person"], [b]) for k, b in enumerate(lying)] + [("b", 0.4 * k, ["person"], [b]) for k, b in enumerate(standing)]
    rows += [("c", 0.4 * k, ["person", "car"], [UPRIGHT, b]) for k, b in enumerate(lying)]  # what falls there is no person
    rows += [("d", 0.4 * k, ["person"], [b]) for k, b in enumerate([UPRIGHT, PRONE, UPRIGHT, PRONE, UPRIGHT])]
    df = frames(spark, rows)
    batch = monitor.person_events(df).collect()
    said = sorted((r.camera, r.event, r.confidence) for r in batch if r.event)
    assert said == [("a", "fall", 0.90), ("a", "immobile", 0.85), ("d", "fall", 0.90)]
    assert len(batch) == 12 * 4 + 5 and {r.track for r in batch if r.camera == "b"} == {1}
    stream = on_stream(spark, df, monitor.person_events, tmp_path, "falls")
    assert sorted(map(str, stream)) == sorted(map(str, batch))
    # the same verdicts by windows over the tracks
    tracks = monitor.person_events(df).where("kind = 'person'").withColumn("key", F.concat_ws("-", "camera", "track"))
    box = F.col("box")
    tracks = tracks.withColumns({"x": (box[0] + box[2]) / 2, "y": (box[1] + box[3]) / 2, "w": box[2] - box[0], "h": box[3] - box[1]}).drop("confidence", "drop_speed", "aspect_before", "aspect_after")
    seen = scene.posture(tracks, "key", "at", "track", "x", "y", "w", "h").collect()
    assert all((r.event == "fall") == r.fall and (r.event == "immobile") == r.immobile for r in seen)
    assert sorted((r.camera, r.confidence) for r in seen if r.event) == sorted((c, s) for c, _, s in said)


def test_tracks_end_and_forget(spark, tmp_path):
    rng = random.Random(3)
    boxes = []
    x, y = 0.3, 0.3
    for k in range(60):
        x, y = min(max(x + rng.uniform(-0.05, 0.05), 0.0), 0.8), min(max(y + rng.uniform(-0.08, 0.08), 0.0), 0.6)
        h = rng.uniform(0.1, 0.35)
        boxes.append([x, y, x + rng.uniform(0.08, 0.3), y + h])
    rows = [("a", 0.3 * k + (20 if k > 40 else 0), ["person"] if k % 11 else [], [b] if k % 11 else []) for k, b in enumerate(boxes)]
    df = frames(spark, rows)
    batch = monitor.person_events(df).collect()
    assert len({r.track for r in batch}) > 1 and min(r.track for r in batch if r.at >= START + timedelta(seconds=30)) > max(r.track for r in batch if r.at < START + timedelta(seconds=20))
    assert sorted(map(str, on_stream(spark, df, monitor.person_events, tmp_path, "tracks2", files=6))) == sorted(map(str, batch))
    fold = monitor.person_fold()
    state = fold.start
    for r in df.where("size(boxes) > 0").toPandas().sort_values("at").itertuples():
        state, _ = fold.step(state, r)
        assert max(state[7]) <= 12
    # walking history by windows gives the same verdicts
    t = monitor.person_events(df).withColumn("key", F.concat_ws("-", "camera", "track"))
    box = F.col("box")
    t = t.withColumns({"x": (box[0] + box[2]) / 2, "y": (box[1] + box[3]) / 2, "w": box[2] - box[0], "h": box[3] - box[1]}).select("key", "at", "event", "x", "y", "w", "h", F.col("confidence").alias("sure"))
    assert all((r.event == "fall") == r.fall and (r.event == "immobile") == r.immobile and r.sure == r.confidence for r in scene.posture(t, "key", "at", "key", "x", "y", "w", "h").collect())
    assert monitor.person_events(df.where("false")).count() == 0


def plain_clips(blocks, voice=380, least=2.0, silence=2.5, longest=30.0):
    out, start = [], None
    for t, rms in blocks:
        if start is not None:
            end = min(start + longest, max(start + least, last + silence))
            if t >= end:
                out.append((start, end))
                start = None
        if rms is not None and rms >= voice:
            if start is None:
                start = t
            last = t
    if start is not None:
        out.append((start, min(start + longest, max(start + least, last + silence))))
    return out


@pytest.mark.parametrize(("least", "silence"), [(2000, 2500), (4000, 500)])
def test_clips_on_stream_and_table(spark, tmp_path, least, silence):
    rng = random.Random(least)
    own = {"a": [], "b": [], "c": [(k * 0.25, 500.0) for k in range(300)], "d": [(0.5, 900.0)], "e": [(1.0, 100.0), (2.0, None)]}
    for d in "ab":
        t, loud = 0.0, False
        for _ in range(400):
            t += 0.25
            loud = loud if rng.random() < 0.9 else not loud
            own[d].append((t, 500.0 if loud else 20.0))
    df = spark.createDataFrame([(d, START + timedelta(seconds=t), rms) for d, rows in own.items() for t, rms in rows], "device string, at timestamp, rms double")
    want = sorted((d, *c) for d, rows in own.items() for c in plain_clips(rows, least=least / 1000, silence=silence / 1000))
    run = lambda x: monitor.clips(x, least_ms=least, silence_ms=silence)
    seconds = lambda t: (t - START).total_seconds()
    batch = run(df).collect()
    assert sorted((r.device, seconds(r.start), seconds(r.end)) for r in batch) == want and len(want) > 10
    assert all(0.001 + (r.end - r.start).total_seconds() >= min(least / 1000, 2) for r in batch)
    tail = df.unionByName(spark.createDataFrame([("z", START + timedelta(seconds=9000 + k), 0.0) for k in range(3)], df.schema))
    stream = [r for r in on_stream(spark, tail, run, tmp_path, f"clips{least}", files=5) if r.device != "z"]
    assert sorted(map(str, stream)) == sorted(map(str, batch))
