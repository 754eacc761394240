"""Operators without a query of their own."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mining, similarity, summary
from plumbline.sources import files
from plumbline.streaming import sinks, state

START = datetime(2024, 1, 1)


def test_votes_of_neighbours(spark):
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (2, 10, 1.0), (2, 12, 0.0)], "query_id long, id long, similarity double")
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, 0)], "id long, y int")
    got = {r.query_id: r.p for r in similarity.weighted_vote(near, labels).collect()}
    assert got[1] == pytest.approx(10 / 12) and got[2] == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "id long, v array<double>")
    found = similarity.nearest(df.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q")), df, 7, block=11).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for q in range(5):
        order = [k for k in np.argsort(-(unit @ unit[q])) if k != q][:7]
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == order


def test_rules_in_words(spark):
    df = spark.createDataFrame([(["activity=hot_work", "site=A"], "exposure=direct_proximity", 0.5, 0.25, 2.0, 12)], "antecedent array<string>, consequent string, confidence double, baseline double, lift double, report_count long")
    assert df.select(mining.statement().alias("s")).first().s == "hot work + A co-occurs with direct proximity in 50% of cases, against a 25% baseline (lift 2.0, 12 reports)."


def test_a_confident_model_sends_sure_buckets_to_review(spark):
    rows = [("HIGH_CONF_SIF", True, False, 0.9), ("HIGH_CONF_SIF", True, True, 0.9), ("HIGH_CONF_NON_SIF", False, True, 0.7), ("HIGH_CONF_NON_SIF", False, True, 0.69), ("NEEDS_MORE_INFO", True, False, 0.99), ("HIGH_CONF_SIF", True, None, None)]
    df = spark.createDataFrame(rows, "b string, flagged boolean, model boolean, sure double")
    got = [r[0] for r in df.select(summary.cross_checked(F.col("b"), F.col("flagged"), F.col("model"), F.col("sure"))).collect()]
    assert got == ["LOW_CONF_REVIEW", "HIGH_CONF_SIF", "LOW_CONF_REVIEW", "HIGH_CONF_NON_SIF", "NEEDS_MORE_INFO", "HIGH_CONF_SIF"]


def test_transcripts_of_segments(spark):
    df = spark.createDataFrame([("a", 2, " and enough words", -0.2), ("a", 1, "a clip with order ", -0.1), ("b", 1, "short", -0.1), ("c", 1, None, None)], "clip_id string, place int, text string, log_probability double")
    got = files.transcripts(df).collect()
    assert [(r.clip_id, r.transcript, r.confidence) for r in got] == [("a", "a clip with order and enough words", round((np.exp(-0.1) + np.exp(-0.2)) / 2, 3))]


def test_persons_in_zones(spark):
    square = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    zones = spark.createDataFrame([("c", "load", "lifting", square), ("c", "yard", "walkway", square), ("d", "store", "restricted", square)], "camera string, zone string, zone_type string, polygon array<struct<x: double, y: double>>")
    seen = spark.createDataFrame([("c", START, "person", [0.1, 0.1, 0.3, 0.4]), ("c", START, "person", [0.1, 0.4, 0.3, 0.9]), ("c", START, "car", [0.1, 0.1, 0.3, 0.4]), ("d", START, "person", [0.0, 0.0, 0.2, 0.2])], "camera string, at timestamp, kind string, box array<double>")
    assert sorted((r.camera, r.zone, r.severity) for r in state.zone_events(seen, zones).collect()) == [("c", "load", "high"), ("d", "store", "medium")]


def test_clips_and_batches_that_come_twice(spark, tmp_path):
    df = spark.createDataFrame([("d", k % 3, START + timedelta(seconds=k)) for k in range(9)], "device_id string, seq long, captured_at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = state.once_per_sequence(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("once").collect()) == [0, 1, 2]
    write = sinks.idempotent(f"{tmp_path}/out", lambda x: x.where("seq > 0"))
    for _ in range(2):
        write(df, 7)
    write(df.limit(0), 8)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    told = sinks.reports_of_events(f"{tmp_path}/reports", lambda x: x.select(F.col("seq").alias("id"), F.lit("The crane lifted a suspended load and a worker stood directly under it.").alias("text")))
    for _ in range(2):
        told(df, 1)
    assert spark.read.parquet(f"{tmp_path}/reports/events").count() == spark.read.parquet(f"{tmp_path}/reports/reports").count() == 9
    assert {r.exposure for r in spark.read.parquet(f"{tmp_path}/reports/reports").select("exposure").collect()} == {"direct_proximity"}
