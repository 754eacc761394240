"""The registered queries against DuckDB, and the operators that SQL does not express against brute force."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.operators import events, mining, patterns, ranking, trends
from plumbline.plans import registry
from plumbline.sources import files
from plumbline.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value + 0.0:.7g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    ours = sorted(tuple(str(plain(r[c])) for c in columns) for r in got.collect())
    theirs = sorted(tuple(str(plain(r[k])) for k in place) for r in want.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_first_mode_takes_the_first_met(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("h", "z", 5)], "g string, v string, k int")
    assert {r.g: r.v for r in ranking.first_mode(df, ["g"], "v", "k").collect()} == {"g": "b", "h": "z"}


def series(spark, values):
    return spark.createDataFrame([(datetime(2020, 1, 1) + timedelta(weeks=k), int(v)) for k, v in enumerate(values)], "period timestamp_ntz, flagged long")


def test_control_charts(spark):
    values = [3, 4, 3, 5, 4, 3, 4, 4, 4, 20, 21, 3, 4, 22]
    mu, sd = np.mean(values[:8]), np.std(values[:8], ddof=1)
    s, want = 0.0, []
    for k, v in enumerate(values):
        s = max(0.0, s + v - mu - 0.5 * sd)
        hit = s > 4 * sd and k >= 8
        want.append((round(s, 6), hit))
        s = 0.0 if hit else s
    got = trends.cusum(series(spark, values)).orderBy("period").collect()
    assert [(round(r.upper, 6), r.signal) for r in got] == want
    z, want = mu, []
    for k, v in enumerate(values):
        z = 0.3 * v + 0.7 * z
        up = mu + 3 * sd * np.sqrt(0.3 / 1.7 * (1 - 0.7 ** (2 * (k + 1))))
        want.append((round(z, 6), bool(k >= 8 and z > up)))
    assert [(round(r.smoothed, 6), r.signal) for r in trends.ewma(series(spark, values)).orderBy("period").collect()] == want
    assert trends.alerts(series(spark, values)).count() >= 3 and trends.alerts(series(spark, [1, 2, 3])).count() == 0
    assert [r.signal for r in trends.cusum(series(spark, [5, 5, 5, 5, 5, 5, 5, 5, 5])).collect()] == [False] * 9


def test_rule_pruning_keeps_the_better(spark):
    rules = spark.createDataFrame([(["a=1"], "exposure=x", 9, 3.0), (["a=1", "b=2"], "exposure=x", 5, 2.0), (["b=2"], "exposure=x", 5, 1.5), (["a=1", "b=2"], "exposure=y", 5, 2.0)], "antecedent array<string>, consequent string, report_count long, lift double")
    kept = [(r.antecedent, r.consequent) for r in mining.pruned_rules(rules).collect()]
    assert kept == [(["a=1"], "exposure=x"), (["a=1", "b=2"], "exposure=y"), (["b=2"], "exposure=x")]


def test_density_clusters_find_planted_groups(spark):
    rows = []
    for k, (a, b, c) in enumerate([("x", "p", "1"), ("y", "q", "2"), ("z", "r", "3")]):
        rows += [(a, b, c, "s", "t")] * (40 - k)
    rows += [(f"n{k}", f"m{k}", f"o{k}", f"s{k}", f"t{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "activity string, energy_type string, barrier_type string, barrier_status string, exposure string")
    got = {r.activity: r.label for r in patterns.density_clusters(df, 15).collect()}
    assert (got["x"], got["y"], got["z"]) == (0, 1, 2) and all(got[f"n{k}"] == -1 for k in range(6))


def test_admissions_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(k, f"u{rng.randrange(4)}", start + timedelta(seconds=k * 7 + rng.randrange(5))) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    last, want = {}, set()
    for k, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if u not in last or (t - last[u]).total_seconds() >= 60:
            last[u] = t
            want.add(k)
    assert {r.event_id for r in events.admitted(df, ["user_id"], "ts", 60, "event_id").collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = state.cooled_down(stream, ["user_id"], "ts", 60, "event_id").writeStream.format("memory").queryName("cooled").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id for r in spark.table("cooled").collect()} == want


def test_tracks(spark, tmp_path):
    start = datetime(2024, 1, 1)
    box = lambda x, y: [x, y, x + 0.1, y + 0.2]
    rows = [("c", start + timedelta(seconds=0.3 * k), [box(0.1 + 0.02 * k, 0.1), box(0.7, 0.5 - 0.01 * k)] if k != 4 else []) for k in range(8)] + [("c", start + timedelta(seconds=9), [box(0.1, 0.1)])]
    df = spark.createDataFrame(rows, "camera string, at timestamp, boxes array<array<double>>")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = state.tracked(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("tracks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tracks").groupBy("track").agg(F.count("*").alias("n")).orderBy("track").collect()
    assert [(r.track, r.n) for r in got] == [(1, 7), (2, 7), (3, 1)]


def test_report_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"site": "A", "report_text": "a report with enough text", "source": "odd", "timestamp": "2024-01-01T00:00:00Z"}\n{"report_id": "x", "report_text": "short"}\n')
    got = files.ingested(files.json_lines(spark, str(tmp_path / "r.json"), files.REPORT)).collect()
    assert len(got) == 1 and got[0].report_id.startswith("rep_") and got[0].source == "synthetic" and got[0].ts == datetime(2024, 1, 1)
    (tmp_path / "c.csv").write_text('report_id,lsr_tag\n1,N/A\n2,\n')
    assert [r.lsr_tag for r in files.csv_corpus(spark, str(tmp_path / "c.csv"), "report_id string, lsr_tag string").collect()] == ["N/A", ""]
    up = files.upserted(spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int"), spark.createDataFrame([(1, "b", 2, "n")], "k int, v string, seq int, more string"), "k", "seq")
    assert [(r.v, r.more) for r in up.collect()] == [("b", "n")]
