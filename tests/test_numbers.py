"""Rounding against Python's, and calibration steps against plain pooling."""

import random
import struct

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded_even
from plumbline.operators import evaluation
from plumbline.plans import tables


def test_rounding_is_python_s(spark):
    rng = random.Random(3)
    odd = [0.5, 1.5, 2.5, 0.125, 0.375, 2.675, 1.005, -2.675, -0.5, 1e-300, 0.0, -0.0, 1e22, 2.0**52 + 1, 2.0**51 + 0.5, float("inf"), 0.00005, 0.00015, 123456.00005, -1e-9, 2.0**50 + 0.25]
    xs = odd + [rng.uniform(-10, 10) for _ in range(40_000)] + [rng.randrange(-(10**6), 10**6) / 2 ** rng.randrange(30) for _ in range(40_000)]
    xs += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").repartition(4).persist()
    for digits in (0, 1, 4, 15):
        got = {r.k: r.v for r in df.select("k", rounded_even(F.col("x"), digits).alias("v")).collect()}
        assert all(got[k] == round(x, digits) or (x != x and got[k] != got[k]) for k, x in enumerate(xs))
    assert [r[0] for r in spark.sql("SELECT cast(null as double) AS x").select(rounded_even(F.col("x"), 4)).collect()] == [None]
    sf = "/root/testdata/sf0.001"
    values = {r.event_id: r.value for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    for r in tables.event_rounded(spark, sf).collect():
        assert r.value == round(values[r.event_id], 1) and r.eighths == round(np.floor(values[r.event_id]) / 8, 2)


def plain_steps(rows):
    out = []
    for p in sorted({p for p, _ in rows}):
        own = [y for q, y in rows if q == p]
        out.append([p, p, len(own), sum(own)])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            _, high, n, pos = out.pop()
            out[-1] = [out[-1][0], high, out[-1][2] + n, out[-1][3] + pos]
    return out


def test_isotonic_steps_and_rates(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < p**2).astype(int)
    rows = [(k, float(a), int(b)) for k, (a, b) in enumerate(zip(p, y, strict=True))]
    df = spark.createDataFrame([*rows, (-1, None, 1), (-2, 0.5, None)], "id int, p double, y int").repartition(6)
    want = plain_steps([(a, b) for _, a, b in rows])
    for ranges in (1, 7, 64):
        got = evaluation.isotonic(df, ranges, together=3).orderBy("low").collect()
        assert [[r.low, r.high, r.n, r.positives] for r in got] == [list(map(float, w)) for w in want]
        assert [r.rate for r in got] == sorted(r.rate for r in got)
    steps = evaluation.isotonic(df)
    knots = [(e, w[3] / w[2]) for w in want for e in ((w[0],) if w[0] == w[1] else (w[0], w[1]))]
    asked = spark.createDataFrame([(k, float(x)) for k, x in enumerate([-1.0, 0.0, 0.5, 1.0, 2.0, *rng.random(200)])] + [(-1, None)], "id int, p double")
    got = {r.id: r.p for r in evaluation.isotonic_rates(asked, steps).collect()}
    assert got.pop(-1) is None and len(got) == 205
    assert all(abs(got[r.id] - np.interp(r.p, *zip(*knots, strict=True))) < 1e-12 for r in asked.where("p IS NOT NULL").collect())
    error = lambda x: evaluation.calibration_error(x).first().ece
    known = df.where("p IS NOT NULL AND y IS NOT NULL")
    assert error(evaluation.isotonic_rates(known, steps)) < min(0.02, error(known))
    assert evaluation.isotonic(df.where("false")).count() == 0
