"""Narratives and what the chain must make of them, without any learned model."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import reports as R

CASES = [
    ("The breaker of pump 9 was switched off for servicing; lockout was in place and verified before anyone touched it.", {"sif_potential": False, "barrier_status": "confirmed_present", "gap_severity": 0.0}),
    ("A hoist carried a pipe bundle over the yard with no exclusion zone, and a rigger stood directly under it.", {"sif_potential": True, "barrier_status": "explicitly_absent", "gap_severity": 1.0, "exposure": "direct_proximity"}),
    ("The crane moved a pump housing to the barge while the area was clear of workers.", {"sif_potential": False, "exposure": "no_exposure"}),
    ("The scaffold tag was unverified when the painters climbed to the elevated platform.", {"barrier_status": "uncertain", "gap_severity": 0.6}),
    ("A cook slipped on a wet tile in the canteen and bruised an elbow.", {"sif_potential": False, "bucket": "HIGH_CONF_NON_SIF", "high_energy": False}),
    ("Pressure testing of the flare header began after the area was cleared of all personnel.", {"sif_potential": False, "exposure": "no_exposure"}),
    ("An electrician worked on a live wire of the switchboard, standing within the panel frame.", {"barrier_status": "not_mentioned", "gap_severity": None, "bucket": "NEEDS_MORE_INFO", "sif_potential": True}),
    ("Near miss on the jetty: a shackle fell from the crane boom and landed in the path of a welder. No injury.", {"near_miss": True, "sif_potential": True}),
    ("The area was clear of workers during the crane lift, yet a signaller was directly under the hook.", {"contradiction": True, "bucket": "LOW_CONF_REVIEW"}),
    (None, {"sif_potential": False, "barrier_status": "not_mentioned"}),
    ("", {"sif_potential": False}),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, text string")
    return {r["id"]: r for r in R.assessed(df).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_narrative(rows, k):
    for column, value in CASES[k][1].items():
        assert rows[k][column] == value, (column, rows[k][column], CASES[k][0])


def test_spans_slice_back_to_their_phrases(rows):
    for k, (text, _) in enumerate(CASES):
        for column in ("hazard_spans", "near_spans", "absent_spans", "confirm_spans", "activity_spans"):
            for s in rows[k][column]:
                assert text[s["start"] : s["end"]].lower() == s["phrase"]


def test_overlapping_occurrences_count(spark):
    df = spark.createDataFrame([("aaaa",), ("é aa",), ("",)], "t string").withColumn("s", T.phrase_spans("t", {"a": ["aa"]}))
    assert [[x["start"] for x in r["s"]] for r in df.collect()] == [[0, 1, 2], [2], []]


def test_whole_words_are_unicode_aware(spark):
    df = spark.createDataFrame([("row arrow row",), ("érow row",)], "t string").withColumn("s", T.phrase_spans("t", {"a": ["row"]}, whole_words=True))
    assert [[x["start"] for x in r["s"]] for r in df.collect()] == [[0, 10], [5]]


def test_normalisation(spark):
    df = spark.createDataFrame([("LOTO tag #482 was  confimed (PTW ref 12) , mazdoor ko dekha",)], "t string")
    assert df.select(R.normalised(F.col("t"))).first()[0] == "lockout tagout isolation tag was confirmed, the worker noticed"


def test_nested_spans_and_tiles(spark):
    df = spark.createDataFrame([("was struck by it",)], "t string").withColumn("s", T.phrase_spans("t", {"x": ["was struck by", "struck by", "by it"]}))
    r = df.select(T.nested_pruned("s").alias("n"), T.tiled("s", "length(t)").alias("w")).first()
    assert [(x["start"], x["end"]) for x in r["n"]] == [(0, 13), (11, 16)]
    assert [(x["start"], x["end"], x["category"]) for x in r["w"]] == [(0, 13, "x"), (13, 16, None)]
