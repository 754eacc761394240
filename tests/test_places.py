from plumbline.operators import models, places


def test_places_and_surroundings(spark):
    df = spark.createDataFrame([("work at field station 2 near rig 4, outside of confined space",), ("nothing",), ("in a confined space by the sea",)], "t string")
    got = df.select(places.named_place("t", {"Rig 4": "rig-4", "Field Station": "fs", "Field Station 2": "fs-2"}).alias("p"), "t").collect()
    assert got[0].p.place == "fs-2" and got[0].t[got[0].p.start : got[0].p.end] == "field station 2" and got[1].p is None
    got = [r.environment for r in places.surroundings(df, "t", {"sea": ["the sea"], "confined": ["confined space"]}, ["outside of"]).collect()]
    assert (got[0].category, got[0].negated) == ("confined", True) and got[1] is None and (got[2].category, got[2].negated) == ("confined", False)
    v = df.select(places.feature_vector("t", {"a": ["work", "rig"], "b": ["sea"]}).alias("v")).collect()
    assert v[0].v[:2] == [2.0, 0.0] and v[2].v[:2] == [0.0, 1.0]


def test_classifier_separates(spark):
    rows = [(k, ("good words here " if k % 2 else "bad stuff there ") + f"x{k}", k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, text string, y int")
    model = models.text_classifier(df.where("doc_id < 40"), features=1 << 10)
    out = models.calibrated(models.scored(model, df.where("doc_id >= 40 and doc_id < 60")), models.scored(model, df.where("doc_id >= 60"))).collect()
    assert len(out) == 20 and all((r.p > 0.5) == (r.y == 1) for r in out)
