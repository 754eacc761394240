"""Tables replaced whole, logs that only grow, and the terms behind coefficients."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import models, patterns
from plumbline.sources import versions


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert versions.current(spark, path, "rows") is None
    versions.published({"rows": old, "more": old.limit(1)}, path)
    reader = versions.current(spark, path, "rows")

    class Killed(Exception):
        pass

    bad = old.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        versions.published({"rows": old.limit(0), "more": bad}, path)  # the first table is written, the second is not
    assert sorted(map(tuple, versions.current(spark, path, "rows").collect())) == [(1, "a"), (2, "b")]
    for n in range(3, 6):
        versions.published({"rows": spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v")), "more": old}, path)
        assert versions.current(spark, path, "rows").count() == n
        if n == 3:
            assert reader.count() == 2  # the version before is still there
    kept = {p.name for p in (tmp_path / "t" / "versions").iterdir()}
    assert len(kept) == 2 and versions.current_version(spark, path) in kept


def test_a_log_takes_each_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda *k: spark.createDataFrame([(x, "created") for x in k], "id int, action string")
    assert versions.appended(rows(1, 2), path, "b1") and not versions.appended(rows(1, 2), path, "b1") and versions.appended(rows(3), path, "b2")
    with pytest.raises(Exception, match="killed"):
        versions.appended(rows(4).withColumn("action", F.raise_error(F.lit("killed"))), path, "b3")
    assert versions.appended(rows(4), path, "b3")
    assert sorted((r.id, r.batch) for r in versions.log(spark, path).collect()) == [(1, "b1"), (2, "b1"), (3, "b2"), (4, "b3")]
    with pytest.raises(ValueError):
        versions.appended(rows(5), path, "../x")


def test_clusters_are_published_with_their_members(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    base = ["lifting", "heat", "permit", "uncertain", "direct_proximity"]
    rows = [(f"r{k}", "s", None, *base, "mode", 4, True, True, "L1") for k in range(20)] + [(f"q{k}", "s", None, f"a{k}", f"b{k}", f"c{k}", f"d{k}", f"e{k}", "", 1, False, True, "N/A") for k in range(5)] + [("z", "s", None, *base, "mode", 4, True, False, "L1")]
    df = spark.createDataFrame(rows, "report_id string, site string, ts timestamp_ntz, activity string, energy_type string, barrier_type string, barrier_status string, exposure string, barrier_failure_mode string, magnitude_class int, is_high_energy boolean, sif_potential boolean, lsr_tag string")
    patterns.materialised(df, path)
    clusters = versions.current(spark, path, "clusters").collect()
    assert [(r.member_count, r.pattern_label) for r in clusters] == [(20, "lifting + heat + unverified barrier + direct exposure")]
    stamped = patterns.stamped(df, versions.current(spark, path, "members")).collect()
    assert {r.report_id for r in stamped if r.cluster_id} == {f"r{k}" for k in range(20)} and len(stamped) == len(rows)
    assert versions.current(spark, path, "edges").count() == 40
    patterns.materialised(df.where("report_id = 'z'"), path)
    assert versions.current(spark, path, "clusters").count() == versions.current(spark, path, "members").count() == 0


def test_terms_behind_coefficients(spark):
    rows = [(k, ("good fine words" if k % 2 else "bad poor words") + f" filler{k % 5}", k % 2) for k in range(60)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    model = models.text_classifier(df, features=1 << 16, chars=(3, 5))
    got = models.top_terms(model, df, top=8).collect()
    by = {s: [t for r in sorted((r for r in got if r.side == s), key=lambda r: r["rank"]) for t in r.terms] for s in ("positive", "negative")}
    assert {"good", "~ood "} & set(by["positive"]) and {"bad", "~bad", "poor"} & set(by["negative"]) and not {"words"} & {*by["positive"], *by["negative"]}
    assert [r["rank"] for r in got if r.side == "positive"] == list(range(1, 9)) and all(r.n_terms >= len(r.terms) for r in got)
    assert sorted(map(str, models.top_terms(model, df, top=8).collect())) == sorted(map(str, got))
    # sixteen features: terms collide, and it shows
    few = models.top_terms(models.text_classifier(df, features=16, chars=(3, 5)), df, top=3, shown=2).collect()
    assert all(len(r.terms) <= 2 for r in few) and any(r.n_terms > 2 for r in few)
