"""Tags and spans inside a document's row, against those that meet by shuffles."""

import random

from pyspark.sql import functions as F

from plumbline.operators import tagging
from plumbline.plans import corpus

SF = "/root/testdata/sf0.001"
SPANS = "array<struct<rank: int, label: string, start: int, end: int>>"


def test_tagged_rows_give_the_tags_and_spans_of_shuffled_tokens(spark):
    rng = random.Random(3)
    rows = []
    for d in range(12):
        text = "".join(rng.choice(["ab", " ", "é中", "😀", "\n", "x_1 ", "-- "]) for _ in range(rng.choice([0, 1, 30, 900])))
        spans = [(r, rng.choice("ABC"), s, s + rng.choice([0, 1, 3, 9, 200])) for r, s in enumerate(rng.randrange(len(text) + 1) for _ in range(len(text) // 8))]
        rows.append((d, text, spans))
    df = spark.createDataFrame([*rows, (90, "", []), (91, None, [])], f"d int, text string, spans {SPANS}").repartition(3)
    tokens = tagging.text_tokens(df, "d")
    plain = tagging.spans_to_tags(tokens, df.select("d", F.explode("spans").alias("s")).select("d", "s.*"), "d")
    label = F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    own = tagging.tagged_texts(df, "d", label)
    assert sorted(map(tuple, own.select("d", F.explode("tagged").alias("t")).select("d", "t.*").collect())) == sorted(map(tuple, plain.collect()))
    # parts of one token up to all of them
    for parts in ((), (1,), (7, 2)):
        again = df.select("d", F.expr(tagging.let(tagging.tokens_of(), "tokens", tagging.tags_of("tokens", "spans", parts))).alias("tagged"))
        assert sorted(map(str, again.collect())) == sorted(map(str, own.collect()))
    spans = own.select("d", F.expr(tagging.spans_of("tagged")).alias("spans"))
    back = spans.select("d", F.explode("spans").alias("s")).select("d", "s.*")
    want = tagging.tags_to_spans(plain, "d")
    assert back.count() > 150 and sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    sure = (F.col("start") % 5) / F.lit(5.0)
    best = spans.select("d", F.explode(F.expr(tagging.best_of("transform(spans, s -> named_struct('label', s.label, 'start', s.start, 'end', s.end, 'confidence', s.start % 5 / 5.0D))"))).alias("s")).select("d", "s.*")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, tagging.best_spans(want.withColumn("confidence", sure), "d").collect()))


def test_no_token_is_shuffled(spark):
    for query, exchanges in ((corpus.doc_tag_spans, 0), (corpus.doc_tags, 1), (corpus.doc_best_spans, 1)):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == exchanges and "Window" not in plan and "Join" not in plan
