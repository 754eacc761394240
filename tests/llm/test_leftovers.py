"""What queries leave in the shared folder, and very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, jaccard, pii, quality, queries, warc
from plumbline.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def held(spark) -> set[str]:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = where.getFileSystem(context._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(where)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_query_leaves_its_result_alone(spark, name):
    before = held(spark)
    rows = queries.QUERIES[name](spark, SF).count()
    left = held(spark) - before
    assert rows > 0 and len(left) <= (0 if name in ("op2_html_extraction", "op7_bpe", "op8_language") else 1), left


def test_the_pipeline_leaves_its_last_stage_alone(spark):
    before = held(spark)
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {x.rsplit("-", 1)[0] for x in held(spark) - before}
    assert left == {"stage-decontamination"}, left


def test_very_long_texts(spark):
    """Two million characters and more in one text: searched, counted and compared whole."""
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [f"word{k % 9973}x{k % 101}".translate(letters) for k in range(180_000)]
    item = "what is the name of the large river that runs through the old town and into the sea? the river is called meander after the god"
    long = " ".join(words[:100_000]) + " " + item + " " + " ".join(words[100_000:]) + " mail me@example.org 192.168.1.77"
    near = long.replace("wordfxf", "changed")
    df = spark.createDataFrame([(1, long, "en", "s"), (2, near, "en", "s"), (3, "short text", "en", "s")], "doc_id long, text string, lang string, source string")
    assert len(long) > 2_000_000
    found = decontaminate.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (2, 7)}
    counted = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert counted[1].n_words == len(long.split()) and counted[1].word_chars == sum(map(len, long.split()))
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df, jaccard.JaccardParams(words=3, percent=90)).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    spans = {r.doc_id: r for r in pii.personal_data(df).collect()}
    at = long.index("me@example.org")
    assert spans[1].n_email == spans[1].n_ip == 1 and f"email:{at}:{at + 14}" in spans[1].spans
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"), F.lit("clash").alias("record_type"), F.lit("clash").alias("payload_digest"))
    got = {r.page_id: r for r in warc.archived(pages.unionByName(pages.where("page_id = 1").withColumn("page_id", F.lit(9).cast("long")))).collect()}
    assert got[1].payload_bytes == len(long) and got[9].refers_to == 1 and got[9].payload_digest == hashlib.sha256(long.encode()).hexdigest()
