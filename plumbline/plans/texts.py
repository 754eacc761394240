"""Registered queries of the text functions over documents and conversations, and streams over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, events, models, ranking
from ..operators.reports import ReportParams, assessed, extracted
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The tables' own words; the default lexicons describe another domain.
WORDS = {"article": ["the", "der", "el "], "joining": ["and", "with", "und"], "place": ["of", "in the"]}
LISTED = [(c, p) for c, ps in WORDS.items() for p in ps]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("lc"))
    return d.withColumn("spans", T.phrase_spans("lc", WORDS))


VALUES = ", ".join(f"({k}, '{c}', '{p}')" for k, (c, p) in enumerate(LISTED))
HITS = f"w AS (SELECT * FROM (VALUES {VALUES}) v(k, c, p)), h AS (SELECT doc_id, k, c, (length(lower(text)) - length(replace(lower(text), p, ''))) // length(p) AS n, strpos(lower(text), p) - 1 AS early FROM documents, w)"


@query(f"WITH {HITS} SELECT doc_id, c AS category, CAST(sum(n) AS BIGINT) AS n, CAST(min(early) FILTER (n > 0) AS BIGINT) AS first_at FROM h GROUP BY doc_id, c HAVING sum(n) > 0")
def doc_phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s"))
    return s.groupBy("doc_id", F.col("s.category").alias("category")).agg(F.count("*").alias("n"), F.min("s.start").cast("long").alias("first_at"))


@query(f"WITH {HITS}, g AS (SELECT doc_id, c, sum(n) AS n, min(early) FILTER (n > 0) AS early, min(k) AS k FROM h GROUP BY doc_id, c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, early, k) AS r FROM g WHERE n > 0) SELECT d.doc_id, c AS best FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r = 1")
def doc_best_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("doc_id", T.best_category("spans", WORDS).alias("best"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)[(].*?ref.*?[)]', '', 'g'), '#[0-9]+', '', 'g'), '[ \t\n\r\f\v]+([.,])', '\1', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS tidy FROM documents")
def doc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tidied(F.col("text")).alias("tidy"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)[(].*?ref.*?[)]', '', 'g'), '#[0-9]+', '', 'g'), '[ \t\n\r\f\v]+([.,])', '\1', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS tidy FROM (SELECT conv_id, turn, '(see Ref ' || conv_id || ') ' || text || ' , tag #' || turn || '7 .' AS t FROM conversations)")
def turn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn between a remark to a reference and a tag number, which the rules take away."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("(see Ref "), F.col("conv_id").cast("string"), F.lit(") "), F.col("text"), F.lit(" , tag #"), F.col("turn").cast("string"), F.lit("7 ."))
    return c.select("conv_id", "turn", T.tidied(said).alias("tidy"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are grouped by length and two 64-bit hashes, so no text is shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return d.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id HAVING length(string_agg(trim(text), ' ' ORDER BY turn)) >= 200")
def conversation_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as one text: a conversation is a result's row, so its turns fit into one."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: F.trim(x["text"])), " ").alias("transcript"))
    return c.where(F.length("transcript") >= 200)


@query("SELECT source, lang AS mode FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def source_first_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_mode(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id").withColumnRenamed("lang", "mode")


COUNTED = "SELECT doc_id, t, (length(t) - length(replace(t, 'of the', ''))) // 6 AS nd, (length(t) - length(replace(t, 'der', ''))) // 3 AS ni, strpos(t, 'of the') AS fd, strpos(t, 'der') AS fi, contains(t, 'es que') AS clear FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"


@query(f"""WITH c AS ({COUNTED}), n AS (SELECT *, CASE WHEN nd = 0 AND ni = 0 THEN NULL WHEN nd > ni OR (nd = ni AND fd < fi) THEN 'direct_proximity' ELSE 'indirect_proximity' END AS nearest FROM c)
SELECT doc_id, CASE WHEN clear AND coalesce(nearest, '') <> 'direct_proximity' THEN 'no_exposure' WHEN nearest IS NOT NULL THEN nearest ELSE 'unspecified' END AS exposure, clear AND nearest IS NOT NULL AS contradiction,
  CASE WHEN contains(t, 'worthless') THEN 1.0::DOUBLE WHEN contains(t, 'stupid') THEN 0.6::DOUBLE END AS gap FROM n""")
def report_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, its contradiction and the gap of named barrier states, with lexicons of the tables' own words."""
    own = ReportParams(hazards=WORDS, activities=WORDS, exposures={"direct_proximity": ["of the"], "indirect_proximity": ["der"]}, no_exposure=["es que"], absences=["worthless"], uncertainties=["stupid"], barrier_terms=["no such barrier"], confirmations=["none"])
    d = extracted(table(spark, sf_dir, "documents").select("doc_id", "text"), own)
    return d.select("doc_id", "exposure", F.col("exposure_contradiction").alias("contradiction"), F.col("gap_severity").alias("gap"))


@query()
def doc_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report chain over every document, with lexicons of the tables' own words; checked by narrative tests."""
    own = ReportParams(hazards=WORDS, activities=WORDS, exposures={"direct_proximity": ["of the"], "indirect_proximity": ["der"]}, no_exposure=["es que"], absences=["worthless"], uncertainties=["stupid"], barrier_terms=["with"], confirmations=["is"])
    d = assessed(table(spark, sf_dir, "documents").select("doc_id", "text"), own)
    return d.select("doc_id", "hazard", "exposure", "barrier_status", "sif_potential", "bucket", "confidence")


@query("SELECT user_id, event_id, CASE WHEN count(value) OVER w >= 4 THEN round(stddev_pop(value) OVER w / avg(value) OVER w, 6) END AS pulse FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def event_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return events.pulse(e, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", F.round("pulse", 6).alias("pulse"))


@query()
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a text classifier of labelled quality on documents it has not seen; a learned model, so rows only."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("y"))
    d = evaluation.stratified_split(d, "y", "doc_id")
    model = models.text_classifier(d.where("part = 'train'"))
    held, test = (models.scored(model, d.where(f"part = '{p}'").drop("part")) for p in ("validation", "test"))
    return evaluation.binary_metrics(models.calibrated(held, test))


@query()
def quality_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words, pairs and character n-grams that speak most for and against quality; a learned model, so rows only."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("y"))
    return models.top_terms(models.text_classifier(d, features=1 << 14, chars=(3, 5)), d)
