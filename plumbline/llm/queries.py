"""The registered queries of the corpus operators, one an operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, html, jaccard, language, lines, negatives, neighbours, pii, quality, tokens, warc
from .common import alone, new_path, table

#: The vocabulary file that the token queries use; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The sentencepiece model that its tokens are aligned with.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and empty texts have the end id only; repeated ids one row each; other columns are ignored."""

    def run() -> DataFrame:
        path = new_path(spark, "tokens")
        tokens.write_token_files(table(spark, sf_dir, "documents"), path, tokens.TokenFileParams(TOKENIZER))
        return tokens.positions(spark, path)

    return alone(spark, run, "positions")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages have an empty text; repeated ids one row each; other columns are ignored."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what is left of their texts; null texts stay null."""
    return lines.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts and items match nothing; repeated rows give repeated results."""
    return alone(spark, lambda: decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "contaminated")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no spans; repeated ids one row each."""
    return alone(spark, lambda: pii.personal_data(table(spark, sf_dir, "documents")), "personal-data")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null page is an empty payload; repeated ids one row each."""
    return alone(spark, lambda: warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "captures")


#: The same decisions in SQL.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids; repeated ids one row each."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter are `und`; a null lang is not learned from; repeated ids one row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    return language.identify(docs, language.train(docs.where("not held_out")), keep=("held_out",))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rules; repeated ids one row each."""
    return alone(spark, lambda: quality.quality_rules(table(spark, sf_dir, "documents")), "quality")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts are groups of their own; repeated ids one row each."""
    return alone(spark, lambda: jaccard.jaccard_groups(table(spark, sf_dir, "documents"), jaccard.JaccardParams(words=3, percent=90)), "jaccard")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those that B's pieces change, have zeros; repeated ids one row each."""
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), alignment.AlignmentParams(TOKENIZER, PIECES))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, zero and non-finite vectors take no part; ties go to smaller ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.neighbours(rows, rows.where("id % 20 = 0")).withColumnRenamed("id", "vec_id")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id, label or vector, or a component that is not finite, take no part; ties go to smaller ids."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, rows.where("id % 100 = 0"))


#: The same by all pairs of anchors and rows.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_orc, op2_html_extraction, op3_line_dedup, op4_decontamination, op5_pii, op6_warc, op7_bpe, op8_language, op9_quality, op10_jaccard, op11_alignment, op12_neighbours, op13_negatives)}
ORACLES: dict[str, str] = {"op6_warc": OP6_SQL, "op13_negatives": OP13_SQL}
