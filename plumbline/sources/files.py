"""Readers and writers of report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPORT = "report_id string, site string, report_text string, source string, timestamp string, reporter_role string"
NARRATIVE = "narrative_id string, source_doc_id string, event_label string, event_type string, text string"


def csv_corpus(spark: SparkSession, path: str, schema: str, missing_as_text: bool = False) -> DataFrame:
    """A CSV with a header; values like "N/A" stay text. Missing strings are blank unless missing_as_text asks for nulls."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df if missing_as_text else df.na.fill("")


def json_lines(spark: SparkSession, path: str, schema: str = NARRATIVE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_stream(spark: SparkSession, folder: str, schema: str = REPORT, files: int = 100) -> DataFrame:
    """Batches of reports dropped as JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def ingested(reports: DataFrame) -> DataFrame:
    """Reports with an id, a time in UTC (null where it cannot be read), a known source and enough text."""
    key = F.sha2(F.concat_ws("|", F.coalesce("site", F.lit("")), F.coalesce("report_text", F.lit("")), F.coalesce("timestamp", F.lit(""))), 256)
    known = F.when(F.col("source").isin("synthetic", "field", "voice", "vision"), F.col("source")).otherwise("synthetic")
    return reports.where(F.length(F.trim("report_text")) >= 15).withColumns({"report_id": F.coalesce("report_id", F.concat(F.lit("rep_"), F.substring(key, 1, 8))), "ts": F.try_to_timestamp("timestamp"), "source": known})


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins; columns that either side lacks are null."""
    both = current.unionByName(changes, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return both.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__")


def transcripts(segments: DataFrame, least: int = 15) -> DataFrame:
    """Clip texts from recognised segments (clip_id, place, text, log_probability): confidence is the mean probability; short ones go."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    out = segments.groupBy("clip_id").agg(F.array_join(F.transform(parts, lambda x: F.trim(x["text"])), " ").alias("transcript"), F.round(F.avg(F.exp("log_probability")), 3).alias("confidence"))
    return out.where(F.length("transcript") >= least)
