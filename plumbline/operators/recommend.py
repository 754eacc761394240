"""Recommendations for recurring patterns: interventions, evidence, priority and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import cluster_summary, evidence, ranked_interventions

#: Where a pattern's reports name no barrier, and where they span no time.
DEFAULT_BARRIER, DEFAULT_DAYS = "Permit to work", 42
#: Members that a record lists; all are counted.
LISTED = 200


def priority_rank(priority: Column) -> Column:
    """HIGH before MEDIUM before LOW."""
    return F.when(priority == "HIGH", 0).when(priority == "MEDIUM", 1).otherwise(2)


def evidence_shares(counts: DataFrame, sizes: DataFrame, top: int = 6) -> DataFrame:
    """(cluster_id, evidence, n, share): a pattern's most frequent evidence but failure modes, as shares of its reports.

    counts: cluster_id, evidence, n. sizes: cluster_id, member_count.
    """
    kept = counts.where(~F.col("evidence").startswith("failure_mode::")).join(sizes.select("cluster_id", "member_count"), "cluster_id")
    w = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "evidence")
    ranked = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return ranked.select("cluster_id", "evidence", "n", (F.col("n") / F.col("member_count")).alias("share"))


def first_members(members: DataFrame, most: int = LISTED) -> DataFrame:
    """(cluster_id, member_ids): the smallest report ids of each pattern. A pattern's reports are ranked, never gathered."""
    w = Window.partitionBy("cluster_id").orderBy("report_id")
    few = members.select("cluster_id", "report_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.groupBy("cluster_id").agg(F.array_sort(F.collect_list("report_id")).alias("member_ids"))


def recommendations(members: DataFrame, library: DataFrame) -> DataFrame:
    """One record a pattern: priority, barrier, objective, evidence and the number of interventions with the first of them.

    members: frames with cluster_id. library: see ranked_interventions().
    """
    s = cluster_summary(members)
    days = F.floor((F.unix_seconds(F.col("last_seen").cast("timestamp")) - F.unix_seconds(F.col("first_seen").cast("timestamp"))) / 86400)
    barrier = F.coalesce("primary_barrier_type", F.lit(DEFAULT_BARRIER))
    out = s.select(
        "cluster_id",
        "priority",
        "pattern_type",
        F.col("primary_barrier_failure_mode").alias("primary_failure"),
        barrier.alias("barrier_type"),
        "primary_activity",
        F.col("member_count").alias("report_count"),
        "site_count",
        F.coalesce(F.when(days > 0, days), F.lit(DEFAULT_DAYS)).cast("long").alias("window_days"),
        "first_seen",
        "last_seen",
        F.concat(F.lit("Reduce recurrence of reports involving "), F.lower("primary_barrier_failure_mode"), F.lit(" during "), F.col("primary_activity"), F.lit(".")).alias("objective"),
    )
    modes = evidence(members).where(F.col("evidence").startswith("failure_mode::")).select("cluster_id", F.substring("evidence", 15, 1 << 20).alias("mode"), "n")
    offered = ranked_interventions(library, out.select("cluster_id", "barrier_type"), modes)
    first = offered.groupBy("cluster_id").agg(F.count("*").alias("interventions"), F.min_by("action", "rank").alias("first_intervention"))
    return out.join(first, "cluster_id", "left").withColumn("interventions", F.coalesce("interventions", F.lit(0).cast("long")))


def ordered(records: DataFrame, limit: int = 20) -> DataFrame:
    """By priority, then most reports first."""
    return records.orderBy(priority_rank(F.col("priority")), F.col("report_count").desc(), "cluster_id").limit(limit)
