"""Recurring patterns: signatures, density clusters, their summaries and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import published
from .density import density_labels
from .ranking import first_mode
from .similarity import match_edges

SIGNATURE = ("activity", "energy_type", "barrier_type", "barrier_status", "exposure")
MISSING = ("", "nan", "none", "<na>")


def cleaned(c: str):
    """Trimmed text; blank for the spellings of a missing value."""
    x = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(F.lower(x).isin(*MISSING), "").otherwise(x)


def signatures(frames: DataFrame, fields: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Distinct combinations of the fields, missing ones "unknown", with their number of reports."""
    known = [F.when(cleaned(c) == "", "unknown").otherwise(cleaned(c)).alias(c) for c in fields]
    return frames.select(*known).groupBy(*fields).agg(F.count("*").alias("n"))


def density_clusters(frames: DataFrame, min_size: int = 15, fields: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """(fields, n, label): hierarchical density clusters of the signatures, -1 for noise; reports of one signature are one weighted point."""
    return density_labels(signatures(frames, fields), fields, min_size)


#: What a pattern's label says of the barrier and of the exposure.
BARRIER_SAYS = {"confirmed_present": "barrier confirmed", "uncertain": "unverified barrier", "explicitly_absent": "absent barrier", "not_mentioned": "barrier not recorded"}
EXPOSURE_SAYS = {"direct_proximity": "direct exposure", "indirect_proximity": "indirect exposure", "no_exposure": "no exposure"}


def pattern_labels(members: DataFrame, order: str = "report_id") -> DataFrame:
    """(cluster_id, pattern_label): the most frequent activity, energy, barrier state and exposure of each cluster, in words.

    Blank values do not count; of equal numbers the value that is met first by
    `order` wins. A field without any value is called unspecified or unknown.
    """
    fields = {"activity": "unspecified activity", "energy_type": "unspecified energy", "barrier_status": "unknown", "exposure": "unknown exposure"}
    out = members.select("cluster_id").distinct()
    for f in fields:
        known = members.where(F.coalesce(F.col(f).cast("string"), F.lit("")) != "")
        out = out.join(first_mode(known, ["cluster_id"], f, order), "cluster_id", "left")
    said = {f: F.coalesce(f, F.lit(default)) for f, default in fields.items()}
    for f, words in (("barrier_status", BARRIER_SAYS), ("exposure", EXPOSURE_SAYS)):
        said[f] = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), said[f]), said[f])
    return out.select("cluster_id", F.concat_ws(" + ", *said.values()).alias("pattern_label"))


def clustered(frames: DataFrame, labels: DataFrame, fields: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Frames with the label of their signature as cluster_id "c<label>"; noise is left out."""
    own = frames
    for f in fields:
        own = own.withColumn(f"_{f}", F.when(cleaned(f) == "", "unknown").otherwise(cleaned(f)))
    key = labels.where("label >= 0").select(*(F.col(f).alias(f"_{f}") for f in fields), F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_id"))
    return own.join(key, [f"_{f}" for f in fields]).drop(*(f"_{f}" for f in fields))


def cluster_summary(members: DataFrame, recent: float = 0.25) -> DataFrame:
    """One row a cluster: size, sites, flagged share, mean magnitude, times, kind and most frequent values.

    Emerging: of at least four timed members, 60 percent or more fall into the
    last quarter of the cluster's own time span. Sporadic high severity: five
    members or fewer, of which all but one have high energy, and one lacks a barrier.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    ends = members.groupBy("cluster_id").agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    timed = members.withColumn("t", seconds).join(ends, "cluster_id")
    out = timed.groupBy("cluster_id").agg(
        F.count("*").alias("member_count"),
        F.count_distinct("site").alias("site_count"),
        F.count_if("sif_potential").alias("flagged"),
        F.avg("magnitude_class").alias("mean_magnitude"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_if("is_high_energy").alias("high_energy"),
        F.count_if(F.col("barrier_status").isin("explicitly_absent", "not_mentioned")).alias("no_barrier"),
        F.count("t").alias("timed"),
        F.count_if((F.col("t") >= F.col("high") - (F.col("high") - F.col("low")) * recent) & (F.col("high") > F.col("low"))).alias("late"),
        F.count_if(F.col("exposure") == "direct_proximity").alias("direct"),
    )
    kind = (
        F.when((F.col("member_count") <= 5) & (F.col("high_energy") >= F.greatest(F.lit(1), F.col("member_count") - 1)) & (F.col("no_barrier") >= 1), "sporadic_high_severity")
        .when((F.col("timed") >= 4) & (F.col("late") / F.greatest("timed", F.lit(1)) >= min(0.6, recent * 2.4)), "emerging")
        .otherwise("established")
    )
    out = out.withColumn("pattern_type", kind).withColumn("sif_share", F.col("flagged") / F.col("member_count"))
    for column, default, skip in (("lsr_tag", "N/A", ("", "N/A")), ("barrier_failure_mode", "not characterised", ("",)), ("barrier_type", None, ("",)), ("activity", "unspecified activity", ("",))):
        mode = first_mode(members.where(~F.coalesce(cleaned(column), F.lit("")).isin(*skip)), ["cluster_id"], column, "report_id").withColumnRenamed(column, f"primary_{column}")
        out = out.join(mode, "cluster_id", "left").withColumn(f"primary_{column}", F.coalesce(f"primary_{column}", F.lit(default)))
    return out.withColumn("priority", priority())


def stamped(frames: DataFrame, members: DataFrame, key: str = "report_id") -> DataFrame:
    """frames with the cluster_id that their key has among the members, null for others."""
    return frames.drop("cluster_id").join(members.select(key, "cluster_id"), key, "left")


def materialised(frames: DataFrame, path: str, min_size: int = 15, fields: tuple[str, ...] = SIGNATURE) -> str:
    """Clusters of the flagged frames, their members and edges, published together as the current version under a path.

    Replaces all clusters, or none: see sources.versions. Fewer flagged frames
    than a cluster needs publish empty tables.
    """
    flagged = frames.where("sif_potential")
    members = clustered(flagged, density_clusters(flagged, min_size, fields), fields)
    clusters = cluster_summary(members).join(pattern_labels(members), "cluster_id", "left")
    return published({"clusters": clusters, "members": members.select("report_id", "cluster_id"), "edges": match_edges(members, "cluster_id", "report_id", fields)}, path)


def priority():
    """HIGH, MEDIUM or LOW of a pattern."""
    n = F.col("member_count")
    return (
        F.when(F.col("pattern_type") == "sporadic_high_severity", "HIGH")
        .when(n >= 20, "HIGH")
        .when((F.col("pattern_type") == "emerging") & (F.col("direct") >= F.greatest(F.lit(1), F.floor(n / 3))), "HIGH")
        .when(n >= 8, "MEDIUM")
        .otherwise("LOW")
    )


def evidence(members: DataFrame, by: str = "cluster_id") -> DataFrame:
    """(by, evidence, n): counts of barrier states, exposure, flags, high energy and each failure mode."""
    mode = F.col("barrier_failure_mode")
    keys = F.array_compact(
        F.array(
            F.when(F.col("barrier_status") == "explicitly_absent", "barrier_explicitly_absent").when(F.col("barrier_status") == "uncertain", "barrier_unverified").when(F.col("barrier_status") == "not_mentioned", "barrier_not_recorded"),
            F.when(F.col("exposure") == "direct_proximity", "direct_personnel_exposure"),
            F.when(F.col("sif_potential"), "flagged_sif_potential"),
            F.when(F.col("magnitude_class") >= 4, "high_energy_present"),
            F.when(mode.isNotNull() & (mode != ""), F.concat(F.lit("failure_mode::"), mode)),
        )
    )
    return members.select(by, F.explode(keys).alias("evidence")).groupBy(by, "evidence").agg(F.count("*").alias("n"))


def ranked_interventions(library: DataFrame, needs: DataFrame, observed: DataFrame) -> DataFrame:
    """Interventions of each pattern by control level, matched evidence and curated order.

    library: barrier_type, action, control_level (1 best), place, addresses; needs:
    cluster_id, barrier_type; observed: cluster_id, mode, n. An action named twice counts once, where it ranks best.
    """
    offered = needs.join(library, "barrier_type")
    matched = offered.select("cluster_id", "place", F.explode_outer("addresses").alias("mode")).join(observed, ["cluster_id", "mode"]).groupBy("cluster_id", "place").agg(F.sum("n").alias("matches"))
    scored = offered.join(matched, ["cluster_id", "place"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    w = Window.partitionBy("cluster_id").orderBy("control_level", F.col("matches").desc(), "place")
    once = scored.withColumn("r", F.row_number().over(w)).withColumn("again", F.row_number().over(Window.partitionBy("cluster_id", "action").orderBy("r"))).where("again = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("r"))).select("cluster_id", "rank", "action", "control_level", "matches")
