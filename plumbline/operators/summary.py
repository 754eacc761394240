"""Counts for overviews, queues, sites and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence weights and strengths of the routing rules.
ENERGY_WEIGHT, BARRIER_WEIGHT, EXPOSURE_WEIGHT = 0.30, 0.40, 0.30
LOW_ENERGY_FACTOR = 0.25
BARRIER_STRENGTH = {"explicitly_absent": 1.0, "uncertain": 0.65, "not_mentioned": 0.5, "confirmed_present": 0.0, "confirmed": 0.0}
EXPOSURE_STRENGTH = {"direct_proximity": 1.0, "indirect_proximity": 0.55, "no_exposure": 0.0, "unspecified": 0.35, "unknown": 0.35}
HIGH_CONFIDENCE = 0.75
MODEL_DISAGREEMENT = 0.70
BUCKETS = ("LOW_CONF_REVIEW", "NEEDS_MORE_INFO", "HIGH_CONF_SIF", "HIGH_CONF_NON_SIF")


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def evidence_strength(base: Column, high_energy: Column, barrier: Column, exposure: Column) -> Column:
    """One score from 0 to 1 for energy, barrier and exposure evidence."""
    energy = F.coalesce(base, F.lit(0.0)) * F.when(high_energy, 1.0).otherwise(LOW_ENERGY_FACTOR)
    score = ENERGY_WEIGHT * energy + BARRIER_WEIGHT * lookup(BARRIER_STRENGTH, barrier, 0.5) + EXPOSURE_WEIGHT * lookup(EXPOSURE_STRENGTH, exposure, 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def bucket(flagged: Column, high_energy: Column, barrier: Column, exposure: Column, strength: Column, *, contradiction: Column | None = None, consistent: Column | None = None, warnings: Column | None = None, fallback_energy: Column | None = None, needs_info: Column | None = None) -> Column:
    """The review bucket, by rules in order: contradictions, undecidable, silent barrier, flagged, cleared."""
    no, yes = F.lit(False), F.lit(True)
    contradiction, consistent, warnings = contradiction if contradiction is not None else no, consistent if consistent is not None else yes, warnings if warnings is not None else no
    fallback_energy, needs_info = fallback_energy if fallback_energy is not None else no, needs_info if needs_info is not None else no
    exposed = exposure.isin("direct_proximity", "indirect_proximity")
    unknown_exposure = ~exposed & F.coalesce(exposure, F.lit("")).isin("unspecified", "unknown", "")
    silent = barrier == "not_mentioned"
    cleared = ~high_energy | barrier.isin("confirmed_present", "confirmed") | ~exposed
    return (
        F.when(contradiction, "LOW_CONF_REVIEW")
        .when(high_energy & silent & (unknown_exposure | fallback_energy), "NEEDS_MORE_INFO")
        .when(high_energy & silent, "NEEDS_MORE_INFO")
        .when(flagged, F.when((strength >= HIGH_CONFIDENCE) & consistent & ~warnings & (barrier != "uncertain"), "HIGH_CONF_SIF").otherwise("LOW_CONF_REVIEW"))
        .when(cleared & consistent & (barrier != "uncertain"), "HIGH_CONF_NON_SIF")
        .when(needs_info, "NEEDS_MORE_INFO")
        .otherwise("LOW_CONF_REVIEW")
    )


def cross_checked(bucket: Column, flagged: Column, model_flagged: Column, model_confidence: Column) -> Column:
    """A confident model that disagrees sends a sure bucket to review."""
    disagrees = F.coalesce((model_flagged != flagged) & (model_confidence >= MODEL_DISAGREEMENT), F.lit(False))
    return F.when(disagrees & bucket.isin("HIGH_CONF_SIF", "HIGH_CONF_NON_SIF"), "LOW_CONF_REVIEW").otherwise(bucket)


def routed(frames: DataFrame) -> DataFrame:
    """Frames with strength and bucket; the frame's confidence stands for that of the energy evidence."""
    strength = evidence_strength(F.col("confidence"), F.col("is_high_energy"), F.col("barrier_status"), F.col("exposure"))
    out = frames.withColumn("strength", strength)
    return out.withColumn("bucket", bucket(F.col("sif_potential"), F.col("is_high_energy"), F.col("barrier_status"), F.col("exposure"), F.col("strength")))


def dashboard(routed_frames: DataFrame) -> DataFrame:
    """Totals, pending and flagged reports, their rate, distinct sites and the latest time, in one pass."""
    pending = F.col("bucket").isin("LOW_CONF_REVIEW", "NEEDS_MORE_INFO")
    return routed_frames.agg(
        F.count("*").alias("total"),
        F.count_if(pending).alias("pending"),
        F.count_if("sif_potential").alias("flagged"),
        F.coalesce(F.try_divide(F.count_if("sif_potential"), F.count("*")), F.lit(0.0)).alias("sif_rate"),
        F.count_distinct("site").alias("sites"),
        F.max("ts").alias("latest"),
    )


def site_profile(frames: DataFrame, top: int = 5) -> DataFrame:
    """One row a site: totals, barrier histogram, level, and its most frequent tags and activities by rank."""
    base = frames.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count_if("sif_potential").alias("flagged"),
        *(F.count_if(F.col("barrier_status") == s).alias(f"n_{s}") for s in ("confirmed_present", "uncertain", "explicitly_absent", "not_mentioned")),
    )
    level = F.col("flagged") / F.col("total")
    base = base.withColumn("density", level).withColumn("level", F.when(level > 0.35, "up").when(level < 0.20, "down").otherwise("flat"))
    lsr = ranked_counts(frames.where("sif_potential AND lsr_tag <> 'N/A'"), "site", "lsr_tag", top)
    activity = ranked_counts(frames.where("activity <> 'unspecified activity'"), "site", "activity", top)
    return base.join(lsr.withColumnRenamed("ranked", "top_lsr"), "site", "left").join(activity.withColumnRenamed("ranked", "top_activity"), "site", "left")


def ranked_counts(frames: DataFrame, by: str, value: str, top: int) -> DataFrame:
    """The most frequent values of each group as one text, "value:count" by falling count, then by value."""
    counted = frames.groupBy(by, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), value))
    few = counted.withColumn("place", place).where(F.col("place") <= top)
    return few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", value, "n"))), lambda x: F.concat_ws(":", x[value], x["n"].cast("string"))), ",").alias("ranked"))


def review_page(routed_frames: DataFrame, order: str, limit: int, offset: int = 0, buckets: tuple[str, ...] = ("LOW_CONF_REVIEW", "NEEDS_MORE_INFO")) -> DataFrame:
    """A page of the review queue: by bucket and age (oldest, newest), or by rising confidence, unknown last."""
    rank = F.when(F.col("bucket") == "LOW_CONF_REVIEW", 0).when(F.col("bucket") == "NEEDS_MORE_INFO", 1).otherwise(2)
    keys = {"oldest": [rank, F.col("ts").asc()], "newest": [rank, F.col("ts").desc()], "confidence": [F.col("confidence").asc_nulls_last()]}[order]
    return routed_frames.where(F.col("bucket").isin(*buckets)).orderBy(*keys, "report_id").offset(offset).limit(limit)


def report_page(routed_frames: DataFrame, limit: int, offset: int = 0, *, sites: list[str] | None = None, flagged: bool | None = None, bucket: str | None = None, tag: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A page of reports, newest first, under optional filters; a limit of time that cannot be read is ignored."""
    out = routed_frames
    if sites is not None:
        out = out.where(F.col("site").isin(sites))
    if flagged is not None:
        out = out.where(F.col("sif_potential") == flagged)
    if bucket is not None:
        out = out.where(F.col("bucket") == bucket)
    if tag is not None:
        out = out.where(F.col("lsr_tag") == tag)
    for text, keep in ((since, lambda x: F.col("ts") >= x), (until, lambda x: F.col("ts") <= x)):
        if text is not None:
            at = F.try_to_timestamp(F.lit(text)).cast("timestamp_ntz")
            out = out.where(at.isNull() | keep(at))
    return out.orderBy(F.col("ts").desc(), "report_id").offset(offset).limit(min(limit, 200))


def promoted(actions: DataFrame, least: int = 2) -> DataFrame:
    """Corrections on which at least two reviewers agree; a missing correction equals a missing one."""
    agreed = actions.groupBy("report_id", "corrected_sif", "corrected_lsr").agg(F.count_distinct("reviewer").alias("reviewers"))
    return agreed.where(F.col("reviewers") >= least)


def rollup(hierarchy: DataFrame, target: str, member: str) -> DataFrame:
    """(target, member) of a two-level hierarchy, every target being a member of itself as well."""
    own = hierarchy.select(F.col(target).alias("target"), F.col(target).alias("member"))
    below = hierarchy.select(F.col(target).alias("target"), F.col(member).alias("member"))
    return own.union(below).distinct()


def legacy_bucket(score, flagged, high: float = 0.75, low: float = 0.25):
    """Routing by a single score, as older models had it."""
    sure = F.when(flagged, score >= high).otherwise(score >= 1 - low)
    return F.when(~sure, "LOW_CONF_REVIEW").when(flagged, "HIGH_CONF_SIF").otherwise("HIGH_CONF_NON_SIF")


def score_band(score, high: float = 0.75, low: float = 0.25):
    """high, low, or review between the two thresholds."""
    return F.when(score >= high, "high").when(score <= low, "low").otherwise("review")
