"""Rankings of groups by precursor density."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Severity of a barrier gap in tenths; any other status counts 4.
GAP_TENTHS = {"explicitly_absent": 10, "uncertain": 6, "not_mentioned": 5, "confirmed_present": 0}
OTHER_GAP_TENTHS = 4


@dataclass(frozen=True)
class DensityWeights:
    rate: float = 0.25
    gap: float = 0.25
    magnitude: float = 0.25
    recurrence: float = 0.25
    reporting: float = 0.10


def first_mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; among equals the one met first in `order`."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "first")))
    return ranked.where("r = 1").select(*by, value)


def windowed(frames: DataFrame, group: str, now, days: int) -> DataFrame:
    """Frames of the current and the previous window with group key g; a frame without time counts as current."""
    start, before = now - timedelta(days=days), now - timedelta(days=2 * days)
    g = F.when(F.col(group).isNull() | (F.col(group) == ""), "unknown").otherwise(F.col(group))
    current = F.coalesce(F.col("ts") >= F.lit(start), F.lit(True))
    return frames.where((F.col("ts") >= F.lit(before)) | F.col("ts").isNull()).withColumns({"g": g, "current": current})


def simple_density(frames: DataFrame, group: str, now, days: int = 42) -> DataFrame:
    """g, total_reports, flagged, density, trend_pct, trend_direction, primary_lsr of the current window.

    The trend compares flagged frames with the window before: 100 percent if
    there were none, 0 if there are none now either. The primary tag is the most
    frequent one among flagged frames, the earliest report id breaking ties.
    """
    rows = windowed(frames, group, now, days)
    flagged = F.col("sif_potential")
    sums = rows.groupBy("g").agg(
        F.count_if("current").alias("total_reports"),
        F.count_if(F.col("current") & flagged).alias("flagged"),
        F.count_if(~F.col("current") & flagged).alias("before"),
    ).where("total_reports > 0")
    change = F.when(F.col("before") > 0, (F.col("flagged") - F.col("before")) / F.col("before") * 100.0).when(F.col("flagged") > 0, 100.0).otherwise(0.0)
    tags = rows.where(F.col("current") & flagged & F.col("lsr_tag").isNotNull() & ~F.col("lsr_tag").isin("N/A", "nan", "None", ""))
    out = sums.withColumn("trend_pct", change).join(first_mode(tags, ["g"], "lsr_tag", "report_id"), "g", "left")
    return out.select(
        "g",
        "total_reports",
        "flagged",
        (F.col("flagged") / F.col("total_reports")).alias("density"),
        "trend_pct",
        F.when(F.col("trend_pct") > 5, "up").when(F.col("trend_pct") < -5, "down").otherwise("flat").alias("trend_direction"),
        F.coalesce("lsr_tag", F.lit("N/A")).alias("primary_lsr"),
    )


def composite_density(frames: DataFrame, group: str, now, workforce: DataFrame, days: int = 42, weights: DensityWeights | None = None) -> DataFrame:
    """The weighted blend of rate, barrier gap, magnitude and recurrence, less a penalty for reporting far above the mean.

    workforce: (g, workers). Groups without workers have no penalty.
    """
    w = weights or DensityWeights()
    rows = windowed(frames, group, now, days).where("current")
    gap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in GAP_TENTHS.items() for x in kv)), F.col("barrier_status")), F.lit(OTHER_GAP_TENTHS))
    flagged = F.col("sif_potential")
    pattern = F.when(flagged & F.col("barrier_failure_mode").isNotNull() & (F.col("barrier_failure_mode") != ""), F.struct("activity", "barrier_failure_mode"))
    sums = rows.groupBy("g").agg(
        F.count("*").alias("total_reports"),
        F.count_if(flagged).alias("flagged"),
        F.sum(gap).alias("gap"),
        F.sum(F.when(flagged, F.coalesce("magnitude_class", F.lit(1)))).alias("magnitude"),
        F.count_distinct(pattern).alias("patterns"),
    )
    sums = sums.join(workforce.where("workers > 0"), "g", "left").withColumn("per_worker", F.col("total_reports") / F.col("workers"))
    sums = sums.withColumn("mean_per_worker", F.avg("per_worker").over(Window.partitionBy()))
    rate = F.col("flagged") / F.col("total_reports")
    mean_gap = F.col("gap") / (F.col("total_reports") * 10.0)
    magnitude = F.coalesce(F.try_divide(F.col("magnitude"), F.col("flagged") * 5.0), F.lit(0.0))
    recurrence = F.least(F.lit(1.0), F.col("patterns") / 10.0)
    penalty = F.coalesce(F.greatest(F.lit(0.0), (F.col("per_worker") - F.col("mean_per_worker")) / F.col("mean_per_worker")) * w.reporting, F.lit(0.0))
    score = w.rate * rate + w.gap * mean_gap + w.magnitude * magnitude + w.recurrence * recurrence - penalty
    return sums.select("g", "total_reports", "flagged", rate.alias("psif_rate"), mean_gap.alias("barrier_gap"), magnitude.alias("energy_magnitude"), recurrence.alias("pattern_recurrence"), penalty.alias("penalty"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("density"))
