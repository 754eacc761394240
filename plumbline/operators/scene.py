"""Scene rules over a table of signals, motion rules over tracked boxes, and what becomes of their events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("low", "medium", "high", "critical")
PRIORITIES = ("P4", "P3", "P2", "P1")


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical; anything else counts as medium."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(SEVERITY) for x in (s, k))), severity), F.lit(1))


def event_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("confidence").desc()]


def scene_events(signals: DataFrame) -> DataFrame:
    """One row for every rule that a row of signals meets: the signals' key columns, event_type, severity, confidence.

    signals: key columns, and fire, smoke (0 to 1), fire_area (share of the frame),
    obscured (0 to 1), persons, previous_persons, and fire_active, smoke_active.
    Fire is critical with a person, with smoke, or over one percent of the frame.
    Bad sight says nothing where smoke explains it.
    """
    key = [c for c in signals.columns if c not in ("fire", "smoke", "fire_area", "obscured", "persons", "previous_persons", "fire_active", "smoke_active")]
    c = F.col
    rule = lambda test, kind, severity, confidence: F.when(test, F.struct(F.lit(kind).alias("event_type"), severity.alias("severity"), F.round(confidence, 6).alias("confidence")))
    delta = c("persons") - c("previous_persons")
    rules = F.array(
        rule(c("fire_active"), "fire", F.when((c("persons") > 0) | c("smoke_active") | (c("fire_area") >= 0.01), "critical").otherwise("high"), c("fire")),
        rule(c("smoke_active"), "smoke", F.when(c("fire_active") | (c("persons") > 0), "high").otherwise("medium"), c("smoke")),
        rule(~c("smoke_active") & (c("obscured") >= 0.5), "low_visibility", F.when(c("persons") > 0, "medium").otherwise("low"), c("obscured")),
        rule(delta >= 3, "crowd_surge", F.when(delta >= 6, "high").otherwise("medium"), F.least(F.lit(1.0), 0.5 + delta / 20)),
        rule((delta <= -3) & (c("previous_persons") >= 4), "crowd_dispersal", F.lit("medium"), F.least(F.lit(1.0), 0.5 - delta / 20)),
    )
    return signals.select(*key, F.explode(F.array_compact(rules)).alias("e")).select(*key, "e.*")


@dataclass(frozen=True)
class FallParams:
    """Fixed values of the fall rules: seconds, ratios of height to width, frame heights a second."""

    youngest: float = 0.25
    oldest: float = 1.8
    upright: float = 1.15
    prone: float = 0.95
    shrink: float = 0.72
    drop: float = 0.30
    fast_drop: float = 0.55
    still_seconds: float = 2.0
    still_reach: float = 0.025
    #: Samples of a track that are remembered.
    history: int = 12


def posture(track: DataFrame, key: str, ts: str, order: str, x: str, y: str, width: str, height: str, params: FallParams = FallParams()) -> DataFrame:
    """track with `fall`, `immobile`, `confidence`, `drop_speed`, `aspect_before`, `aspect_after` by the last samples of each key.

    A sample is held against the newest of the last samples that is between
    youngest and oldest seconds old. It is a fall if the box went from upright to
    lying (0.80 sure, 0.90 if its centre sank fast), or sank very fast (0.72), or
    lost height against its width while it sank (0.55); the first of a track
    counts. Immobile (0.85): still_seconds or more after the fall, all samples of
    that time that are remembered, two at least, lie within reach of the first
    of them; the first such sample counts. y grows downwards; times are ordered by ts, then `order`.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = Window.partitionBy(key).orderBy(micros, order)
    sample = F.struct(micros.alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(height) / F.greatest(F.col(width), F.lit(1e-4))).cast("double").alias("aspect"))
    # as many samples as a track remembers, whatever its density
    held = track.withColumn("held__", F.collect_list(sample).over(own.rowsBetween(1 - params.history, 0)))
    age = "(held__[size(held__) - 1].t - s.t)"
    held = held.withColumn("now__", F.expr("held__[size(held__) - 1]"))
    held = held.withColumn("ref__", F.expr(f"try_element_at(filter(held__, s -> {age} BETWEEN {round(params.youngest * 1e6)} AND {round(params.oldest * 1e6)}), -1)"))
    c = F.col
    speed = (c("now__.y") - c("ref__.y")) / F.greatest((c("now__.t") - c("ref__.t")) / 1e6, F.lit(1e-3))
    held = held.withColumn("speed__", speed)
    collapse = (c("ref__.aspect") >= params.upright) & (c("now__.aspect") <= params.prone)
    shrunk = (c("now__.aspect") < c("ref__.aspect") * params.shrink) & (c("speed__") >= params.drop)
    held = held.withColumns({"collapse__": F.coalesce(collapse, F.lit(False)), "hit__": F.coalesce(collapse | shrunk | (c("speed__") >= params.fast_drop), F.lit(False))})
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("fall", c("hit__") & (F.count_if("hit__").over(so_far) == 1)).withColumn("fallen__", F.min(F.when(c("hit__"), c("now__.t"))).over(so_far))
    recent = f"filter(held__, s -> {age} <= {round(params.still_seconds * 1e6)})"
    calm = F.expr(f"size({recent}) >= 2 AND forall({recent}, s -> hypot(s.x - {recent}[0].x, s.y - {recent}[0].y) <= {params.still_reach})")
    still = ~c("fall") & c("ref__").isNotNull() & (c("now__.t") - c("fallen__") >= round(params.still_seconds * 1e6)) & calm
    held = held.withColumn("still__", F.coalesce(still, F.lit(False)))
    held = held.withColumn("immobile", c("still__") & (F.count_if("still__").over(so_far) == 1))
    sure = F.when(c("immobile"), 0.85).when(c("fall"), F.when(c("collapse__"), F.when(c("speed__") >= params.drop, 0.90).otherwise(0.80)).when(c("speed__") >= params.fast_drop, 0.72).otherwise(0.55))
    said = c("fall") | c("immobile")
    extra = {"confidence": sure, "drop_speed": F.when(c("immobile"), 0.0).when(c("fall"), F.round("speed__", 3)), "aspect_before": F.when(said, F.round("ref__.aspect", 2)), "aspect_after": F.when(said, F.round("now__.aspect", 2))}
    return held.withColumns(extra).select(*track.columns, "fall", "immobile", *extra)


def falling_mass(track: DataFrame, key: str, ts: str, x: str, y: str, near_person: Column, *, youngest: float = 0.15, oldest: float = 1.2, least: float = 0.35, least_near: float = 0.20) -> DataFrame:
    """Adds `speed` and `falling`: an object sank by `least` a second or more (`least_near` near a person), and not mostly sideways, against its reference sample; `confidence` where it did.

    Only the first of a track counts.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-int(oldest * 1e6), -int(youngest * 1e6))
    ref = F.last(F.struct(micros.alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))).over(w)
    seen = track.withColumn("ref__", ref).withColumn("near__", near_person)
    down, side = F.col(y) - F.col("ref__.y"), F.abs(F.col(x) - F.col("ref__.x"))
    seen = seen.withColumn("speed", down / ((micros - F.col("ref__.t")) / 1e6))
    hit = F.coalesce((F.col("speed") >= F.when(F.col("near__"), least_near).otherwise(least)) & (side <= 1.2 * down), F.lit(False))
    seen = seen.withColumn("hit__", hit)
    before = F.count_if("hit__").over(Window.partitionBy(key).orderBy(micros).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumn("falling", F.col("hit__") & (before == 1))
    sure = 0.45 + 0.35 * F.least(F.lit(1.0), F.col("speed") / 1.2) + F.when(F.col("near__"), 0.20).otherwise(0.0)
    return seen.withColumn("confidence", F.when(F.col("falling"), sure)).drop("ref__", "near__", "hit__")


def joint_priority(severity: Column, seen_confidence: Column, sif_potential: Column, text_confidence: Column) -> Column:
    """P1 to P4: the graver of what the camera and what the text says; a high severity seen with 0.70 or more is P1."""
    seen = F.when((severity == "high") & (seen_confidence >= 0.70), 3).otherwise(severity_rank(severity))
    told = F.when(sif_potential & (text_confidence >= 0.70), 3).when(sif_potential, 2).otherwise(0)
    return F.element_at(F.array(*map(F.lit, PRIORITIES)), F.greatest(seen, told) + 1)


def article(noun: Column) -> Column:
    """The noun behind a or an, by its first letter."""
    return F.concat(F.when(noun.rlike("^(?i)[aeiou]"), "an ").otherwise("a "), noun)


def narrative(kind: Column, zone: Column, ts: Column, confidence: Column) -> Column:
    """A sentence about an event: its kind, the zone if there is one, its time and how sure the camera is."""
    where = F.coalesce(F.concat(F.lit(" in "), F.rtrim(zone, F.lit("."))), F.lit(""))
    return F.concat(F.lit("Camera saw "), article(F.translate(kind, "_", " ")), where, F.lit(" at "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC ("), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("% sure)."))
