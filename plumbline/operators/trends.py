"""Period series and control charts.

Both charts are recurrences over a short ordered series (weeks or months), so a
series is one array and the recurrence a fold over it, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def period_series(frames: DataFrame, unit: str = "week", by: list[str] | None = None) -> DataFrame:
    """Totals, flagged counts and rate of each period that has frames; weeks begin on Mondays. Rows without time are left out."""
    by = by or []
    out = frames.where("ts IS NOT NULL").groupBy(*by, F.date_trunc(unit, "ts").cast("date").alias("period")).agg(F.count("*").alias("total"), F.count_if("sif_potential").alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("total"))


def baseline(series: DataFrame, by: list[str], value: str, periods: int) -> DataFrame:
    """One row a series: the ordered points, and mean and deviation of the first max(3, min(periods, n)) of them.

    Where the deviation vanishes it is the square root of the mean, 1 at least.
    """
    points = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("period", F.col(value).cast("double").alias("v")))).alias("points"))
    points = points.withColumn("base_n", F.greatest(F.lit(3), F.least(F.lit(periods), F.size("points"))))
    points = points.withColumn("mu", F.expr("aggregate(slice(points, 1, base_n), 0D, (s, p) -> s + p.v) / least(base_n, size(points))"))
    points = points.withColumn("sd", F.expr("sqrt(aggregate(slice(points, 1, base_n), 0D, (s, p) -> s + (p.v - mu) * (p.v - mu)) / greatest(least(base_n, size(points)) - 1, 1))"))
    return points.withColumn("sd", F.when(F.col("sd") <= 1e-9, F.greatest(F.lit(1.0), F.sqrt(F.greatest("mu", F.lit(1.0))))).otherwise(F.col("sd")))


def charted(series: DataFrame, by: list[str], value: str, periods: int, start: str, step: str, columns: dict[str, str]) -> DataFrame:
    """Folds `step` over the points of each series and returns a row a point with `columns` of the fold's state.

    In step, s is the state so far, p the point; i is its place, from 0.
    """
    points = baseline(series, by, value, periods).withColumn("numbered", F.expr("transform(points, (p, i) -> named_struct('i', i, 'period', p.period, 'v', p.v))"))
    folded = points.withColumn("states", F.expr(f"aggregate(numbered, named_struct('s', {start}, 'all', cast(array() as array<struct<s:double>>)), (acc, p) -> named_struct('s', {step}, 'all', concat(acc.all, array(named_struct('s', {columns['state']})))) ).all"))
    return folded.select(*by, "mu", "sd", "base_n", F.size("points").alias("n"), F.posexplode(F.arrays_zip("numbered", "states")).alias("i", "x")).select(*by, "mu", "sd", "base_n", "n", "i", F.col("x.numbered.period").alias("period"), F.col("x.numbered.v").alias("value"), F.col("x.states.s").alias("state"))


def cusum(series: DataFrame, value: str = "flagged", by: list[str] | None = None, periods: int = 8, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Tabular CUSUM for a rise of the mean: a point signals beyond the base when the sum passes h deviations, and the sum starts anew only then.

    A series of under three points has sums of 0 and no signal.
    """
    grown = f"greatest(0D, acc.s + (p.v - mu) - {k} * sd)"
    step = f"IF({grown} > {h} * sd AND p.i >= base_n, 0D, {grown})"
    out = charted(series, by or [], value, periods, "0D", step, {"state": grown})
    enough = F.col("n") >= 3
    return out.select(*(by or []), "period", "i", "value", "mu", "sd", F.when(enough, F.col("state")).otherwise(0.0).alias("upper"), (enough & (F.col("state") > h * F.col("sd")) & (F.col("i") >= F.col("base_n"))).alias("signal"))


def ewma(series: DataFrame, value: str = "flagged", by: list[str] | None = None, periods: int = 8, lam: float = 0.3, width: float = 3.0) -> DataFrame:
    """Exponentially weighted mean with limits that widen to their end value; only a rise signals, beyond the base."""
    step = f"{lam} * p.v + (1 - {lam}) * acc.s"
    out = charted(series, by or [], value, periods, "mu", step, {"state": step}).where("n >= 3")
    limit = width * F.col("sd") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * (F.col("i") + 1))))
    upper = F.col("mu") + limit
    return out.select(*(by or []), "period", "i", "value", "mu", F.col("state").alias("smoothed"), upper.alias("upper_limit"), F.greatest(F.lit(0.0), F.col("mu") - limit).alias("lower_limit"), ((F.col("i") >= F.col("base_n")) & (F.col("state") > upper)).alias("signal"))


def alerts(series: DataFrame, value: str = "flagged", by: list[str] | None = None) -> DataFrame:
    """CUSUM signals, and EWMA signals at other points; none for a series of under four points."""
    by = by or []
    n = series.groupBy(*by).agg(F.count("*").alias("points")).where("points >= 4") if by else None
    c = cusum(series, value, by).where("signal").select(*by, "period", "value", F.lit("CUSUM").alias("method"), F.when(F.col("value") >= 2 * F.col("mu"), "high").otherwise("medium").alias("severity"))
    e = ewma(series, value, by).where("signal").select(*by, "period", "value", F.lit("EWMA").alias("method"), F.lit("medium").alias("severity"))
    out = c.unionByName(e.join(c.select(*by, "period"), [*by, "period"], "left_anti"))
    if n is not None:
        return out.join(n.select(*by), by, "left_semi")
    return out.where(F.lit(series.count() >= 4))


def surges(counts: DataFrame, key: str, at: str, count: str, rise: int = 3, fall: int = 3, crowd: int = 4) -> DataFrame:
    """Jumps against the reading before, of the same key: surge, or dispersal of a crowd."""
    before = F.lag(count).over(Window.partitionBy(key).orderBy(at))
    out = counts.withColumn("before", before)
    kind = F.when(F.col(count) - F.col("before") >= rise, "surge").when((F.col(count) - F.col("before") <= -fall) & (F.col("before") >= crowd), "dispersal")
    return out.withColumn("kind", kind).where("kind IS NOT NULL")
