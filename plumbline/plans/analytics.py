"""Registered queries over the event frame, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, patterns, ranking, similarity, summary, trends
from ..sources.tables import FRAMES_SQL, frames, latest, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAYS = 365


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def clock(spark: SparkSession, sf_dir: str):
    """The latest time in the frames: every order line is a frame, so no join is needed."""
    return latest(table(spark, sf_dir, "lineitem"), "l_shipdate")


def with_frames(sql: str) -> str:
    return f"WITH RECURSIVE {FRAMES_SQL}, clock AS (SELECT max(ts) AS now FROM frames){sql}"


def density_sql(group: str) -> str:
    return with_frames(f"""
, w AS (SELECT coalesce(nullif({group}, ''), 'unknown') AS g, ts >= now - INTERVAL {DAYS} DAY AS cur, * FROM frames, clock WHERE ts >= now - INTERVAL {2 * DAYS} DAY),
s AS (SELECT g, count(*) FILTER (cur) AS total_reports, count(*) FILTER (cur AND sif_potential) AS flagged, count(*) FILTER (NOT cur AND sif_potential) AS before FROM w GROUP BY g),
t AS (SELECT g, lsr_tag, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, min(report_id)) AS r FROM w WHERE cur AND sif_potential AND lsr_tag <> 'N/A' GROUP BY g, lsr_tag),
u AS (SELECT *, CASE WHEN before > 0 THEN (flagged - before) / before * 100.0 WHEN flagged > 0 THEN 100.0 ELSE 0.0 END AS trend_pct FROM s WHERE total_reports > 0)
SELECT u.g, total_reports, flagged, flagged / total_reports AS density, CAST(trend_pct AS DOUBLE) AS trend_pct,
  CASE WHEN trend_pct > 5 THEN 'up' WHEN trend_pct < -5 THEN 'down' ELSE 'flat' END AS trend_direction, coalesce(lsr_tag, 'N/A') AS primary_lsr
FROM u LEFT JOIN t ON u.g = t.g AND r = 1""")


@query(density_sql("site"))
def density_simple_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return ranking.simple_density(f, "site", clock(spark, sf_dir), DAYS)


@query(density_sql("activity"))
def density_simple_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return ranking.simple_density(f, "activity", clock(spark, sf_dir), DAYS)


@query(
    with_frames(f"""
, w AS (SELECT site AS g, * FROM frames, clock WHERE ts >= now - INTERVAL {DAYS} DAY),
s AS (SELECT g, count(*) AS total_reports, count(*) FILTER (sif_potential) AS flagged,
  sum(CASE barrier_status WHEN 'explicitly_absent' THEN 10 WHEN 'uncertain' THEN 6 WHEN 'not_mentioned' THEN 5 WHEN 'confirmed_present' THEN 0 ELSE 4 END) AS gap,
  coalesce(sum(magnitude_class) FILTER (sif_potential), 0) AS magnitude,
  count(DISTINCT activity || '|' || barrier_failure_mode) FILTER (sif_potential AND barrier_failure_mode <> '') AS patterns FROM w GROUP BY g),
p AS (SELECT s.*, total_reports / (100 + n_nationkey * 10) AS pw FROM s LEFT JOIN nation ON g = n_name),
q AS (SELECT *, avg(pw) OVER () AS mean_pw FROM p),
r AS (SELECT g, total_reports, flagged, flagged / total_reports AS psif_rate, gap / (total_reports * 10.0) AS barrier_gap, CASE WHEN flagged > 0 THEN magnitude / (flagged * 5.0) ELSE 0.0 END AS energy_magnitude,
  least(1.0, patterns / 10.0) AS pattern_recurrence, coalesce(greatest(0.0, (pw - mean_pw) / mean_pw) * 0.1::DOUBLE, 0.0) AS penalty FROM q)
SELECT g, total_reports, flagged, psif_rate, round(barrier_gap, 9) AS barrier_gap, round(energy_magnitude, 9) AS energy_magnitude, CAST(pattern_recurrence AS DOUBLE) AS pattern_recurrence, round(penalty, 9) AS penalty,
  round(greatest(0.0, least(1.0, 0.25 * psif_rate + 0.25 * barrier_gap + 0.25 * energy_magnitude + 0.25 * pattern_recurrence - penalty)), 9) AS density FROM r""")
)
def density_composite_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    workforce = table(spark, sf_dir, "nation").select(F.col("n_name").alias("g"), (100 + F.col("n_nationkey") * 10).alias("workers"))
    out = ranking.composite_density(f, "site", clock(spark, sf_dir), workforce, DAYS)
    return out.withColumns({c: F.round(c, 9) for c in ("barrier_gap", "energy_magnitude", "penalty", "density")})


ROUTED_SQL = """
, st AS (SELECT *, greatest(0.0, least(1.0, 0.3::DOUBLE * (confidence * CASE WHEN is_high_energy THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END)
    + 0.4::DOUBLE * CASE barrier_status WHEN 'explicitly_absent' THEN 1.0::DOUBLE WHEN 'uncertain' THEN 0.65::DOUBLE WHEN 'not_mentioned' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + 0.3::DOUBLE * CASE exposure WHEN 'direct_proximity' THEN 1.0::DOUBLE WHEN 'indirect_proximity' THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END)) AS strength FROM frames),
routed AS (SELECT *, CASE WHEN barrier_status = 'not_mentioned' AND is_high_energy THEN 'NEEDS_MORE_INFO'
    WHEN sif_potential THEN CASE WHEN strength >= 0.75 AND barrier_status <> 'uncertain' THEN 'HIGH_CONF_SIF' ELSE 'LOW_CONF_REVIEW' END
    WHEN (NOT is_high_energy OR barrier_status = 'confirmed_present' OR exposure = 'no_exposure') AND barrier_status <> 'uncertain' THEN 'HIGH_CONF_NON_SIF'
    ELSE 'LOW_CONF_REVIEW' END AS bucket FROM st)
"""


@query(with_frames(ROUTED_SQL + "SELECT count(*) AS total, count(*) FILTER (bucket IN ('LOW_CONF_REVIEW', 'NEEDS_MORE_INFO')) AS pending, count(*) FILTER (sif_potential) AS flagged, count(*) FILTER (sif_potential) / count(*) AS sif_rate, count(DISTINCT site) AS sites, max(ts) AS latest FROM routed"))
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dashboard(summary.routed(frames(spark, sf_dir)))


@query(with_frames(ROUTED_SQL + "SELECT bucket, count(*) AS n FROM routed GROUP BY bucket"))
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.routed(frames(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(with_frames(ROUTED_SQL + "SELECT report_id, ts, site, bucket FROM routed WHERE sif_potential AND ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1999-12-31' ORDER BY ts DESC, report_id LIMIT 50 OFFSET 100"))
def report_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = summary.report_page(summary.routed(frames(spark, sf_dir)), 50, 100, flagged=True, since="1997-01-01", until="1999-12-31")
    return page.select("report_id", "ts", "site", "bucket")


@query(with_frames(ROUTED_SQL + "SELECT report_id, ts, bucket FROM routed WHERE bucket IN ('LOW_CONF_REVIEW', 'NEEDS_MORE_INFO') ORDER BY CASE bucket WHEN 'LOW_CONF_REVIEW' THEN 0 ELSE 1 END, ts, report_id LIMIT 100"))
def review_queue_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.review_page(summary.routed(frames(spark, sf_dir)), "oldest", 100).select("report_id", "ts", "bucket")


@query(with_frames(ROUTED_SQL + "SELECT report_id, bucket FROM routed WHERE bucket IN ('LOW_CONF_REVIEW', 'NEEDS_MORE_INFO') ORDER BY confidence ASC NULLS LAST, report_id LIMIT 100"))
def review_queue_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.review_page(summary.routed(frames(spark, sf_dir)), "confidence", 100).select("report_id", "bucket")


@query(with_frames(", h AS (SELECT r_name AS target, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region) SELECT target, count(*) AS reports, count(*) FILTER (sif_potential) AS flagged FROM frames JOIN h ON site = member GROUP BY target"))
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    closure = summary.rollup(tree, "r_name", "n_name")
    return frames(spark, sf_dir).join(closure, F.col("site") == F.col("member")).groupBy("target").agg(F.count("*").alias("reports"), F.count_if("sif_potential").alias("flagged"))


SITE_SQL = """
, b AS (SELECT site, count(*) AS total, count(*) FILTER (sif_potential) AS flagged, count(*) FILTER (barrier_status = 'confirmed_present') AS n_confirmed_present, count(*) FILTER (barrier_status = 'uncertain') AS n_uncertain,
  count(*) FILTER (barrier_status = 'explicitly_absent') AS n_explicitly_absent, count(*) FILTER (barrier_status = 'not_mentioned') AS n_not_mentioned FROM frames GROUP BY site),
l AS (SELECT site, lsr_tag AS v, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, lsr_tag) AS r FROM frames WHERE sif_potential GROUP BY site, lsr_tag),
a AS (SELECT site, activity AS v, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, activity) AS r FROM frames GROUP BY site, activity),
profile AS (SELECT b.*, flagged / total AS density, CASE WHEN flagged / total > 0.35 THEN 'up' WHEN flagged / total < 0.20 THEN 'down' ELSE 'flat' END AS level,
  (SELECT string_agg(v || ':' || n, ',' ORDER BY r) FROM l WHERE l.site = b.site AND r <= 5) AS top_lsr, (SELECT string_agg(v || ':' || n, ',' ORDER BY r) FROM a WHERE a.site = b.site AND r <= 5) AS top_activity FROM b)
"""


@query(with_frames(SITE_SQL + "SELECT * FROM profile"))
def site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.site_profile(frames(spark, sf_dir))


@query(with_frames(SITE_SQL + "SELECT pos, p.site, total, flagged, density, level FROM profile p JOIN (VALUES (0, 'NATION_3'), (1, 'NATION_17'), (2, 'NATION_8')) v(pos, site) ON p.site = v.site"))
def site_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(["NATION_3", "NATION_17", "NATION_8"],)], "asked array<string>").select(F.posexplode("asked").alias("pos", "site"))
    return summary.site_profile(frames(spark, sf_dir)).join(F.broadcast(asked), "site").select("pos", "site", "total", "flagged", "density", "level")


@query(with_frames(" SELECT activity, barrier_failure_mode, count(*) AS report_count, count(*) FILTER (sif_potential) AS flagged, count(*) FILTER (sif_potential) / count(*) AS share FROM frames WHERE barrier_failure_mode <> '' AND activity <> '' GROUP BY ALL HAVING count(*) >= 5"))
def barrier_failure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.failure_pairs(frames(spark, sf_dir))


def series_sql(unit: str) -> str:
    return with_frames(f" SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS period, count(*) AS total, count(*) FILTER (sif_potential) AS flagged, count(*) FILTER (sif_potential) / count(*) AS rate FROM frames GROUP BY 1")


@query(series_sql("week"))
def trend_series_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.period_series(frames(spark, sf_dir), "week")


@query(series_sql("month"))
def trend_series_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.period_series(frames(spark, sf_dir), "month")


def chart_sql(unit: str, key: str = "'all'") -> str:
    return f"""
, s AS (SELECT {key} AS g, CAST(date_trunc('{unit}', ts) AS DATE) AS period, CAST(count(*) FILTER (sif_potential) AS DOUBLE) AS v FROM frames GROUP BY 1, 2),
o AS (SELECT g, period, v, row_number() OVER (PARTITION BY g ORDER BY period) - 1 AS i FROM s),
b AS (SELECT g AS bg, avg(v) AS mu, CASE WHEN stddev_samp(v) <= 1e-9 THEN greatest(1.0, sqrt(greatest(avg(v), 1.0))) ELSE stddev_samp(v) END AS sd FROM o WHERE i < 8 GROUP BY g),
c AS (SELECT g, i, v, period, greatest(0.0, v - mu - 0.5 * sd) AS u, 0.3::DOUBLE * v + 0.7::DOUBLE * mu AS z FROM o JOIN b ON g = bg WHERE i = 0
  UNION ALL SELECT o.g, o.i, o.v, o.period, greatest(0.0, (CASE WHEN c.u > 4 * sd AND c.i >= 8 THEN 0.0 ELSE c.u END) + o.v - mu - 0.5 * sd), 0.3::DOUBLE * o.v + 0.7::DOUBLE * c.z FROM c JOIN o ON o.g = c.g AND o.i = c.i + 1 JOIN b ON o.g = bg),
chart AS (SELECT g, period, i, v AS value, mu, sd, u, u > 4 * sd AND i >= 8 AS cus, z, mu + 3 * sd * sqrt(0.3::DOUBLE / 1.7::DOUBLE * (1 - power(0.7::DOUBLE, 2 * (i + 1)))) AS up, greatest(0.0, mu - 3 * sd * sqrt(0.3::DOUBLE / 1.7::DOUBLE * (1 - power(0.7::DOUBLE, 2 * (i + 1))))) AS low FROM c JOIN b ON g = bg)
"""


CHART_SQL = chart_sql("week")


@query(with_frames(CHART_SQL + "SELECT period, value, round(u, 4) AS upper, cus AS signal FROM chart"))
def cusum_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trends.cusum(trends.period_series(frames(spark, sf_dir), "week"))
    return out.select("period", "value", F.round("upper", 4).alias("upper"), "signal")


@query(with_frames(CHART_SQL + "SELECT period, value, round(z, 4) AS smoothed, round(up, 4) AS upper_limit, round(low, 4) AS lower_limit, i >= 8 AND z > up AS signal FROM chart"))
def ewma_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trends.ewma(trends.period_series(frames(spark, sf_dir), "week"))
    return out.select("period", "value", *(F.round(c, 4).alias(c) for c in ("smoothed", "upper_limit", "lower_limit")), "signal")


@query(with_frames(chart_sql("month", "site") + "SELECT g AS site, period, value, CASE WHEN cus THEN 'CUSUM' ELSE 'EWMA' END AS method, CASE WHEN cus AND value >= 2 * mu THEN 'high' ELSE 'medium' END AS severity FROM chart WHERE cus OR (i >= 8 AND z > up)"))
def trend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.alerts(trends.period_series(frames(spark, sf_dir), "month", ["site"]), by=["site"])


#: Thresholds of the queries: the tables hold weak associations only.
RULES = mining.RuleParams(min_support=0.005, min_confidence=0.2, min_lift=1.01)
ITEMS = ", ".join(f"CASE WHEN {f} NOT IN ('', 'N/A', 'unknown') THEN '{f}=' || {f} END" for f in mining.ITEM_FIELDS)
ITEMS_SQL = f"""
, t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY report_id, ts) AS id, list_filter([{ITEMS}], lambda x: x IS NOT NULL) AS items FROM frames),
n AS (SELECT count(*) AS n, greatest(2, CAST(floor(0.005::DOUBLE * count(*)) AS BIGINT)) AS least FROM t WHERE len(items) > 0),
i AS MATERIALIZED (SELECT id, unnest(items) AS x FROM t),
c AS (SELECT [x] AS items, count(*) AS k FROM i GROUP BY x
  UNION ALL SELECT [a.x, b.x], count(*) FROM i a JOIN i b ON a.id = b.id AND a.x < b.x GROUP BY a.x, b.x
  UNION ALL SELECT [a.x, b.x, c.x], count(*) FROM i a JOIN i b ON a.id = b.id AND a.x < b.x JOIN i c ON a.id = c.id AND b.x < c.x GROUP BY a.x, b.x, c.x),
f AS MATERIALIZED (SELECT array_to_string(items, ' + ') AS name, items, k FROM c, n WHERE k >= least),
r AS MATERIALIZED (SELECT list_filter(items, lambda y: y <> x) AS a, x, k AS k2 FROM (SELECT items, k, unnest(items) AS x FROM f WHERE len(items) > 1) WHERE split_part(x, '=', 1) IN ('exposure', 'barrier_status', 'barrier_failure_mode')),
rules AS MATERIALIZED (SELECT array_to_string(a, ' + ') AS antecedent, a, x AS consequent, k2 AS report_count, k2 / n AS support, k2 / l.k AS confidence, g.k / n AS baseline, k2 / l.k / (g.k / n) AS lift FROM r JOIN f l ON l.name = array_to_string(a, ' + ') JOIN f g ON g.name = x, n
  WHERE k2 / l.k >= 0.2::DOUBLE AND k2 / l.k / (g.k / n) >= 1.01::DOUBLE
  AND NOT (x LIKE 'barrier_status=%' AND len(list_filter(a, lambda y: y LIKE 'barrier_failure_mode=%')) > 0) AND NOT (x LIKE 'barrier_failure_mode=%' AND len(list_filter(a, lambda y: y LIKE 'barrier_status=%')) > 0))
"""


@query(with_frames(ITEMS_SQL + "SELECT name AS items, k AS n FROM f"))
def itemset_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, _, _ = mining.itemset_counts(frames(spark, sf_dir), RULES)
    return sets.select(F.array_join("items", " + ").alias("items"), "n")


@query(with_frames(ITEMS_SQL + "SELECT antecedent, consequent, report_count, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM rules"))
def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = mining.association_rules(frames(spark, sf_dir), RULES)
    return rules.select(F.array_join("antecedent", " + ").alias("antecedent"), "consequent", "report_count", *(F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")))


@query(with_frames(ITEMS_SQL + ", o AS (SELECT *, row_number() OVER (ORDER BY round(lift, 3) DESC, report_count DESC, a, consequent) AS p FROM rules) SELECT antecedent, consequent, report_count FROM o WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.consequent = o.consequent AND q.p < o.p AND len(list_filter(q.a, lambda y: NOT list_contains(o.a, y))) = 0) ORDER BY p LIMIT 40"))
def assoc_rules_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = mining.pruned_rules(mining.association_rules(frames(spark, sf_dir), RULES))
    return rules.select(F.array_join("antecedent", " + ").alias("antecedent"), "consequent", "report_count")


@query(with_frames(" SELECT activity, energy_type, barrier_type, barrier_status, exposure, count(*) AS n FROM frames GROUP BY ALL"))
def pattern_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.signatures(frames(spark, sf_dir))


#: Clusters of the queries: by four fields, so that groups recur at every scale.
FEW = ("activity", "barrier_type", "barrier_status", "exposure")
MEMBERS_SQL = ", members AS (SELECT concat_ws('|', activity, barrier_type, barrier_status, exposure) AS cluster_id, * FROM frames)"


def signature_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("cluster_id", F.concat_ws("|", *FEW))


@query(
    with_frames(MEMBERS_SQL + """
, t AS (SELECT cluster_id, count(*) AS member_count, count(DISTINCT site) AS site_count, count(*) FILTER (sif_potential) AS flagged, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (is_high_energy) AS he,
  count(*) FILTER (barrier_status IN ('explicitly_absent', 'not_mentioned')) AS nb, count(*) FILTER (exposure = 'direct_proximity') AS direct FROM members GROUP BY cluster_id),
l AS (SELECT t.cluster_id, count(*) FILTER (epoch(m.ts) >= epoch(last_seen) - (epoch(last_seen) - epoch(first_seen)) * 0.25 AND last_seen > first_seen) AS late FROM t JOIN members m ON t.cluster_id = m.cluster_id GROUP BY t.cluster_id),
k AS (SELECT t.*, late, CASE WHEN member_count <= 5 AND he >= greatest(1, member_count - 1) AND nb >= 1 THEN 'sporadic_high_severity' WHEN member_count >= 4 AND late / member_count >= 0.6 THEN 'emerging' ELSE 'established' END AS pattern_type FROM t JOIN l ON t.cluster_id = l.cluster_id),
p AS (SELECT cluster_id, lsr_tag, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(report_id)) AS r FROM members WHERE lsr_tag <> 'N/A' GROUP BY cluster_id, lsr_tag)
SELECT k.cluster_id, member_count, site_count, flagged, first_seen, last_seen, pattern_type, coalesce(lsr_tag, 'N/A') AS primary_lsr_tag,
  CASE WHEN pattern_type = 'sporadic_high_severity' OR member_count >= 20 THEN 'HIGH' WHEN pattern_type = 'emerging' AND direct >= greatest(1, member_count // 3) THEN 'HIGH' WHEN member_count >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM k LEFT JOIN p ON k.cluster_id = p.cluster_id AND r = 1""")
)
def pattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patterns.cluster_summary(signature_members(spark, sf_dir))
    return out.select("cluster_id", "member_count", "site_count", "flagged", "first_seen", "last_seen", "pattern_type", "primary_lsr_tag", "priority")


@query(with_frames(MEMBERS_SQL + """
, e AS (SELECT cluster_id, unnest(list_filter([CASE barrier_status WHEN 'explicitly_absent' THEN 'barrier_explicitly_absent' WHEN 'uncertain' THEN 'barrier_unverified' WHEN 'not_mentioned' THEN 'barrier_not_recorded' END,
  CASE WHEN exposure = 'direct_proximity' THEN 'direct_personnel_exposure' END, CASE WHEN sif_potential THEN 'flagged_sif_potential' END, CASE WHEN magnitude_class >= 4 THEN 'high_energy_present' END,
  CASE WHEN barrier_failure_mode <> '' THEN 'failure_mode::' || barrier_failure_mode END], lambda x: x IS NOT NULL)) AS evidence FROM members) SELECT cluster_id, evidence, count(*) AS n FROM e GROUP BY ALL"""))
def evidence_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.evidence(signature_members(spark, sf_dir))


EDGE_FIELDS = ("energy_type", "barrier_type", "barrier_status", "exposure")


@query(with_frames(f""", m AS (SELECT site || substr(activity, 1, 2) AS cluster_id, report_id, {", ".join(EDGE_FIELDS)} FROM frames),
e AS (SELECT a.cluster_id, a.report_id AS source, b.report_id AS target, {" + ".join(f"CAST(a.{f} IS NOT DISTINCT FROM b.{f} AS INT)" for f in EDGE_FIELDS)} AS same FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.report_id < b.report_id)
SELECT cluster_id, source, target, same FROM e QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY same DESC, source, target) <= 40"""))
def pattern_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 pairs of each group of reports that agree in most fields; groups are of a site and a kind of activity."""
    m = frames(spark, sf_dir).withColumn("cluster_id", F.concat("site", F.substring("activity", 1, 2)))
    return similarity.match_edges(m, "cluster_id", "report_id", EDGE_FIELDS)


@query(with_frames(MEMBERS_SQL + "".join(f", {f}_n AS (SELECT cluster_id, {f}, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(report_id)) AS r FROM members WHERE {f} <> '' GROUP BY cluster_id, {f})" for f in ("activity", "energy_type", "barrier_status", "exposure")) + """
SELECT DISTINCT members.cluster_id, a.activity || ' + ' || e.energy_type || ' + ' || CASE b.barrier_status WHEN 'confirmed_present' THEN 'barrier confirmed' WHEN 'uncertain' THEN 'unverified barrier' WHEN 'explicitly_absent' THEN 'absent barrier' ELSE 'barrier not recorded' END
  || ' + ' || CASE x.exposure WHEN 'direct_proximity' THEN 'direct exposure' WHEN 'indirect_proximity' THEN 'indirect exposure' ELSE 'no exposure' END AS pattern_label
FROM members JOIN activity_n a ON a.cluster_id = members.cluster_id AND a.r = 1 JOIN energy_type_n e ON e.cluster_id = members.cluster_id AND e.r = 1 JOIN barrier_status_n b ON b.cluster_id = members.cluster_id AND b.r = 1 JOIN exposure_n x ON x.cluster_id = members.cluster_id AND x.r = 1"""))
def pattern_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words for each pattern, from its most frequent values."""
    return patterns.pattern_labels(signature_members(spark, sf_dir))


@query()
def pattern_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the frames' five fields with their summary; tested against a plain form of the algorithm."""
    f = frames(spark, sf_dir)
    return patterns.cluster_summary(patterns.clustered(f, patterns.density_clusters(f)))
