"""Registered queries of ingest, review desk, recommendations and scene rules, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events, evaluation, ingest, patterns, ranking, recommend, scene, summary, trends
from ..sources.tables import frames, table
from ..streaming import monitor
from .analytics import DAYS, MEMBERS_SQL, ROUTED_SQL, clock, density_sql, signature_members, with_frames

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- ingest


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 5 <> 0 AND event_type <> 'click' THEN event_type ELSE 'k' || json_extract_string(props, '$.k') END AS kind,
  coalesce(json_extract_string(props, '$.k'), '') AS k FROM events""")
def ingest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth for a third of the rows, blank columns for others, the JSON cell behind both."""
    e = table(spark, sf_dir, "events")
    cell = F.to_json(F.struct(F.struct(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("label")).alias("kind"), F.struct(F.get_json_object("props", "$.k").alias("text")).alias("k")))
    own = F.when((F.col("event_id") % 5 == 0) | (F.col("event_type") == "click"), "").otherwise(F.col("event_type"))
    rows = e.select("event_id", own.alias("kind"), F.struct(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind")).alias("truth"), cell.alias("cell"))
    return ingest.projected(rows, ["kind", "k"], "cell", "truth").select("event_id", "kind", F.coalesce("k", F.lit("")).alias("k"))


@query(with_frames(" SELECT report_id, CASE WHEN lsr_tag <> 'N/A' THEN lsr_tag WHEN barrier_failure_mode IS NOT NULL THEN barrier_failure_mode ELSE 'N/A' END AS tag FROM frames"))
def first_real_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("report_id", ingest.first_real_tag("lsr_tag", "barrier_failure_mode").alias("tag"))


@query("SELECT CASE WHEN source IN ('synthetic', 'manual', 'voice', 'vision') THEN source ELSE 'synthetic' END AS source, count(*) AS n FROM documents GROUP BY 1")
def report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(ingest.known_source("source").alias("source")).agg(F.count("*").alias("n"))


SITES_SQL = """, a AS (SELECT lower(trim(alias)) AS alias, min(site) AS site FROM (SELECT n_name AS alias, n_name AS site FROM nation UNION ALL SELECT 'Site ' || n_nationkey, n_name FROM nation) GROUP BY 1),
s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  ' || lower(n_name) || ' ' WHEN 1 THEN 'SITE ' || c_nationkey WHEN 2 THEN '' WHEN 3 THEN ' Yard ' || c_nationkey ELSE n_name END AS said FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("WITH x AS (SELECT 1)" + SITES_SQL + " SELECT c_custkey, CASE WHEN trim(said) = '' THEN 'Rig 4' ELSE coalesce(site, trim(said)) END AS site FROM s LEFT JOIN a ON lower(trim(said)) = a.alias")
def sites_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    aliases = n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("site")).unionByName(n.select(F.concat(F.lit("Site "), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("site")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key, number = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string")
    said = F.when(key == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).when(key == 1, F.concat(F.lit("SITE "), number)).when(key == 2, "").when(key == 3, F.concat(F.lit(" Yard "), number)).otherwise(F.col("n_name"))
    return ingest.resolved_sites(c.select("c_custkey", said.alias("said")), "said", aliases, "Rig 4").select("c_custkey", "site")


@query("SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier)")
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("SELECT event_id AS id, ts, user_id FROM events WHERE event_type = 'purchase' AND ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    since = e.agg(F.date_format(F.min("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    page = ingest.audit_page(e.select(F.col("event_id").alias("id"), "ts", "user_id", "event_type"), 200, since=since, until="no date", event_type="purchase")
    return page.select("id", "ts", "user_id")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(role, '')), 'the')")
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.matching(table(spark, sf_dir, "conversations"), " The ", ["text", "role"]).select("conv_id", "turn")


@query("""SELECT c_custkey, count(event_id) AS n_actions, coalesce(string_agg(event_type, ',' ORDER BY ts, event_id), '') AS actions FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey""")
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, acts = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", "event_type")
    return ingest.with_actions(reports, acts, "c_custkey", ["ts", "event_id"], "event_type").select("c_custkey", "n_actions", F.array_join("actions", ",").alias("actions"))


# ---- rankings and patterns


@query(density_sql("site").replace("SELECT u.g, total_reports, flagged, flagged / total_reports AS density, CAST(trend_pct AS DOUBLE) AS trend_pct,\n  CASE WHEN trend_pct > 5 THEN 'up' WHEN trend_pct < -5 THEN 'down' ELSE 'flat' END AS trend_direction, coalesce(lsr_tag, 'N/A') AS primary_lsr", "SELECT row_number() OVER (ORDER BY flagged / total_reports DESC, u.g) AS place, u.g, flagged / total_reports AS density"))
def density_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites in their order; a ranking has one row a site, so its window is small whatever the reports."""
    f = frames(spark, sf_dir)
    d = ranking.simple_density(f, "site", clock(spark, sf_dir), DAYS)
    return d.select(F.row_number().over(Window.orderBy(F.col("density").desc(), "g")).cast("long").alias("place"), "g", "density")


SUMMARY_SQL = MEMBERS_SQL + """
, t AS (SELECT cluster_id, count(*) AS member_count, count(DISTINCT site) AS site_count, count(*) FILTER (sif_potential) AS flagged, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (is_high_energy) AS he, avg(magnitude_class) AS mean_magnitude,
  count(*) FILTER (barrier_status IN ('explicitly_absent', 'not_mentioned')) AS nb, count(*) FILTER (exposure = 'direct_proximity') AS direct FROM members GROUP BY cluster_id),
l AS (SELECT t.cluster_id, count(*) FILTER (epoch(m.ts) >= epoch(last_seen) - (epoch(last_seen) - epoch(first_seen)) * 0.25 AND last_seen > first_seen) AS late FROM t JOIN members m ON t.cluster_id = m.cluster_id GROUP BY t.cluster_id),
k AS (SELECT t.*, late, CASE WHEN member_count <= 5 AND he >= greatest(1, member_count - 1) AND nb >= 1 THEN 'sporadic_high_severity' WHEN member_count >= 4 AND late / member_count >= 0.6 THEN 'emerging' ELSE 'established' END AS pattern_type FROM t JOIN l ON t.cluster_id = l.cluster_id),
fm AS (SELECT cluster_id, barrier_failure_mode AS mode, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(report_id)) AS r FROM members WHERE coalesce(barrier_failure_mode, '') <> '' GROUP BY cluster_id, barrier_failure_mode),
q AS (SELECT k.*, coalesce(mode, 'not characterised') AS primary_failure, split_part(k.cluster_id, '|', 1) AS primary_activity, split_part(k.cluster_id, '|', 2) AS barrier_type,
  CASE WHEN pattern_type = 'sporadic_high_severity' OR member_count >= 20 THEN 'HIGH' WHEN pattern_type = 'emerging' AND direct >= greatest(1, member_count // 3) THEN 'HIGH' WHEN member_count >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS priority
  FROM k LEFT JOIN fm ON k.cluster_id = fm.cluster_id AND fm.r = 1)
"""

#: (barrier, action, control level, place, failure modes that it addresses): the tables' own barriers and modes.
LIBRARY = [
    ("BUILDING", "Fix a guard", 3, 1, ["1-URGENT", "2-HIGH"]),
    ("BUILDING", "Take the task away", 1, 2, []),
    ("BUILDING", "Train the crew", 4, 3, ["3-MEDIUM"]),
    ("BUILDING", "Fix a guard", 4, 4, ["5-LOW"]),
    ("MACHINERY", "Interlock the drive", 3, 1, ["2-HIGH"]),
    ("MACHINERY", "Lock it out", 3, 2, ["4-NOT SPECIFIED", "5-LOW"]),
    ("AUTOMOBILE", "Separate the roads", 2, 1, []),
    ("AUTOMOBILE", "Set a speed limit", 4, 2, ["1-URGENT"]),
    ("HOUSEHOLD", "Label the tanks", 4, 1, ["3-MEDIUM"]),
]
LIBRARY_SQL = ", lib AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{a}', {lv}, {p}, {m}::VARCHAR[])" for b, a, lv, p, m in LIBRARY) + ") v(barrier_type, action, control_level, place, addresses))"
OFFERED_SQL = LIBRARY_SQL + """
, o AS (SELECT q.cluster_id, action, control_level, place, coalesce((SELECT sum(n) FROM fm WHERE fm.cluster_id = q.cluster_id AND list_contains(addresses, mode)), 0) AS matches FROM q JOIN lib ON q.barrier_type = lib.barrier_type),
o1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY control_level, matches DESC, place) AS r FROM o), o2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, action ORDER BY r) AS again FROM o1),
offered AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY r) AS rank, action, control_level, CAST(matches AS BIGINT) AS matches FROM o2 WHERE again = 1)
"""


def library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIBRARY, "barrier_type string, action string, control_level int, place int, addresses array<string>")


@query(with_frames(SUMMARY_SQL + OFFERED_SQL + "SELECT cluster_id, CAST(rank AS INTEGER) AS rank, action, control_level, matches FROM offered"))
def interventions_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signature_members(spark, sf_dir)
    needs = m.select("cluster_id", "barrier_type").distinct()
    modes = patterns.evidence(m).where(F.col("evidence").startswith("failure_mode::")).select("cluster_id", F.substring("evidence", 15, 1000).alias("mode"), "n")
    return patterns.ranked_interventions(library(spark), needs, modes)


@query(with_frames(SUMMARY_SQL + OFFERED_SQL + """, f AS (SELECT cluster_id, count(*) AS interventions, min_by(action, rank) AS first_intervention FROM offered GROUP BY cluster_id)
SELECT q.cluster_id, priority, pattern_type, primary_failure, barrier_type, primary_activity, member_count AS report_count, site_count,
  CAST(CASE WHEN floor((epoch(last_seen) - epoch(first_seen)) / 86400) > 0 THEN floor((epoch(last_seen) - epoch(first_seen)) / 86400) ELSE 42 END AS BIGINT) AS window_days, first_seen, last_seen,
  'Reduce recurrence of reports involving ' || lower(primary_failure) || ' during ' || primary_activity || '.' AS objective, coalesce(interventions, 0) AS interventions, first_intervention
FROM q LEFT JOIN f ON q.cluster_id = f.cluster_id"""))
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommendations(signature_members(spark, sf_dir), library(spark))


@query(with_frames(SUMMARY_SQL + "SELECT cluster_id, priority, member_count AS report_count FROM q ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, member_count DESC, cluster_id LIMIT 20"))
def recommendations_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = patterns.cluster_summary(signature_members(spark, sf_dir)).select("cluster_id", "priority", F.col("member_count").alias("report_count"))
    return recommend.ordered(s)


EVIDENCE_SQL = MEMBERS_SQL + """
, e AS (SELECT cluster_id, unnest(list_filter([CASE barrier_status WHEN 'explicitly_absent' THEN 'barrier_explicitly_absent' WHEN 'uncertain' THEN 'barrier_unverified' WHEN 'not_mentioned' THEN 'barrier_not_recorded' END,
  CASE WHEN exposure = 'direct_proximity' THEN 'direct_personnel_exposure' END, CASE WHEN sif_potential THEN 'flagged_sif_potential' END, CASE WHEN magnitude_class >= 4 THEN 'high_energy_present' END], lambda x: x IS NOT NULL)) AS evidence FROM members),
c AS (SELECT cluster_id, evidence, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY cluster_id)
"""


@query(with_frames(EVIDENCE_SQL + "SELECT cluster_id, evidence, n, share FROM (SELECT c.cluster_id, evidence, n, n / size AS share, row_number() OVER (PARTITION BY c.cluster_id ORDER BY n DESC, evidence) AS r FROM c JOIN z ON c.cluster_id = z.cluster_id) WHERE r <= 6"))
def evidence_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signature_members(spark, sf_dir)
    return recommend.evidence_shares(patterns.evidence(m), m.groupBy("cluster_id").agg(F.count("*").alias("member_count")))


@query(with_frames(MEMBERS_SQL + ", r AS (SELECT cluster_id, report_id, row_number() OVER (PARTITION BY cluster_id ORDER BY report_id) AS r FROM members) SELECT cluster_id, string_agg(report_id, ',' ORDER BY report_id) AS member_ids FROM r WHERE r <= 200 GROUP BY cluster_id"))
def pattern_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.first_members(signature_members(spark, sf_dir)).select("cluster_id", F.array_join("member_ids", ",").alias("member_ids"))


@query(with_frames(SUMMARY_SQL + "SELECT cluster_id, member_count, pattern_type FROM q WHERE pattern_type = 'established' ORDER BY member_count DESC, cluster_id LIMIT 24"))
def pattern_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = patterns.cluster_summary(signature_members(spark, sf_dir)).where("pattern_type = 'established'")
    return s.orderBy(F.col("member_count").desc(), "cluster_id").limit(24).select("cluster_id", "member_count", "pattern_type")


@query(with_frames(MEMBERS_SQL + """, t AS (SELECT cluster_id, count(*) AS member_count, list_sort(list(DISTINCT site)) AS sites FROM members GROUP BY cluster_id)
SELECT cluster_id, member_count, len(list_intersect(sites, ['NATION_3', 'NATION_17'])) AS shared FROM t WHERE member_count >= 5 AND list_has_any(sites, ['NATION_3', 'NATION_17'])"""))
def patterns_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the requested sites; a pattern's sites are as few as there are sites."""
    asked = F.array(F.lit("NATION_3"), F.lit("NATION_17"))
    t = signature_members(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.sort_array(F.collect_set("site")).alias("sites"))
    return t.where((F.col("member_count") >= 5) & F.arrays_overlap("sites", asked)).select("cluster_id", "member_count", F.size(F.array_intersect("sites", asked)).cast("long").alias("shared"))


@query(with_frames(SUMMARY_SQL + "SELECT count(*) FILTER (pattern_type = 'emerging') AS emerging, count(*) FILTER (priority = 'HIGH') AS high, count(*) AS patterns FROM q"))
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = patterns.cluster_summary(signature_members(spark, sf_dir))
    return s.agg(F.count_if(F.col("pattern_type") == "emerging").alias("emerging"), F.count_if(F.col("priority") == "HIGH").alias("high"), F.count("*").alias("patterns"))


@query(with_frames(" SELECT lsr_tag, count(*) AS reports, count(DISTINCT energy_type) AS energies, count(DISTINCT barrier_type) AS barriers, count(DISTINCT barrier_failure_mode) AS modes, dense_rank() OVER (ORDER BY count(*) DESC, lsr_tag) AS place FROM frames WHERE sif_potential GROUP BY lsr_tag"))
def rule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with their energies, barriers and failure modes, most reports first; one row a rule."""
    g = frames(spark, sf_dir).where("sif_potential").groupBy("lsr_tag")
    out = g.agg(F.count("*").alias("reports"), F.count_distinct("energy_type").alias("energies"), F.count_distinct("barrier_type").alias("barriers"), F.count_distinct("barrier_failure_mode").alias("modes"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("reports").desc(), "lsr_tag")).cast("long"))


@query(with_frames(" SELECT field, value, n, n / sum(n) OVER (PARTITION BY field) AS share FROM (SELECT 'site' AS field, site AS value, count(*) AS n FROM frames GROUP BY site UNION ALL SELECT 'energy_type', energy_type, count(*) FROM frames GROUP BY energy_type UNION ALL SELECT 'lsr_tag', lsr_tag, count(*) FROM frames GROUP BY lsr_tag)"))
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of three fields in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("site", "energy_type", "lsr_tag")))
    n = frames(spark, sf_dir).select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


@query(with_frames(" SELECT count(*) AS n, avg(CASE WHEN sif_potential <> is_high_energy THEN 1.0 ELSE 0.0 END) AS noise FROM frames"))
def label_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).agg(F.count("*").alias("n"), F.avg((F.col("sif_potential") != F.col("is_high_energy")).cast("int")).alias("noise"))


@query(with_frames(" SELECT period, total, flagged FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS total, count(*) FILTER (sif_potential) AS flagged FROM frames GROUP BY 1 ORDER BY 1 DESC LIMIT 52)"))
def trend_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trends.period_series(frames(spark, sf_dir), "week")
    return s.orderBy(F.col("period").desc()).limit(52).orderBy("period").select("period", "total", "flagged")


# ---- decisions


@query(with_frames(ROUTED_SQL + "SELECT report_id, CASE WHEN sif_potential THEN CASE WHEN confidence >= 0.75 THEN 'HIGH_CONF_SIF' ELSE 'LOW_CONF_REVIEW' END WHEN confidence >= 0.75 THEN 'HIGH_CONF_NON_SIF' ELSE 'LOW_CONF_REVIEW' END AS old_bucket, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence <= 0.25 THEN 'low' ELSE 'review' END AS band FROM routed"))
def legacy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select("report_id", summary.legacy_bucket(F.col("confidence"), F.col("sif_potential")).alias("old_bucket"), summary.score_band(F.col("confidence")).alias("band"))


@query(with_frames(" SELECT report_id, list_extract(['P4', 'P3', 'P2', 'P1'], CAST(greatest(CASE WHEN sev = 'high' AND confidence >= 0.7 THEN 3 WHEN sev = 'low' THEN 0 WHEN sev = 'high' THEN 2 WHEN sev = 'critical' THEN 3 ELSE 1 END, CASE WHEN sif_potential AND 1 - confidence >= 0.7 THEN 3 WHEN sif_potential THEN 2 ELSE 0 END) + 1 AS INTEGER)) AS priority FROM (SELECT *, list_extract(['low', 'medium', 'high', 'critical', 'odd'], magnitude_class) AS sev FROM frames)"))
def event_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.element_at(F.array(*map(F.lit, (*scene.SEVERITY, "odd"))), F.col("magnitude_class"))
    return frames(spark, sf_dir).select("report_id", scene.joint_priority(sev, F.col("confidence"), F.col("sif_potential"), 1 - F.col("confidence")).alias("priority"))


CUES = {"high_energy": ["the ", "der "], "gap": [" of ", " que "], "exposure": ["and", "und"]}
CUES_SQL = " AND ".join("(" + " OR ".join(f"contains(t, '{c}')" for c in cues) + ")" for cues in CUES.values())


@query(f"SELECT doc_id, {CUES_SQL} AS flagged FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import keyword_verdict

    return table(spark, sf_dir, "documents").select("doc_id", keyword_verdict("text", list(CUES.values())).alias("flagged"))


# ---- scenes: the events' minutes as camera frames

MINUTES_SQL = """m AS (SELECT user_id % 7 AS camera, date_trunc('hour', ts) AS t, least(1.0, max(value) / 200.0) AS fire, least(1.0, avg(value) / 100.0) AS smoke, count(*) / 400.0 AS fire_area, least(1.0, min(value) / 20.0) AS obscured, count(*) AS persons FROM events GROUP BY ALL),
s AS (SELECT *, coalesce(lag(persons) OVER (PARTITION BY camera ORDER BY t), persons) AS previous_persons, fire >= 0.6 AS fire_active, smoke >= 0.55 AS smoke_active FROM m),
ev AS (SELECT camera, t, 'fire' AS event_type, CASE WHEN persons > 0 OR smoke_active OR fire_area >= 0.01 THEN 'critical' ELSE 'high' END AS severity, fire AS confidence FROM s WHERE fire_active
 UNION ALL SELECT camera, t, 'smoke', CASE WHEN fire_active OR persons > 0 THEN 'high' ELSE 'medium' END, smoke FROM s WHERE smoke_active
 UNION ALL SELECT camera, t, 'low_visibility', CASE WHEN persons > 0 THEN 'medium' ELSE 'low' END, obscured FROM s WHERE NOT smoke_active AND obscured >= 0.5
 UNION ALL SELECT camera, t, 'crowd_surge', CASE WHEN persons - previous_persons >= 6 THEN 'high' ELSE 'medium' END, least(1.0, 0.5 + (persons - previous_persons) / 20) FROM s WHERE persons - previous_persons >= 3
 UNION ALL SELECT camera, t, 'crowd_dispersal', 'medium', least(1.0, 0.5 - (persons - previous_persons) / 20) FROM s WHERE persons - previous_persons <= -3 AND previous_persons >= 4)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = F.lit(1.0)
    m = e.groupBy((F.col("user_id") % 7).alias("camera"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(
        F.least(one, F.max("value") / 200.0).alias("fire"), F.least(one, F.avg("value") / 100.0).alias("smoke"), (F.count("*") / 400.0).alias("fire_area"), F.least(one, F.min("value") / 20.0).alias("obscured"), F.count("*").alias("persons")
    )
    before = F.coalesce(F.lag("persons").over(Window.partitionBy("camera").orderBy("t")), "persons")
    return m.withColumns({"previous_persons": before, "fire_active": F.col("fire") >= 0.6, "smoke_active": F.col("smoke") >= 0.55})


@query(f"WITH {MINUTES_SQL} SELECT camera, t, event_type, severity, round(confidence, 6) AS confidence FROM ev")
def scene_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene_events(signals(spark, sf_dir))


RANK_SQL = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'low' THEN 0 ELSE 1 END"


@query(f"WITH {MINUTES_SQL} SELECT camera, t, event_type FROM ev ORDER BY {RANK_SQL} DESC, round(confidence, 6) DESC, camera, t, event_type LIMIT 100")
def scene_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene_events(signals(spark, sf_dir)).orderBy(*scene.event_order(), "camera", "t", "event_type").limit(100).select("camera", "t", "event_type")


@query(f"WITH {MINUTES_SQL} SELECT camera, count(*) AS events, count(*) FILTER (severity IN ('high', 'critical')) AS grave, count(DISTINCT event_type) AS kinds FROM ev GROUP BY camera")
def camera_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene_events(signals(spark, sf_dir)).groupBy("camera").agg(F.count("*").alias("events"), F.count_if(F.col("severity").isin("high", "critical")).alias("grave"), F.count_distinct("event_type").alias("kinds"))


@query(f"""WITH {MINUTES_SQL} SELECT camera, t, event_type, 'Camera saw ' || CASE WHEN event_type[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || replace(event_type, '_', ' ') || CASE WHEN camera % 2 = 0 THEN ' in zone ' || camera ELSE '' END
  || ' at ' || strftime(t, '%Y-%m-%d %H:%M:%S') || ' UTC (' || CAST(CAST(floor(round(confidence, 6) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% sure).' AS narrative FROM ev""")
def scene_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("camera") % 2 == 0, F.concat(F.lit("zone "), F.col("camera").cast("string"), F.lit(".")))
    return scene.scene_events(signals(spark, sf_dir)).select("camera", "t", "event_type", scene.narrative(F.col("event_type"), zone, F.col("t"), F.col("confidence")).alias("narrative"))


TRACK_SQL = "tr AS (SELECT event_id, user_id, ts, (value % 10) / 10.0 AS x, (value % 7) / 7.0 AS y, (value % 5) / 5.0 AS h, (value % 3) / 3.0 AS w FROM events)"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as a track; an hour stands for a tenth of a second."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", ((v % 10) / 10.0).alias("x"), ((v % 7) / 7.0).alias("y"), ((v % 5) / 5.0).alias("h"), ((v % 3) / 3.0).alias("w"))


HOUR = 36_000.0


#: Rules for tracks whose samples lie hours apart.
SLOW = scene.FallParams(youngest=0.25 * HOUR, oldest=1.8 * HOUR, drop=0.30 / HOUR, fast_drop=0.55 / HOUR, still_seconds=2 * HOUR, still_reach=0.5)
POSTURE_SQL = f"""{TRACK_SQL}, h AS (SELECT event_id, user_id, list({{'t': epoch_us(ts), 'x': x, 'y': y, 'a': h / greatest(w, 1e-4::DOUBLE)}}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING) AS held, ts FROM tr),
g AS (SELECT *, held[-1] AS n, list_filter(held, lambda s: held[-1].t - s.t BETWEEN {round(SLOW.youngest * 1e6)} AND {round(SLOW.oldest * 1e6)})[-1] AS r FROM h),
q AS (SELECT *, (n.y - r.y) / greatest((n.t - r.t) / 1e6::DOUBLE, 1e-3::DOUBLE) AS speed FROM g),
z AS (SELECT *, coalesce(r.a >= 1.15::DOUBLE AND n.a <= 0.95::DOUBLE, false) AS collapse, coalesce((r.a >= 1.15::DOUBLE AND n.a <= 0.95::DOUBLE) OR (n.a < r.a * 0.72::DOUBLE AND speed >= {SLOW.drop!r}::DOUBLE) OR speed >= {SLOW.fast_drop!r}::DOUBLE, false) AS hit FROM q),
f AS (SELECT *, hit AND count(*) FILTER (hit) OVER o = 1 AS fall, min(n.t) FILTER (hit) OVER o AS fallen, list_filter(held, lambda s: held[-1].t - s.t <= {round(SLOW.still_seconds * 1e6)}) AS recent FROM z WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, coalesce(NOT fall AND r IS NOT NULL AND n.t - fallen >= {round(SLOW.still_seconds * 1e6)} AND len(recent) >= 2 AND len(list_filter(recent, lambda s: sqrt((s.x - recent[1].x) * (s.x - recent[1].x) + (s.y - recent[1].y) * (s.y - recent[1].y)) > {SLOW.still_reach}::DOUBLE)) = 0, false) AS still FROM f),
p AS (SELECT *, still AND count(*) FILTER (still) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS immobile FROM i)"""


def postures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.posture(track(spark, sf_dir), "user_id", "ts", "event_id", "x", "y", "w", "h", SLOW)


@query(f"WITH {POSTURE_SQL} SELECT event_id, user_id, CASE WHEN collapse THEN CASE WHEN speed >= {SLOW.drop!r}::DOUBLE THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END WHEN speed >= {SLOW.fast_drop!r}::DOUBLE THEN 0.72::DOUBLE ELSE 0.55::DOUBLE END AS confidence, round(r.a, 2) AS aspect_before, round(n.a, 2) AS aspect_after FROM p WHERE fall")
def track_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fall of each track: collapse of posture, a very fast drop, or a shrinking box that sinks."""
    return postures(spark, sf_dir).where("fall").select("event_id", "user_id", "confidence", "aspect_before", "aspect_after")


@query()
def track_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls and immobility of the tracks that a follower makes of each user's events as boxes; tested on streams and tables."""
    t = track(spark, sf_dir).where("w > 0 AND h > 0")
    half = lambda c, size, sign: F.col(c) + sign * F.col(size) / 2
    box = F.array(half("x", "w", -1), half("y", "h", -1), half("x", "w", 1), half("y", "h", 1))
    frames = t.select(F.col("user_id").alias("camera"), F.col("ts").cast("timestamp").alias("at"), F.array(F.lit("person")).alias("kinds"), F.array(box).alias("boxes"))
    return monitor.person_events(frames, SLOW, 24 * HOUR).where("event IS NOT NULL").select("camera", F.col("at").cast("timestamp_ntz").alias("at"), "track", "event", "confidence")


@query()
def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a user's loud events, an hour standing for a second; tested on streams and tables."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("rms"))
    out = monitor.clips(e, voice=50, least_ms=2 * 3_600_000, silence_ms=int(2.5 * 3_600_000), longest_ms=30 * 3_600_000)
    return out.select("device", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "blocks", "voiced")


@query(f"WITH {POSTURE_SQL} SELECT event_id, user_id FROM p WHERE immobile")
def track_immobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sample of each fallen track that shows it has not moved since."""
    return postures(spark, sf_dir).where("immobile").select("event_id", "user_id")


@query(f"""WITH {TRACK_SQL}, r AS (SELECT *, last_value({{'t': ts, 'x': x, 'y': y}}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 43200 SECOND PRECEDING AND INTERVAL 5400 SECOND PRECEDING) AS ref FROM tr),
a AS (SELECT *, (y - ref.y) / ((epoch_us(ts) - epoch_us(ref.t)) / 1e6::DOUBLE) AS speed FROM r), b AS (SELECT *, coalesce(speed >= CASE WHEN event_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END AND abs(x - ref.x) <= 1.2::DOUBLE * (y - ref.y), false) AS hit FROM a),
c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT event_id, user_id, round(0.45::DOUBLE + 0.35::DOUBLE * least(1.0, speed / 1.2::DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confidence FROM c WHERE hit AND k = 1""".replace("0.2::DOUBLE ELSE 0.35::DOUBLE", "0.000002::DOUBLE ELSE 0.0000035::DOUBLE"))
def track_falling_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir)
    out = scene.falling_mass(t, "user_id", "ts", "x", "y", F.col("event_id") % 2 == 0, youngest=0.15 * HOUR, oldest=1.2 * HOUR, least=0.0000035, least_near=0.000002)
    return out.where("falling").select("event_id", "user_id", F.round("confidence", 6).alias("confidence"))


@query("""WITH h AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS h FROM events) SELECT event_id, CASE WHEN len(h) >= 4 THEN round((h[len(h)] + h[len(h) - 1]) / 2 - (h[1] + h[2]) / 2, 6) END AS growth FROM h""")
def event_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return events.growth(e, "user_id", ["ts", "event_id"], "value").select("event_id", F.round("growth", 6).alias("growth"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT event_id, user_id, r, v AS base FROM e WHERE r = 1 UNION ALL SELECT e.event_id, e.user_id, e.r, b.base + CASE WHEN b.r >= 5 AND e.v < 0.5::DOUBLE * b.base THEN 0.02::DOUBLE ELSE 0.1::DOUBLE END * (e.v - b.base) FROM b JOIN e ON b.user_id = e.user_id AND e.r = b.r + 1)
SELECT event_id, CASE WHEN r >= 5 THEN round(base, 6) END AS baseline FROM b""")
def event_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return events.adaptive_baseline(e, "user_id", ["ts", "event_id"], "value", ready=5).select("event_id", F.round("baseline", 6).alias("baseline"))


# ---- evaluation of spans and classes

GOLD_SQL = "g AS (SELECT l_orderkey AS doc, l_returnflag AS label, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 9 + 1 AS b FROM lineitem), p AS (SELECT doc, label, CASE WHEN (doc + a) % 4 = 0 THEN a + 1 ELSE a END AS a, b FROM g WHERE doc % 5 <> 0)"


@query(f"""WITH {GOLD_SQL}, gc AS (SELECT doc, label, a, b, count(*) AS n FROM g GROUP BY ALL), pc AS (SELECT doc, label, a, b, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT gc.label, sum(least(gc.n, pc.n)) AS tp FROM gc JOIN pc ON gc.doc = pc.doc AND gc.label = pc.label AND gc.a = pc.a AND gc.b = pc.b GROUP BY gc.label),
c AS (SELECT label, sum(n) AS gold FROM gc GROUP BY label), d AS (SELECT label, sum(n) AS told FROM pc GROUP BY label)
SELECT c.label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(coalesce(told, 0) AS BIGINT) AS told, round(coalesce(tp, 0) / told, 9) AS precision, round(coalesce(tp, 0) / gold, 9) AS recall FROM c LEFT JOIN d ON c.label = d.label LEFT JOIN h ON c.label = h.label""")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact span scores by label, of the order lines as gold spans and of a shifted part of them as found ones."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 9 + 1).alias("end"))
    p = g.where("doc % 5 <> 0").withColumn("start", F.when((F.col("doc") + F.col("start")) % 4 == 0, F.col("start") + 1).otherwise(F.col("start")))
    s = evaluation.span_scores(g, p, ["doc", "label", "start", "end"], "label")
    return s.select("label", "tp", "gold", "told", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


PARTIAL_SQL = GOLD_SQL.replace("a + 1 ELSE a END AS a, b FROM g", "a + 6 ELSE a END AS a, b + 4 AS b FROM g")


@query(f"""WITH RECURSIVE {PARTIAL_SQL}, go AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY a, b) AS r FROM g), po AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY a, b) AS r FROM p),
walk AS (SELECT doc, label, 0 AS r, CAST(0 AS BIGINT) AS used, 0 AS hit FROM g GROUP BY doc, label
  UNION ALL SELECT n.doc, n.label, n.r, coalesce(n.q, n.used), CASE WHEN n.q IS NULL THEN 0 ELSE 1 END FROM (SELECT w.doc, w.label, w.r + 1 AS r, w.used, min(po.r) AS q FROM walk w JOIN go ON go.doc = w.doc AND go.label = w.label AND go.r = w.r + 1
    LEFT JOIN po ON po.doc = w.doc AND po.label = w.label AND po.r > w.used AND po.a < go.b AND po.b > go.a AND po.a < po.b AND go.a < go.b GROUP BY w.doc, w.label, w.r, w.used) n),
h AS (SELECT label, sum(hit) AS tp, count(*) FILTER (r > 0) AS gold FROM walk GROUP BY label), d AS (SELECT label, count(*) AS told FROM p GROUP BY label)
SELECT h.label, CAST(tp AS BIGINT) AS tp, CAST(gold AS BIGINT) AS gold, CAST(coalesce(told, 0) AS BIGINT) AS told, round(coalesce(tp / told, 0), 9) AS precision, round(tp / gold, 9) AS recall FROM h LEFT JOIN d ON h.label = d.label""")
def span_scores_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans, but for shifted ends that reach into the next line, scored by overlap, one to one."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 9 + 1).alias("end"))
    p = g.where("doc % 5 <> 0").withColumn("start", F.when((F.col("doc") + F.col("start")) % 4 == 0, F.col("start") + 6).otherwise(F.col("start"))).withColumn("end", F.col("end") + 4)
    s = evaluation.span_scores_partial(g, p)
    return s.select("label", "tp", "gold", "told", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""WITH s AS (SELECT lang AS t, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS q, CASE WHEN n_chars % 5 = 0 AND n_chars % 2 = 0 THEN lang ELSE 'zz' END AS q2 FROM documents WHERE lang IS NOT NULL), c AS (SELECT DISTINCT t AS c FROM s UNION SELECT DISTINCT q FROM s),
m AS (SELECT c, count(*) FILTER (t = c) AS support, CASE WHEN count(*) FILTER (t = c AND q = c) > 0 THEN 2.0::DOUBLE * count(*) FILTER (t = c AND q = c) / (count(*) FILTER (t = c) + count(*) FILTER (q = c)) ELSE 0 END AS f1 FROM c, s GROUP BY c)
SELECT (SELECT avg(CASE WHEN t = q THEN 1.0 ELSE 0.0 END) FROM s) AS top1, (SELECT avg(CASE WHEN t = q OR t = q2 THEN 1.0 ELSE 0.0 END) FROM s) AS top2, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM m""")
def class_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang is not null")
    five = F.col("n_chars") % 5 == 0
    s = d.select(F.col("lang").alias("t"), F.when(five, "en").otherwise(F.col("lang")).alias("q"), F.when(five & (F.col("n_chars") % 2 == 0), F.col("lang")).otherwise("zz").alias("q2"))
    out = evaluation.class_overall(s, "t", "q", "q2")
    return out.select("top1", "top2", F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1"))
