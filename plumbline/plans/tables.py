"""Registered queries over events, labels and embeddings, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.numbers import rounded_even
from ..operators import evaluation, events, similarity, trends
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the score is a bounded function of their length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


SCORED = "s AS (SELECT d.doc_id, quality AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1,
round(5 * (tp / (tp + fp)) * (tp / (tp + fn)) / (4 * (tp / (tp + fp)) + tp / (tp + fn)), 9) AS f2, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp + fp) / (tp + fp + fn + tn) AS flagged_fraction FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.binary_metrics(scored(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("f1", "f2")})


BINS = f"{SCORED}, b AS (SELECT CAST(greatest(0, least(9, ceil(p * 10) - 1)) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM s GROUP BY 1)"


@query(f"WITH {BINS} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 9) AS ece FROM b")
def calib_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_error(scored(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


@query(f"WITH {BINS} SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_p, 9) AS mean_p, rate FROM range(10) t(k) LEFT JOIN b ON k = bin")
def calib_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reliability(scored(spark, sf_dir)).withColumn("mean_p", F.round("mean_p", 9))


@query(f"""WITH {SCORED}, t AS (SELECT DISTINCT round(p, 4) AS thr FROM s),
m AS (SELECT thr, count(*) FILTER (p >= thr AND y = 1) AS tp, count(*) FILTER (p >= thr) AS called, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM t, s GROUP BY thr)
SELECT thr AS threshold, tp / pos AS recall, tp / called AS precision, round(5 * (tp / called) * (tp / pos) / (4 * (tp / called) + tp / pos), 9) AS f2, called / n AS review_queue_fraction FROM m WHERE tp / pos >= 0.9 ORDER BY thr DESC LIMIT 1""")
def calib_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_for_recall(scored(spark, sf_dir)).withColumn("f2", F.round("f2", 9))


@query(f"""WITH {SCORED}, g AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) AS n, sum((p - y) * (p - y)) AS sq FROM s GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS called, n - pos AS neg FROM g)
SELECT round(sum(pos * tp / called) / sum(pos), 9) AS average_precision, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(neg) * sum(pos)), 9) AS roc_auc, round(sum(sq) / sum(n), 9) AS brier FROM c""")
def calib_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.ranking_areas(scored(spark, sf_dir))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("""WITH s AS (SELECT lang AS t, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS q FROM documents), c AS (SELECT DISTINCT t AS c FROM s UNION SELECT DISTINCT q FROM s),
m AS (SELECT c, count(*) FILTER (t = c) AS support, count(*) FILTER (t = c AND q = c) AS tp, count(*) FILTER (q = c) AS called FROM c, s GROUP BY c)
SELECT c, support, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (support + called) ELSE 0 END, 9) AS f1 FROM m""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("t"), F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("q"))
    return evaluation.class_metrics(d, "t", "q").withColumn("f1", F.round("f1", 9))


@query()
def event_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values and their eighths, rounded half to even by their binary value, as Python's round does; tested against it."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", rounded_even(F.col("value"), 1).alias("value"), rounded_even(F.floor("value") / 8, 2).alias("eighths"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scored documents of even ids, to fit on, and of odd ids."""
    s = scored(spark, sf_dir)
    return s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1")


#: The fitted rate of a score is the greatest, over the places where a stretch may begin at or before it, of the least mean of the stretches from there to an end at or behind it.
STEPS_SQL = f"""{SCORED}, g AS (SELECT p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM s WHERE doc_id % 2 = 0 GROUP BY p), c AS (SELECT p, n, sum(n) OVER (ORDER BY p) AS cn, sum(pos) OVER (ORDER BY p) AS cp, pos FROM g),
m AS (SELECT k.p, k.n, k.pos, max(a.least) AS rate FROM c k JOIN (SELECT a.p AS a, x.p AS x, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)) AS least FROM c a JOIN c x ON x.p >= a.p JOIN c b ON b.p >= x.p GROUP BY a.p, x.p) a ON a.x = k.p GROUP BY k.p, k.n, k.pos),
steps AS (SELECT min(p) AS low, max(p) AS high, sum(n) AS n, sum(pos) AS positives, round(rate, 9) AS rate FROM m GROUP BY round(rate, 9))"""


@query(f"WITH {STEPS_SQL} SELECT * FROM steps")
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rising steps of quality over the score, fitted on documents of even ids."""
    return evaluation.isotonic(halves(spark, sf_dir)[0]).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {STEPS_SQL}, k AS (SELECT *, lead(low) OVER (ORDER BY low) AS next_low, lead(rate) OVER (ORDER BY low) AS next_rate, lag(low) OVER (ORDER BY low) AS before FROM steps)
SELECT s.doc_id, round(CASE WHEN p <= high OR next_low IS NULL THEN rate ELSE rate + (next_rate - rate) / (next_low - high) * (p - high) END, 6) AS p FROM s JOIN k ON (before IS NULL OR p >= low) AND (next_low IS NULL OR p < next_low) WHERE s.doc_id % 2 = 1""")
def isotonic_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated scores of documents of odd ids."""
    fit, rest = halves(spark, sf_dir)
    return evaluation.isotonic_rates(rest, evaluation.isotonic(fit)).select("doc_id", F.round("p", 6).alias("p"))


@query("""WITH n AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, toxic, n, n / sum(n) OVER () AS share FROM n""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


RECURRENCE = """WITH RECURSIVE e AS (SELECT event_id, ts, {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS r FROM events),
a AS (SELECT *, ts AS last, true AS ok FROM e WHERE r = 1 UNION ALL SELECT e.event_id, e.ts, {ekeys}, e.r, CASE WHEN e.ts - a.last >= INTERVAL {seconds} SECOND THEN e.ts ELSE a.last END, e.ts - a.last >= INTERVAL {seconds} SECOND
  FROM a JOIN e ON {match} AND e.r = a.r + 1) SELECT event_id, ts FROM a WHERE ok"""


def recurrence_sql(keys: list[str], seconds: int) -> str:
    return RECURRENCE.format(keys=", ".join(keys), ekeys=", ".join(f"e.{k}" for k in keys), match=" AND ".join(f"a.{k} = e.{k}" for k in keys), seconds=seconds)


@query(recurrence_sql(["user_id", "event_type"], 43200))
def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.admitted(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", 43200, "event_id").select("event_id", "ts")


@query(recurrence_sql(["user_id"], 21600).replace("SELECT event_id, ts FROM a", "SELECT event_id FROM a"))
def event_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return events.admitted(e, ["user_id"], "ts", 21600, "event_id").select("event_id")


@query("""WITH c AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY h) AS before FROM c)
SELECT event_type, h, n, before, CASE WHEN n - before >= 3 THEN 'surge' ELSE 'dispersal' END AS kind FROM l WHERE n - before >= 3 OR (n - before <= -3 AND before >= 4)""")
def event_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return trends.surges(c.withColumn("h", F.col("h").cast("timestamp_ntz")), "event_type", "h", "n")


@query("WITH e AS (SELECT event_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS hits FROM events) SELECT event_id, CAST(hits AS BIGINT) AS hits, hits >= 2 AS active FROM e")
def event_hit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return events.hits_in_window(e, "user_id", ["ts", "event_id"], F.col("value") > 50).select("event_id", "hits", "active")


@query("SELECT event_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND INTERVAL 3600 SECOND PRECEDING) AS ref FROM events")
def event_range_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return events.reference_sample(e, "user_id", "ts", "event_id", 3600, 86400).select("event_id", "ref")


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest_state(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.session_window("ts", "12 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


@query("SELECT user_id, count(DISTINCT event_id) AS reviewers, event_type AS corrected, CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS k FROM events GROUP BY user_id, event_type, 4 HAVING count(DISTINCT event_id) >= 2")
def review_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import promoted

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("report_id"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("corrected_sif"), F.col("event_type").alias("corrected_lsr"), F.col("event_id").alias("reviewer"))
    return promoted(e).select(F.col("report_id").alias("user_id"), "reviewers", F.col("corrected_lsr").alias("corrected"), F.col("corrected_sif").alias("k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM u q JOIN u v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) WHERE rank <= 10""")
def embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return similarity.nearest(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, 10).select("query_id", "id", "rank")


SQUARE = "[(-0.5, -0.5), (0.5, -0.5), (0.8, 0.5), (-0.5, 0.5)]"


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT * FROM (VALUES (0, -0.05::DOUBLE, -0.05::DOUBLE, -0.05::DOUBLE, 0.1::DOUBLE), (1, 0.1::DOUBLE, -0.05::DOUBLE, -0.05::DOUBLE, -0.05::DOUBLE), (2, 0.15::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE, -0.05::DOUBLE), (3, -0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.1::DOUBLE)) t(i, ax, ay, bx, by_))
SELECT vec_id FROM p, c GROUP BY vec_id HAVING count(*) FILTER (((ay > y) <> (by_ > y)) AND x < (bx - ax) * (y - ay) / ((by_ - ay) + 1e-12) + ax) % 2 = 1""")
def zone_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.05, -0.05), (0.1, -0.05), (0.15, 0.1), (-0.05, 0.1))))
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")).withColumn("zone", corners)
    return p.where(geometry.point_in_polygon("x", "y", "zone")).select("vec_id")


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.009 THEN 'high' ELSE 'medium' END AS severity FROM p a JOIN p b ON a.label = 0 AND b.label = 1 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.018""")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons (label 0) near vehicles (label 1): a grid join, each vehicle offered to the nine cells around its own."""
    near, close = 0.018, 0.009
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    cell = lambda c: F.floor(F.col(c) / near)
    a = p.where("label = 0").select(F.col("vec_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("i"), cell("y").alias("j"))
    around = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = p.where("label = 1").withColumn("o", F.explode(around)).select(F.col("vec_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (cell("x") + F.col("o.di")).alias("i"), (cell("y") + F.col("o.dj")).alias("j"))
    d = geometry.distance("ax", "ay", "bx", "by")
    return a.join(b, ["i", "j"]).withColumn("d", d).where(F.col("d") < near).select("a", "b", F.when(F.col("d") < close, "high").otherwise("medium").alias("severity"))
