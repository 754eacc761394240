"""Registered queries of spelling, tagging and embedding over documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding, reports, spelling, tagging
from ..sources import lexicons
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Phrases of the tables' own words; of spans that overlap the first kind's counts.
PHRASES = {"place": ["of the", "in the"], "article": ["the"], "joining": ["and"]}
#: Share of the documents that hold a word of the vocabulary.
COMMON = 0.02


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    uses = spelling.token_uses(d)
    return d, uses, spelling.corrections(uses, spelling.common_words(d, "doc_id", "text", COMMON))


@query()
def token_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens that are near a common word of the documents, their uses and corrections; tested against difflib."""
    _, uses, found = fixes(spark, sf_dir)
    return found.join(uses, "token").select("token", "correction", "ratio", "uses")


@query()
def doc_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens corrected; tested against difflib."""
    d, _, found = fixes(spark, sf_dir)
    return spelling.respelled(d, found)


@query()
def doc_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of at most 128 components for every document; tested against numpy."""
    return embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its tagged tokens, which stay in the document's row."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    spans = F.transform(T.phrase_spans("text", PHRASES, whole_words=True), lambda s: F.struct(s["category"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    return tagging.tagged_texts(d, "doc_id", spans, token=r"[\p{L}\p{N}_]+")


TAGS_SQL = r"""pieces AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+') AS x FROM documents)),
t AS (SELECT doc_id, k, regexp_extract(piece, '[\p{L}\p{N}_]+$') AS w, left(piece, length(piece) - length(regexp_extract(piece, '[\p{L}\p{N}_]+$'))) AS gap, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
u AS (SELECT *, e - length(w) AS s, w = 'the' AND gap = ' ' AND lag(w) OVER d IN ('of', 'in') AS inner_the, w IN ('of', 'in') AND lead(w) OVER d = 'the' AND lead(gap) OVER d = ' ' AS opens, lead(e) OVER d AS next_e FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT *, CASE WHEN opens THEN 'B-place' WHEN inner_the THEN 'I-place' WHEN w = 'the' THEN 'B-article' WHEN w = 'and' THEN 'B-joining' END AS tag FROM u)"""
SPANS_SQL = "sp AS (SELECT doc_id, substring(tag, 3) AS label, CAST(s AS INT) AS \"start\", CAST(CASE WHEN opens THEN next_e ELSE e END AS INT) AS \"end\" FROM g WHERE tag LIKE 'B-%')"


@query(f"WITH {TAGS_SQL} SELECT doc_id, tag, count(*) AS n FROM g WHERE tag IS NOT NULL GROUP BY doc_id, tag")
def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of a document begin or continue a span of each kind."""
    tags = F.expr("transform(filter(tagged, t -> t.tag <> 'O'), t -> t.tag)")
    return tagged(spark, sf_dir).select("doc_id", F.explode_outer(tags).alias("tag")).where("tag IS NOT NULL").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {TAGS_SQL}, {SPANS_SQL} SELECT * FROM sp")
def doc_tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that the tags of the tokens give back."""
    spans = tagged(spark, sf_dir).select("doc_id", F.explode_outer(F.expr(tagging.spans_of("tagged"))).alias("s"))
    return spans.where("s IS NOT NULL").select("doc_id", "s.*")


@query(f"""WITH {TAGS_SQL}, {SPANS_SQL}, c AS (SELECT *, ("start" * 7 % 101) / 101.0::DOUBLE AS confidence FROM sp)
SELECT doc_id, label, "start", "end", confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY confidence DESC, "start", "end") = 1""")
def doc_best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of each kind with the highest of confidences that are made from its place."""
    spans = F.transform(F.expr(tagging.spans_of("tagged")), lambda s: s.withField("confidence", (s["start"] * 7 % 101) / F.lit(101.0)))
    best = tagged(spark, sf_dir).select("doc_id", spans.alias("spans")).select("doc_id", F.explode_outer(F.expr(tagging.best_of("spans"))).alias("s"))
    # a document brings a row for each label; rows that repeat an id meet
    return tagging.best_spans(best.where("s IS NOT NULL").select("doc_id", "s.*"), "doc_id")


# ---- the report chain with lexicons of the tables' own words

OWN = reports.ReportParams(
    hazards={"energy_isolation": ["ention"], "working_at_height": ["sch"], "confined_space": ["que"]},
    activities=PHRASES,
    exposures={"direct_proximity": ["of the"], "indirect_proximity": ["der"]},
    no_exposure=["es que"],
    absences=["worthless"],
    uncertainties=["stupid"],
    barrier_terms=["is"],
    confirmations=["of"],
    negations=["and"],
    negation_pairs=["to the", "in the"],
    energy_cues={"thermal (hot work)": ["con"], "vehicular/motion": ["und"], "fall from height": ["is"]},
    energy_label="label",
    clearance=["inin"],
    near=["onon"],
    live=["erer"],
    unharmed=["thth"],
    exposed=["anan"],
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 5 == 0, "low-energy/ergonomic").when(F.col("doc_id") % 5 == 1, "vehicular/motion")
    return d.select("doc_id", "text", label.alias("label"))


def sql_case(value: str, pairs: dict, default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + f" ELSE {default} END"


def says(*cues: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{c}')" for c in cues) + ")"


def whole_word(word: str) -> str:
    return rf"regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])')"


HAZARD_SQL = ", ".join(f"{{'n': -((length(t) - length(replace(t, '{p[0]}', ''))) // {len(p[0])}), 'at': strpos(t, '{p[0]}'), 'k': {k}, 'c': '{c}'}}" for k, (c, p) in enumerate(OWN.hazards.items()))
CUES_SQL = " + ".join(f"CAST({whole_word(c[0])} AS INT)" for c in OWN.energy_cues.values())
FIRST_CUE_SQL = "CASE " + " ".join(f"WHEN {whole_word(c[0])} THEN '{e}'" for e, c in OWN.energy_cues.items()) + " END"
DOES_SQL = r"""r AS (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE doc_id % 5 WHEN 0 THEN 'low-energy/ergonomic' WHEN 1 THEN 'vehicular/motion' END AS label FROM documents)"""
BARRIER_SQL = DOES_SQL + r""",
bp AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(t, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+') AS x FROM r)),
bw AS (SELECT doc_id, regexp_extract(piece, '[\p{L}\p{N}_]+$') AS w, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS e FROM bp),
bc AS (SELECT bw.doc_id, regexp_extract_all(left(t, e - 2), '[a-zA-Z0-9'']+') AS x FROM bw JOIN r ON r.doc_id = bw.doc_id WHERE w = 'of'),
bn AS (SELECT doc_id, x[greatest(len(x) - 3, 1):] AS y FROM bc),
bf AS (SELECT doc_id, list_contains(y, 'and') OR len(list_filter(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1] IN ('to the', 'in the'))) > 0 AS neg FROM bn),
bs AS (SELECT doc_id, count(*) FILTER (neg) AS n_negated, count(*) FILTER (NOT neg) AS n_confirmed FROM bf GROUP BY doc_id),
bt AS (SELECT DISTINCT doc_id FROM bw WHERE w = 'is'),
barrier AS (SELECT r.*, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_negated, 0) AS n_negated,
  CASE WHEN contains(t, 'worthless') THEN 'explicitly_absent' WHEN contains(t, 'stupid') THEN 'uncertain' WHEN bt.doc_id IS NULL THEN 'not_mentioned' WHEN n_negated > 0 THEN 'uncertain' WHEN n_confirmed > 0 THEN 'confirmed_present' ELSE 'not_mentioned' END AS barrier_status
  FROM r LEFT JOIN bs ON r.doc_id = bs.doc_id LEFT JOIN bt ON r.doc_id = bt.doc_id)"""
ENERGY_SQL = f"""h AS (SELECT *, list_sort(list_filter([{HAZARD_SQL}], lambda x: x.n < 0))[1].c AS hazard, {CUES_SQL} AS hits FROM barrier),
energy AS (SELECT *, hits > 0 OR hazard IS NOT NULL AS high_energy, CASE WHEN hits > 0 THEN least(0.70::DOUBLE + 0.05::DOUBLE * hits, 0.95::DOUBLE) WHEN hazard IS NOT NULL THEN 0.80::DOUBLE ELSE 0.85::DOUBLE END AS energy_confidence,
  coalesce(label, {sql_case("hazard", {k: f"'{lexicons.HAZARD_ENERGY[k][0]}'" for k in OWN.hazards}, "NULL")}, {FIRST_CUE_SQL}, 'low-energy/ergonomic') AS energy_type FROM h)"""
PATHWAY_TESTS = [(n, " OR ".join([f"coalesce(hazard = '{h}', false)", *(f"contains(lower(energy_type), '{w}')" for w in words)]), tag) for n, words, h, tag in reports.PATHWAYS]
VERDICT_SQL = f"""x AS (SELECT *, (length(t) - length(replace(t, 'of the', ''))) // 6 AS nd, (length(t) - length(replace(t, 'der', ''))) // 3 AS ni, strpos(t, 'of the') AS fd, strpos(t, 'der') AS fi, contains(t, 'es que') AS clear FROM energy),
y AS (SELECT *, CASE WHEN nd = 0 AND ni = 0 THEN NULL WHEN nd > ni OR (nd = ni AND fd < fi) THEN 'direct_proximity' ELSE 'indirect_proximity' END AS nearest FROM x),
e0 AS (SELECT *, CASE WHEN clear AND coalesce(nearest, '') <> 'direct_proximity' THEN 'no_exposure' ELSE coalesce(nearest, 'unspecified') END AS seen, clear AND nearest IS NOT NULL OR ({says('inin')} AND {says('onon')}) AS w1, barrier_status = 'confirmed_present' AND {says('erer')} AS w2,
  coalesce(NOT list_contains({sql_case("hazard", {k: str(list(v)) for k, v in lexicons.HAZARD_ENERGIES.items() if k in OWN.hazards}, "NULL")}, energy_type), false) AS w3 FROM y),
e1 AS (SELECT *, CAST(w1 AS INT) + CAST(w2 AS INT) + CAST(w3 AS INT) AS n_warnings, w1 OR w2 OR (w3 AND energy_type = 'low-energy/ergonomic') AS contradiction, least(0.4::DOUBLE, CASE WHEN w1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN w2 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN w3 THEN 0.15::DOUBLE ELSE 0 END) AS penalty,
  {says('thth')} AND (seen IN ('direct_proximity', 'indirect_proximity') OR {says('onon')}) AS near_miss, CASE WHEN seen = 'unspecified' AND {says('anan')} THEN 'direct_proximity' ELSE seen END AS exposure, {sql_case("energy_type", {k: str(v).lower() for k, v in reports.direct_controls().items()}, "false")} AS direct FROM e0),
e2 AS (SELECT *, exposure IN ('direct_proximity', 'indirect_proximity') AS near FROM e1),
e3 AS (SELECT *, CASE WHEN barrier_status = 'confirmed_present' THEN high_energy AND near AND NOT direct ELSE (high_energy AND near) OR (near_miss AND high_energy AND exposure = 'direct_proximity') END AS sif_potential, CASE {" ".join(f"WHEN {test} THEN '{n}'" for n, test, _ in PATHWAY_TESTS)} ELSE 'low_energy' END AS pathway,
  coalesce(CASE {" ".join(f"WHEN {test} THEN '{tag}'" for _, test, tag in PATHWAY_TESTS)} END, {sql_case("energy_type", {k: f"'{v[0]}'" for k, v in lexicons.ENERGY_RULES.items()}, "'Work Authorisation'")}) AS tag,
  greatest(0.0, least(1.0, 0.3::DOUBLE * (energy_confidence * CASE WHEN high_energy THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) + 0.4::DOUBLE * CASE barrier_status WHEN 'explicitly_absent' THEN 1.0::DOUBLE WHEN 'uncertain' THEN 0.65::DOUBLE WHEN 'not_mentioned' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + 0.3::DOUBLE * CASE exposure WHEN 'direct_proximity' THEN 1.0::DOUBLE WHEN 'indirect_proximity' THEN 0.55::DOUBLE WHEN 'no_exposure' THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END)) AS strength FROM e2)
SELECT doc_id, hazard, energy_type, exposure, barrier_status, sif_potential, pathway, CASE WHEN sif_potential OR barrier_status = 'not_mentioned' THEN tag ELSE 'N/A' END AS lsr_tag, n_warnings, contradiction,
  CASE WHEN contradiction THEN 'LOW_CONF_REVIEW' WHEN high_energy AND barrier_status = 'not_mentioned' THEN 'NEEDS_MORE_INFO' WHEN sif_potential THEN CASE WHEN strength >= 0.75 AND n_warnings = 0 AND barrier_status <> 'uncertain' THEN 'HIGH_CONF_SIF' ELSE 'LOW_CONF_REVIEW' END
    WHEN (NOT high_energy OR barrier_status = 'confirmed_present' OR NOT near) AND n_warnings = 0 AND barrier_status <> 'uncertain' THEN 'HIGH_CONF_NON_SIF' WHEN barrier_status = 'not_mentioned' THEN 'NEEDS_MORE_INFO' ELSE 'LOW_CONF_REVIEW' END AS bucket,
  round(greatest(0.1, least(1.0, CASE WHEN sif_potential THEN strength ELSE 1 - strength END - penalty)), 3) AS confidence FROM e3"""


@query(f"WITH {BARRIER_SQL} SELECT doc_id, barrier_status, n_confirmed, n_negated FROM barrier")
def report_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the barrier: absence, doubt, a name, and confirmations that the tokens before them may negate."""
    d = reports.extracted(chain(spark, sf_dir), OWN)
    count = lambda test: F.size(F.filter("confirmed_at", test)).cast("long")
    return d.select("doc_id", "barrier_status", count(lambda s: ~s["negated"]).alias("n_confirmed"), count(lambda s: s["negated"]).alias("n_negated"))


NEAR_SQL = BARRIER_SQL.replace("bn AS (SELECT doc_id, x[greatest(len(x) - 3, 1):] AS y FROM bc)", """bz AS (SELECT bw.doc_id, len(regexp_extract_all(left(t, e - 2), '[a-zA-Z0-9'']+')) AS at FROM bw JOIN r ON r.doc_id = bw.doc_id WHERE w = 'is'),
bn AS (SELECT doc_id, x[greatest(len(x) - 3, 1):] AS y FROM bc WHERE EXISTS (FROM bz WHERE bz.doc_id = bc.doc_id AND abs(bz.at - len(bc.x)) <= 8))""")


@query(f"WITH {NEAR_SQL} SELECT doc_id, barrier_status, n_confirmed, n_negated FROM barrier")
def report_barrier_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where a confirmation counts only within eight tokens of a barrier's name."""
    d = reports.extracted(chain(spark, sf_dir), replace(OWN, proximity=8))
    count = lambda test: F.size(F.filter("confirmed_at", test)).cast("long")
    return d.select("doc_id", "barrier_status", count(lambda s: ~s["negated"]).alias("n_confirmed"), count(lambda s: s["negated"]).alias("n_negated"))


@query(f"WITH {BARRIER_SQL}, {ENERGY_SQL} SELECT doc_id, hazard, high_energy, round(energy_confidence, 6) AS energy_confidence, energy_type FROM energy")
def report_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a high energy is named, how surely, and which."""
    d = reports.energy_gate(reports.extracted(chain(spark, sf_dir), OWN), OWN)
    return d.select("doc_id", "hazard", "high_energy", F.round("energy_confidence", 6).alias("energy_confidence"), "energy_type")


@query(f"WITH {BARRIER_SQL}, {ENERGY_SQL}, {VERDICT_SQL}")
def report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: evidence, consistency, verdict, rule, pathway, review bucket and confidence."""
    d = reports.assessed(chain(spark, sf_dir), OWN)
    return d.select("doc_id", "hazard", "energy_type", "exposure", "barrier_status", "sif_potential", "pathway", "lsr_tag", F.size("warnings").alias("n_warnings"), "contradiction", "bucket", "confidence")
