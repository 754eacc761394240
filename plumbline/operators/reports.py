"""From the text of a report to a verdict: normalisation, evidence with places in the text, decision, routing.

Lexicons are parameters. Everything is column expressions: one select after
another over the row, no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import lexicons as L
from .summary import bucket as bucket_rule
from .summary import evidence_strength

# Pathways by which energy does harm, in order: words of the energy type, hazard category, rule.
PATHWAYS = (
    ("suspended_load", ("suspended",), "safe_mechanical_lifting", "Safe Mechanical Lifting"),
    ("electrical_isolation", ("electrical",), "energy_isolation", "Energy Isolation"),
    ("hot_work_ignition", ("hot work", "thermal"), "hot_work", "Hot Work"),
    ("confined_space_asphyxiation", ("confined", "asphyxiation"), "confined_space", "Confined Space"),
    ("fall_from_height", ("height", "fall"), "working_at_height", "Working at Height"),
    ("vehicular_impact", ("vehicular", "motion"), "driving", "Driving"),
    ("line_of_fire_burst", ("line of fire", "kinetic"), "line_of_fire", "Line of Fire"),
)
# Cues of the consistency checks.
CLEARANCE = ["area was clear of workers", "area was cleared of workers", "area was clear of all personnel", "area was cleared of all workers", "area was cleared of all personnel", "barricaded with no entry", "no personnel were in the vicinity", "no workers were present"]
NEAR = ["directly under", "directly beneath", "worker beneath", "worker directly under", "under crane arm", "inside the equipment", "worker entered", "personnel entered", "entered the vessel", "in the line of fire", "worker below"]
LIVE = ["live circuit", "energized", "live wire", "arc flash", "live switchboard"]
UNHARMED = ["no injury occurred", "no injury", "no personnel injured", "zero injury", "near miss", "corrected before escalation", "deflected by netting", "worker ducked", "narrowly avoided"]
EXPOSED = ["worker was exposed", "personnel were exposed", "exposed to an energized electrical component", "exposed to electrical energy", "was exposed to", "worker exposed to"]


@dataclass(frozen=True)
class ReportParams:
    hazards: dict = field(default_factory=lambda: L.HAZARDS)
    activities: dict = field(default_factory=lambda: L.ACTIVITIES)
    exposures: dict = field(default_factory=lambda: L.EXPOSURES)
    no_exposure: list = field(default_factory=lambda: L.NO_EXPOSURE)
    absences: list = field(default_factory=lambda: L.ABSENCES)
    uncertainties: list = field(default_factory=lambda: L.UNCERTAINTIES)
    barrier_terms: list = field(default_factory=lambda: L.BARRIER_TERMS)
    confirmations: list = field(default_factory=lambda: L.CONFIRMATIONS)
    #: Tokens before a confirmation that may negate it.
    window: int = 4
    negations: list = field(default_factory=lambda: L.NEGATIONS)
    negation_pairs: list = field(default_factory=lambda: L.NEGATION_PAIRS)
    #: Cues of each high energy type, as whole words; None: those of the lexicons.
    energy_cues: dict | None = None
    #: A column with a learned energy type, which comes before what hazard and cues say.
    energy_label: str | None = None
    #: Cues of the consistency checks.
    clearance: list = field(default_factory=lambda: CLEARANCE)
    near: list = field(default_factory=lambda: NEAR)
    live: list = field(default_factory=lambda: LIVE)
    unharmed: list = field(default_factory=lambda: UNHARMED)
    exposed: list = field(default_factory=lambda: EXPOSED)
    #: Whether a confirmation must stand within so many tokens of a barrier's name; None: it need not.
    proximity: int | None = None


def normalised(text: Column) -> Column:
    """Abbreviations spelled out, mixed-language phrases translated, lower case, known misspellings fixed, noise removed."""
    flat = lambda g: {k: v[0] for k, v in g.items()}
    protected = sorted({w for g in (L.ABBREVIATIONS, L.GLOSSARY) for v in g.values() for w in v[0].lower().split()})
    out = T.replaced(text, flat(L.ABBREVIATIONS), ignore_case=False)
    out = T.replaced(out, flat(L.GLOSSARY), ignore_case=True)
    return T.tidied(T.typo_fixed(F.lower(out), flat(L.TYPOS), protected))


def energy_cues() -> dict[str, list[str]]:
    """Cues of high energy types, as whole words: several words, or six letters at least."""
    out = {}
    for name, cues in L.ENERGY_CUES.items():
        if L.ENERGY_RULES[name][2] == "true":
            every = {c.lower() for c in cues + L.MORE_ENERGY_CUES.get(name, [])}
            out[name] = sorted(c for c in every if " " in c or len(c) >= 6)
    return out


def any_of(cues: list[str]) -> Column:
    return F.expr("exists(array(" + ", ".join(T.sql_text(c) for c in cues) + "), c -> contains(lc, c))")


def keyword_verdict(text: str, cues: list[list[str]], most: int = 6) -> Column:
    """The baseline rule: of every list of cues one of the first few is in the text, whatever its case."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = F.lit(True)
    for some in cues:
        hit = F.lit(False)
        for cue in some[:most]:
            hit = hit | F.contains(lower, F.lit(cue.lower()))
        out = out & hit
    return out


def extracted(reports: DataFrame, params: ReportParams | None = None, text: str = "text") -> DataFrame:
    """Adds the evidence of each report: hazard, activity, exposure and barrier with their spans.

    Spans are (start, end) in code points of the text. A null text is an empty one.
    """
    p = params or ReportParams()
    one = lambda name, phrases: {name: phrases}
    df = reports.withColumn("lc", F.lower(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumns(
        {
            "hazard_spans": T.phrase_spans("lc", p.hazards),
            "activity_spans": T.phrase_spans("lc", p.activities),
            "clear_spans": T.phrase_spans("lc", one("no_exposure", p.no_exposure)),
            "near_spans": T.phrase_spans("lc", p.exposures),
            "absent_spans": T.phrase_spans("lc", one("explicitly_absent", p.absences)),
            "doubt_spans": T.phrase_spans("lc", one("uncertain", p.uncertainties)),
            "term_spans": T.phrase_spans("lc", one("barrier", p.barrier_terms), whole_words=True),
            "confirm_spans": T.phrase_spans("lc", one("confirmation", p.confirmations), whole_words=True),
        }
    )
    df = df.withColumns({"hazard": T.best_category("hazard_spans", p.hazards), "activity_category": F.coalesce(T.best_category("activity_spans", p.activities), F.lit("unspecified"))})
    # a phrase of nearness inside one that says that nobody was near says nothing
    df = df.withColumn("near_spans", F.expr("filter(near_spans, s -> NOT exists(clear_spans, n -> s.start >= n.start AND s.end <= n.end))"))
    df = df.withColumn("nearest", T.best_category("near_spans", p.exposures))
    clear, near = F.size("clear_spans") > 0, F.col("nearest")
    df = df.withColumn("exposure_contradiction", clear & near.isNotNull())
    df = df.withColumn("exposure", F.when(clear & ~F.coalesce(near == "direct_proximity", F.lit(False)), "no_exposure").when(near.isNotNull(), near).otherwise("unspecified"))
    confirm = f"transform(confirm_spans, s -> named_struct('start', s.start, 'end', s.end, 'negated', {T.negated('lc', 's.start', p.window, p.negations, p.negation_pairs)}))"
    if p.proximity is not None:
        # how many tokens stand before each, counted once
        place = lambda x: f"size({T.tokens(f'substring(lc, 1, {x}.start)')})"
        placed = f"filter(transform(confirm_spans, s -> named_struct('s', s, 'at', {place('s')})), c -> exists(terms, b -> abs(c.at - b) <= {p.proximity}))"
        close = f"transform(array(transform(term_spans, b -> {place('b')})), terms -> transform({placed}, c -> c.s))[0]"
        confirm = confirm.replace("transform(confirm_spans,", f"transform({close},")
    df = df.withColumn("confirmed_at", F.expr(confirm))
    no, yes = F.expr("exists(confirmed_at, s -> s.negated)"), F.expr("exists(confirmed_at, s -> NOT s.negated)")
    status = (
        F.when(F.size("absent_spans") > 0, "explicitly_absent")
        .when(F.size("doubt_spans") > 0, "uncertain")
        .when(F.size("term_spans") == 0, "not_mentioned")
        .when(no, "uncertain")
        .when(yes, "confirmed_present")
        .otherwise("not_mentioned")
    )
    df = df.withColumn("barrier_status", status)
    gap = F.when(status == "explicitly_absent", 1.0).when(status == "uncertain", 0.6).when(status == "confirmed_present", 0.0)
    return df.withColumn("gap_severity", gap)


def energy_gate(df: DataFrame, params: ReportParams | None = None) -> DataFrame:
    """Adds high_energy, energy_confidence and energy_type: cues of high energy, else what the hazard category stands for."""
    p = params or ReportParams()
    cues = energy_cues() if p.energy_cues is None else p.energy_cues
    label = F.lit(None).cast("string") if p.energy_label is None else F.col(p.energy_label)
    df = df.withColumn("energy_hits", F.expr(f"filter({T.lexicon(cues)}, p -> contains(lc, p.phrase) AND lc rlike concat('(?U)\\\\b\\\\Q', p.phrase, '\\\\E\\\\b'))"))
    by_hazard = F.create_map(*(F.lit(x) for k, v in L.HAZARD_ENERGY.items() for x in (k, v[0])))
    some = F.size("energy_hits") > 0
    return df.withColumns(
        {
            "high_energy": some | F.col("hazard").isNotNull(),
            "energy_confidence": F.when(some, F.least(0.70 + 0.05 * F.size("energy_hits"), F.lit(0.95))).when(F.col("hazard").isNotNull(), 0.80).otherwise(0.85),
            # without a learned label the hazard's energy type names the energy, then the first type with a cue
            "energy_type": F.coalesce(label, F.element_at(by_hazard, F.col("hazard")), F.when(some, F.expr("array_min(transform(energy_hits, p -> named_struct('place', p.place, 'c', p.category))).c")), F.lit("low-energy/ergonomic")),
        }
    )


def checked(df: DataFrame, params: ReportParams | None = None) -> DataFrame:
    """Adds the consistency findings: kinds of warnings, contradiction, penalty and near miss."""
    p = params or ReportParams()
    agree = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in L.HAZARD_ENERGIES.items() for x in kv))
    expected = F.element_at(agree, F.col("hazard"))
    disagrees = F.coalesce(~F.array_contains(expected, F.col("energy_type")), F.lit(False))
    low = F.col("energy_type") == "low-energy/ergonomic"
    exposure = F.col("exposure_contradiction") | (any_of(p.clearance) & any_of(p.near))
    live = (F.col("barrier_status") == "confirmed_present") & any_of(p.live)
    df = df.withColumn("warnings", F.array_compact(F.array(F.when(exposure, "EXPOSURE_CONTRADICTION"), F.when(live, "BARRIER_HAZARD_CONTRADICTION"), F.when(disagrees, "ENERGY_HAZARD_DISAGREEMENT"))))
    df = df.withColumn("contradiction", exposure | live | (disagrees & low))
    df = df.withColumn("penalty", F.least(F.lit(0.4), F.when(exposure, 0.25).otherwise(0.0) + F.when(live, 0.20).otherwise(0.0) + F.when(disagrees, 0.15).otherwise(0.0)))
    return df.withColumn("near_miss", any_of(p.unharmed) & (F.col("exposure").isin("direct_proximity", "indirect_proximity") | any_of(p.near)))


def direct_controls() -> dict[str, bool]:
    """Whether the barrier that controls an energy type (the first declared one) is a direct control."""
    first: dict[str, str] = {}
    for name, values in L.BARRIERS.items():
        for energy in values[1:]:
            first.setdefault(energy, name)
    return {energy: L.BARRIERS[name][0] == "true" for energy, name in first.items()}


def decided(df: DataFrame, params: ReportParams | None = None) -> DataFrame:
    """Adds the verdict, rule tag, pathway, bucket, confidence and a justification."""
    p = params or ReportParams()
    direct = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in direct_controls().items() for x in kv)), F.col("energy_type")), F.lit(False))
    exposure = F.when((F.col("exposure") == "unspecified") & any_of(p.exposed), "direct_proximity").otherwise(F.col("exposure"))
    df = df.withColumn("exposure", exposure)
    near, close = F.col("exposure").isin("direct_proximity", "indirect_proximity"), F.col("exposure") == "direct_proximity"
    confirmed, silent = F.col("barrier_status") == "confirmed_present", F.col("barrier_status") == "not_mentioned"
    flagged = F.when(confirmed, F.col("high_energy") & near & ~direct).otherwise((F.col("high_energy") & near) | (F.col("near_miss") & F.col("high_energy") & close))
    lower = F.lower("energy_type")
    pathway, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, parts, hazard, tag in reversed(PATHWAYS):
        hit = F.coalesce(F.col("hazard") == hazard, F.lit(False))
        for part in parts:
            hit = hit | F.contains(lower, F.lit(part))
        pathway, rule = F.when(hit, name).otherwise(pathway), F.when(hit, tag).otherwise(rule)
    own_rule = F.element_at(F.create_map(*(F.lit(x) for k, v in L.ENERGY_RULES.items() for x in (k, v[0]))), F.col("energy_type"))
    df = df.withColumn("sif_potential", flagged).withColumn("pathway", F.coalesce(pathway, F.lit("low_energy")))
    df = df.withColumn("lsr_tag", F.when(flagged | silent, F.coalesce(rule, own_rule, F.lit("Work Authorisation"))).otherwise("N/A"))
    strength = evidence_strength(F.col("energy_confidence"), F.col("high_energy"), F.col("barrier_status"), F.when(near | (F.col("exposure") == "no_exposure"), F.col("exposure")).otherwise("unspecified"))
    df = df.withColumn("strength", strength)
    consistent = ~F.col("contradiction") & (F.size("warnings") == 0)
    df = df.withColumn("bucket", bucket_rule(flagged, F.col("high_energy"), F.col("barrier_status"), F.col("exposure"), F.col("strength"), contradiction=F.col("contradiction"), consistent=consistent, warnings=F.size("warnings") > 0, needs_info=silent))
    sure = F.when(flagged, F.col("strength")).otherwise(1 - F.col("strength")) - F.col("penalty")
    df = df.withColumn("confidence", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), sure)), 3))
    return df.withColumn(
        "justification",
        F.concat_ws(
            " ",
            F.when(flagged, F.format_string("Flagged: high energy (%s).", "energy_type")).otherwise(F.format_string("Not flagged (%s).", "energy_type")),
            F.concat(F.lit("Barrier "), F.replace("barrier_status", F.lit("_"), F.lit(" ")), F.lit(".")),
            F.concat(F.lit("Exposure "), F.replace("exposure", F.lit("_"), F.lit(" ")), F.lit(".")),
            F.when(F.col("near_miss"), "A near-miss: exposure without harm."),
        ),
    )


def assessed(reports: DataFrame, params: ReportParams | None = None, text: str = "text") -> DataFrame:
    """The whole chain for a DataFrame of reports; one row of input gives one row."""
    return decided(checked(energy_gate(extracted(reports, params, text), params), params), params).drop("lc")
