"""Personal data by weak supervision, in DataFrame and SQL functions only (operator 5).

Base patterns give spans that always stay. They and looser patterns (spelled-out
addresses, national telephone numbers, IPv6, secrets) are candidates on which
three labelers vote: a strict pattern, a gazetteer and the words around.
Expectation maximisation over the counts of vote patterns estimates how reliable
each labeler is, for each kind; its posteriors are the labels of a naive Bayes
span classifier, which sees the span's form and surroundings, not the votes, and
decides on the looser candidates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans, in the order in which spans with the same start are listed; the method alone adds secrets.
ALL_KINDS = (*KINDS, "secret")

# Patterns. Runs are matched possessively and begin where a run begins (or where
# the last match ended), so that they cost linear time on any text and never
# recurse; they match what the plain patterns match.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text for a pattern to be tried at all.
NEEDS = {"email": "contains(text, '@')", "ip": "has_digit", "card": "has_digit", "phone": "contains(text, '+')", "email2": "lower(text) rlike '[(\\\\[ ]at[)\\\\] ]'", "phone2": "has_digit", "ip2": "contains(text, ':')", "secret2": "has_digit"}
LOOSE = {
    "email2": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{2,63}(?:(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?)[A-Za-z0-9-]{2,63}){1,4}",
    "phone2": r"(?<![0-9+(.-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret2": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[0-9+/_-]{0,40}[A-Za-z])[A-Za-z0-9+/_-]{20,200}+={0,2}(?![A-Za-z0-9@.])",
    "ip2": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
}
# The default gazetteer (top-level domains, issuer prefixes, country codes, prefixes of access keys)
# and words of the contexts, in the languages of the tables.
GAZETTEER = {
    "email": "com org net edu gov int info biz io de fr es uk it nl eu ch at us ca au",
    "card": "4 51 52 53 54 55 22 23 24 25 26 27 34 37 6",
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
    "secret": "AKIA ASIA AIza ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk_test_ pk_live_ rk_live_ xoxb- xoxp- sk- ya29 eyJ hf_ npm_ SG",
}
CONTEXT = {
    "email": "mail email e-mail contact write kontakt adresse correo courriel schreiben escribir",
    "ip": "ip host server address login client adresse servidor serveur direccion",
    "card": "card visa mastercard amex credit payment karte kreditkarte carte tarjeta pago zahlung",
    "phone": "phone tel call mobile fax cell telefon anrufen telephone appeler telefono llamar",
    "secret": "token secret password passwd pwd key apikey api_key access_key auth bearer credential passwort clave contraseña motdepasse",
}


@dataclass(frozen=True)
class PiiParams:
    #: Characters before and after a candidate that the context labeler reads.
    before: int = 40
    after: int = 24
    em_rounds: int = 30
    #: A looser candidate becomes a span from this probability on.
    least_probability: float = 0.9
    #: Matches that one fold numbers; arrays of matches are cut into such chunks.
    chunk: int = 512
    #: Most rows of a gazetteer, which becomes part of the plan.
    most_terms: int = 10_000


def candidates(docs: DataFrame, params: PiiParams) -> DataFrame:
    """doc_id and all candidates of each row: array of (kind, base, start, end, value, before, after).

    The pieces between matches and the matches give the offsets, in code points;
    running sums are taken in chunks, so a text with very many matches costs no
    square.
    """
    c = params.chunk
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    parts = []
    for kind, pattern in (BASE | LOOSE).items():
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        rows = rows.withColumn(f"{kind}_h", F.expr(f"CASE WHEN {NEEDS[kind]} THEN regexp_extract_all(text, '{quoted}', 0) END"))
        # a text without a match (nearly all of them) is not cut up
        rows = rows.withColumn(f"{kind}_g", F.expr(f"CASE WHEN size({kind}_h) > 0 THEN split(text, '{quoted}', -1) END"))
        item = f"named_struct('g', length({kind}_g[i]), 'm', length(h), 'value', h, 'before', right({kind}_g[i], {params.before}), 'after', left({kind}_g[i + 1], {params.after}))"
        rows = rows.withColumn(f"{kind}_i", F.expr(f"transform({kind}_h, (h, i) -> {item})")).drop(f"{kind}_h", f"{kind}_g")
        rows = rows.withColumn(f"{kind}_c", F.expr(f"transform(sequence(0, cast((size({kind}_i) - 1) div {c} as int)), k -> slice({kind}_i, k * {c} + 1, {c}))")).drop(f"{kind}_i")
        running = "aggregate(part, named_struct('s', 0, 'a', cast(array() as array<int>)), (acc, x) -> named_struct('s', acc.s + x.g + x.m, 'a', concat(acc.a, array(acc.s + x.g))))"
        rows = rows.withColumn(f"{kind}_r", F.expr(f"transform({kind}_c, part -> {running})"))
        rows = rows.withColumn(f"{kind}_o", F.expr(f"aggregate({kind}_r, named_struct('s', 0, 'a', cast(array() as array<int>)), (acc, x) -> named_struct('s', acc.s + x.s, 'a', concat(acc.a, array(acc.s)))).a"))
        name, base = kind.rstrip("2"), str(kind in BASE).lower()
        span = f"named_struct('kind', '{name}', 'base', {base}, 'start', {kind}_r[k].a[j] + {kind}_o[k], 'end', {kind}_r[k].a[j] + {kind}_o[k] + x.m, 'value', x.value, 'before', x.before, 'after', x.after)"
        rows = rows.withColumn(f"{kind}_s", F.expr(f"coalesce(flatten(transform({kind}_c, (part, k) -> transform(part, (x, j) -> {span}))), array())")).drop(f"{kind}_c", f"{kind}_r", f"{kind}_o")
        parts.append(f"{kind}_s")
    return rows.select("doc_id", F.concat(*parts).alias("found"))


DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = (
    f"aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substr({DIGITS}, length({DIGITS}) - i + 1, 1) as int)"
    f" ELSE cast(substr({DIGITS}, length({DIGITS}) - i + 1, 1) as int) * 2 - IF(cast(substr({DIGITS}, length({DIGITS}) - i + 1, 1) as int) > 4, 9, 0) END) % 10 = 0"
)
#: Whether a match of a base pattern is a base span.
VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(right(p, 3) as int) <= 255)",
    "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}


def quoted(words: list[str]) -> str:
    """A group of alternatives inside a pattern inside a SQL string."""
    return "(" + "|".join(re.sub(r"([^\w\s'])", r"\\\\\1", w).replace("'", r"\'") for w in words) + ")"


def terms_of(gazetteer: DataFrame | None, params: PiiParams) -> dict[str, list[str]]:
    """The terms of each kind: of a table (kind, term), whose size is checked, or the default."""
    if gazetteer is None:
        return {k: v.split() for k, v in GAZETTEER.items()}
    rows = gazetteer.where("kind is not null and length(term) > 0").select("kind", "term").distinct().orderBy("kind", "term").limit(params.most_terms + 1).collect()
    if len(rows) > params.most_terms:
        raise ValueError(f"the gazetteer has more than {params.most_terms} terms")
    return {k: [r["term"] for r in rows if r["kind"] == k] for k in ALL_KINDS}


def votes(terms: dict[str, list[str]]) -> str:
    """SQL of the three labelers' votes on candidate x: 1 for, 0 against, -1 for no opinion."""
    hexadecimal = "x.value rlike '^([0-9a-f]+|[0-9A-F]+)$' AND length(x.value) IN (32, 40, 56, 64, 96, 128)"
    mixed = "x.value rlike '[0-9].*[0-9].*[0-9]' AND x.value rlike '[a-z]' AND x.value rlike '[A-Z]'"
    strict = f"""CASE WHEN x.base THEN int(x.valid) WHEN x.kind = 'phone' THEN int(length({DIGITS}) = 10 AND x.value NOT rlike '^[01]') WHEN x.kind = 'ip' THEN 1
      WHEN x.kind = 'secret' THEN int(({hexadecimal}) OR ({mixed})) ELSE int(x.value rlike '(?i)dot|[.]') END"""
    known = {k: quoted(v) if v else "(?!)" for k, v in ((k, terms.get(k, [])) for k in ALL_KINDS)}
    gazetteer = f"""CASE x.kind WHEN 'email' THEN int(x.value rlike '(?i)[. )]{known["email"]}$') WHEN 'card' THEN IF(length({DIGITS}) < 12, 0, int({DIGITS} rlike '^{known["card"]}'))
      WHEN 'ip' THEN CASE WHEN x.value rlike '^(0|10|127|192[.]168|169[.]254|22[4-9]|2[3-5][0-9])[.]' THEN 0 WHEN x.valid THEN 1 ELSE 0 END
      WHEN 'secret' THEN IF(x.value rlike '^{known["secret"]}', 1, -1)
      ELSE IF(x.value rlike '^[+]{known["phone"]}', 1, -1) END"""
    context = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN IF(concat(x.before, ' ', x.after) rlike '(?i)(^|[^a-z]){quoted(w.split())}([^a-z]|$)', 1, {0 if k == 'secret' else -1})" for k, w in CONTEXT.items()) + " END"
    glued = "x.kind <> 'secret' AND (x.before rlike '[A-Za-z0-9]$' OR x.after rlike '^[A-Za-z0-9]')"
    return f"named_struct('v1', {strict}, 'v2', {gazetteer}, 'v3', CASE WHEN {glued} THEN 0 ELSE {context} END)"


def features() -> str:
    """SQL of the span classifier's features of candidate x; each takes a few values. None looks at the votes."""
    size = f"concat(x.kind, ' digits ', least(length({DIGITS}), 20))"
    left = "concat(x.kind, ' left ', CASE WHEN x.before = '' THEN 'start' WHEN x.before rlike '[ \n]$' THEN 'blank' WHEN x.before rlike '[A-Za-z]$' THEN 'letter' WHEN x.before rlike '[0-9]$' THEN 'digit' WHEN x.before rlike '[:=] ?[\"]?$' THEN 'assigned' ELSE 'mark' END)"
    right = "concat(x.kind, ' right ', CASE WHEN x.after = '' THEN 'end' WHEN x.after rlike '^[ \n]' THEN 'blank' WHEN x.after rlike '^[A-Za-z]' THEN 'letter' WHEN x.after rlike '^[0-9]' THEN 'digit' ELSE 'mark' END)"
    form = "concat(x.kind, ' form ', CASE WHEN x.value rlike '[(\\\\[]' THEN 'bracket' WHEN x.value rlike '-' THEN 'hyphen' WHEN x.value rlike ' ' THEN 'blank' WHEN x.value rlike '/' THEN 'slash' WHEN x.value rlike '_' THEN 'line' ELSE 'plain' END)"
    length = "concat(x.kind, ' length ', least(length(x.value) div 8, 9))"
    return f"array({size}, {left}, {right}, {form}, {length})"


def likelihood(side: str, prior: str) -> str:
    """Of vote pattern q, under parameters s of one side ('a': is personal data, 'b': is not)."""
    return " * ".join([prior] + [f"CASE q.v{k} WHEN 1 THEN s.{side}{k} WHEN 0 THEN 1 - s.{side}{k} ELSE 1D END" for k in (1, 2, 3)])


def em(rounds: int) -> str:
    """SQL: parameters after so many rounds over `patterns`, the counted vote patterns of one kind."""
    yes, no = likelihood("a", "s.prior"), likelihood("b", "(1 - s.prior)")
    p = f"(({yes}) / greatest(({yes}) + ({no}), 1e-300))"
    sums = ", ".join(
        [f"'n', acc.n + q.n, 'p', acc.p + q.n * {p}"]
        + [f"'x{k}', acc.x{k} + IF(q.v{k} = 1, q.n * {p}, 0D), 'y{k}', acc.y{k} + IF(q.v{k} >= 0, q.n * {p}, 0D), 'z{k}', acc.z{k} + IF(q.v{k} = 1, q.n * (1 - {p}), 0D), 'w{k}', acc.w{k} + IF(q.v{k} >= 0, q.n * (1 - {p}), 0D)" for k in (1, 2, 3)]
    )
    zero = ", ".join(["'n', 0D, 'p', 0D"] + [f"'x{k}', 0D, 'y{k}', 0D, 'z{k}', 0D, 'w{k}', 0D" for k in (1, 2, 3)])
    # priors of two votes each keep a labeler that never speaks at its first guess
    done = ", ".join(["'prior', (t.p + 1) / (t.n + 2)"] + [f"'a{k}', (t.x{k} + 1.6) / (t.y{k} + 2), 'b{k}', (t.z{k} + 0.4) / (t.w{k} + 2)" for k in (1, 2, 3)])
    first = "named_struct('prior', 0.5D, " + ", ".join(f"'a{k}', 0.8D, 'b{k}', 0.2D" for k in (1, 2, 3)) + ")"
    step = f"transform(array(aggregate(patterns, named_struct({zero}), (acc, q) -> named_struct({sums}))), t -> named_struct({done}))[0]"
    return f"aggregate(sequence(1, {rounds}), {first}, (s, round) -> {step})"


def reliabilities(spans: DataFrame, params: PiiParams) -> DataFrame:
    """(kind, patterns, s) by expectation maximisation: s has the prior and, for each labeler, how often it votes for what is personal data (a) and for what is not (b)."""
    counted = spans.groupBy("kind", "v.v1", "v.v2", "v.v3").agg(F.count("*").cast("double").alias("n"))
    by_kind = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v1", "v2", "v3", "n"))).alias("patterns"))
    return by_kind.select("kind", "patterns", F.expr(em(params.em_rounds)).alias("s"))


def posteriors(spans: DataFrame, params: PiiParams) -> DataFrame:
    """(kind, v1, v2, v3, p): the estimated probability of each vote pattern; at most 27 rows a kind."""
    fitted = reliabilities(spans, params)
    yes, no = likelihood("a", "s.prior"), likelihood("b", "(1 - s.prior)")
    return fitted.select("kind", F.explode("patterns").alias("q"), "s").select("kind", "q.v1", "q.v2", "q.v3", F.expr(f"({yes}) / greatest(({yes}) + ({no}), 1e-300)").alias("p"))


def with_fields(x: str, names: str) -> str:
    """SQL of a struct, left open, with fields of x."""
    return "named_struct(" + ", ".join(f"'{n}', {x}.{n}" for n in names.split())


def personal_data(docs: DataFrame, params: PiiParams | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans.

    The counts and base_sha256 are those of the base spans; spans also holds the
    looser candidates that the classifier accepts and that overlap no base span,
    n_added of them. gazetteer is a table (kind, term) for the second labeler.
    A null text counts as empty: no spans, the hash of the empty string. Rows
    that repeat an id, and null ids, give one row each. Works on an empty table.
    """
    params = params or PiiParams()
    valid = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VALID.items()) + " END"
    judged = (
        candidates(docs, params)
        .withColumn("found", F.expr(f"transform(found, x -> {with_fields('x', 'kind base start end value before after')}, 'valid', IF(x.base, {valid}, true)))"))
        .withColumn("found", F.expr(f"transform(found, x -> {with_fields('x', 'kind base start end valid value before after')}, 'v', {votes(terms_of(gazetteer, params))}))"))
        .withColumn("found", F.expr(f"transform(found, x -> {with_fields('x', 'kind base start end valid v')}, 'features', {features()}))"))
    )
    judged = stored(judged, "spans")
    spans = judged.select(F.explode("found").alias("x")).select("x.*")
    trained = spans.select("kind", "v.*", "features").join(posteriors(spans, params), ["kind", "v1", "v2", "v3"])
    # features take a few values each (at most 21), so this table is small whatever the corpus
    table = trained.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    logs: dict[str, float] = {}
    for kind in ALL_KINDS:
        own = [r for r in table if r["kind"] == kind]
        for r in own:
            same = [x for x in own if x["feature"].split(" ")[1] == r["feature"].split(" ")[1]]
            logs[r["feature"]] = math.log((r["yes"] + 0.5) / (sum(x["yes"] for x in same) + 1) * (sum(x["no"] for x in same) + 1) / (r["no"] + 0.5))
        one = [x for x in own if x["feature"].split(" ")[1] == "form"]
        logs[kind] = math.log((sum(x["yes"] for x in one) + 1) / (sum(x["no"] for x in one) + 1))
    model = F.create_map(*(F.lit(v) for pair in sorted(logs.items()) for v in pair))
    floor = math.log(params.least_probability / (1 - params.least_probability))
    score = "aggregate(x.features, model[x.kind], (s, f) -> s + coalesce(model[f], 0D))"
    order = "array_position(array({}), x.kind)".format(", ".join(f"'{k}'" for k in ALL_KINDS))
    key = f"named_struct('start', x.start, 'k', {order}, 'end', x.end, 'kind', x.kind)"
    out = (
        judged.withColumn("model", model)
        .withColumn("base", F.expr(f"array_sort(transform(filter(found, x -> x.base AND x.valid), x -> {key}))"))
        .withColumn("loose", F.expr(f"transform(filter(found, x -> NOT (x.base AND x.valid) AND NOT x.base AND {score} >= {floor}), x -> {key})"))
        .withColumn("loose", F.expr("filter(loose, x -> NOT exists(base, y -> x.start < y.end AND y.start < x.end))"))
        .withColumn("all", F.expr("array_sort(concat(base, loose))"))
    )
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return out.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(text.format("base")), 256).alias("base_sha256"),
        F.expr(text.format("all")).alias("spans"),
        F.expr("cast(size(loose) as long)").alias("n_added"),
        F.expr("cast(size(base) + size(loose) as long)").alias("n_spans"),
    )
