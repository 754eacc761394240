"""Sites and surroundings named in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def named_place(text: str, aliases: dict[str, str]) -> Column:
    """(place, start, end) of the longest alias that stands in a lower-cased text as a whole word, at its first occurrence; null if none does.

    aliases: alias to place. Among aliases of one length the first declared wins.
    """
    ordered = sorted(aliases, key=lambda a: -len(a))
    if not ordered:
        return F.lit(None).cast("struct<place:string,start:int,end:int>")
    rows = ", ".join(f"named_struct('alias', {T.sql_text(a.lower())}, 'place', {T.sql_text(aliases[a])})" for a in ordered)
    regex = "concat('(?U)(?=\\\\b\\\\Q', p.alias, '\\\\E\\\\b)')"
    hits = f"filter(array({rows}), p -> contains({text}, p.alias) AND {text} rlike {regex})"
    at = T.offsets(text, regex) + "[0]"
    return F.expr(f"get(transform(slice({hits}, 1, 1), p -> named_struct('place', p.place, 'start', {at}, 'end', {at} + length(p.alias))), 0)")


def surroundings(df: DataFrame, text: str, patterns: dict[str, list[str]], negations: list[str], prefix: int = 40) -> DataFrame:
    """Adds environment (category, start, end, negated): the earliest pattern that no negation precedes, else the first negated one by declaration.

    Patterns are found anywhere in the lower-cased text; a negation counts within the characters before.
    """
    before = f"substring({text}, greatest(s.start - {prefix}, 0) + 1, least(s.start, {prefix}))"
    no = "array(" + ", ".join(T.sql_text(n.lower()) for n in negations) + ")"
    out = df.withColumn("env__", T.phrase_spans(text, patterns))
    out = out.withColumn("env__", F.expr(f"transform(env__, s -> named_struct('negated', exists({no}, n -> contains({before}, n)), 'start', s.start, 'end', s.end, 'place', s.place, 'category', s.category))"))
    yes = "array_min(transform(filter(env__, s -> NOT s.negated), s -> named_struct('start', s.start, 'place', s.place, 'end', s.end, 'negated', s.negated, 'category', s.category)))"
    other = "array_min(transform(filter(env__, s -> s.negated), s -> named_struct('place', s.place, 'start', s.start, 'end', s.end, 'negated', s.negated, 'category', s.category)))"
    pick = lambda x: f"named_struct('category', {x}.category, 'start', {x}.start, 'end', {x}.end, 'negated', {x}.negated)"
    return out.withColumn("environment", F.expr(f"CASE WHEN exists(env__, s -> NOT s.negated) THEN {pick(yes)} WHEN size(env__) > 0 THEN {pick(other)} END")).drop("env__")


def feature_vector(text: str, *lexicons: dict[str, list[str]]) -> Column:
    """Hits of every category of the lexicons, then log(1 + words) of a lower-cased text."""
    counts = [F.expr(f"transform({_counts(text, groups)}, x -> cast(x as double))") for groups in lexicons]
    return F.concat(*counts, F.array(F.log1p(F.expr(f"size(filter(split({text}, ' '), w -> w <> ''))").cast("double"))))


def _counts(text: str, groups: dict[str, list[str]]) -> str:
    count = lambda p: f"(size(split(concat('\\u0001', {text}), {T.sql_text('(?=' + chr(92) + 'Q' + p.lower() + chr(92) + 'E)')}, -1)) - 1)"
    return "array(" + ", ".join(" + ".join(count(p) for p in phrases) for phrases in groups.values()) + ")"
