"""Phrase and token functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folds(phrase: str) -> str:
    """SQL true if a phrase can overlap itself: it ends as it begins."""
    return str(any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))).lower()


def lexicon(groups: dict[str, list[str]]) -> str:
    """SQL of an array of (category, place of the category, phrase, whether it can overlap itself), lower-cased, in order."""
    rows = (f"named_struct('category', {sql_text(c)}, 'place', {k}, 'phrase', {sql_text(p.lower())}, 'folds', {folds(p.lower())})" for k, (c, phrases) in enumerate(groups.items()) for p in phrases)
    return "array(" + ", ".join(rows) + ")"


#: Values that one fold adds up; longer arrays are cut into such chunks, so that running sums cost no square.
CHUNK = 24


def running_sums(values: str) -> str:
    """SQL of the running sums of an array of ints."""
    none = "named_struct('s', 0, 'a', cast(array() as array<int>))"
    fold = "aggregate({}, " + none + ", (acc, x) -> named_struct('s', acc.s + {}, 'a', concat(acc.a, array(acc.s + {}))))"
    chunks = f"transform(sequence(0, cast(greatest(size(values) - 1, 0) div {CHUNK} as int)), k -> slice(values, k * {CHUNK} + 1, {CHUNK}))"
    sums = f"transform({chunks}, part -> {fold.format('part', 'x', 'x')})"
    # each chunk begins with what all chunks before it add up to
    starts = fold.format("sums", "x.s", "x.s")
    return f"transform(array({values}), values -> transform(array({sums}), sums -> transform(array({starts}.a), ends -> flatten(transform(sums, (p, k) -> transform(p.a, x -> x + ends[k] - p.s))))[0])[0])[0]"


def offsets(text: str, regex: str) -> str:
    """SQL of the places, from 0, at which a lookahead regex matches: overlapping matches count.

    The text is cut before each match, behind a marker character that keeps a
    match at its beginning; the lengths of the pieces give the places.
    """
    pieces = f"split(concat('\\u0001', {text}), {regex}, -1)"
    lengths = f"transform(array({pieces}), p -> transform(slice(p, 1, size(p) - 1), x -> length(x)))[0]"
    return f"transform({running_sums(lengths)}, n -> n - 1)"


def cuts(text: str, regex: str, size: str) -> str:
    """SQL of the places, from 0, of the matches of a regex that are all `size` long and do not overlap: the text is cut at them."""
    lengths = f"transform(array(split({text}, {regex}, -1)), p -> transform(slice(p, 1, size(p) - 1), x -> length(x)))[0]"
    return f"transform({running_sums(lengths)}, (n, i) -> n + i * {size})"


def phrase_spans(text: str, groups: dict[str, list[str]], whole_words: bool = False) -> Column:
    """All occurrences of a lexicon's phrases in a lower-cased text column: array of (category, place, phrase, start, end).

    Phrases are found anywhere, also inside words and over each other, or as
    whole words (in the Unicode sense). Spans come in the lexicon's order, then by place.
    """
    edge = "\\\\b" if whole_words else ""
    ahead = f"concat('(?U)(?={edge}\\\\Q', p.phrase, '\\\\E{edge})')"
    plain = f"concat('{'(?U)' if whole_words else ''}{edge}\\\\Q', p.phrase, '\\\\E{edge}')"
    places = f"IF(p.folds, {offsets(text, ahead)}, {cuts(text, plain, 'length(p.phrase)')})"
    hits = f"filter({lexicon(groups)}, p -> contains({text}, p.phrase))"
    span = "named_struct('category', p.category, 'place', p.place, 'phrase', p.phrase, 'start', o, 'end', o + length(p.phrase))"
    return F.expr(f"flatten(transform({hits}, p -> transform({places}, o -> {span})))")


def best_category(spans: str, groups: dict[str, list[str]]) -> Column:
    """The category with most spans, then the earliest, then the first declared; null without spans."""
    cats = "array(" + ", ".join(sql_text(c) for c in groups) + ")"
    score = f"transform(filter({cats}, c -> exists({spans}, s -> s.category = c)), c -> named_struct('n', size(filter({spans}, s -> s.category = c)), 'early', -array_min(transform(filter({spans}, s -> s.category = c), s -> s.start)), 'place', -array_position({cats}, c), 'c', c))"
    return F.expr(f"array_max({score}).c")


def category_counts(spans: str, groups: dict[str, list[str]]) -> Column:
    """Spans of each category, in the lexicon's order."""
    return F.array(*(F.expr(f"size(filter({spans}, s -> s.category = {sql_text(c)}))") for c in groups))


def tokens(text: str) -> str:
    """SQL of the tokens of a lower-cased text: runs of letters a-z, digits and apostrophes."""
    return f"regexp_extract_all({text}, \"[a-zA-Z0-9']+\", 0)"


#: Characters before a place that are looked at first.
TAIL = 128


def negated(text: str, start: str, window: int, single: list[str], pairs: list[str]) -> str:
    """SQL: whether one of the tokens just before a place negates it, alone or with its neighbour."""
    # mostly the last characters hold the tokens; a first token that is cut off does not count among so many
    tail = tokens(f"substring({text}, greatest({start} - {TAIL - 1}, 1), least({start}, {TAIL}))")
    whole = tokens(f"substring({text}, 1, {start})")
    before = f"slice(reverse(transform(array({tail}), q -> IF({start} <= {TAIL} OR size(q) > {window}, q, {whole}))[0]), 1, {window})"
    one = "array(" + ", ".join(map(sql_text, single)) + ")"
    two = "array(" + ", ".join(map(sql_text, pairs)) + ")"
    couples = "transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(w[i + 1], ' ', x))"
    return f"transform(array({before}), w -> arrays_overlap(w, {one}) OR arrays_overlap({couples}, {two}))[0]"


def nested_pruned(spans: str) -> Column:
    """Spans sorted by start and falling length, without those inside a kept one of the same category."""
    order = f"array_sort({spans}, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END)"
    return F.expr(f"aggregate({order}, slice({spans}, 1, 0), (kept, x) -> IF(exists(kept, k -> k.category = x.category AND k.start <= x.start AND k.end >= x.end), kept, concat(kept, array(x))))")


def tiled(spans: str, length: str) -> Column:
    """Non-overlapping spans, earliest and longest first, with the gaps between them: array of (start, end, category) that cover the text."""
    order = f"array_sort({spans}, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END)"
    piece = "named_struct('start', {}, 'end', {}, 'category', {})"
    gap = f"IF(x.start > acc.at, array({piece.format('acc.at', 'x.start', 'cast(null as string)')}), array())"
    step = f"IF(x.start >= acc.at, named_struct('at', x.end, 'out', concat(acc.out, {gap}, array({piece.format('x.start', 'x.end', 'x.category')}))), acc)"
    done = f"IF(acc.at < {length}, concat(acc.out, array({piece.format('acc.at', length, 'cast(null as string)')})), acc.out)"
    return F.expr(f"aggregate({order}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,category:string>>)), (acc, x) -> {step}, acc -> {done})")


def replaced(text: Column, entries: dict[str, str], ignore_case: bool) -> Column:
    """Whole-word replacement, longest entry first, one after another."""
    for key, value in sorted(entries.items(), key=lambda kv: -len(kv[0])):
        text = F.regexp_replace(text, ("(?iU)" if ignore_case else "(?U)") + rf"\b\Q{key}\E\b", value)
    return text


def tidied(text: Column) -> Column:
    """Reference remarks in brackets and tag numbers go, no blank before full stops and commas, single blanks."""
    text = F.regexp_replace(text, r"(?i)\(.*?ref.*?\)", "")
    text = F.regexp_replace(text, r"#\d+", "")
    text = F.regexp_replace(text, r"(?U)\s+([.,])", "$1")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def typo_fixed(text: Column, typos: dict[str, str], protected: list[str]) -> Column:
    """Known misspellings replaced token by token; a replaced token loses its punctuation, others stay as they are."""
    fixes = F.create_map(*(F.lit(x) for kv in typos.items() for x in kv))
    keep = F.array(*map(F.lit, protected))
    bare = lambda t: F.lower(F.regexp_replace(t, r"^[.,;:()]+|[.,;:()]+$", ""))
    fixed = lambda t: F.when(F.array_contains(keep, bare(t)), t).otherwise(F.coalesce(F.element_at(fixes, bare(t)), t))
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), fixed), " ")
