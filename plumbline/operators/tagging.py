"""Spans to token labels and back: B at a span's first token, I inside it, O elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import running_sums, sql_text

#: Characters of a stretch of text; tokens and spans meet where they share one.
STRETCH = 64


#: Tokens of a part of a text, and of a part of that: a token meets the spans of its part only.
PARTS = (2048, 128, 12)


def let(value: str, name: str, body: str) -> str:
    """SQL of body, in which name stands for a value that is made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def tokens_of(text: str = "text", token: str = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]") -> str:
    """SQL of the tokens of a text by a pattern, by default words and single marks: array of (place, start, end)."""
    regex = sql_text(f"(?s){token}")
    # what stands between the tokens and the tokens add up to the text, so their lengths give the places
    ends = running_sums("transform(words, (w, i) -> length(get(gaps, i)) + length(w))")
    each = "transform(words, (w, i) -> named_struct('place', i, 'start', get(ends, i) - length(w), 'end', get(ends, i)))"
    return let(f"regexp_extract_all({text}, {regex}, 0)", "words", let(f"split({text}, {regex}, -1)", "gaps", let(ends, "ends", each)))


def text_tokens(texts: DataFrame, key: str, text: str = "text", token: str = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]") -> DataFrame:
    """(key, place, start, end): the tokens of each text by a pattern, by default words and single marks. Keys are unique."""
    return texts.select(key, F.explode_outer(F.expr(tokens_of(text, token))).alias("t__")).where("t__ IS NOT NULL").select(key, "t__.*")


def tags_of(tokens: str, spans: str, parts: tuple[int, ...] = PARTS) -> str:
    """SQL of the tokens (place, start, end), in order, with `tag`, from the spans (label, start, end) of the same text, in the order of their rank.

    The tags are those of spans_to_tags(). All of it is inside a row, so neither tokens nor spans are shuffled.
    """
    if not parts:
        tag = "IF(own IS NULL, 'O', concat(IF(t.start <= own.start, 'B-', 'I-'), own.label))"
        row = f"named_struct('place', t.place, 'start', t.start, 'end', t.end, 'tag', {tag})"
        return f"transform({tokens}, t -> {let(f'get(filter({spans}, s -> s.start < s.end AND s.start < t.end AND s.end > t.start), 0)', 'own', row)})"
    n, k = parts[0], len(parts)
    own = f"transform(sequence(0, cast(greatest(size({tokens}) - 1, 0) div {n} as int)), k -> slice({tokens}, k * {n} + 1, {n}))"
    near = let(f"get(p{k}, 0).start", "low", let(f"get(p{k}, size(p{k}) - 1).end", "high", f"filter({spans}, s -> s.start < high AND s.end > low)"))
    return f"flatten(transform({own}, p{k} -> {let(near, f'near{k}', tags_of(f'p{k}', f'near{k}', parts[1:]))}))"


def tagged_texts(texts: DataFrame, key: str, spans: Column, text: str = "text", token: str = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]") -> DataFrame:
    """(key, tagged) for every text: its tokens (place, start, end, tag) by its spans, an array of (label, start, end) in the order of their rank."""
    rows = texts.select(key, spans.alias("spans__"), F.expr(tokens_of(text, token)).alias("tokens__"))
    return rows.select(key, F.expr(let("tokens__", "tokens", let("spans__", "spans", tags_of("tokens", "spans")))).alias("tagged"))


def spans_of(tagged: str) -> str:
    """SQL of the spans (label, start, end) that the tagged tokens (place, start, end, tag) of a text give, in order, as tags_to_spans() does."""
    goes_on = "coalesce(get(tagged, i - 1).tag <> 'O' AND substring(get(tagged, i - 1).tag, 3) = substring(t.tag, 3), false)"
    begins = f"t.tag <> 'O' AND (startswith(t.tag, 'B-') OR NOT {goes_on})"
    marked = f"transform(tagged, (t, i) -> named_struct('label', substring(t.tag, 3), 'start', t.start, 'end', t.end, 'first', {begins}, 'other', t.tag = 'O'))"
    ends = "filter(marked, (t, i) -> NOT t.other AND coalesce(get(marked, i + 1).first OR get(marked, i + 1).other, true))"
    pairs = f"zip_with(filter(marked, t -> t.first), {ends}, (a, b) -> named_struct('label', a.label, 'start', a.start, 'end', b.end))"
    return let(f"filter({tagged}, t -> t.start < t.end)", "tagged", let(marked, "marked", pairs))


def best_of(spans: str) -> str:
    """SQL of the span (label, start, end, confidence) of highest confidence of each label of a text, the first of equals."""
    own = "filter(spans, s -> s.label = l)"
    best = f"array_max(transform({own}, s -> named_struct('confidence', s.confidence, 'early', -s.start, 'short', -s.end)))"
    row = "named_struct('label', l, 'start', -b.early, 'end', -b.short, 'confidence', b.confidence)"
    return let(spans, "spans", f"transform(array_distinct(transform(spans, s -> s.label)), l -> {let(best, 'b', row)})")


def spread(df: DataFrame) -> DataFrame:
    """df with a row for each stretch of text that its start and end touch."""
    return df.withColumn("stretch__", F.explode(F.expr(f"sequence(start div {STRETCH}, greatest(start, end - 1) div {STRETCH})")))


def spans_to_tags(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, place, start, end) with `tag`, from spans (key, rank, label, start, end).

    The overlapping span of least rank (then start, label) gives the tag: B if
    the token begins no later than the span, I otherwise. Both sides are dealt by
    text and stretch of text, so a long text's rows do not all meet each other.
    """
    t, s = spread(tokens).alias("t"), spread(spans.where("start < end")).alias("s")
    met = t.join(s, [key, "stretch__"]).where("t.start < s.end AND t.end > s.start")
    first = met.groupBy(key, F.col("t.place").alias("place")).agg(F.min(F.struct(F.col("s.rank").alias("rank"), F.col("s.start").alias("begin"), F.col("s.label").alias("label"))).alias("own__"))
    tagged = tokens.join(first, [key, "place"], "left")
    tag = F.when(F.col("own__").isNull(), "O").otherwise(F.concat(F.when(F.col("start") <= F.col("own__.begin"), "B-").otherwise("I-"), F.col("own__.label")))
    return tagged.select(*tokens.columns, tag.alias("tag"))


def tags_to_spans(tagged: DataFrame, key: str) -> DataFrame:
    """(key, label, start, end) of tagged tokens (key, place, start, end, tag): islands that begin at B, or at I behind another label or O."""
    w = Window.partitionBy(key).orderBy("place")
    rows = tagged.where("start < end").withColumn("label", F.when(F.col("tag") != "O", F.substring("tag", 3, 1 << 20)))
    new = F.col("label").isNotNull() & (F.startswith("tag", F.lit("B-")) | ~F.lag("label").over(w).eqNullSafe(F.col("label")))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(w)).where("label IS NOT NULL")
    return rows.groupBy(key, "island").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end")).select(key, "label", "start", "end")


def best_spans(spans: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    """Of each text and label the span of highest confidence, the first of equals."""
    own = F.struct(F.col(confidence), (-F.col("start")).alias("early"), (-F.col("end")).alias("short"))
    return spans.groupBy(key, "label").agg(F.max_by(F.struct("start", "end", confidence), own).alias("x")).select(key, "label", "x.*")
