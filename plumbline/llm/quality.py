"""Quality rules by distribution divergence (operator 9).

A document's character classes and common words are compared, by Jensen-Shannon
distance, with those of its language. References are counted over all documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other letter", "digit", "blank", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A common word has at most so many characters; so many of a language's most frequent are compared.
    word_length: int = 5
    top_words: int = 48
    #: Languages whose references are broadcast, the ones with most documents. Documents of others meet theirs by a join.
    broadcast_languages: int = 64
    #: Greatest distances (0 to 1); a short text may lie further away by slack / sqrt(words).
    max_class_distance: float = 0.17
    max_word_distance: float = 0.29
    slack: float = 1.2


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; a fixed rule on Unicode categories."""
    out = np.full(65536, 7, np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        if chr(c) in BLANKS or kind[0] == "Z":
            out[c] = 4
        elif chr(c) in SYMBOLS or kind[0] == "S":
            out[c] = 6
        elif kind == "Ll":
            out[c] = 0
        elif kind in ("Lu", "Lt"):
            out[c] = 1
        elif kind[0] in "LM":
            out[c] = 2
        elif kind[0] == "N":
            out[c] = 3
        elif kind[0] == "P":
            out[c] = 5
    return out


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than space, tab, LF, VT, FF, CR."""
    return text.encode("utf-8", "replace").split()


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.bincount(class_table()[np.minimum(points, 65535)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:  # three word numbers no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    hit = np.zeros(len(window), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            duplicates += line in seen
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    return chars, sum(text.count(c) for c in SYMBOLS), duplicates, repeated_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


class ShortWords(dict):
    """Raw word to its lower-cased form without surrounding punctuation, "" where that is no common word.

    A cache: emptied when it has grown large, so its memory is bounded.
    """

    def __init__(self, longest: int):
        self.longest = longest

    def __missing__(self, word: bytes) -> str:
        x = word.decode("utf-8", "replace").strip(".,;:!?\"'()").lower()
        x = x if 0 < len(x) <= self.longest and x.isalpha() else ""
        if len(self) > 200_000:
            self.clear()
        self[word] = x
        return x

    def counts(self, words: list[bytes]) -> Counter:
        out: Counter = Counter()
        plain = 2 * self.longest + 4
        wide = 4 * self.longest + 4  # a character takes up to four bytes
        for w, n in Counter(words).items():
            if len(w) <= wide and (len(w) <= plain or not w.isascii()) and (x := self[w]):
                out[x] += n
        return out


#: A reference: class histogram, common words in order, histogram of these and of all other words.
REFERENCE = "lang string, docs long, classes array<double>, words array<string>, hist array<double>"


def references(docs: DataFrame, params: QualityParams) -> DataFrame:
    """One row of REFERENCE for every language, counted over every document that has it; a stored table.

    A row holds classes + 2 * top_words + 1 values, whatever the corpus.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        short = ShortWords(params.word_length)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text or "")
                for k, n in enumerate(class_counts(text or "").tolist()):
                    total[lang, f"c{k}"] += n
                total[lang, "n"] += len(words)
                total[lang, "d"] += 1
                for w, k in short.counts(words).items():
                    total[lang, "w" + w] += k
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "item", "n"])

    arrow_rows(docs.sparkSession)
    counted = docs.where("lang is not null").select("lang", "text").mapInArrow(partial, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    is_word = F.col("item").startswith("w")
    rank = F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.col("n").desc(), "item"))
    kept = counted.withColumn("rank", F.when(is_word, rank)).where(~is_word | (F.col("rank") <= params.top_words))
    one = lambda item: F.coalesce(F.max(F.when(F.col("item") == item, F.col("n"))), F.lit(0))
    common = F.array_sort(F.collect_list(F.when(is_word, F.struct("rank", F.substring("item", 2, 1 << 20).alias("word"), "n"))))
    rows = kept.groupBy("lang").agg(one("d").alias("docs"), one("n").alias("total"), F.array(*(one(f"c{k}").cast("double") for k in range(len(CLASSES)))).alias("classes"), common.alias("common"))
    hist = F.concat(F.transform("common", lambda x: x["n"].cast("double")), F.array(F.greatest(F.col("total") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0)).cast("double")))
    return stored(rows.select("lang", "docs", "classes", F.transform("common", lambda x: x["word"]).alias("words"), hist.alias("hist")), "references")


Reference = tuple[np.ndarray, dict[str, int], np.ndarray]


def as_reference(row) -> Reference:
    return np.array(row["classes"], float), {w: k for k, w in enumerate(row["words"])}, np.array(row["hist"], float)


def distances(text: str, words: list[bytes], refs: list[Reference], short: ShortWords) -> tuple[float, float]:
    """Class and word distance to the nearest of the references; zeros where there is none."""
    if not refs:
        return 0.0, 0.0
    classes, common = class_counts(text), short.counts(words)
    best = None
    for ref_classes, places, ref_words in refs:
        hist = np.zeros(len(places) + 1)
        for w, n in common.items():
            if (k := places.get(w)) is not None:
                hist[k] = n
        hist[-1] = len(words) - hist.sum()
        d = js_distance(classes, ref_classes), js_distance(hist, ref_words)
        if best is None or sum(d) < sum(best):
            best = d
    return best


def judged(docs: DataFrame, params: QualityParams | None, schema, emit) -> DataFrame:
    """docs through emit(batch, verdicts), whose verdicts are made against the reference of each document's language.

    The references of the commonest languages are broadcast. Only documents of
    other languages, so few for each of them, are shuffled to meet theirs.
    """
    params = params or QualityParams()
    spark = docs.sparkSession
    arrow_rows(spark)
    table = references(docs, params)
    top = table.orderBy(F.col("docs").desc(), "lang").limit(params.broadcast_languages).collect()
    refs = spark.sparkContext.broadcast({r["lang"]: as_reference(r) for r in top})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = ShortWords(params.word_length)
        known = refs.value
        everyone = list(known.values())
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            yield emit(batch, [verdict([known[x]] if x in known else everyone, t or "", short, params) for x, t in zip(langs, texts, strict=True)])

    def judge_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = ShortWords(params.word_length)
        for batch in batches:
            own = [as_reference(r) for r in batch.column("reference__").to_pylist()]
            rest = batch.drop_columns(["reference__"])
            yield emit(rest, [verdict([r], t or "", short, params) for r, t in zip(own, rest.column("text").to_pylist(), strict=True)])

    if len(top) < params.broadcast_languages or table.count() == len(top):
        return docs.mapInArrow(judge, schema)
    common = F.coalesce(F.col("lang").isin([r["lang"] for r in top]), F.lit(True))
    others = docs.where(~common).join(table.select("lang", F.struct("classes", "words", "hist").alias("reference__")), "lang").select(*docs.columns, "reference__")
    return docs.where(common).mapInArrow(judge, schema).unionByName(others.mapInArrow(judge_others, schema))


def quality_rules(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """Counts, distances and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed and kept.
    A null text counts as an empty one (no words, base_failed); a null lang is
    held against the nearest of the commonest languages; rows with equal ids are
    judged one by one; an empty table gives no rows.
    """

    def emit(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=list(NAMES))

    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), params, SCHEMA, emit)


def verdict(refs: list[Reference], text: str, short: ShortWords, params: QualityParams) -> tuple:
    """n_words and all columns after it, for one document."""
    words = words_of(text)
    n = len(words)
    chars, symbols, dup, repeat = base_counts(text, words)
    failed = n < params.min_words or 100 * repeat > params.max_repeat_percent * n
    d_class, d_word = distances(text, words, refs, short)
    slack = params.slack / np.sqrt(max(n, 1))
    fits = d_class <= params.max_class_distance + slack / 2 and d_word <= params.max_word_distance + slack
    return n, chars, symbols, dup, repeat, d_class, d_word, failed, not failed and bool(fits)


def keep_good(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns, whatever their names.

    Null and empty texts go (they have no words); rows that repeat an id are
    judged one by one; an empty table stays empty.
    """
    return judged(docs, params, docs.schema, lambda batch, rows: batch.filter(pa.array([r[-1] for r in rows], pa.bool_())))


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"
