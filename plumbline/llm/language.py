"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, gathered

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 14
    smoothing: float = 0.5
    #: Characters that are counted together; about 100 bytes of memory each.
    most_chars: int = 1 << 20
    #: Greatest size of the broadcast matrix (languages * buckets * 4 bytes).
    most_matrix_bytes: int = 256 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[str], params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of several lower-case texts, and the text that each belongs to.

    Every character that is no letter is a blank, and
    blanks in a row are one, so figures and punctuation say nothing.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    ends = points == 0
    owner = np.cumsum(ends) - ends
    letter = is_letter()[points]
    code = np.where(letter, points, 32).astype(np.uint32)
    code[ends] = 0
    keep = letter | ends
    keep[1:] |= letter[:-1]
    code, owner = code[keep], owner[keep]
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(params.orders) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        h = (h[:size] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
        if n in params.orders:
            own = owner[:size]
            same = (own == owner[n - 1 :]) & (code[n - 1 :] != 0) & (code[:size] != (32 if n == 1 else 0))
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append(((mixed ^ (mixed >> np.uint32(12))) % np.uint32(params.buckets))[same])
            owners.append(own[same])
    return np.concatenate(buckets or [np.zeros(0, np.uint32)]).astype(np.int64), np.concatenate(owners or [np.zeros(0, np.int64)])


def before(text: str, at: int, n: int) -> str:
    """The last n characters or some more before a letter's place, from a letter on, with blanks in a row as one, as grams() sees them."""
    out = ""
    while at > 0 and (len(out) < n or out[:1] == " "):
        at -= 1
        if text[at].isalpha():
            out = text[at] + out
        elif out[:1] != " ":
            out = " " + out
    return out.lstrip(" ")


def counted(texts: list[str], params: LanguageParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of the texts, some at a time: bucket, text, and 1 or -1.

    A long text is cut before letters. A part has the characters before it in
    front, and what these hold by themselves counts -1.
    """
    reach = max(params.orders) - 1
    parts: list[tuple[int, int, str]] = []
    size = 0

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, part = grams([p for _, _, p in parts], params)
        return bucket, np.array([k for k, _, _ in parts], np.int64)[part], np.array([s for _, s, _ in parts], np.int64)[part]

    for k, text in enumerate(texts):
        low = text.replace("\0", " ").lower()
        at = 0
        while at < len(low):
            end = at + params.most_chars
            while end < len(low) and not low[end].isalpha():
                end += 1
            front = before(low, at, reach) if at else ""
            parts += [(k, 1, front + low[at:end]), *([(k, -1, front)] if front else [])]
            size += min(end, len(low)) - at
            at = end
            if size >= params.most_chars:
                yield settle()
                parts, size = [], 0
    if parts:
        yield settle()


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def train(docs: DataFrame, params: LanguageParams | None = None) -> tuple[list[str], np.ndarray]:
    """Learned languages, in order, and the (buckets, languages) matrix of log probabilities; one more row holds the priors.

    Every row of docs with a text and a lang is counted. Tasks send one count
    for each bucket and language that they saw, and Spark adds them.
    """
    params = params or LanguageParams()
    arrow_rows(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in gathered(batches, params.most_chars):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = total.setdefault(lang, np.zeros(params.buckets + 1, np.int64))
                for bucket, _, sign in counted(texts, params):
                    own[:-1] += np.bincount(bucket[sign > 0], minlength=params.buckets) - np.bincount(bucket[sign < 0], minlength=params.buckets)
                own[-1] += len(texts)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").take(params.most_matrix_bytes // (4 * params.buckets) + 1)]
    if 4 * len(langs) * params.buckets > params.most_matrix_bytes:
        raise ValueError(f"{len(langs)} or more languages of {params.buckets} buckets pass most_matrix_bytes")
    out = np.zeros((params.buckets + 1, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect():  # at most the matrix
        out[np.array(r["b"], np.int64), place[r["lang"]]] = r["n"]
    seen, prior = out[:-1] + params.smoothing, out[-1:]
    return langs, np.concatenate([np.log(seen / seen.sum(0)), np.log(np.maximum(prior, 1) / max(prior.sum(), 1))]).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], params: LanguageParams | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score for every row.

    score is the posterior probability of the prediction. A null text, or one
    without a letter, is `und` with score 0, and so is every row where no
    language was learned; ties go to the first language by name.
    """
    params = params or LanguageParams()
    spark = docs.sparkSession
    arrow_rows(spark)
    langs = model[0]
    matrix = spark.sparkContext.broadcast(model[1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, params.most_chars):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if langs:
                logs = matrix.value
                sums, seen = np.tile(logs[-1].astype(np.float64), (len(texts), 1)), np.zeros(len(texts))
                for bucket, owner, sign in counted(texts, params):
                    seen += np.bincount(owner, sign, len(texts))
                    for k in range(len(langs)):
                        sums[:, k] += np.bincount(owner, logs[:-1, k][bucket] * sign, len(texts))
                best = sums.argmax(1)
                p = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                known = seen > 0
                scores = np.where(known, p, 0.0)
                names = [langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            own = [batch.column(c).combine_chunks() for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    extra = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c not in ("doc_id", "text")))
    return source.mapInArrow(score, f"doc_id long, {extra}lang_pred string, score double")
