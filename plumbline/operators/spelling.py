"""Fuzzy spelling: tokens near a word of a vocabulary, by the share of characters in matching blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored


@dataclass(frozen=True)
class SpellingParams:
    #: Least ratio of a correction: 2 * matching characters / characters of both.
    cutoff: float = 0.82
    #: Tokens of fewer characters stay as they are.
    least_length: int = 5
    #: Distinct tokens, and words of the vocabulary, that a task compares.
    token_block: int = 20_000
    word_block: int = 5_000


#: Letters are counted in so many classes; letters that share one only weaken the bound.
CLASSES = 64


def bare(token: Column) -> Column:
    """A token without the marks around it, lower-cased."""
    return F.lower(F.regexp_replace(token, r"^[.,;:()]+|[.,;:()]+$", ""))


def token_uses(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, uses): the distinct bare tokens of a text column."""
    words = texts.select(F.explode(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")).alias("token"))
    return words.select(bare(F.col("token")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("uses"))


def common_words(texts: DataFrame, key: str, text: str, share: float, least_length: int = 5) -> DataFrame:
    """(word): tokens of letters that at least this share of the texts hold."""
    held = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"(?U)\s+"))).alias("word")).where(F.rlike("word", F.lit(r"^\p{L}+$")) & (F.length("word") >= least_length))
    least = texts.agg(F.ceil(F.count("*") * share).alias("least"))
    return held.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(least), F.col("n") >= F.col("least")).select("word")


def block_ratio(a: str, b: str) -> float:
    """2 * M / T: M characters in the longest common block, and likewise on both sides of it; of equal blocks the first in a, then in b."""
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, at_a, at_b = 0, a0, b0
        row = [0] * (b1 - b0 + 1)
        for i in range(a0, a1):
            before, c = 0, a[i]
            for j in range(b1 - b0):
                here = row[j + 1]
                row[j + 1] = n = before + 1 if b[b0 + j] == c else 0
                if n > best:
                    best, at_a, at_b = n, i - n + 1, b0 + j - n + 1
                before = here
        if best:
            matched += best
            if a0 < at_a and b0 < at_b:
                todo.append((a0, at_a, b0, at_b))
            if at_a + best < a1 and at_b + best < b1:
                todo.append((at_a + best, a1, at_b + best, b1))
    total = len(a) + len(b)
    return 2 * matched / total if total else 1.0


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each class of letters occurs, a row for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.minimum(np.bincount(row * CLASSES + points % CLASSES, minlength=len(words) * CLASSES), 255).astype(np.uint8).reshape(-1, CLASSES)


def nearest_words(tokens: list[str], words: list[str], cutoff: float) -> tuple[list[tuple[int, int, float]], int]:
    """(token, word, ratio) of each token's best word of at least the cutoff, the last by name among equals; and how many pairs were compared.

    Blocks match no more letters than both have, and no more than the shorter
    has: only pairs whose lengths and letters allow the cutoff are compared.
    """
    order = sorted(range(len(words)), key=lambda k: (len(words[k]), words[k]))
    lengths = np.array([len(words[k]) for k in order])
    counts = letter_counts([words[k] for k in order])
    own = letter_counts(tokens)
    out, compared = [], 0
    for n in sorted({len(t) for t in tokens}):
        same = [k for k, t in enumerate(tokens) if len(t) == n]
        fits = 2 * np.minimum(lengths, n) >= cutoff * (lengths + n) - 1e-9
        low, high = (int(np.argmax(fits)), len(fits) - int(np.argmax(fits[::-1]))) if fits.any() else (0, 0)
        if low == high:
            continue
        step = max(1, (1 << 24) // ((high - low) * CLASSES))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            shared = np.minimum(own[some][:, None, :], counts[None, low:high]).sum(2, dtype=np.int64)
            ok = 2 * shared >= cutoff * (lengths[low:high] + n) - 1e-9
            for row, k in enumerate(some):
                best = None
                for j in np.flatnonzero(ok[row]).tolist():
                    word = words[order[low + j]]
                    compared += 1
                    ratio = 1.0 if word == tokens[k] else block_ratio(word, tokens[k])
                    if ratio >= cutoff and (best is None or (ratio, word) > best[:2]):
                        best = ratio, word, order[low + j]
                if best:
                    out.append((k, best[2], best[0]))
    return out, compared


def corrections(tokens: DataFrame, vocabulary: DataFrame, protected: DataFrame | None = None, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(token, correction, ratio) for the distinct tokens (column token) that are near a word (column word) but none themselves.

    Short tokens, tokens with a hyphen, and those of `protected` (column word)
    stay as they are; nulls and repeats count as nothing and once. Tokens and
    words are dealt to blocks of bounded size, and each pair of blocks is one
    task's work; the best of all blocks stays. An empty vocabulary corrects nothing.
    """
    words = vocabulary.where("word IS NOT NULL AND word <> ''").select(F.lower("word").alias("word")).distinct()
    asked = tokens.where(F.col("token").isNotNull() & (F.length("token") >= params.least_length) & ~F.contains("token", F.lit("-"))).select("token").distinct()
    if protected is not None:
        asked = asked.join(protected.select(F.lower("word").alias("token")).distinct(), "token", "left_anti")
    with Scratch(tokens.sparkSession) as t:
        words = t.stored(words, "words")
        size = words.agg(F.count("*").alias("n"), F.max(F.length("word")).alias("longest")).first()
        # no word is near a token of more than so many times its length
        asked = t.stored(asked.where(F.length("token") <= F.lit(int((size.longest or 0) * (2 - params.cutoff) / params.cutoff) + 1)), "tokens")
        blocks, parts = -(-size.n // params.word_block) or 1, -(-asked.count() // params.token_block) or 1
        return stored(compared_blocks(asked, words, blocks, parts, params), "corrections")


def compared_blocks(asked: DataFrame, words: DataFrame, blocks: int, parts: int, params: SpellingParams) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("token", part("token", parts).alias("part"), every(blocks).alias("block"))
    right = words.select("word", part("word", blocks).alias("block"), every(parts).alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own, vocabulary = (t.column(c).to_pylist() for t, c in ((left, "token"), (right, "word")))
        found = nearest_words(own, vocabulary, params.cutoff)[0] if own and vocabulary else []
        return pa.table({"token": pa.array([own[k] for k, _, _ in found], pa.string()), "word": pa.array([vocabulary[j] for _, j, _ in found], pa.string()), "ratio": pa.array([r for _, _, r in found], pa.float64())})

    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(compare, "token string, word string, ratio double")
    best = near.groupBy("token").agg(F.max(F.struct("ratio", "word")).alias("x"))
    return best.where("x.word <> token").select("token", F.col("x.word").alias("correction"), F.col("x.ratio").alias("ratio"))


def respelled(texts: DataFrame, fixes: DataFrame, text: str = "text") -> DataFrame:
    """texts with the corrected tokens (columns token, correction) in place, and n_fixed; a corrected token loses the marks around it.

    Blanks become single spaces. Only the changed places of a text are gathered,
    by two hashes of the text, so no text is shuffled but those that change meet their
    changes; texts that repeat are treated alike. A null text stays null, with n_fixed 0.
    """
    tokens = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
    keys = {"h1__": F.xxhash64(text), "h2__": F.xxhash64(F.lit(1), text)}
    places = texts.select(*(v.alias(k) for k, v in keys.items()), F.posexplode(tokens).alias("place", "word")).withColumn("token", bare(F.col("word")))
    changed = places.join(fixes.select("token", "correction"), "token").groupBy("h1__", "h2__", "place").agg(F.min("correction").alias("correction"))
    changed = changed.groupBy("h1__", "h2__").agg(F.map_from_entries(F.collect_list(F.struct("place", "correction"))).alias("fixes__"))
    met = texts.withColumns(keys).join(changed, ["h1__", "h2__"], "left").withColumn("tokens__", tokens)
    said = F.array_join(F.transform("tokens__", lambda t, k: F.coalesce(F.element_at("fixes__", k), t)), " ")
    return met.withColumns({text: F.when(F.col("fixes__").isNull(), F.array_join("tokens__", " ")).otherwise(said), "n_fixed": F.coalesce(F.size("fixes__"), F.lit(0)).cast("long")}).withColumn("n_fixed", F.greatest("n_fixed", F.lit(0).cast("long"))).select(*texts.columns, "n_fixed")
