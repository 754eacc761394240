"""Spelling, embedding, tagging and span scores against plain versions."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import embedding, evaluation, spelling, tagging
from plumbline.plans import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").persist()


def closest(token, words):
    if len(token) < 5 or "-" in token:
        return None
    found = difflib.get_close_matches(token, words, n=1, cutoff=0.82)
    return found[0] if found and found[0] != token else None


def test_corrections_of_every_distinct_token(spark, documents):
    words = sorted(r.word for r in spelling.common_words(documents, "doc_id", "text", corpus.COMMON).collect())
    tokens = {r.token: r.uses for r in spelling.token_uses(documents).collect()}
    want = {(t, c, difflib.SequenceMatcher(None, c, t).ratio(), n) for t, n in tokens.items() if (c := closest(t, words))}
    got = {(r.token, r.correction, r.ratio, r.uses) for r in corpus.token_spelling(spark, SF).collect()}
    assert len(want) > 500 and got == want
    texts = {r.doc_id: r.text for r in documents.collect()}
    said = corpus.doc_spelling(spark, SF).collect()
    assert len(said) == len(texts)
    for r in said[::7]:
        own = texts[r.doc_id].split()
        fixed = [closest(w.strip(".,;:()").lower(), words) for w in own]
        assert r.text.split() == [c or w for c, w in zip(fixed, own, strict=True)] and r.n_fixed == sum(map(bool, fixed))


def test_bounds_spare_most_pairs(documents):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 12))) for _ in range(300)]
    tokens = [w[:2] + rng.choice("abcxyz") + w[3:] for w in words[:100]] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(8)) for _ in range(200)]
    found, compared = spelling.nearest_words(tokens, words, 0.82)
    assert {tokens[k]: words[j] for k, j, _ in found} == {t: m[0] for t in tokens if (m := difflib.get_close_matches(t, words, 1, 0.82))}
    assert compared < 0.02 * len(tokens) * len(words)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in "ab")
        assert spelling.block_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_corrections_of_odd_tokens(spark):
    tokens = spark.createDataFrame([(t,) for t in ["verifed", "verifed", "re-verified", "safty", "cat", "protectid", None, "", "x" * 5000, "isolation"]], "token string")
    words = spark.createDataFrame([("verified",), ("Safety",), ("protected",), ("isolation",), (None,), ("",)], "word string")
    blocks = spelling.SpellingParams(token_block=2, word_block=2)
    for params in (spelling.SpellingParams(), blocks):
        got = {r.token: r.correction for r in spelling.corrections(tokens, words, spark.createDataFrame([("protectid",)], "word string"), params).collect()}
        assert got == {"verifed": "verified", "safty": "safety"}
    assert spelling.corrections(tokens, words.where("false")).count() == spelling.corrections(tokens.where("false"), words).count() == 0
    texts = spark.createDataFrame([(1, "not verifed,  (safty)! re-verified", "clash"), (1, "not verifed,  (safty)! re-verified", "clash"), (2, None, ""), (3, "", "")], "id int, text string, correction string")
    fixes = spark.createDataFrame([("verifed", "verified"), ("safty", "safety")], "token string, correction string")
    assert sorted(map(str, ((r.id, r.text, r.n_fixed) for r in spelling.respelled(texts, fixes).collect()))) == sorted(map(str, [(1, "not verified (safty)! re-verified", 1)] * 2 + [(2, None, 0), (3, "", 0)]))


def test_embedding_against_numpy(spark, documents):
    params = embedding.EmbeddingParams(dimensions=32, spare=48)
    rows = embedding.counted(documents, "text", params).drop("text").persist()
    model = embedding.fitted(rows, params)
    own = rows.orderBy("doc_id").collect()
    a = np.zeros((len(own), params.buckets))
    for k, r in enumerate(own):
        a[k, r.at] = np.array(r.times) * model.idf[r.at]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    right *= np.sign(right[np.arange(len(right)), np.abs(right).argmax(1)])[:, None]
    assert len(model.values) == 32 and np.allclose(model.values, values[:32], rtol=0.01)
    assert np.allclose(model.loadings[:, :8], right[:8].T, atol=1e-2)
    want = a @ right[:32].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = np.array([r.embedding for r in embedding.projected(rows, model, params).orderBy("doc_id").collect()])
    assert np.abs((got * want).sum(1) - 1).max() < 0.02
    # words stand apart, between blanks: the n-grams of scikit-style word-bounded analysis
    def plain(text):
        return sum(max(len(w) + 2 - n + 1, 0) for w in text.split() for n in (3, 4, 5))
    for t in ("Hello hello wo a", "", " \n ", "é中😀 x", "one"):
        assert embedding.gram_counts(t, params)[1].sum() == plain(t)
    small = embedding.EmbeddingParams(most_chars=7)
    assert all((x == y).all() for x, y in zip(embedding.gram_counts("some words and others " * 5, small), embedding.gram_counts("some words and others " * 5, params), strict=True))


def test_embedding_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta", 5), (1, "alpha beta", 5), (2, None, 1), (3, "", 2), (None, "gamma delta words", 3), (4, "beta gamma", 4)], "k long, text string, at int")
    got = embedding.embedded(df, "k", params=embedding.EmbeddingParams(buckets=512)).collect()
    by = {r.k: np.array(r.embedding) for r in got}
    assert len(got) == 6 and len(by[1]) == 3 and not by[2].any() and not by[3].any() and abs(np.linalg.norm(by[None]) - 1) < 1e-5
    assert embedding.embedded(df.where("false"), "k").count() == 0 and [r.embedding for r in embedding.embedded(df.where("k = 4"), "k").collect()] == [[]]


def test_tags_round_trip(spark, documents):
    tokens = tagging.text_tokens(documents, "doc_id").persist()
    texts = {r.doc_id: r.text for r in documents.collect()}
    import regex

    pattern = regex.compile(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")
    rows = tokens.collect()
    for doc in list(texts)[::9]:
        assert sorted((r.start, r.end) for r in rows if r.doc_id == doc) == [m.span() for m in pattern.finditer(texts[doc])]
    # spans of one to four tokens that do not touch each other
    spans = tokens.where("place % 7 = 0").select("doc_id", F.col("place").alias("first"), "start", (F.col("place") + F.col("doc_id") % 4).alias("last"))
    ends = tokens.select("doc_id", F.col("place").alias("last"), F.col("end"))
    spans = spans.join(ends, ["doc_id", "last"]).select("doc_id", F.lit(0).alias("rank"), F.when(F.col("first") % 2 == 0, "A").otherwise("B").alias("label"), "start", "end")
    back = tagging.tags_to_spans(tagging.spans_to_tags(tokens, spans, "doc_id"), "doc_id")
    want = {tuple(r) for r in spans.select("doc_id", "label", "start", "end").collect()}
    assert len(want) > 1000 and {tuple(r) for r in back.collect()} == want


def test_tags_of_overlapping_spans(spark):
    tokens = spark.createDataFrame([(1, k, 10 * k, 10 * k + 8) for k in range(30)], "d int, place int, start int, end int")
    spans = spark.createDataFrame([(1, 0, "X", 5, 25), (1, 1, "Y", 20, 38), (1, 2, "Z", 50, 51), (1, 3, "W", 90, 290), (1, 4, "V", 100, 100), (2, 0, "X", 0, 9)], "d int, rank int, label string, start int, end int")
    got = [r.tag for r in tagging.spans_to_tags(tokens, spans, "d").orderBy("place").collect()]
    assert got == ["B-X", "I-X", "I-X", "I-Y", "O", "B-Z", "O", "O", "O", "B-W"] + ["I-W"] * 19 + ["O"]
    tagged = spark.createDataFrame([(1, k, k, k + 1, t) for k, t in enumerate(["I-A", "I-A", "I-B", "O", "B-B", "B-B", "I-B", "I-A"])] + [(1, 8, 8, 8, "B-A")], "d int, place int, start int, end int, tag string")
    assert sorted(tuple(r)[1:] for r in tagging.tags_to_spans(tagged, "d").collect()) == [("A", 0, 2), ("A", 7, 8), ("B", 2, 3), ("B", 4, 5), ("B", 5, 7)]


def greedy(gold, found):
    """Each gold span in order takes the first free span that overlaps it."""
    used, tp = set(), 0
    for g in sorted(gold):
        for k, p in enumerate(sorted(found)):
            if k not in used and p[0] < g[1] and p[1] > g[0] and p[0] < p[1] and g[0] < g[1]:
                used.add(k)
                tp += 1
                break
    return tp


def test_partial_span_scores_against_plain_matching(spark):
    rng = random.Random(4)
    gold, found = ([(d, lab, s, s + rng.randrange(0, 9)) for d in range(40) for lab in ("A", None, "C") for s in (rng.randrange(60) for _ in range(rng.randrange(12)))] for _ in range(2))
    gold += [("hot", "A", k, k + 3) for k in range(0, 6000, 2)]
    found += [("hot", "A", k + 1, k + 2) for k in range(0, 6000, 3)]
    as_df = lambda rows: spark.createDataFrame([(str(d), lab, s, e, "clash") for d, lab, s, e in rows], "doc string, label string, start int, end int, kind string").repartition(5)
    want = {lab: [0, 0, 0] for lab in ("A", None, "C")}
    for lab in want:
        own = [[(d, (s, e)) for d, x, s, e in rows if x == lab] for rows in (gold, found)]
        for d in {d for rows in own for d, _ in rows}:
            want[lab][0] += greedy(*([x for y, x in rows if y == d] for rows in own))
        want[lab][1:] = map(len, own)
    got = {r.label: [r.tp, r.gold, r.told] for r in evaluation.span_scores_partial(as_df(gold), as_df(found)).collect()}
    assert got == want
    assert evaluation.span_scores_partial(as_df(gold).where("false"), as_df(found).where("false")).count() == 0
