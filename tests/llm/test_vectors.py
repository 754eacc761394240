"""Alignment, neighbours and hard negatives against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, negatives, neighbours, queries

SF = "/root/testdata/sf0.001"
PARAMS = alignment.AlignmentParams(queries.TOKENIZER, queries.PIECES)


@pytest.fixture(scope="module")
def brute():
    """Per text: A's and B's ids, linked pairs and groups, by a plain walk along the bytes; None where there are no tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    from plumbline.llm.bpe import vocabulary

    a_model, b_model = Tokenizer.from_file(PARAMS.a), sentencepiece.SentencePieceProcessor(model_file=PARAMS.b)
    a_model.encode_special_tokens = True
    a_bytes = vocabulary(PARAMS.a).bytes_of
    b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b_model.id_to_piece, range(b_model.get_piece_size())))]

    def spans(tokens):
        ends = np.cumsum([len(x) for x in tokens]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def of(text):
        if not text:
            return None
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        x, y = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return None
        x, y = spans(x), spans(y)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(x) for j, (u, v) in enumerate(y) if u < e and s < v]
        ends = [0, *sorted({e for _, e in x} & {e for _, e in y})]
        inside = lambda ids, at, s, e: ",".join(str(i) for i, (u, v) in zip(ids, at, strict=True) if s <= u and v <= e)
        return len(a), len(b), links, [f"{inside(a, x, s, e)}|{inside(b, y, s, e)}" for s, e in zip(ends[:-1], ends[1:], strict=True)]

    return of


def expected_measures(texts, brute):
    found = [brute(t) for t in texts]
    counts = Counter(p for f in found if f for p in set(f[2]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for f in found:
        if not f:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, links, groups = f
            yield (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


def odd_texts():
    rng = random.Random(3)
    letters = " .,;:!?'\"<|endoftext|>\n\t\r abcXYZ019é中😀▁ \xa0　̈ﬁ\x1c-_/"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + [None, "", " ", "  ", "a", "▁", "don't  I'LL <s></s> <unk> <0x0A> ", " a b ", "word, word, word. word!", "x" * 3000 + " tail"]


def test_alignment_against_a_plain_walk(spark, brute):
    texts = odd_texts() + odd_texts()[:40] + ["same text, many times over"] * 30
    df = spark.createDataFrame([(k if k % 9 else None, t, 1, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, groups_sha256 string").repartition(5)
    want = sorted((str(k if k % 9 else None), *m) for k, m in enumerate(expected_measures(texts, brute)))
    for chars in (4 << 20, 60):  # 60: texts in parts, many blocks
        params = alignment.AlignmentParams(PARAMS.a, PARAMS.b, chars)
        assert sorted((str(r[0]), *r[1:]) for r in alignment.aligned_documents(df, params).collect()) == want
    assert alignment.aligned_documents(df.where("false"), PARAMS).count() == 0
    assert sum(w[1] > 0 for w in want) > 60


def test_alignment_of_the_given_documents(spark, brute):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, *m) for r, m in zip(rows, expected_measures([r.text for r in rows], brute), strict=True)}
    assert {tuple(r) for r in alignment.aligned_documents(df, PARAMS).collect()} == want
    counts = Counter(p for r in rows if (f := brute(r.text)) for p in set(f[2]))
    got = alignment.pair_counts(df, PARAMS).collect()
    assert {(r.a, r.b): r["count"] for r in got} == dict(counts) and {r.a for r in got if r.best} == {a for a, _ in counts}
    groups = {r.doc_id: r.groups for r in alignment.text_groups(df, PARAMS).collect()}
    assert all(groups[r.doc_id] == (";".join(f[3]) if (f := brute(r.text)) else "") for r in rows)


def test_a_very_long_text_is_aligned_in_parts(brute):
    text = "Some words, and more of them; " * 60_000 + "y" * 50_000
    got = alignment.align([text, "end"], alignment.AlignmentParams(PARAMS.a, PARAMS.b, 1 << 18))
    a, b, links, groups = brute("Some words, and more of them; " * 3)
    assert got.n_links[1] == len(brute("end")[2]) and got.n_a[0] > 60_000 * (a // 3) and len(got.said[0]) == 64


def as_vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"id long, label int, vector array<{kind}>, score string, rank string")


def row(k, label, vector):
    return k, label, vector, "clash", "clash"


ODD = [row(1000, 1, None), row(1001, 1, [0.0] * 8), row(1002, 1, [float("nan")] + [1.0] * 7), row(1003, 1, [float("inf")] + [1.0] * 7), row(1004, 1, [None] + [1.0] * 7), row(None, 1, [1.0] * 8), row(1005, None, [0.5] * 8), row(1006, 1, [1.0] * 5)]


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(600, 8)).astype(np.float32) * rng.uniform(0.1, 3, (600, 1)).astype(np.float32)
    points[300:340] = points[300]  # copies
    points[340:420] = points[340] + 1e-3 * rng.normal(size=(80, 8)).astype(np.float32)  # near copies
    rows = [row(k, k % 7, [float(x) for x in p]) for k, p in enumerate(points)]
    df = as_vectors(spark, rows + ODD + rows[:30]).repartition(4)
    params = neighbours.GraphParams(shard_values=8 * 150, query_values=8 * 20)
    got = defaultdict(list)
    for r in neighbours.neighbours(df, df.where("id % 10 = 0"), params).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    every = {k: p.astype(float) for k, p in enumerate(points)} | {1005: np.full(8, 0.5)}
    found = total = 0
    assert set(got) == {k for k in every if k % 10 == 0}
    for q, own in got.items():
        own.sort()
        scores = {k: float(every[q] @ p) for k, p in every.items() if k != q}
        best = sorted(scores, key=lambda k: (-scores[k], k))[:20]
        assert [r for r, _, _ in own] == list(range(1, 21)) and len({k for _, k, _ in own}) == 20
        assert all(abs(scores[k] - s) < 1e-9 for _, k, s in own) and [(-s, k) for _, k, s in own] == sorted((-s, k) for _, k, s in own)
        found += len({k for _, k, _ in own} & set(best))
        total += 20
    assert found / total >= 0.95
    few = as_vectors(spark, rows[:5])
    assert neighbours.neighbours(few, few, params).count() == 20
    assert neighbours.neighbours(few.where("false"), few, params).count() == neighbours.neighbours(few, few.where("false"), params).count() == 0
    # of many copies of one vector the smallest ids tie first
    same = as_vectors(spark, [row(k, 0, [1.0, 2.0]) for k in range(200)], "double")
    assert [r.id for r in neighbours.neighbours(same, same.where("id = 7"), params).orderBy("rank").collect()] == [k for k in range(21) if k != 7]


def test_recall_on_the_given_embeddings(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    points, ids = np.stack(base.embedding).astype(float), base.vec_id.to_numpy()
    got = queries.op12_neighbours(spark, "/root/testdata/sf0.1").groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect()
    place = {v: k for k, v in enumerate(ids.tolist())}
    scores = {r.query_id: points @ points[place[r.query_id]] for r in got}
    best = {q: set(ids[[k for k in np.argsort(-s)[:21] if ids[k] != q][:20]].tolist()) for q, s in scores.items()}
    assert len(got) == int((ids % 20 == 0).sum()) and np.mean([len(best[r.query_id] & set(r.found)) / 20 for r in got]) >= 0.95


def brute_negatives(rows, anchors, k=5, percent=80):
    """By all pairs, in whole numbers."""
    whole = {(i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, label, v in rows}
    out = set()
    for a in anchors:
        a = (a[0], a[1], tuple(int(np.floor(256 * float(x))) for x in a[2]))
        scored = [(sum(x * y for x, y in zip(a[2], v, strict=True)), i, label) for i, label, v in whole if i != a[0] and len(v) == len(a[2])]
        order = sorted(scored, key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in order if x[2] == a[1]][:k]:
            fits = [x for x in order if x[2] != a[1] and percent * ps <= 100 * x[0] <= 100 * ps]
            out |= {(a[0], p, r, n, ps, ns) for r, (ns, n, _) in enumerate(fits[:k], 1)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])  # scores fit float32, float64, and neither
def test_negatives_against_all_pairs(spark, scale):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    points = (centres[rng.integers(0, 12, 400)] + 0.05 * rng.normal(size=(400, 8))) * scale
    points[50:70] = points[50]
    labels = np.where(rng.random(400) < 0.4, 3, rng.integers(0, 10, 400))
    rows = [row(k, int(labels[k]), [float(x) for x in p]) for k, p in enumerate(points)]
    df = as_vectors(spark, rows + ODD + rows[:40], "double").repartition(4)
    valid = [(k, label, v) for k, label, v, *_ in [*rows, *ODD] if None not in (k, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    want = brute_negatives(valid, [r for r in valid if r[0] % 9 == 0 or r[0] in (1001, 1006)])
    anchors = df.where("id % 9 = 0 OR id IN (1001, 1006)")
    assert len(want) > 300
    for params in (negatives.NegativeParams(), negatives.NegativeParams(candidate_values=8 * 60, anchor_values=8 * 10)):
        assert {tuple(r) for r in negatives.hard_negatives(df, anchors, params).collect()} == want
    assert negatives.hard_negatives(df.where("false"), anchors).count() == negatives.hard_negatives(df, anchors.where("false")).count() == 0


def test_spanning_trees_and_visits():
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 200):
        points = np.floor(256 * rng.normal(size=(n, 5)))
        parent, edge = negatives.spanning_tree(points)
        far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        joined, total = {0}, 0.0
        while len(joined) < n:  # Prim's way, plainly
            d, k = min((far[i, j], j) for i in joined for j in range(n) if j not in joined)
            joined.add(k)
            total += d
        assert abs(edge.sum() - total) < 1e-6 * max(total, 1)
        parent[rng.random(n) < 0.1] = -1
        seen, open_, most = set(), set(), 0
        for k, p, last, has in negatives.visits(parent):
            assert p == parent[k] and (p < 0 or p in open_)
            if last:
                open_.remove(p)
            if has:
                open_.add(k)
            seen.add(k)
            most = max(most, len(open_))
        assert seen == set(range(n)) and not open_ and most <= max(1, n).bit_length() + 1


def test_bounds_leave_out_what_no_window_meets():
    """Near anchors of a tree score far fewer candidates than there are."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16) * 256
    anchors = np.floor(centre + rng.normal(size=(50, 16)))
    candidates = np.floor(rng.normal(size=(5000, 16)) * 256)
    parent, edge = negatives.spanning_tree(anchors)
    asked = []

    class Counting(negatives.Scorer):
        def __call__(self, some, at=slice(None)):
            out = super().__call__(some, at)
            asked.append(out.size)
            return out

    a = {"id": np.arange(50), "label": np.zeros(50), "points": anchors, "parent": parent, "edge": edge}
    c = {"id": np.arange(100, 5100), "label": np.ones(5000), "points": candidates}
    exact = (anchors @ candidates.T).astype(int)
    windows = [[int(np.sort(row)[-20])] for row in exact]
    plain = negatives.Scorer
    negatives.Scorer = Counting
    try:
        got = list(negatives.in_windows(a, c, windows, negatives.NegativeParams()))
    finally:
        negatives.Scorer = plain
    for k in range(50):
        fits = [j for j in np.lexsort((c["id"], -exact[k])) if 80 * windows[k][0] <= 100 * exact[k, j] <= 100 * windows[k][0]][:5]
        assert [(j, s) for i, _, j, s in got if i == k] == [(j, exact[k, j]) for j in fits]
    assert sum(asked) < 0.2 * exact.size
