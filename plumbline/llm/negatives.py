"""Hard negatives in a window below each positive's score, by bounds along a spanning tree of anchors (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, stored


@dataclass(frozen=True)
class NegativeParams:
    #: Positives of an anchor, and negatives of a positive.
    positives: int = 5
    negatives: int = 5
    #: A negative's score has at least so many hundredths of the positive's, and at most all.
    percent: int = 80
    #: Components become floor(scale * x).
    scale: int = 256
    #: Components in a block of candidates, and in one of anchors; a task holds one of each.
    candidate_values: int = 1 << 20
    anchor_values: int = 1 << 18


def usable(rows: DataFrame) -> DataFrame:
    """The rows with an id, a label, and a vector whose components are all finite, with `dims`."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("id", "label", "vector").where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~bad).withColumn("dims", F.size("vector"))


def whole(vectors: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector."""
    lists = vectors.combine_chunks()
    return np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(lists), dims)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each point in a least spanning tree from point 0 (-1 for it), and the length of the edge to it."""
    n = len(points)
    square = (points * points).sum(1)
    parent, best, todo = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    k = 0
    for _ in range(n - 1):
        todo[k] = False
        far = square + square[k] - 2 * (points @ points[k])
        near = todo & (far < best)
        best[near] = far[near]
        parent[near] = k
        k = int(np.argmin(np.where(todo, best, np.inf)))
    edge = np.zeros(n)
    edge[1:] = np.sqrt(((points[1:] - points[parent[1:]]) ** 2).sum(1)) if n > 1 else 0
    return parent, edge


def visits(parent: np.ndarray) -> Iterator[tuple[int, int, bool, bool]]:
    """(point, its parent, whether it is the parent's last child, whether it has children), parents first.

    The child with the most points below it comes last, when its parent is let
    go, so no more than log2 of all points wait for children at once.
    """
    n = len(parent)
    below: list[list[int]] = [[] for _ in range(n)]
    roots: list[int] = []
    for k, p in enumerate(parent.tolist()):
        (below[p] if p >= 0 else roots).append(k)
    order, stack = [], list(roots)
    while stack:
        order.append(k := stack.pop())
        stack += below[k]
    size = np.ones(n, np.int64)
    for k in reversed(order):
        if parent[k] >= 0:
            size[parent[k]] += size[k]
    waiting = [(r, -1, False) for r in reversed(roots)]
    while waiting:
        k, p, last = waiting.pop()
        yield k, p, last, bool(below[k])
        some = sorted(below[k], key=lambda c: -size[c])
        waiting += [(c, k, c == some[0]) for c in some]


class Scorer:
    """Exact inner products of rows of whole numbers, in the cheapest type that holds them exactly."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.norm_a, self.norm_c = (np.sqrt((x * x).sum(1)) for x in (anchors, candidates))
        most = float(self.norm_a.max(initial=0) * self.norm_c.max(initial=0)) * 1.001
        if most < 2**24 or most < 2**53:  # no sum of some of the products is larger
            kind = np.float32 if most < 2**24 else np.float64
            self.a, self.c = anchors.astype(kind), candidates.astype(kind)
        else:
            self.a, self.c = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (anchors, candidates))

    def __call__(self, some: np.ndarray | slice, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = self.a[some] @ self.c[at].T
        if out.dtype == object and out.size and max(abs(out.max()), abs(out.min())) >= 2**63:
            raise OverflowError("an inner product of the vectors does not fit into a long")
        return out.astype(np.int64)


def best_first(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The first `most` of at by falling score, then rising id. Only those that may be among them are sorted."""
    s = scores[at]
    if len(at) > 4 * most:
        low = np.partition(s, len(s) - most)[len(s) - most]
        at, s = at[s >= low], s[s >= low]
    return at[np.lexsort((ids[at], -s))[:most]]


def same_label(anchors: dict, candidates: dict, params: NegativeParams) -> Iterator[tuple[int, int, int]]:
    """(place of the anchor, place of the candidate, score): the best of the anchor's label in this block."""
    score = Scorer(anchors["points"], candidates["points"])
    for label in np.intersect1d(anchors["label"], candidates["label"]).tolist():
        a, c = (np.flatnonzero(x["label"] == label) for x in (anchors, candidates))
        for k in range(0, len(a), 64):
            scores = score(a[k : k + 64], c)
            for j, row in zip(a[k : k + 64].tolist(), scores, strict=True):
                others = np.flatnonzero(candidates["id"][c] != anchors["id"][j])
                for x in best_first(row, candidates["id"][c], others, params.positives).tolist():
                    yield j, int(c[x]), int(row[x])


def in_windows(anchors: dict, candidates: dict, windows: list[list[int]], params: NegativeParams) -> Iterator[tuple[int, int, int, int]]:
    """(place of the anchor, number of the positive, place of the candidate, score) of the best negatives of this block.

    windows has the scores of each anchor's positives. An anchor's scores are
    bounded by its parent's bounds and the edge's length times the candidates'
    norms; only candidates whose bounds meet a window are scored again. Where an
    edge is longer than the anchor itself the bounds can leave out nothing, and
    the anchor begins a tree of its own: all its candidates are scored.
    """
    ids = candidates["id"]
    score = Scorer(anchors["points"], candidates["points"])
    edge = anchors["edge"]
    parent = np.where(edge < score.norm_a, anchors["parent"], -1)
    roots = np.flatnonzero(parent < 0)
    ready: dict[int, np.ndarray] = {}
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    every = np.arange(len(ids))
    for k, p, last_child, has_children in visits(parent):
        open_ = [(i, low, s) for i, s in enumerate(windows[k]) if (low := -(-params.percent * s // 100)) <= s]
        least, most = min((w for _, w, _ in open_), default=0), max((s for _, _, s in open_), default=-1)
        if p < 0:
            if k not in ready:
                some = roots[(at := int(np.searchsorted(roots, k))) : at + 32]
                ready.update(zip(some.tolist(), score(some), strict=True))
            at, exact = every, ready.pop(k)
            low = high = exact.astype(np.float64)
        else:
            low, high = bounds[p]
            wide = (edge[k] * score.norm_c + 1e-9 * np.maximum(np.abs(low), np.abs(high))) * (1 + 1e-9) + 1e-3
            low, high = low - wide, high + wide
            at = np.flatnonzero((high >= least) & (low <= most)) if open_ else every[:0]
            exact = score(k, at) if 3 * len(at) < len(ids) else score(k)[at]
            low[at] = high[at] = exact
            if last_child:
                del bounds[p]
        if has_children:
            bounds[k] = low, high
        keep = (exact >= least) & (exact <= most) & (candidates["label"][at] != anchors["label"][k]) & (ids[at] != anchors["id"][k])
        at, exact = at[keep], exact[keep]
        sort = np.lexsort((ids[at], -exact))
        at, exact = at[sort], exact[sort]
        for i, w, s in open_:
            begin = int(np.searchsorted(-exact, -s, "left"))
            for x in range(begin, min(begin + params.negatives, len(at))):
                if exact[x] >= w:
                    yield k, i, int(at[x]), int(exact[x])


def first_of(rows: DataFrame, keys: list[str], ids: str, scores: str, most: int) -> DataFrame:
    """The first `most` rows of each key by falling score and rising id, with `rank`. Spark keeps no more of a key in each task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(scores), ids))).where(F.col("rank") <= most)


def unpacked(t: pa.Table, dims: int, scale: int) -> dict:
    """ids, labels and whole vectors by rising id; rows that repeat all three count once."""
    ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
    points = whole(t.column("vector"), dims, scale)
    order = np.lexsort((label, ids))
    ids, label, points = ids[order], label[order], points[order]
    same = (ids[1:] == ids[:-1]) & (label[1:] == label[:-1])
    if same.any():
        keep, seen = np.ones(len(ids), bool), set()
        for k in np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])).tolist():
            key = ids[k], label[k], points[k].tobytes()
            keep[k] = key not in seen
            seen.add(key)
        ids, label, points = ids[keep], label[keep], points[keep]
    return {"id": ids, "label": label, "points": points}


PLACED = "dims int, block int, place int, id long, label long, vector array<double>, parent int, edge double"


def hard_negatives(rows: DataFrame, anchors: DataFrame, params: NegativeParams = NegativeParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `anchors` against all `rows`.

    Both have columns id, label, vector (whole-number ids and labels; an array
    of float or double); other columns are ignored. Rows with a null id, label or
    vector, or a component that is null or not finite, take no part. Scores are
    inner products of floor(scale * x), exact; higher scores come first, ties by
    smaller id. An anchor's partners have another id and as many components.
    Rows that repeat id, label and vector count once; of rows that share an id
    but differ each counts. Empty tables give no rows. A score that does not
    fit into a long is an error.

    Anchors and rows are dealt to blocks of bounded size, and each pair of
    blocks is one task's work: twice, for the positives and for the negatives in
    their windows. A task gives a few best for each anchor, which are merged.
    Anchors are dealt by the signs of their first components, so that near ones share a block's tree;
    rows by id, so no label or vector is ever one task's own.
    """
    spark = rows.sparkSession
    rows = usable(rows).withColumn("label", F.col("label").cast("long")).withColumn("id", F.col("id").cast("long"))
    anchors = usable(anchors).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), "dims").distinct()
    signs = sum((F.when(F.get("vector", F.lit(k)) > 0, 1 << (61 - k)).otherwise(0) for k in range(24)), F.lit(0))
    anchors = anchors.withColumn("near", (signs + F.shiftrightunsigned(F.xxhash64("id"), 26)).cast("long"))
    size = rows.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    n_anchors = anchors.count()
    dims = max(size.dims or 0, 1)
    many = -(-size.n * dims // params.candidate_values) or 1
    many_anchors = -(-n_anchors * dims // params.anchor_values) or 1
    with Tables(spark) as t:
        anchors = t.stored(anchors, "anchors")
        cuts = []
        if many_anchors > 1:
            cuts = anchors.agg(F.percentile_approx("near", [k / many_anchors for k in range(1, many_anchors)], 100 * many_anchors).alias("cuts")).first().cuts
        block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("near"))) if cuts else F.lit(0)

        def plant(t: pa.Table) -> pa.Table:
            dims = t.column("dims")[0].as_py()
            parent, edge = spanning_tree(whole(t.column("vector"), dims, params.scale))
            own = {c: t.column(c) for c in ("dims", "block")} | {"place": pa.array(range(len(t)), pa.int32())} | {c: t.column(c) for c in ("id", "label", "vector")}
            return pa.table(own | {"parent": pa.array(parent, pa.int32()), "edge": pa.array(edge)})

        trees = t.stored(anchors.withColumn("block", block.cast("int")).groupBy("dims", "block").applyInArrow(plant, PLACED), "trees")
        keys = ["dims", "block", "part"]
        whole_parts = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part")
        blocks = F.explode(F.sequence(F.lit(0), F.lit(many_anchors - 1))).alias("block")
        dealt = rows.select("dims", blocks, F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("part"), "id", "label", "vector")

        def both(left: pa.Table, right: pa.Table) -> tuple[dict, dict] | None:
            if not len(left) or not len(right):
                return None
            dims = left.column("dims")[0].as_py()
            left = left.sort_by("place")
            numbers = {c: left.column(c).to_numpy() for c in ("place", "id", "label", "parent", "edge")}
            return numbers | {"points": whole(left.column("vector"), dims, params.scale)}, unpacked(right, dims, params.scale)

        found = "dims int, block int, place int, anchor_id long, other_id long, score long"

        def positives(key, left: pa.Table, right: pa.Table) -> pa.Table:
            pair = both(left, right)
            got = list(same_label(*pair, params)) if pair else []
            a, c, s = (np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
            fixed = lambda v: pa.array(np.full(len(a), v.as_py()), pa.int32())
            ids = (pair[0]["id"][a], pair[1]["id"][c]) if pair else (a, c)
            return pa.table({"dims": fixed(key[0]), "block": fixed(key[1]), "place": pa.array(a, pa.int32()), "anchor_id": ids[0], "other_id": ids[1], "score": s})

        own = ["dims", "block", "place"]
        near = trees.select("*", whole_parts).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(positives, found)
        near = first_of(near, own, "other_id", "score", params.positives)
        near = t.stored(near.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("positives")), "positives")
        # the anchors without a positive stay for the tree's sake
        asked = trees.join(near, own, "left")
        asked = asked.select(*trees.columns, F.col("positives.other_id").alias("positive_ids"), F.col("positives.score").alias("positive_scores"), whole_parts)

        def negatives(key, left: pa.Table, right: pa.Table) -> pa.Table:
            pair = both(left, right)
            names = ("place", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score")
            out: list[tuple] = []
            if pair:
                left = left.sort_by("place")
                ids, scores = (left.column(c).to_pylist() for c in ("positive_ids", "positive_scores"))
                windows = [s or [] for s in scores]
                a_ids, c_ids = pair[0]["id"].tolist(), pair[1]["id"].tolist()
                out = [(k, a_ids[k], i, ids[k][i], windows[k][i], c_ids[c], s) for k, i, c, s in in_windows(*pair, windows, params)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            fixed = lambda v: pa.array([v.as_py()] * len(out), pa.int32())
            table = {"dims": fixed(key[0]), "block": fixed(key[1])}
            return pa.table(table | {c: pa.array(x, pa.int32() if c in ("place", "positive_rank") else pa.int64()) for c, x in zip(names, columns, strict=True)})

        hard = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
            negatives, "dims int, block int, place int, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long"
        )
        hard = first_of(hard, [*own, "positive_rank"], "negative_id", "negative_score", params.negatives)
        return stored(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
