"""Density clusters, edges and labels of patterns against plain forms."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import density, patterns, similarity


def plain_clusters(codes: np.ndarray, weight: np.ndarray, min_size: int) -> np.ndarray:
    """Labels of weighted categorical points under the matching distance, as hierarchical density clustering gives them."""
    n, m = codes.shape
    if n == 1:
        return np.zeros(1, int) if weight.sum() >= min_size else np.full(1, -1)
    step = np.sqrt(2 * np.arange(m + 1) / m)
    apart = np.stack([(codes != codes[k]).sum(1) for k in range(n)]).astype(np.int8)
    core = np.zeros(n)
    for k in range(n):
        reach = np.cumsum(np.bincount(apart[k], weights=weight, minlength=m + 1))
        core[k] = step[min(int(np.searchsorted(reach, min_size)), m)]
    # Prim's tree over mutual reachability
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, here = [], 0
    for _ in range(n - 1):
        inside[here] = True
        d = np.maximum(np.maximum(step[apart[here]], core[here]), core)
        closer = (d < best) & ~inside
        best[closer], link[closer] = d[closer], here
        here = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[here], link[here], here))
    # merges of equal distance happen at once
    edges.sort(key=lambda e: e[0])
    owner = list(range(n))
    node: dict[int, tuple] = {k: (0.0, float(weight[k]), [], k) for k in range(n)}  # distance, weight, children, point
    next_id = n

    def find(a: int) -> int:
        while owner[a] != a:
            owner[a] = owner[owner[a]]
            a = owner[a]
        return a

    at = 0
    while at < len(edges):
        end = at
        touched: dict[int, set[int]] = {}
        while end < len(edges) and edges[end][0] == edges[at][0]:
            end += 1
        parent = {}

        def root(x: int, parent=parent) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for _, a, b in edges[at:end]:
            parent[root(find(a))] = root(find(b))
        for x in list(parent):
            touched.setdefault(root(x), set()).add(x)
        for group in touched.values():
            owner.append(next_id)
            node[next_id] = (float(edges[at][0]), sum(node[g][1] for g in group), sorted(group), None)
            for g in group:
                owner[g] = next_id
            next_id += 1
        at = end
    top = find(0)

    def points(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if node[y][3] is not None:
                out.append(node[y][3])
            todo += node[y][2]
        return out

    labels, count = np.full(n, -1), 0
    lam = lambda d: 1 / max(d, 1e-9)

    def walk(x: int, born: float) -> tuple[float, list[int]]:
        """Stability and chosen clusters of the condensed subtree that is born at lambda `born` with node x."""
        stability, at = 0.0, x
        while True:
            children = node[at][2]
            here = lam(node[at][0])
            big = [c for c in children if node[c][1] >= min_size]
            if not children or not big:
                return stability + node[at][1] * (here - born), [x]
            stability += sum(node[c][1] for c in children if c not in big) * (here - born)
            if len(big) == 1:
                at = big[0]
                continue
            stability += sum(node[c][1] for c in big) * (here - born)
            below = [walk(c, here) for c in big]
            total = sum(s for s, _ in below)
            return (total, [k for _, ks in below for k in ks]) if total > stability else (stability, [x])

    if node[top][1] < min_size:
        return labels
    chosen = walk(top, lam(node[top][0]))[1]
    if chosen == [top]:  # the whole data is no cluster, unless nothing ever splits
        big = [c for c in node[top][2] if node[c][1] >= min_size]
        chosen = [k for c in big for k in walk(c, lam(node[top][0]))[1]]
    for c in chosen:
        labels[points(c)] = count
        count += 1
    return labels


def labelled(rows, fields, min_size):
    df = pd.DataFrame(rows, columns=[*fields, "n"]).sort_values(list(fields), ignore_index=True)
    df["label"] = plain_clusters(np.stack([df[f].astype("category").cat.codes.to_numpy() for f in fields], 1), df["n"].to_numpy(), min_size)
    size = df[df.label >= 0].groupby("label")["n"].sum()
    order = {old: new for new, old in enumerate(sorted(size.index, key=lambda k: (-size[k], df.index[df.label == k][0])))}
    return {tuple(r[f] for f in fields): order.get(r.label, -1) for _, r in df.iterrows()}


@pytest.mark.parametrize(("seed", "many", "min_size", "values"), [(1, 200, 8, (3, 5, 2, 4, 3)), (2, 60, 15, (2, 3, 3)), (3, 120, 3, (6, 6, 6, 6, 6))])
def test_density_labels_equal_the_plain_form(spark, seed, many, min_size, values):
    rng = random.Random(seed)
    fields = tuple("abcde"[: len(values)])
    count = Counter(tuple(str(rng.randrange(v)) for v in values) for _ in range(many))
    for _ in range(3):
        count[tuple(str(rng.randrange(v)) for v in values)] += min_size if seed != 3 else 1
    rows = [(*k, n) for k, n in count.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields) + ", n long")
    got = {tuple(r[f] for f in fields): r.label for r in density.density_labels(df, fields, min_size).collect()}
    assert got == labelled(rows, fields, min_size) and len(set(got.values())) > 1


def test_density_of_few_and_of_one(spark):
    df = spark.createDataFrame([("x", "y", 9)], "a string, b string, n long")
    label = lambda d, k: [r.label for r in density.density_labels(d, ("a", "b"), k).orderBy("a").collect()]
    assert label(df, 5) == [0] and label(df.where("false"), 5) == []
    two = spark.createDataFrame([("x", "y", 1), ("z", "y", 2)], "a string, b string, n long")
    assert label(two, 5) == [1, 0]  # fewer reports than a cluster needs: by signature, the larger first


def test_edges_against_all_pairs(spark):
    rng = random.Random(5)
    fields = ("p", "q", "r")
    rows = [(f"g{rng.randrange(4)}", f"k{k:04}", *(rng.choice(["a", "b", None]) if f != "q" else str(rng.randrange(12)) for f in fields)) for k in range(160)]
    rows += [("hot", f"h{k:04}", "same", "same", "same") for k in range(300)] + [("pair", "x1", "a", "b", "c"), ("pair", "x2", "d", "e", "f"), ("one", "y", "a", "a", "a")]
    rows += [("apart", f"z{k:03}", f"p{k}", f"q{k}", f"r{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, key string, p string, q string, r string").repartition(3)
    want, by = set(), defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    for g, own in by.items():
        pairs = [(-sum(x == y for x, y in zip(a[2:], b[2:], strict=True)), a[1], b[1]) for a in own for b in own if a[1] < b[1]]
        want |= {(g, a, b, -n) for n, a, b in sorted(pairs)[:40]}
    assert {tuple(r) for r in similarity.match_edges(df, "g", "key", fields).collect()} == want
    assert similarity.match_edges(df.where("false"), "g", "key", fields).count() == 0


def test_pattern_labels_of_blank_fields(spark):
    df = spark.createDataFrame([("c", 1, "", None, "uncertain", "direct_proximity"), ("c", 2, "lifting", None, "odd", ""), ("c", 3, "digging", None, "odd", None), ("d", 4, None, "heat", None, "no_exposure")], "cluster_id string, report_id int, activity string, energy_type string, barrier_status string, exposure string")
    got = {r.cluster_id: r.pattern_label for r in patterns.pattern_labels(df).collect()}
    assert got == {"c": "lifting + unspecified energy + odd + direct exposure", "d": "unspecified activity + heat + unknown + no exposure"}
