"""Vector similarity."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored


def norm(v: str) -> str:
    return f"greatest(sqrt(aggregate({v}, 0D, (s, x) -> s + cast(x as double) * x)), 1e-9)"


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays; a zero vector is 0 to all."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x) / ({norm(a)} * {norm(b)})")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, rank, similarity): the k nearest vectors of each query by cosine, the smaller id first among equals.

    queries (query_id, q) is a stated set; vectors (id, v). Both are dealt into
    blocks of about so many rows, so there are as many blocks as the tables
    need; each pair of blocks is one product of two matrices, and gives its k
    best for every query before the blocks meet.
    """
    left_blocks, right_blocks = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    as_double = lambda v: F.expr(f"transform({v}, x -> cast(x as double))")
    left = queries.select(F.lit(True).alias("query"), F.col("query_id").alias("id"), as_double("q").alias("v"), part("query_id", left_blocks).alias("i")).withColumn("j", every(right_blocks))
    right = vectors.select(F.lit(False).alias("query"), "id", as_double("v").alias("v"), part("id", right_blocks).alias("j")).withColumn("i", every(left_blocks)).select("query", "id", "v", "i", "j")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        ask, own = group[group["query"]], group[~group["query"]].sort_values("id")
        out = {"query_id": [], "id": [], "similarity": []}
        if len(ask) and len(own):
            unit = lambda g: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9))(np.stack(g["v"].to_numpy()))
            ids, scores = own["id"].to_numpy(), unit(ask) @ unit(own).T
            for query, row in zip(ask["id"].tolist(), scores, strict=True):
                row = np.where(ids == query, -np.inf, row)
                least = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                near = np.flatnonzero((row >= least) & (row > -np.inf))
                near = near[np.argsort(-row[near], kind="stable")][:k]  # ids ascend, so the smaller comes first
                out["query_id"] += [query] * len(near)
                out["id"] += ids[near].tolist()
                out["similarity"] += row[near].tolist()
        return pd.DataFrame({"query_id": np.array(out["query_id"], np.int64), "id": np.array(out["id"], np.int64), "similarity": np.array(out["similarity"], float)})

    met = left.unionByName(right).groupBy("i", "j").applyInPandas(best, "query_id long, id long, similarity double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")


def weighted_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, p): share of the label among the neighbours, by weight 1 / distance."""
    weight = 1 / F.greatest(1 - F.col("similarity"), F.lit(1e-9))
    return neighbours.join(labels, "id").groupBy("query_id").agg((F.sum(weight * F.col("y")) / F.sum(weight)).alias("p"))


def match_edges(members: DataFrame, group: str, key: str, fields: tuple[str, ...], top: int = 40) -> DataFrame:
    """(group, source, target, same): the pairs of a group's members that agree in most fields, `top` a group, then by source and target.

    From all fields down to none: members that share the values of a choice of
    so many fields are candidates, in groups that have fewer than `top` pairs
    yet. Such a group has fewer than `top` pairs that agree in more, so of those
    that share a choice's values the first 2 * top + 2 by key hold its next pairs,
    and no more are paired. Nulls agree with nulls; keys are unique.
    """
    with Scratch(members.sparkSession) as t:
        rows = t.stored(members.select(group, key, *fields), "members")
        found = None
        for size in range(len(fields), -1, -1):
            own = rows
            if found is not None:
                full = found.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= top)
                own = rows.join(full, group, "left_anti")
            choices = list(combinations(fields, size))
            keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.array(*(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("")) for f in c)).cast("array<string>").alias("values")) for k, c in enumerate(choices)))
            dealt = own.select(group, key, F.struct(*fields).alias("own"), F.explode(keys).alias("at"))
            first = F.row_number().over(Window.partitionBy(group, "at").orderBy(key))
            few = dealt.withColumn("r", first).where(F.col("r") <= 2 * top + 2).drop("r")
            a, b = few.alias("a"), few.alias("b")
            same = sum((F.col(f"a.own.{f}").eqNullSafe(F.col(f"b.own.{f}")).cast("int") for f in fields), F.lit(0))
            met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.at") == F.col("b.at")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (same == size))
            pairs = met.select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("source"), F.col(f"b.{key}").alias("target"), F.lit(size).alias("same"))
            best = F.row_number().over(Window.partitionBy(group).orderBy("source", "target"))
            pairs = t.stored(pairs.withColumn("r", best).where(F.col("r") <= top).drop("r"), "edges")
            found = pairs if found is None else found.unionByName(pairs)
        w = Window.partitionBy(group).orderBy(F.col("same").desc(), "source", "target")
        return stored(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r"), "edges")
