"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored


def components(edges: DataFrame, store=stored) -> DataFrame:
    """(id, component) of every id with an edge (columns a, b of one type): the least id that it reaches, as `store` keeps it.

    Rounds of two kinds: every id hands its larger neighbours to the least of
    them all, then the ids below it to the least of these. Both are grouped minima,
    combined before the shuffle; each round is written, so lineage stays short.
    """
    with Scratch(edges.sparkSession) as t:
        now = t.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = mark(now)
        while before[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = up.groupBy("u").agg(F.min("v").alias("m"))
            across = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = t.stored(across.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            after = mark(now)
            if after == before:
                break
            before = after
        return store(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), "components")
