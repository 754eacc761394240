"""Hierarchical density clusters of categorical signatures, level by level.

One-hot rows of unit length over m fields are sqrt(2 k / m) apart if k fields
differ, so the hierarchy has m + 1 levels. Signatures with at most k different
fields share the values of some m - k fields: core distances are counts over
subsets of fields, and the components of a level come from the subsets' keys.
Stabilities add up from level to level, so every step is a grouping or a join,
and no task holds the signatures.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored
from .graph import components

SEPARATOR = "\x1f"


def subset_key(fields: tuple[str, ...], number: int):
    return F.concat_ws(SEPARATOR, F.lit(str(number)), *(F.col(f) for f in fields))


def core_levels(sign: DataFrame, fields: tuple[str, ...], min_size: int) -> DataFrame:
    """sign (id, fields, n) with `core`: the least number of differing fields within which min_size reports lie, at most all.

    The weight that agrees in at least j fields is a sum over the subsets of j or
    more fields of the weight that agrees on the subset, with binomial signs.
    """
    m = len(fields)
    subsets = [s for size in range(1, m + 1) for s in combinations(fields, size)]
    keys = F.array(*(F.struct(F.lit(len(s)).alias("size"), subset_key(s, k).alias("key")) for k, s in enumerate(subsets)))
    keyed = sign.select("id", "n", F.explode(keys).alias("x")).select("id", "n", "x.size", "x.key")
    counts = keyed.groupBy("key").agg(F.sum("n").alias("held"))
    agree = [F.sum(F.col("held") * sum((F.when(F.col("size") == s, (-1) ** (s - j) * comb(s - 1, j - 1)).otherwise(0) for s in range(j, m + 1)), F.lit(0))).alias(f"agree{j}") for j in range(1, m + 1)]
    within = keyed.join(counts, "key").groupBy("id").agg(*agree)
    core = F.coalesce(*(F.when(F.col(f"agree{m - k}") >= min_size, k) for k in range(m)), F.lit(m))
    return sign.join(within.select("id", core.alias("core")), "id")


def linked_levels(nodes: DataFrame, fields: tuple[str, ...], t: Scratch) -> DataFrame:
    """nodes (id, fields, n, core) with c0 to cm: the component of each level, named by its least id."""
    m = len(fields)
    now = nodes.withColumn("c0", F.col("id"))
    for k in range(1, m):
        keys = F.array(*(subset_key(s, i) for i, s in enumerate(combinations(fields, m - k))))
        keyed = now.where(F.col("core") <= k).select(F.col(f"c{k - 1}").alias("entity"), F.explode(keys).alias("key")).distinct()
        first = keyed.groupBy("key").agg(F.min("entity").alias("first"))
        found = components(keyed.join(first, "key").select(F.col("first").alias("a"), F.col("entity").alias("b")), t.stored)
        met = now.join(found.withColumnRenamed("id", f"c{k - 1}"), f"c{k - 1}", "left")
        now = t.stored(met.withColumn(f"c{k}", F.coalesce("component", f"c{k - 1}")).drop("component"), f"level{k}")
    least = now.agg(F.min("id")).first()[0]
    return now.withColumn(f"c{m}", F.lit(least))


def density_labels(sign: DataFrame, fields: tuple[str, ...], min_size: int) -> DataFrame:
    """(fields, n, label) of distinct signatures (fields, n): clusters by excess of mass, -1 for noise.

    A cluster is a component of at least min_size reports. Going up a level it
    stays the same cluster if only small components join it, and ends where two
    clusters meet; it is chosen if its stability (the sum over its reports of
    1 / distance at which they leave, less that at which it began) is no less than
    that of the best clusters inside it. The whole is a cluster only if there is
    one signature. Fewer reports than min_size (or two) are grouped by signature.
    Labels go by falling number of reports, then by the fields. No signatures give no rows.
    """
    m = len(fields)
    rate = [1 / max(sqrt(2 * k / m), 1e-9) for k in range(m + 1)]
    by = Window.orderBy(F.desc("size"), "first")
    with Scratch(sign.sparkSession) as t:
        named = t.stored(sign.withColumn("id", subset_key(fields, 0)).select("id", *fields, "n"), "signatures")
        seen = named.agg(F.count("*").alias("signatures"), F.sum("n").alias("reports")).first()
        if seen.signatures < 2 or seen.reports < max(2, min_size):
            alone = named.withColumn("size", F.col("n")).withColumn("first", F.struct(*fields))
            label = F.when(F.lit((seen.reports or 0) < max(2, min_size)) | (F.col("n") >= min_size), F.row_number().over(by) - 1).otherwise(-1)
            return stored(alone.select(*fields, "n", label.cast("int").alias("label")), "density")
        nodes = linked_levels(t.stored(core_levels(named, fields, min_size), "cores"), fields, t)
        counts = nodes.agg(*(F.count_distinct(f"c{k}").alias(f"c{k}") for k in range(m + 1))).first()
        top = min(k for k in range(m + 1) if counts[f"c{k}"] == 1)

        # upwards: weight, sum of n / distance at leaving (mass), and what the clusters inside are worth (inner)
        stats = [t.stored(nodes.where(F.col("n") >= min_size).select(F.col("c0").alias("c"), F.col("n").cast("double").alias("weight"), (F.col("n") * rate[0]).alias("mass"), F.lit(None).cast("double").alias("inner")), "stats")]
        tree = [None]
        worth = lambda k: F.greatest(F.coalesce("inner", F.lit(float("-inf"))), F.col("mass") - F.col("weight") * rate[k])
        for k in range(1, top + 1):
            pairs = nodes.groupBy(F.col(f"c{k}").alias("parent"), F.col(f"c{k - 1}").alias("c")).agg(F.sum("n").cast("double").alias("own"))
            met = t.stored(pairs.join(stats[-1], "c", "left"), "pairs")
            up = met.groupBy("parent").agg(F.sum("own").alias("weight"), F.count("*").alias("kids"), F.count("mass").alias("big"), F.max("mass").alias("mass"), F.max("weight").alias("heir"), F.max("inner").alias("inner"), F.sum(F.when(F.col("mass").isNotNull(), worth(k))).alias("worth"))
            up = t.stored(up.where(F.col("weight") >= min_size), "parents")
            same = F.col("kids") == 1
            mass = F.when(same, F.col("mass")).when(F.col("big") == 1, F.col("mass") + (F.col("weight") - F.col("heir")) * rate[k]).otherwise(F.col("weight") * rate[k])
            inner = F.when(same | (F.col("big") == 1), F.col("inner")).when(F.col("big") > 1, F.col("worth"))
            stats.append(t.stored(up.select(F.col("parent").alias("c"), "weight", mass.alias("mass"), inner.alias("inner")), "stats"))
            tree.append(met.join(up.select("parent", "kids", "big"), "parent"))

        # downwards: which components hold clusters that are still to be found
        chosen = []
        whole = stats[top].first()
        open_ = stats[top].select(F.col("c").alias("parent"), F.lit(not (whole.inner is not None and whole.inner > whole.mass - whole.weight * rate[top])).alias("forced")) if whole else None
        for k in range(top, 0, -1) if whole else ():
            kids = t.stored(tree[k].where("mass IS NOT NULL").join(open_, "parent"), "open")
            heir = ~F.col("forced") & ((F.col("kids") == 1) | (F.col("big") == 1))
            own = ~F.coalesce(F.col("inner") > F.col("mass") - F.col("weight") * rate[k], F.lit(False))
            chosen.append((k - 1, kids.where(~heir & own).select("c")))
            open_ = kids.where(heir | ~own).select(F.col("c").alias("parent"), F.lit(False).alias("forced"))
        label = named.select("id", F.lit(None).cast("string").alias("cluster")).where("false")
        for k, c in chosen:
            label = label.unionByName(nodes.join(c.withColumnRenamed("c", f"c{k}"), f"c{k}").select("id", F.concat(F.lit(f"{k}{SEPARATOR}"), f"c{k}").alias("cluster")))
        placed = t.stored(named.join(label, "id", "left"), "placed")
        sizes = placed.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct(*fields)).alias("first"))
        ranked = sizes.select("cluster", (F.row_number().over(by) - 1).alias("label"))
        return stored(placed.join(ranked, "cluster", "left").select(*fields, "n", F.coalesce("label", F.lit(-1)).cast("int").alias("label")), "density")
