"""Association rules and patterns over categorical frames."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

# The fields of an itemset, what a rule may conclude, and pairs of fields that hold by definition.
ITEM_FIELDS = ("activity", "energy_type", "barrier_status", "barrier_failure_mode", "exposure", "site")
CONSEQUENTS = ("exposure", "barrier_status", "barrier_failure_mode")
TAUTOLOGIES = frozenset({("energy_type", "lsr_tag"), ("lsr_tag", "energy_type"), ("barrier_failure_mode", "barrier_status"), ("barrier_status", "barrier_failure_mode")})
MISSING = ("", "N/A", "unknown")


@dataclass(frozen=True)
class RuleParams:
    min_support: float = 0.01
    min_confidence: float = 0.45
    min_lift: float = 1.25
    #: Largest itemset counted: antecedents are one smaller.
    max_itemset: int = 3
    top: int = 40
    fields: tuple[str, ...] = ITEM_FIELDS


def itemset_counts(frames: DataFrame, params: RuleParams) -> tuple[DataFrame, int, int]:
    """(items, n) of every frequent itemset up to the largest size, the transactions, and the least count.

    Itemsets are choices of fields, so they are counted by one grouping of each
    choice, after frames are first grouped to distinct field combinations, which
    are few and written once.
    """
    value = lambda f: F.when(~F.col(f).isin(*MISSING), F.concat(F.lit(f + "="), F.col(f)))
    signed = frames.select(*(value(f).alias(f) for f in params.fields)).groupBy(*params.fields).agg(F.count("*").alias("n"))
    signed = stored(signed.where(F.coalesce(*params.fields).isNotNull()), "signed")
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, int(params.min_support * total))
    sets = F.array(*(F.array_compact(F.array_sort(F.array(*map(F.col, c)))) if len(c) == 1 else F.when(F.expr(" AND ".join(f"`{f}` IS NOT NULL" for f in c)), F.array_sort(F.array(*map(F.col, c)))) for size in range(1, params.max_itemset + 1) for c in combinations(params.fields, size)))
    counted = signed.select("n", F.explode(F.array_compact(sets)).alias("items")).where(F.size("items") > 0).groupBy("items").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least), total, least


def association_rules(frames: DataFrame, params: RuleParams | None = None) -> DataFrame:
    """antecedent, consequent, report_count, support, confidence, baseline, lift of the rules that pass all thresholds."""
    params = params or RuleParams()
    sets, total, _ = itemset_counts(frames, params)
    split = sets.where(F.size("items") > 1).select("items", F.col("n").alias("both"), F.explode("items").alias("consequent"))
    split = split.where(F.substring_index("consequent", "=", 1).isin(*CONSEQUENTS)).withColumn("antecedent", F.array_except("items", F.array("consequent")))
    left = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("n_left"))
    right = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("n").alias("n_right"))
    rules = split.join(left, "antecedent").join(right, "consequent")
    confidence, base = F.col("both") / F.col("n_left"), F.col("n_right") / F.lit(total)
    rules = rules.select("antecedent", "consequent", F.col("both").alias("report_count"), (F.col("both") / F.lit(total)).alias("support"), confidence.alias("confidence"), base.alias("baseline"), (confidence / base).alias("lift"))
    rules = rules.where((F.col("confidence") >= params.min_confidence) & (F.col("lift") >= params.min_lift))
    for a, c in sorted(TAUTOLOGIES):
        rules = rules.where(~(F.col("consequent").startswith(c + "=") & F.exists("antecedent", lambda x: x.startswith(a + "="))))  # noqa: B023
    return rules


def pruned_rules(rules: DataFrame, top: int = 40) -> DataFrame:
    """Rules by falling lift without those that a better rule with the same consequent makes redundant.

    A rule is redundant if a better one's antecedent is part of its own; whether
    that one is redundant itself makes no difference, so one anti join settles it.
    """
    order = Window.orderBy(F.round("lift", 3).desc(), F.col("report_count").desc(), "antecedent", "consequent")
    ranked = rules.withColumn("place", F.row_number().over(order))  # the rules that pass, a few hundred
    better = ranked.select(F.col("antecedent").alias("a"), F.col("consequent").alias("c"), F.col("place").alias("p"))
    kept = ranked.join(better, (F.col("consequent") == F.col("c")) & (F.col("p") < F.col("place")) & (F.size(F.array_except("a", "antecedent")) == 0), "left_anti")
    return kept.orderBy("place").limit(top).drop("place")


def statement(antecedent: str = "antecedent", consequent: str = "consequent"):
    """A rule as a sentence."""
    said = lambda x: F.replace(F.substring_index(x, "=", -1), F.lit("_"), F.lit(" "))
    words = F.array_join(F.transform(F.col(antecedent), said), " + ")
    return F.format_string("%s co-occurs with %s in %.0f%% of cases, against a %.0f%% baseline (lift %.1f, %d reports).", words, said(F.col(consequent)), F.col("confidence") * 100, F.col("baseline") * 100, F.col("lift"), F.col("report_count"))


def failure_pairs(frames: DataFrame, least: int = 5) -> DataFrame:
    """(activity, failure mode): reports, flagged reports and their share, for pairs with enough reports."""
    known = frames.where("activity <> '' AND barrier_failure_mode <> ''")
    out = known.groupBy("activity", "barrier_failure_mode").agg(F.count("*").alias("report_count"), F.count_if("sif_potential").alias("flagged")).where(F.col("report_count") >= least)
    return out.withColumn("share", F.col("flagged") / F.col("report_count"))
