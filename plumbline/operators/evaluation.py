"""Metrics of scores and labels. Input columns: y (0 or 1) and p (0 to 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def ratio(a, b):
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(precision, recall, beta: float = 2.0):
    return ratio((1 + beta * beta) * precision * recall, beta * beta * precision + recall)


def binary_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the rates made of them, in one pass."""
    hit = F.col("p") >= threshold
    c = df.agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumns({"f1": f_beta(F.col("precision"), F.col("recall"), 1.0), "f2": f_beta(F.col("precision"), F.col("recall")), "accuracy": ratio(F.col("tp") + F.col("tn"), n), "flagged_fraction": ratio(F.col("tp") + F.col("fp"), n)})


def binned(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean score and rate; bins are closed on the right, the first on both sides."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("p") * bins).cast("int") - 1))
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: the gap of each filled bin, weighted by its rows."""
    b = binned(df, bins)
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """All bins with count, mean score and rate, both null where a bin is empty."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned(df, bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def by_threshold(df: DataFrame, digits: int = 4) -> DataFrame:
    """thr, tp, fp and totals for every distinct rounded score as a threshold.

    Scores are grouped first, so the running sum goes over the distinct rounded
    scores (10,001 at most at four digits), not over the rows.
    """
    s = F.round("p", digits)
    g = df.groupBy(s.alias("thr")).agg(F.count_if((F.col("y") == 1) & (F.col("p") >= s)).alias("pos_in"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("p") >= s).alias("n_in"), F.count("*").alias("n"))
    above = Window.orderBy(F.col("thr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tp = F.coalesce(F.sum("pos").over(above), F.lit(0)) + F.col("pos_in")
    called = F.coalesce(F.sum("n").over(above), F.lit(0)) + F.col("n_in")
    whole = Window.partitionBy()
    return g.select("thr", tp.alias("tp"), (called - tp).alias("fp"), F.sum("pos").over(whole).alias("total_pos"), F.sum("n").over(whole).alias("total"))


def threshold_for_recall(df: DataFrame, target: float = 0.9) -> DataFrame:
    """The highest threshold that keeps the recall, with precision, F2 and the share of rows it calls."""
    t = by_threshold(df).withColumn("recall", ratio(F.col("tp"), F.col("total_pos"))).where(F.col("recall") >= target)
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return t.orderBy(F.col("thr").desc()).limit(1).select(F.col("thr").alias("threshold"), "recall", "precision", f_beta(F.col("precision"), F.col("recall")).alias("f2"), ((F.col("tp") + F.col("fp")) / F.col("total")).alias("review_queue_fraction"))


def ranking_areas(df: DataFrame, ranges: int = 256) -> DataFrame:
    """Average precision, area under the ROC curve (ties half) and Brier score. Scores lie in 0 to 1.

    Sums run over distinct scores after grouping: inside equal ranges of the
    score, each with what all ranges above it add up to. A range's window is one
    task, so no task holds all scores; the sums of the ranges are few.
    """
    place = F.least(F.lit(ranges - 1), F.greatest(F.lit(0), F.floor(F.col("p") * ranges))).cast("int")
    g = df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("square")).withColumn("range", place)
    above = g.groupBy("range").agg(F.sum("pos").alias("own_pos"), F.sum("n").alias("own_n"))
    higher = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = above.select("range", (F.sum("own_pos").over(higher) - F.col("own_pos")).alias("pos_above"), (F.sum("own_n").over(higher) - F.col("own_n")).alias("n_above"))
    down = Window.partitionBy("range").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = g.join(F.broadcast(above), "range").withColumns({"tp": F.col("pos_above") + F.sum("pos").over(down), "called": F.col("n_above") + F.sum("n").over(down)}).withColumn("neg", F.col("n") - F.col("pos"))
    # of each score's negatives, the positives above and half of those at it rank before
    return c.agg(
        (F.sum(F.col("pos") * F.col("tp") / F.col("called")) / F.sum("pos")).alias("average_precision"),
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (F.sum("neg") * F.sum("pos"))).alias("roc_auc"),
        (F.sum("square") / F.sum("n")).alias("brier"),
    )


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("q")).agg(F.count("*").alias("n"))
    rows = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("q").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("x")).select("x.*")
    c = rows.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("called")), "recall": ratio(F.col("tp"), F.col("support"))})
    return c.select("c", "support", "precision", "recall", f_beta(F.col("precision"), F.col("recall"), 1.0).alias("f1"))


def stratified_split(df: DataFrame, stratum: str, key: str, shares: tuple[float, float] = (0.6, 0.2), buckets: int = 1024) -> DataFrame:
    """Adds `part`: train, validation or test, in exact shares of each stratum by the order of a hash of the key.

    The hash deals a stratum into buckets; a row's place is its place in its
    bucket behind the rows of the buckets before, so no task ranks a whole
    stratum. The buckets' counts are few whatever the rows, and are broadcast.
    """
    h = F.xxhash64(key)
    rows = df.withColumn("b__", F.floor((h / 2.0**63 + 1) * (buckets / 2)).cast("int"))
    counts = rows.groupBy(stratum, "b__").agg(F.count("*").alias("n__"))
    w = Window.partitionBy(stratum)
    counts = counts.select(F.col(stratum).alias("s__"), F.col("b__").alias("c__"), (F.sum("n__").over(w.orderBy("b__")) - F.col("n__")).alias("before__"), F.sum("n__").over(w).alias("all__"))
    rows = rows.join(F.broadcast(counts), F.col(stratum).eqNullSafe(F.col("s__")) & (F.col("b__") == F.col("c__")))
    place = (F.col("before__") + F.row_number().over(Window.partitionBy(stratum, "b__").orderBy(h, key))) / F.col("all__")
    part = F.when(place <= shares[0], "train").when(place <= sum(shares), "validation").otherwise("test")
    return rows.withColumn("part", part).select(*df.columns, "part")


def span_scores(gold: DataFrame, found: DataFrame, span: list[str], by: str) -> DataFrame:
    """(by, tp, gold, told, precision, recall, f1) of exactly equal spans; equal spans match one to one."""
    g = gold.groupBy(*span).agg(F.count("*").alias("g"))
    p = found.groupBy(*span).agg(F.count("*").alias("p"))
    both = g.join(p, span, "full").groupBy(by).agg(F.sum(F.coalesce(F.least("g", "p") * F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1), F.lit(0))).alias("tp"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("told"))
    both = both.withColumns({"precision": ratio(F.col("tp"), F.col("told")), "recall": ratio(F.col("tp"), F.col("gold"))})
    return both.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))


def class_overall(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """top1 and top2 accuracy, macro_f1 and weighted_f1, from one count of (truth, first, second)."""
    n = df.groupBy(truth, first, second).agg(F.count("*").alias("n"))
    top = n.agg((F.sum(F.when(F.col(truth) == F.col(first), F.col("n")).otherwise(0)) / F.sum("n")).alias("top1"), (F.sum(F.when((F.col(truth) == F.col(first)) | (F.col(truth) == F.col(second)), F.col("n")).otherwise(0)) / F.sum("n")).alias("top2"))
    per = class_metrics(df, truth, first)
    return top.crossJoin(per.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")))  # one row each


def span_scores_partial(gold: DataFrame, found: DataFrame, doc: str = "doc", label: str = "label") -> DataFrame:
    """(label, tp, gold, told, precision, recall, f1) of spans (doc, label, start, end) that overlap, each matched at most once.

    In each document and label, gold spans take in order of start (then end) the
    first overlapping span found that is still free. Rows are dealt by document
    and label and sorted by start; a task walks along them and keeps only the
    spans that have no partner yet and still reach beyond the place it is at, so
    what it keeps is as many spans as lie over each other. Empty spans overlap nothing.
    """
    tagged = [df.select(F.col(doc).alias("doc"), F.col(label).alias("label"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(kind).alias("kind")) for df, kind in ((gold, 0), (found, 1))]
    rows = tagged[0].unionByName(tagged[1]).withColumn("h", F.xxhash64("doc", "label"))
    rows = rows.repartition("h").sortWithinPartitions("h", "doc", "label", "start", "end", "kind")
    label_type = rows.schema["label"].dataType
    arrow_type = to_arrow_type(label_type)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, free = None, ([], [])
        seen: dict = {}
        for batch in batches:
            for d, name, start, end, kind in zip(*(batch.column(c).to_pylist() for c in ("doc", "label", "start", "end", "kind")), strict=True):
                if (d, name) != own:
                    own, free = (d, name), ([], [])
                counts = seen.setdefault(name, [0, 0, 0])
                counts[1 + kind] += 1
                if start >= end:
                    continue
                others = free[1 - kind]
                while others and others[0] <= start:  # sorted by start; what ends here meets nothing that comes
                    others.pop(0)
                partner = next((k for k, e in enumerate(others) if e > start), None)
                if partner is None:
                    free[kind].append(end)
                else:
                    others.pop(partner)
                    counts[0] += 1
        names = list(seen)
        columns = [pa.array([seen[n][k] for n in names], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(names, arrow_type), *columns], names=["label", "tp", "gold", "told"])

    both = rows.drop("h").mapInArrow(walk, f"label {label_type.simpleString()}, tp long, gold long, told long").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "gold", "told")))
    both = both.withColumns({"precision": ratio(F.col("tp"), F.col("told")), "recall": ratio(F.col("tp"), F.col("gold"))})
    return both.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (low, high, n, positives) in order of score, pooled until their rates rise."""
    out: list[list[float]] = []
    for low, high, n, positives in blocks:
        out.append([low, high, n, positives])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high, n, positives = out.pop()
            out[-1][1] = high
            out[-1][2] += n
            out[-1][3] += positives
    return out


BLOCK = "part int, low double, high double, n double, positives double"


def isotonic(scores: DataFrame, ranges: int = 64, together: int = 16) -> DataFrame:
    """(low, high, n, positives, rate): the rising steps that fit y best by least squares over p, lowest first by `low`.

    Rows of one score count together. Scores are dealt by ranges; each range is
    pooled by itself, in order, and then so many neighbouring ranges at a time,
    until one is left: pooling what is pooled gives the same steps. A task holds
    steps, not rows; noisy labels leave about the cube root of the rows of them.
    Null scores and labels take no part; without rows there are no steps.
    """
    columns = ("low", "high", "n", "positives")

    def table(part: int, own: list) -> dict:
        return {"part": pa.array([part] * len(own), pa.int32())} | {c: pa.array([b[k] for b in own], pa.float64()) for k, c in enumerate(columns)}

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = [], 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            own = pooled([*own, *zip(*(batch.column(c).to_pylist() for c in columns), strict=True)])
        yield pa.RecordBatch.from_pydict(table(part, own))

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("low")
        return pa.table(table(t.column("part")[0].as_py(), pooled(zip(*(t.column(c).to_pylist() for c in columns), strict=True))))

    by_score = scores.where("p IS NOT NULL AND y IS NOT NULL").groupBy(F.col("p").cast("double").alias("low")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("positives"))
    dealt = by_score.repartitionByRange(ranges, "low").sortWithinPartitions("low").select(F.spark_partition_id().alias("part"), "low", F.col("low").alias("high"), "n", "positives")
    steps = dealt.mapInArrow(pool, BLOCK)
    while ranges > 1:
        ranges = -(-ranges // together)
        steps = steps.withColumn("part", F.floor(F.col("part") / together).cast("int")).groupBy("part").applyInArrow(merge, BLOCK)
    return steps.select("low", "high", "n", "positives", (F.col("positives") / F.col("n")).alias("rate"))


#: Equal parts of the scores' range in which rows and steps meet.
CELLS = 1024


def isotonic_rates(df: DataFrame, steps: DataFrame) -> DataFrame:
    """df with p replaced by the rate of the fitted steps: between two steps along the line, beyond the ends the nearest. Null scores stay null.

    Rows and steps meet in cells of the scores' range, and a step is in the cells from its own low to the next one's.
    """
    following = F.lead(F.struct("low", "rate")).over(Window.orderBy("low"))  # steps, not rows
    cell = lambda p: F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(p * CELLS).cast("int")))
    known = steps.withColumn("next", following).withColumn("before", F.lag("low").over(Window.orderBy("low")))
    known = known.select(
        F.when(F.col("before").isNull(), F.lit(float("-inf"))).otherwise(F.col("low")).alias("from__"), F.coalesce("next.low", F.lit(float("inf"))).alias("to__"), F.col("high").alias("high__"), F.col("rate").alias("rate__"), F.col("next").alias("next__")
    ).withColumn("cell__", F.explode(F.sequence(F.when(F.col("from__") == float("-inf"), 0).otherwise(cell(F.col("from__"))), F.when(F.col("to__") == float("inf"), CELLS - 1).otherwise(cell(F.col("to__"))))))
    score = F.col("p").cast("double")
    met = df.withColumn("cell__", cell(score)).alias("d").join(known.alias("k"), (F.col("d.cell__") == F.col("k.cell__")) & (score >= F.col("from__")) & (score < F.col("to__")), "left")
    slope = (F.col("next__.rate") - F.col("rate__")) / (F.col("next__.low") - F.col("high__"))
    rate = F.when((score <= F.col("high__")) | F.col("next__").isNull(), F.col("rate__")).otherwise(F.col("rate__") + slope * (score - F.col("high__")))
    return met.select(*(rate.alias("p") if c == "p" else F.col(f"d.{c}") for c in df.columns))
