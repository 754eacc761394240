"""Learned text classifiers on pyspark.ml, and their calibration."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, SQLTransformer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def terms_sql(chars: tuple[int, int] | None) -> str:
    """SQL of a text's terms from its `words__` and `pairs__`: these, and n-grams of the characters of each word between blanks, marked by a leading ~."""
    if chars is None:
        return "concat(words__, pairs__)"
    least, most = chars
    grams = f"transform(filter(sequence({least}, {most}), n -> n <= length(w)), n -> transform(sequence(1, length(w) + 1 - n), k -> concat('~', substring(w, k, n))))"
    return f"concat(words__, pairs__, flatten(flatten(transform(transform(filter(words__, w -> w <> ''), w -> concat(' ', w, ' ')), w -> {grams}))))"


def text_classifier(train: DataFrame, text: str = "text", label: str = "y", features: int = 1 << 16, regularisation: float = 1e-3, chars: tuple[int, int] | None = None) -> PipelineModel:
    """TF-IDF over words, pairs of words and, if asked for, n-grams of characters, and a logistic regression with balanced class weights.

    Features are hashed, so no vocabulary is gathered.
    """
    rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    stages = [
        Tokenizer(inputCol=text, outputCol="words__"),
        NGram(n=2, inputCol="words__", outputCol="pairs__"),
        SQLTransformer(statement=f"SELECT *, {terms_sql(chars)} AS terms__ FROM __THIS__"),
        HashingTF(numFeatures=features, inputCol="terms__", outputCol="tf__"),
        IDF(inputCol="tf__", outputCol="tfidf__"),
        LogisticRegression(featuresCol="tfidf__", labelCol=label, weightCol="weight__", regParam=regularisation, maxIter=20, probabilityCol="probability__", rawPredictionCol="raw__", predictionCol="prediction__"),
    ]
    weight = F.when(F.col(label) == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9))
    counting = PipelineModel(stages[:-2])
    counts = counting.transform(train.where(F.col(text).isNotNull()).withColumn("weight__", weight)).select(label, "weight__", "tf__")
    # both fits read the counts, one of them twice
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*counting.stages, *Pipeline(stages=stages[-2:]).fit(counts).stages])
    finally:
        counts.unpersist()


def scored(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """df with `raw` (log odds) and `p` of class 1; a null text counts as empty."""
    out = model.transform(df.withColumn(text, F.coalesce(text, F.lit(""))))
    return out.withColumns({"raw": vector_to_array("raw__")[1], "p": vector_to_array("probability__")[1]}).select(*df.columns, "raw", "p")


def calibrated(held_out: DataFrame, df: DataFrame, label: str = "y") -> DataFrame:
    """df with p recalibrated by a one-dimensional logistic regression (Platt) on held-out raw scores."""
    as_vector = lambda x: x.withColumn("raw_vector__", array_to_vector(F.array("raw")))
    model = LogisticRegression(featuresCol="raw_vector__", labelCol=label, probabilityCol="probability__", rawPredictionCol="raw__", predictionCol="prediction__").fit(as_vector(held_out))
    return model.transform(as_vector(df)).withColumn("p", vector_to_array("probability__")[1]).select(df.columns)


def uses_of(model: PipelineModel, df: DataFrame, features: list[int], text: str = "text") -> DataFrame:
    """(feature, term, uses) of the terms that fall into the features, counted over all texts as the model counts them.

    N-grams of characters are made of the distinct words, not of every use of a
    word, and pairs of words are counted only where their feature is asked for.
    """
    hashing = next(s for s in model.stages if isinstance(s, HashingTF))
    terms = next(s for s in model.stages if isinstance(s, SQLTransformer))
    split = PipelineModel(model.stages[: model.stages.index(terms)]).transform(df.select(F.coalesce(text, F.lit("")).alias(text)))
    words = split.select(F.explode_outer("words__").alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    # a text of one word has the terms that each use of the word adds to a text
    alone = words.where("word <> ''").select("uses", F.array("word").alias("words__"), F.array().cast("array<string>").alias("pairs__"))
    of_words = terms.transform(alone).select(F.explode_outer("terms__").alias("term"), "uses").groupBy("term").agg(F.sum("uses").alias("uses"))
    pairs = split.select(F.explode_outer("pairs__").alias("term"), F.lit(1).cast("long").alias("uses")).where("term IS NOT NULL")
    # a term's sparse vector holds its feature as the only index: no vector of all features is made for a term
    placed = lambda x: hashing.transform(x.withColumn("terms__", F.array("term"))).select(F.unwrap_udt("tf__")["indices"][0].alias("feature"), "term", "uses").where(F.col("feature").isin(features))
    return placed(of_words).unionByName(placed(pairs)).groupBy("feature", "term").agg(F.sum("uses").alias("uses"))


def top_terms(model: PipelineModel, train: DataFrame, top: int = 15, shown: int = 5, text: str = "text") -> DataFrame:
    """(side, rank, coefficient, n_terms, terms): the features of greatest and least coefficient, with the terms that hash to them.

    Only features that terms of the texts fall into count. The coefficients are
    as many as the features, whatever the texts; terms are looked up for the top
    features alone. A feature shows its most used terms first, then by name, and how many more
    it has; equal coefficients go by their first term.
    """
    spark = train.sparkSession
    weights = {k: float(w) for k, w in enumerate(model.stages[-1].coefficients.toArray()) if w}
    # the features up to the top coefficients, with all that equal the last of them, until their terms tell which come first;
    # one more, since the empty word, which is no term, may have a feature of its own
    sides = {"positive": F.desc("coefficient"), "negative": F.asc("coefficient")}
    ends = sorted(weights.values())
    best = [(k, w) for k, w in weights.items() if w >= ends[-top - 1 :][0] or w <= ends[: top + 1][-1]]
    uses = uses_of(model, train, [k for k, _ in best], text)
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("uses"), "term"))
    own = uses.withColumn("place", place).groupBy("feature").agg(F.count("*").alias("n_terms"), F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "term")))).alias("terms"))
    own = own.join(spark.createDataFrame(best, "feature int, coefficient double"), "feature").withColumn("terms", F.transform("terms", lambda x: x["term"]))
    own = stored(own, "top-terms")
    ranked = [own.withColumn("rank", F.row_number().over(Window.orderBy(key, F.col("terms")[0]))).where(F.col("rank") <= top).withColumn("side", F.lit(side)) for side, key in sides.items()]
    return ranked[0].unionByName(ranked[1]).select("side", "rank", "coefficient", "n_terms", "terms")
