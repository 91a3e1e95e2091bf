"""Text and URL classifiers trained and scored as Spark ML pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatlake import fixed_values_phishing as P
from threatlake.operators.trees import margin, node_table, probability
from threatlake.operators.urls import feature_vector


WORD = r"\W+"


class TextModel:
    """Word TF-IDF of unit length, linear SVM, and a logistic calibration of its margin."""

    def __init__(self, features: PipelineModel, svm, platt) -> None:
        self.features, self.svm, self.platt = features, svm, platt

    def term_weights(self, spark: SparkSession) -> DataFrame:
        """``term, idf, weight`` of the vocabulary: how much an occurrence counts, and what a unit of it adds to the margin. At most ``dims`` rows."""
        words, idf = self.features.stages[1].vocabulary, self.features.stages[2].idf.toArray()
        return spark.createDataFrame(list(zip(words, idf.tolist(), self.svm.coefficients.toArray().tolist())), "term string, idf double, weight double")

    def probability_by_terms(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """``key, probability`` as a sparse product: words joined with their weights, summed per row. The table of weights is bounded by the
        vocabulary, so it is broadcast. Keys must be distinct."""
        weights = self.term_weights(df.sparkSession)
        words = df.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD)).alias("term")).where("term <> ''")
        counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(weights), "term")
        value = F.col("_n") * F.col("idf")
        sums = counts.groupBy(key).agg((F.sum(value * F.col("weight")) / F.sqrt(F.sum(value * value))).alias("_m"))
        total = F.coalesce("_m", F.lit(0.0)) + self.svm.intercept
        scaled = float(self.platt.coefficients[0]) * total + self.platt.intercept
        return df.select(key).join(sums, key, "left").select(key, (1 / (1 + F.exp(-scaled))).alias("probability"))

    def probability(self, df: DataFrame, text: str = "text", out: str = "probability") -> DataFrame:
        margins = _margin(self.svm.transform(self.features.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))))
        scored = self.platt.transform(margins)
        return scored.withColumn(out, vector_to_array("_p")[1]).drop(
            "_text", "_words", "_tf", "_idf", "_x", "_raw", "_pred", "_m", "_mraw", "_p", "_mpred"
        )


def _margin(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    df = df.withColumn("_m0", vector_to_array("_raw")[1])
    return VectorAssembler(inputCols=["_m0"], outputCol="_m").transform(df).drop("_m0")


def fit_text_model(df: DataFrame, text: str = "text", label: str = "label", dims: int = 1 << 16, seed: int = 42) -> TextModel:
    """Fit on labelled text (1 = phishing); the calibration uses rows held out from the SVM."""
    data = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("_text", F.lit(seed)), F.lit(5))
    features = Pipeline(
        stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=WORD),
            CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=dims, minDF=3),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_x"),
        ]
    ).fit(data)
    ready = features.transform(data.withColumn("_fold", fold)).select("_x", "label", "_fold")
    svm = LinearSVC(featuresCol="_x", rawPredictionCol="_raw", predictionCol="_pred", regParam=0.001, maxIter=30).fit(ready.where("_fold <> 0"))
    held = _margin(svm.transform(ready.where("_fold = 0")))
    platt = LogisticRegression(featuresCol="_m", rawPredictionCol="_mraw", probabilityCol="_p", predictionCol="_mpred").fit(held)
    return TextModel(features, svm, platt)


def score_text(df: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """Add ``probability`` (4 decimals), ``prediction`` and ``risk``; empty text is UNKNOWN."""
    low, high = P.MODEL_BANDS
    df = model.probability(df, text)
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    p = F.col("probability")
    return df.withColumns(
        {
            "prediction": F.when(empty, "UNKNOWN").when(p < low, "LEGITIMATE").when(p < high, "SUSPICIOUS").otherwise("PHISHING"),
            "risk": F.when(empty, "UNKNOWN").when(p < low, "LOW").when(p < high, "SUSPICIOUS").otherwise("HIGH"),
            "probability": F.when(empty, 0.0).otherwise(F.round(p, 4)),
        }
    )


def text_report(model: TextModel, held_out: DataFrame, label: str = "label", threshold: float = P.MODEL_BANDS[0]) -> DataFrame:
    """Per class of held-out rows: support, and precision, recall and F1 of calling phishing what reaches ``threshold``."""
    scored = model.probability(held_out).withColumn("prediction", F.when(F.col("probability") >= threshold, 1.0).otherwise(0.0))
    return class_report(scored.select(F.col(label).cast("double").alias("label"), "prediction"))


def ranking(model: TextModel, held_out: DataFrame, label: str = "label") -> float:
    """Area under the ROC curve of held-out rows."""
    scored = model.probability(held_out).select(F.col(label).cast("double").alias("label"), F.col("probability").alias("p"))
    return BinaryClassificationEvaluator(rawPredictionCol="p").evaluate(scored)


def fit_url_model(df: DataFrame, label: str = "label", trees: int = 200, depth: int = 3, seed: int = 42, held_out: Column | None = None):
    """Boosted trees on the sixteen URL features; returns the model and the held-out report.

    By default a fifth of the rows is held out by a hash of the features, so the split does not depend on partitioning.
    """
    part = F.pmod(F.xxhash64(*P.FEATURE_ORDER, F.lit(seed)), F.lit(5)) == 0 if held_out is None else held_out
    data = feature_vector(df.withColumns({"label": F.col(label).cast("double"), "_held": part}))
    data = data.select("features", "label", "_held", *P.FEATURE_ORDER)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(data.where(~F.col("_held")).select("features", "label"))
    return model, class_report(score_url(model, data.where("_held")))


def score_url(model, df: DataFrame) -> DataFrame:
    """Add ``probability`` and ``prediction`` by following the ensemble's nodes, from the sixteen feature columns."""
    nodes = node_table(model, df.sparkSession).collect()  # trees times at most 2 ** (depth + 1) rows
    p = probability(margin(nodes, lambda i: F.col(P.FEATURE_ORDER[i]).cast("double")))
    return df.withColumn("probability", p).withColumn("prediction", F.when(F.col("probability") > 0.5, 1.0).otherwise(0.0))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from one aggregation of the confusion counts."""
    cells = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    named = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    r = actual.join(named, "class", "left")
    precision, recall = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    r = r.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return r.select("class", "precision", "recall", f1.alias("f1"), "support")
