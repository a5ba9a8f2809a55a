"""Trained models: family attribution with an open set, the boosted static gate, the n-gram model table, folds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluation import hash_ranked
from .tokens import api_ngrams, document_frequencies, tfidf

CELLS = 1 << 18


class FamilyModel:
    """Multinomial regression over hashed, binary, normalised tokens."""

    def __init__(self, index: StringIndexerModel, regression: LogisticRegressionModel, cells: int):
        self.index, self.regression, self.cells = index, regression, cells

    @staticmethod
    def features(rows: DataFrame, cells: int) -> DataFrame:
        hashed = HashingTF(inputCol="tokens", outputCol="__tf", numFeatures=cells, binary=True).transform(rows)
        return Normalizer(inputCol="__tf", outputCol="__features", p=2.0).transform(hashed)

    @classmethod
    def fit(cls, rows: DataFrame, c: float = 10.0, cells: int = CELLS, rounds: int = 100) -> "FamilyModel":
        """``rows``: (tokens, family). The penalty is the inverse of ``c`` times the number of rows."""
        n = rows.count()
        index = StringIndexer(inputCol="family", outputCol="__label", stringOrderType="alphabetAsc").fit(rows)
        made = cls.features(index.transform(rows), cells)
        regression = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=rounds)
        return cls(index, regression.fit(made), cells)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add family and confidence, the most probable of the known families."""
        names = F.array(*map(F.lit, self.index.labels))
        scored = self.regression.transform(self.features(rows, self.cells)).withColumn("__p", vector_to_array("__probability"))
        best = F.array_max("__p")
        return scored.withColumns({"confidence": best, "family": F.get(names, F.array_position("__p", best).cast("int") - 1)}).drop("__tf", "__features", "__raw", "__probability", "__prediction", "__p")


    def explain(self, rows: DataFrame, k: int = 8) -> DataFrame:
        """(run_id, family, rank, token, impact): of (run_id, tokens, family) the tokens that speak most for the family.

        A token's impact is its coefficient over the root of the number of distinct tokens, rounded to 4.
        """
        spark, cells = rows.sparkSession, self.cells
        matrix = self.regression.coefficientMatrix.toArray()
        if len(matrix) == 1:  # two families: one row of coefficients, for the second against the first
            matrix = [-matrix[0], matrix[0]]
        names = self.index.labels
        at = [np.flatnonzero(row) for row in matrix]
        table = pd.DataFrame({"cell": np.concatenate(at).astype(np.int32), "family": np.repeat(names, [len(a) for a in at]), "coefficient": np.concatenate([row[a] for row, a in zip(matrix, at)])})
        weights = spark.createDataFrame(table, "cell int, family string, coefficient double")  # by column, as the model itself is held: cells times families at most
        own = rows.select("run_id", "family", F.array_distinct("tokens").alias("tokens")).withColumn("root", F.sqrt(F.size("tokens")))
        tokens = own.select("run_id", "family", "root", F.explode("tokens").alias("token"))
        distinct = tokens.select(F.array("token").alias("tokens"), "token").distinct()
        hashed = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=cells, binary=True).transform(distinct).select("token", one_cell(F.col("tf")).alias("cell"))
        scored = tokens.join(hashed, "token").join(weights, ["cell", "family"], "left")
        scored = scored.withColumn("impact", F.coalesce("coefficient", F.lit(0.0)) / F.col("root"))
        rank = F.row_number().over(Window.partitionBy("run_id", "family").orderBy(F.desc("impact"), "token"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("run_id", "family", "rank", "token", F.round("impact", 4).alias("impact"))

    def save(self, path: str) -> None:
        self.index.write().overwrite().save(f"{path}/families")
        self.regression.write().overwrite().save(f"{path}/regression")

    @classmethod
    def load(cls, path: str) -> "FamilyModel":
        regression = LogisticRegressionModel.load(f"{path}/regression")
        return cls(StringIndexerModel.load(f"{path}/families"), regression, regression.numFeatures)


def one_cell(vector: Column) -> Column:
    """The cell of a vector that has one entry."""
    return F.get_json_object(F.to_json(F.struct(vector.alias("v"))), "$.v.indices[0]").cast("int")


def open_set(family: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """The family from the threshold on, else the closest named as unknown."""
    return F.when(confidence >= threshold, family).otherwise(F.concat(F.lit("unknown (closest: "), family, F.lit(")")))


def fit_gate(rows: DataFrame, rounds: int = 30, depth: int = 5, features: str = "features", label: str = "label") -> GBTClassificationModel:
    """Boosted trees over an array of features: the substitute for a gradient-boosting library that is not at hand."""
    made = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("__features"))
    return GBTClassifier(featuresCol="__features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7).fit(made)


def gate_scores(model: GBTClassificationModel, rows: DataFrame, features: str = "features") -> DataFrame:
    scored = model.transform(rows.withColumn("__features", array_to_vector(features)))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("__features", "rawPrediction", "probability", "prediction")


@F.udf(VectorUDT())
def sparse(entries, size):
    """A sparse vector of (cell, value) pairs, one row of a run at a time."""
    return Vectors.sparse(size, sorted((e["cell"], e["value"]) for e in entries))


def fit_ngrams(calls: DataFrame, labels: DataFrame, min_df: int = 2, penalty: float = 0.01, cells: int = 1 << 20) -> tuple[DataFrame, float]:
    """(model table (token, idf, weight), intercept): TF-IDF of API n-grams and logistic regression over hashed, sparse cells.

    Every n-gram of ``min_df`` runs counts, however many there are; those that share one of the ``cells`` share its weight.
    """
    tf = api_ngrams(calls)
    idf = document_frequencies(tf, min_df).withColumn("cell", F.pmod(F.xxhash64("token"), F.lit(cells)).cast("int"))
    summed = tfidf(tf, idf).join(idf.select("token", "cell"), "token").groupBy("run_id", "cell").agg(F.sum("value").alias("value"))
    vectors = summed.groupBy("run_id").agg(F.collect_list(F.struct("cell", "value")).alias("v"))
    made = vectors.join(labels.select("run_id", "label"), "run_id").select(F.col("label").cast("double").alias("label"), sparse("v", F.lit(cells)).alias("features"))
    model = LogisticRegression(regParam=penalty, maxIter=50, standardization=False).fit(made)
    learned = model.coefficients.toArray()
    at = np.flatnonzero(learned)
    weights = idf.sparkSession.createDataFrame(pd.DataFrame({"cell": at.astype(np.int32), "weight": learned[at]}), "cell int, weight double")  # by column, ``cells`` at most
    return idf.join(weights, "cell", "left").select("token", "idf", F.coalesce("weight", F.lit(0.0)).alias("weight")), float(model.intercept)


def save_ngrams(model: DataFrame, intercept: float, path: str) -> None:
    """The model table and its intercept as Parquet, one folder."""
    model.withColumn("intercept", F.lit(intercept)).write.mode("overwrite").parquet(path)


def load_ngrams(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    rows = spark.read.parquet(path)
    first = rows.select("intercept").first()
    return rows.select("token", "idf", "weight"), float(first["intercept"]) if first else 0.0


def save_gate(model: GBTClassificationModel, threshold: float, path: str) -> None:
    model.write().overwrite().save(f"{path}/trees")
    model_spark().createDataFrame([(threshold,)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_gate(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, float]:
    return GBTClassificationModel.load(f"{path}/trees"), spark.read.json(f"{path}/meta").first()["threshold"]


def model_spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold``: stratified by label, by hash of the key, so the same on every run."""
    return hash_ranked(rows, label, key, seed, "__rank").withColumn("fold", (F.col("__rank") - 1) % k).drop("__rank")


def leave_one_out(rows: DataFrame, by: str, fit, score) -> DataFrame:
    """For each value of ``by`` (a few: families) a model of the other rows scores its rows: score(model, rows), all united."""
    names = [r[0] for r in rows.select(by).distinct().orderBy(by).limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError(f"more than 1000 values of {by}: each takes a model of its own")
    parts = [score(fit(rows.where(F.col(by) != name)), rows.where(F.col(by) == name)) for name in names]
    return reduce(DataFrame.unionByName, parts)
