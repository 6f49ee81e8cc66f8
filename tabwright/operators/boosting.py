"""Gradient boosting with joint probabilities for several classes, from Spark's regression trees."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.storage import written

#: Rounds after which the margins are written, which bounds what a lost executor has to repeat.
ROUNDS_PER_WRITE = 10
#: Least sum of ``|r| (1 - |r|)`` by which a Newton step divides, and least share of a class.
LEAST = 1e-15


class _Boosting(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class number", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds, each of one tree per class", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's step that is taken", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the trees", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the trees", TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "how many rows a row stands for, 1 if not set", TypeConverters.toString)

    def get(self, name: str):
        return self.getOrDefault(name)


def softmax(margins: Column) -> Column:
    """Probabilities that add up to 1; the largest margin is taken off first, so nothing overflows."""
    odds = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def _tree(node, values: list[float]) -> object:
    """A fitted tree with the leaves, from left to right, holding ``values``: a number, or feature, test, left and right."""
    if node.subtreeDepth() == 0:
        return values.pop(0)
    split = node.split()
    if split.getClass().getSimpleName() == "CategoricalSplit":
        test = [float(c) for c in split.leftCategories()]
    else:
        test = float(split.threshold())
    return [int(split.featureIndex()), test, _tree(node.leftChild(), values), _tree(node.rightChild(), values)]


def _leaves(node) -> int:
    return 1 if node.subtreeDepth() == 0 else _leaves(node.leftChild()) + _leaves(node.rightChild())


def _add(tree, features: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Add the leaf values of ``tree`` to ``out`` at ``rows``."""
    if not len(rows):
        return
    if isinstance(tree, float):
        out[rows] += tree
        return
    feature, test, left, right = tree
    x = features[rows, feature]
    goes = np.isin(x, test) if isinstance(test, list) else x <= test
    _add(left, features, rows[goes], out)
    _add(right, features, rows[~goes], out)


class SoftmaxBoosting(Estimator, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting that minimises the multinomial log loss, so a row's class probabilities add up to 1.

    Margins start at the logarithms of the class shares. In every round each class gets one regression tree on its residuals (1 or 0, less
    the probability); a leaf's value is the Newton step ``(K - 1) / K * sum(r) / sum(|r| (1 - |r|))``, of which ``stepSize`` is taken. All
    trees of a round see the same probabilities. The leaf sums of all classes come from one aggregation per round; what reaches the driver
    are trees and leaf sums, at most ``2 ** maxDepth`` per class. Margins travel with the rows as one array and are written every
    ``ROUNDS_PER_WRITE`` rounds.

    A row with a weight counts as that many equal rows. Rows without a label are left out. A class without rows keeps the smallest share. An empty table is refused.
    """

    @keyword_only
    def __init__(self, *, numClasses=2, maxIter=100, stepSize=0.1, maxDepth=3, maxBins=32, seed=42, featuresCol="features", labelCol="label", weightCol=None):
        super().__init__()
        self._setDefault(numClasses=2, maxIter=100, stepSize=0.1, maxDepth=3, maxBins=32, seed=42, featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        label, classes, rounds = self.get("labelCol"), self.get("numClasses"), self.get("maxIter")
        weight = F.col(self.get("weightCol")).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = df.select(F.col(self.get("featuresCol")).alias("features"), F.col(label).cast("double").alias("y"), weight.alias("w")).where(F.col("y").isNotNull())
        counts = rows.agg(F.coalesce(F.sum("w"), F.lit(0.0)), *[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)) for k in range(classes)]).first()
        if not counts[0]:
            raise ValueError("no row has a label")
        start = [float(np.log(max(n / counts[0], LEAST))) for n in counts[1:]]
        state = rows.withColumn("margins", F.array(*map(F.lit, start))).persist(StorageLevel.MEMORY_AND_DISK)
        trees, importances = [], None
        for turn in range(rounds):
            fitted = self._round(state)
            values = self._leaf_values(state, fitted)
            trees.append([_tree(m._java_obj.rootNode(), list(v)) for m, v in zip(fitted, values)])
            found = sum(m.featureImportances.toArray() for m in fitted)
            importances = found if importances is None else importances + found
            if turn + 1 < rounds:
                state = self._advanced(state, fitted, values, turn)
        state.unpersist()
        return SoftmaxBoostingModel(start=start, trees=json.dumps(trees), importances=[] if importances is None else importances.tolist(),
                                    stepSize=self.get("stepSize"), featuresCol=self.get("featuresCol"))

    def _round(self, state: DataFrame) -> list:
        """One tree per class on the residuals of ``state``."""
        probability = softmax(F.col("margins"))
        residuals = F.transform(probability, lambda p, k: F.when(F.col("y") == k, 1.0).otherwise(0.0) - p)
        turned = state.withColumn("residuals", residuals)
        learner = DecisionTreeRegressor(featuresCol="features", labelCol="residual", weightCol="w", maxDepth=self.get("maxDepth"), maxBins=self.get("maxBins"), seed=self.get("seed"))
        return [learner.fit(turned.select("features", "w", F.col("residuals")[k].alias("residual"))) for k in range(self.get("numClasses"))]

    def _with_leaves(self, state: DataFrame, fitted: list) -> DataFrame:
        """Add ``leaves``: the leaf, counted from the left, of a row in every class's tree."""
        own = state.columns
        for k, model in enumerate(fitted):
            state = model.setLeafCol(f"leaf_{k}").setPredictionCol("").transform(state)
        return state.select(*own, F.array(*[F.col(f"leaf_{k}").cast("int") for k in range(len(fitted))]).alias("leaves"))

    def _leaf_values(self, state: DataFrame, fitted: list) -> list[list[float]]:
        """Newton steps of every leaf of every class."""
        parts = F.arrays_zip(softmax(F.col("margins")).alias("p"), F.col("leaves"))
        each = self._with_leaves(state, fitted).select("y", "w", F.posexplode(parts).alias("k", "x")).select("k", "w", F.col("x.leaves").alias("leaf"), (
            F.when(F.col("y") == F.col("k"), 1.0).otherwise(0.0) - F.col("x.p")).alias("r"))
        sums = each.groupBy("k", "leaf").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.sum(F.col("w") * F.abs("r") * (1 - F.abs("r"))).alias("h")).collect()
        values = [[0.0] * _leaves(m._java_obj.rootNode()) for m in fitted]
        for s in sums:
            if s["h"] > LEAST:
                values[s["k"]][s["leaf"]] = (len(fitted) - 1) / len(fitted) * s["r"] / s["h"]
        return values

    def _advanced(self, state: DataFrame, fitted: list, values: list[list[float]], turn: int) -> DataFrame:
        """``state`` with the steps of a round added to its margins."""
        steps = F.array(*[F.array(*[F.lit(self.get("stepSize") * v) for v in of_class]) for of_class in values])
        moved = F.transform("margins", lambda m, k: m + steps[k][F.col("leaves")[k]])
        following = self._with_leaves(state, fitted).select("features", "y", "w", moved.alias("margins"))
        if turn % ROUNDS_PER_WRITE == ROUNDS_PER_WRITE - 1:
            following = written(following, "boosting")
        following = following.persist(StorageLevel.MEMORY_AND_DISK)
        following.count()
        state.unpersist()
        return following


class SoftmaxBoostingModel(Model, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``. The trees are one JSON document, so the model is saved with its parameters."""

    start = Param(Params._dummy(), "start", "margins before the first round", TypeConverters.toListFloat)
    trees = Param(Params._dummy(), "trees", "trees per round and class, as JSON", TypeConverters.toString)
    importances = Param(Params._dummy(), "importances", "summed importance per feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, start=None, trees="[]", importances=None, stepSize=0.1, featuresCol="features"):
        super().__init__()
        self._setDefault(start=[], trees="[]", importances=[], stepSize=0.1, featuresCol="features")
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:
        """Importance per feature, adding up to 1 (zeros where no tree splits)."""
        sums = np.array(self.get("importances"))
        return Vectors.dense(sums / sums.sum() if sums.sum() > 0 else sums)

    def _transform(self, df: DataFrame) -> DataFrame:
        start, step = np.array(self.get("start")), self.get("stepSize")
        trees = json.loads(self.get("trees"))

        @F.pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            matrix = np.stack(features.to_numpy()) if len(features) else np.empty((0, 0))
            out, rows = np.tile(start, (len(matrix), 1)), np.arange(len(matrix))
            for of_round in trees:
                for k, tree in enumerate(of_round):
                    sums = np.zeros(len(matrix))
                    _add(tree, matrix, rows, sums)
                    out[:, k] += step * sums
            return pd.Series(list(out))

        raw = F.col("rawPrediction")
        best = F.array_position(vector_to_array(raw), F.array_max(vector_to_array(raw)))
        return df.withColumn("rawPrediction", array_to_vector(margins(vector_to_array(self.get("featuresCol"))))).withColumns(
            {"probability": array_to_vector(softmax(vector_to_array(raw))), "prediction": (best - 1).cast("double")})
