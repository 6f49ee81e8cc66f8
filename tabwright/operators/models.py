"""Learners under one registry, with the usual penalty conventions on top of Spark ML."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.boosting import SoftmaxBoosting

#: Spark's limit on tree depth, used when no depth is asked for. The driver holds all trees, and so deep ones grow with the
#: rows: ``max_depth``, ``min_instances`` (rows per leaf) and ``subsampling_rate`` bound them on large tables.
DEEPEST = 30
#: Most features of Spark's solver of normal equations.
MOST_MOMENTS = 4_096
#: Most classes that are weighted.
MOST_CLASSES = 10_000
CLASSIFIERS = ("logreg_l2", "logreg_l1", "rf", "gbr", "gbr_one_vs_rest")
REGRESSORS = ("linear", "ridge", "lasso", "elasticnet", "rf", "gbr")


class _Supervised(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "numeric label", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "convergence tolerance", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "how many rows a row stands for, 1 if not set", TypeConverters.toString)

    def get(self, name: str):
        return self.getOrDefault(name)


def class_weights(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class). A row stands for ``weight`` rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("weight", totals["n"] / (totals["k"] * F.col("n")))


def _weight_expression(df: DataFrame, label: str, weight: str | None):
    """Balanced weights as a literal map, of at most ``MOST_CLASSES`` classes."""
    found = class_weights(df, label, weight).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label!r} has more than {MOST_CLASSES} values, too many for classes")
    pairs = [F.lit(float(x)) for r in found for x in (r[label], r["weight"])]
    return F.create_map(*pairs)[F.col(label).cast("double")]


class PenalisedLogistic(Estimator, _Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression minimising ``C * sum(loss) + penalty``, binary or multinomial.

    Spark minimises the mean loss plus ``regParam`` times the penalty, so ``regParam`` is
    ``1 / (C n)`` with the rows of the fit at hand.
    """

    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    balanced = Param(Params._dummy(), "balanced", "weight classes equally", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, C=1.0, penalty="l2", balanced=False, featuresCol="features", labelCol="label",
                 maxIter=5000, tol=1e-6, weightCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(C=1.0, penalty="l2", balanced=False, featuresCol="features", labelCol="label",
                         maxIter=5000, tol=1e-6)

    def _fit(self, df: DataFrame):
        label, weight = self.get("labelCol"), self.get("weightCol") if self.isDefined("weightCol") else None
        rows = (df.agg(F.sum(weight)).first()[0] or 0) if weight else df.count()
        learner = LogisticRegression(
            featuresCol=self.get("featuresCol"), labelCol=label, maxIter=self.get("maxIter"),
            tol=self.get("tol"), standardization=False, regParam=1.0 / (self.get("C") * max(rows, 1)),
            elasticNetParam=1.0 if self.get("penalty") == "l1" else 0.0)
        if self.get("balanced"):
            balance = _weight_expression(df, label, weight)
            df = df.withColumn("_weight", balance * F.col(weight) if weight else balance)
            learner.setWeightCol("_weight")
        elif weight:
            learner.setWeightCol(weight)
        return learner.fit(df)


class PenalisedLinear(Estimator, _Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """Linear regression under the three usual penalty conventions.

    ridge: ``sum(err^2) + alpha |w|^2``; lasso and elastic net: ``sum(err^2) / 2n + alpha (r |w|_1 +
    (1 - r) |w|^2 / 2)``. Spark rescales the label by its deviation, which the squared part of the penalty has to
    follow. Up to ``MOST_MOMENTS`` features are solved from one pass over the rows.
    """

    kind = Param(Params._dummy(), "kind", "linear, ridge, lasso or elasticnet", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    l1_ratio = Param(Params._dummy(), "l1_ratio", "share of the absolute penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, kind="linear", alpha=1.0, l1_ratio=0.5, featuresCol="features", labelCol="label",
                 maxIter=2000, tol=1e-10):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(kind="linear", alpha=1.0, l1_ratio=0.5, featuresCol="features", labelCol="label",
                         maxIter=2000, tol=1e-10)

    def _fit(self, df: DataFrame):
        label, kind, alpha = self.get("labelCol"), self.get("kind"), self.get("alpha")
        features = self.get("featuresCol")
        first = df.select(features).first()
        one_pass = first is not None and first[0].size <= MOST_MOMENTS
        # The solver of normal equations rescales by the population deviation, the iterative one by that of a sample.
        n, spread = df.agg(F.count(F.lit(1)), (F.stddev_pop if one_pass else F.stddev_samp)(label)).first()
        spread = spread or 0.0
        if kind == "linear" or alpha == 0.0 or spread == 0.0:
            l1, l2 = 0.0, 0.0
        elif kind == "ridge":
            l1, l2 = 0.0, alpha * spread / n
        elif kind == "lasso":
            l1, l2 = alpha, 0.0
        elif kind == "elasticnet":
            l1, l2 = alpha * self.get("l1_ratio"), alpha * (1.0 - self.get("l1_ratio")) * spread
        else:
            raise ValueError(f"unknown kind {kind!r}")
        strength = l1 + l2
        return LinearRegression(
            featuresCol=features, labelCol=label, maxIter=self.get("maxIter"),
            tol=self.get("tol"), standardization=False, regParam=strength,
            elasticNetParam=l1 / strength if strength else 0.0,
            solver="auto" if not strength else "normal" if one_pass else "l-bfgs").fit(df)


def weighs(name: str, params: Mapping | None = None) -> bool:
    """Whether a row that stands for several equal ones serves a learner as well as these.

    Not where rows are drawn or counted one by one, nor for linear learners, whose labels rarely repeat.
    """
    p = dict(params or {})
    if name == "rf":
        least = int(p.get("min_instances", max(1, int(p.get("min_samples_split", 2)) // 2)))
        return not p.get("bootstrap", True) and float(p.get("subsampling_rate", 1.0)) == 1.0 and least <= 1
    return name in ("logreg_l2", "logreg_l1", "gbr", "gbr_one_vs_rest")


def _depth(value) -> int:
    return DEEPEST if value is None else int(value)


def build_classifier(name: str, params: Mapping | None = None, classes: int = 2, seed: int = 42,
                     features: str = "features", label: str = "label", max_bins: int = 32) -> Estimator:
    p = dict(params or {})
    columns = {"featuresCol": features, "labelCol": label}
    if name in ("logreg_l2", "logreg_l1"):
        return PenalisedLogistic(C=float(p.get("C", 1.0)), penalty=name[-2:],
                                 balanced=p.get("class_weight") == "balanced", **columns,
                                 maxIter=int(p.get("max_iter", 5000)), tol=float(p.get("tol", 1e-6)))
    if name == "rf":
        return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth")),
                                      featureSubsetStrategy="sqrt", seed=seed, maxBins=max_bins,
                                      minInstancesPerNode=int(p.get("min_instances", 1)), subsamplingRate=float(p.get("subsampling_rate", 1.0)),
                                      bootstrap=bool(p.get("bootstrap", True)), cacheNodeIds=True, **columns)
    if name == "gbr" and classes > 2:
        return SoftmaxBoosting(numClasses=classes, maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                               maxDepth=int(p.get("max_depth", 3)), seed=seed, maxBins=max_bins, **columns)
    if name in ("gbr", "gbr_one_vs_rest"):
        boosted = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                                maxDepth=int(p.get("max_depth", 3)), seed=seed, maxBins=max_bins, **columns)
        if classes <= 2:
            return boosted
        return OneVsRest(classifier=boosted, featuresCol=features, labelCol=label)
    raise ValueError(f"unknown model {name!r}, choose from {sorted(CLASSIFIERS)}")


def build_regressor(name: str, params: Mapping | None = None, seed: int = 42, features: str = "features",
                    label: str = "label", max_bins: int = 32) -> Estimator:
    p = dict(params or {})
    columns = {"featuresCol": features, "labelCol": label}
    if name in ("linear", "ridge", "lasso", "elasticnet"):
        return PenalisedLinear(kind=name, alpha=float(p.get("alpha", 1.0)),
                               l1_ratio=float(p.get("l1_ratio", 0.5)), **columns)
    if name == "rf":
        # Spark has no least size for splitting a node; half of it per child is the nearest.
        return RandomForestRegressor(
            numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth")),
            minInstancesPerNode=int(p.get("min_instances", max(1, int(p.get("min_samples_split", 2)) // 2))),
            subsamplingRate=float(p.get("subsampling_rate", 1.0)),
            bootstrap=bool(p.get("bootstrap", True)), featureSubsetStrategy="all", seed=seed, maxBins=max_bins,
            cacheNodeIds=True, **columns)
    if name == "gbr":
        return GBTRegressor(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                            maxDepth=int(p.get("max_depth", 3)), seed=seed, maxBins=max_bins, **columns)
    raise ValueError(f"unknown model {name!r}, choose from {sorted(REGRESSORS)}")
