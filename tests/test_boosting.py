"""Softmax boosting against a plain version, saving, absent classes and odd tables."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import boosting, models
from tabwright.operators.boosting import SoftmaxBoosting
from tabwright.operators.scoring import model_importances

RNG = np.random.default_rng(11)
N, ROUNDS, STEP = 300, 3, 0.3
X = np.column_stack([RNG.integers(0, 9, N), RNG.integers(0, 5, N), RNG.integers(0, 2, N)]).astype(float)
Y = ((X[:, 0] + 2 * X[:, 1] + 3 * X[:, 2] + RNG.integers(0, 4, N)) // 6).clip(0, 2).astype(int)


def brute_tree(x, r, depth):
    """Row numbers of the leaves of the regression tree that takes the best split of every node."""
    best = (1e-12, None)
    if depth:
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                goes = x[:, j] <= cut
                gain = r.var() * len(r) - r[goes].var() * goes.sum() - r[~goes].var() * (~goes).sum()
                if gain > best[0]:
                    best = (gain, goes)
    if best[1] is None:
        return [np.arange(len(r))]
    sides = [np.flatnonzero(best[1]), np.flatnonzero(~best[1])]
    return [side[leaf] for side in sides for leaf in brute_tree(x[side], r[side], depth - 1)]


def brute_scores(x, y, classes, rounds, step, depth):
    margins = np.tile(np.log(np.maximum([(y == k).mean() for k in range(classes)], 1e-15)), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
        for k in range(classes):
            r = (y == k) - p[:, k]
            for leaf in brute_tree(x, r, depth):
                h = (abs(r[leaf]) * (1 - abs(r[leaf]))).sum()
                margins[leaf, k] += step * (classes - 1) / classes * r[leaf].sum() / h if h > 1e-15 else 0
    return np.exp(margins) / np.exp(margins).sum(1, keepdims=True)


@pytest.fixture(scope="module")
def rows(spark):
    columns = spark.createDataFrame([(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(X, Y))], "id int, a double, b double, c double, label double")
    return columns.repartition(3).cache()


def probabilities(model, rows):
    found = model.transform(rows).select("id", vector_to_array("probability").alias("p"), "prediction").orderBy("id").collect()
    return np.array([r["p"] for r in found]), np.array([r["prediction"] for r in found])


def assembled(learner, categorical=False):
    stages = [OneHotEncoder(inputCols=["b"], outputCols=["h"])] if categorical else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["a", "h", "c"] if categorical else ["a", "b", "c"], outputCol="features"), learner])


@pytest.mark.parametrize("writes", [10, 1])
def test_scores_are_those_of_brute_force(rows, monkeypatch, writes):
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", writes)
    fitted = assembled(SoftmaxBoosting(numClasses=3, maxIter=ROUNDS, stepSize=STEP, maxDepth=2)).fit(rows)
    p, prediction = probabilities(fitted, rows)
    want = brute_scores(X, Y, 3, ROUNDS, STEP, 2)
    np.testing.assert_allclose(p, want, atol=1e-9)
    np.testing.assert_allclose(p.sum(1), 1)
    assert (prediction == want.argmax(1)).all()


def test_categories_split_and_models_survive_saving(rows, tmp_path):
    fitted = assembled(SoftmaxBoosting(numClasses=3, maxIter=ROUNDS, stepSize=STEP, maxDepth=2), categorical=True).fit(rows)
    hot = np.column_stack([X[:, 0], *[X[:, 1] == k for k in range(4)], X[:, 2]]).astype(float)
    p, _ = probabilities(fitted, rows)
    np.testing.assert_allclose(p, brute_scores(hot, Y, 3, ROUNDS, STEP, 2), atol=1e-9)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    np.testing.assert_array_equal(probabilities(again, rows)[0], p)
    shares = model_importances(again, list("abcdef"))
    assert sum(shares.values()) == pytest.approx(1) and min(shares.values()) >= 0


def test_absent_classes_missing_labels_and_empty_tables(spark, rows):
    learner = assembled(SoftmaxBoosting(numClasses=4, maxIter=2, maxDepth=2))
    odd = rows.unionByName(rows.limit(20).withColumn("label", F.lit(None).cast("double")))
    p, prediction = probabilities(learner.fit(odd), rows)
    np.testing.assert_allclose(p, brute_scores(X, Y, 4, 2, 0.1, 2), atol=1e-9)
    assert (p[:, 3] < 1e-9).all() and set(prediction) <= {0, 1, 2}
    assert learner.fit(rows).transform(rows.limit(0)).count() == 0
    same = learner.fit(rows.withColumn("label", F.lit(1.0)))
    assert set(probabilities(same, rows)[1]) == {1}
    with pytest.raises(ValueError, match="label"):
        learner.fit(rows.limit(0))


def test_registry(spark):
    assert isinstance(models.build_classifier("gbr", classes=3), SoftmaxBoosting)
    assert not isinstance(models.build_classifier("gbr", classes=2), SoftmaxBoosting)
    assert not isinstance(models.build_classifier("gbr_one_vs_rest", classes=3), SoftmaxBoosting)
