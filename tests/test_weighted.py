"""Equal training rows as one weighted row, and partitions of bounded size."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import models, tuning
from tabwright.operators.boosting import SoftmaxBoosting
from tabwright.operators.roles import Roles

CLASSES = ["0", "1", "2"]
ROLES = Roles(["a", "b"], ["t"])


@pytest.fixture(scope="module")
def rows(spark):
    """6,000 rows with 105 different inputs, one number in twenty missing."""
    return spark.range(6_000).selectExpr("id", "IF(id % 20 = 3, NULL, id % 7) AS a", "CAST(id * 7 % 11 % 5 AS double) AS b", "concat('t', id % 3) AS t",
                                         "CAST((id % 7 + id * 13 % 17 + id % 3 * 4) div 9 % 3 AS int) AS c", "CAST(id % 2 = 0 AND id % 7 < 5 AS int) AS two",
                                         "CAST(id * 31 % 101 AS double) + id % 7 * 10 AS y").cache()


def scored(model, rows):
    found = model.transform(rows)
    value = vector_to_array("probability") if "probability" in found.columns else F.array("prediction")
    return np.array([r["v"] for r in found.select("id", value.alias("v")).orderBy("id").collect()])


@pytest.mark.parametrize("target,classes,name,params", [
    ("c", CLASSES, "gbr", {"n_estimators": 3, "max_depth": 3}),
    ("c", CLASSES, "rf", {"n_estimators": 2, "max_depth": 4, "bootstrap": False}),
    ("c", CLASSES, "logreg_l2", {"C": 0.5, "tol": 1e-10}),
    ("two", CLASSES[:2], "logreg_l2", {"C": 0.5, "class_weight": "balanced", "tol": 1e-10}),
    ("two", CLASSES[:2], "gbr", {"n_estimators": 3, "max_depth": 3}),
    ("y", None, "gbr", {"n_estimators": 3, "max_depth": 3}),
    ("y", None, "rf", {"n_estimators": 2, "max_depth": 4, "bootstrap": False})])
def test_weighted_rows_fit_what_all_rows_fit(spark, rows, target, classes, name, params):
    trainer = tuning.Trainer(ROLES, target, classes)
    fitted = trainer.fit(name, params, rows)
    prepared = trainer.prepare(rows)
    plain = trainer.build(name, params).fit(trainer.prepared_rows(prepared, rows))
    few = trainer.fitting_rows(prepared, rows, [(name, params)])
    assert list(few) == [True] and few[True].count() < 500 and few[True].agg(F.sum("weight")).first()[0] == 6_000
    np.testing.assert_allclose(scored(fitted, rows), scored(plain, prepared.transform(rows)), atol=1e-6)


@pytest.mark.parametrize("name,params", [("rf", {}), ("rf", {"bootstrap": False, "subsampling_rate": 0.5}), ("rf", {"bootstrap": False, "min_instances": 4}),
                                         ("rf", {"bootstrap": False, "min_samples_split": 10}), ("linear", {}), ("lasso", {})])
def test_rows_that_are_drawn_or_counted_stay_single(name, params):
    assert not models.weighs(name, params)


def test_partitions_of_learners_are_bounded(spark, rows, monkeypatch):
    """Where inputs are all different and where rows stay single."""
    monkeypatch.setattr(tuning.spread, "__defaults__", (200,))
    trainer = tuning.Trainer(Roles(["id"]), "two", CLASSES[:2])
    one = rows.coalesce(1)
    prepared = trainer.prepare(one)
    both = trainer.fitting_rows(prepared, one, [("rf", {}), ("gbr", {})])
    assert sorted(both) == [False, True]
    for part in both.values():
        sizes = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6_000 and max(sizes) <= 400
    assert tuning.spread(rows.coalesce(1), 6_000).rdd.getNumPartitions() == 1


def test_softmax_boosting_counts_weights(spark, rows):
    data = tuning.Trainer(ROLES, "c", CLASSES).labelled(rows)
    prepared = tuning.Trainer(ROLES, "c", CLASSES).prepare(rows)
    data = prepared.transform(data).withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    weighted = SoftmaxBoosting(numClasses=3, maxIter=2, maxDepth=2, weightCol="w").fit(data)
    repeated = SoftmaxBoosting(numClasses=3, maxIter=2, maxDepth=2).fit(data.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))))
    np.testing.assert_allclose(scored(weighted, data), scored(repeated, data), atol=1e-9)


def test_folds_are_cut_once(spark, rows):
    """What every fit reads is a written table, not the split of its source."""
    parts, train = tuning._partitioned(rows, F.col("id"), ["a", "b", "t"], "c", "c", 3, 42, 0.2, 0.2, True)
    files = train.inputFiles()
    assert files and all("/folds-" in f for f in files) and train.count() == parts.where("_part = 'train'").count()
