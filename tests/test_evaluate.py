import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import evaluate

RNG = np.random.default_rng(3)


def counts_frame(spark, labels, matrix):
    rows = [(a, p, int(n)) for a, line in zip(labels, matrix) for p, n in zip(labels, line) if n]
    return spark.createDataFrame(rows, "actual string, predicted string, n bigint")


@pytest.mark.parametrize("labels,matrix,accuracy,f1,mcc", [
    (["0", "1"], [[12557, 87], [100, 7256]], 0.99065, 0.9899435169563153, 0.979888000912348),
    (["high", "low", "medium"], [[928, 3246, 2102], [677, 5479, 1159], [959, 3154, 2296]],
     0.43515, 0.38820543199854757, 0.14609514537062848),
])
def test_published_confusions_give_published_metrics(spark, labels, matrix, accuracy, f1, mcc):
    got = evaluate.class_metrics(counts_frame(spark, labels, matrix)).first()
    assert (got["accuracy"], got["f1_macro"], got["mcc"]) == pytest.approx((accuracy, f1, mcc), abs=1e-12)
    assert got["total"] == np.sum(matrix) and got["misclassified"] == np.sum(matrix) - np.trace(np.array(matrix))
    grid = evaluate.confusion_grid(counts_frame(spark, labels, matrix)).first()
    assert grid["labels"] == labels and grid["matrix"] == matrix


def test_degenerate_confusions_score_zero(spark):
    one = evaluate.class_metrics(spark.createDataFrame([("a", "a", 5)], "actual string, predicted string, n bigint")).first()
    assert (one["accuracy"], one["f1_macro"], one["mcc"]) == (1.0, 1.0, 0.0)
    never = evaluate.class_metrics(spark.createDataFrame(
        [("a", "a", 5), ("a", "c", 1)], "actual string, predicted string, n bigint")).first()
    assert never["f1_macro"] == pytest.approx((10 / 11) / 2) and never["mcc"] == 0.0
    rates = evaluate.binary_rates(spark.createDataFrame(
        [("0", "0", 4), ("0", "1", 1)], "actual string, predicted string, n bigint"), "1").first()
    assert rates["tpr"] is None and rates["fnr"] is None and rates["tnr"] == 0.8 and rates["fpr"] == 0.2


def brute_curve(y, s):
    points = [(math.inf, 0.0, 0.0)]
    levels = sorted(set(s), reverse=True)
    hits = [(int(((s == v) & (y == 1)).sum()), int(((s == v) & (y == 0)).sum())) for v in levels]
    tp = np.cumsum([h[0] for h in hits])
    fp = np.cumsum([h[1] for h in hits])
    for i, v in enumerate(levels):
        inner = 0 < i < len(levels) - 1
        if not inner or hits[i] != hits[i + 1]:
            points.append((v, fp[i] / (y == 0).sum(), tp[i] / (y == 1).sum()))
    return points


@pytest.mark.parametrize("levels,window_rows", [(8, 1_000_000), (5000, 1_000_000), (5000, 90)])
def test_roc_and_auc_match_brute_force(spark, levels, window_rows):
    n = 700
    y = RNG.integers(0, 2, n)
    s = np.round(RNG.normal(size=n) + y, 4) if levels > 100 else RNG.integers(0, levels, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    got = evaluate.roc_curve(df, "s", F.col("y") == 1, window_rows=window_rows).orderBy(F.desc("threshold")).collect()
    np.testing.assert_allclose([tuple(r) for r in got], brute_curve(y, s))
    wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2
    assert evaluate.auc(df, "s", F.col("y") == 1, window_rows=window_rows).first()[0] == pytest.approx(wins)


def test_auc_of_equal_scores_and_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert evaluate.auc(df, "s", F.col("y") == 1).first()[0] == 0.5
    assert evaluate.auc(df.where("y = 1"), "s", F.col("y") == 1).first()[0] is None


def test_curve_picks_are_evenly_spaced(spark):
    curve = spark.createDataFrame([(float(i), i / 20, i / 20) for i in range(20)], "threshold double, fpr double, tpr double")
    got = sorted(r["idx"] for r in evaluate.curve_picks(curve).collect())
    assert got == list(np.linspace(0, 19, 7, dtype=int)[1:-1])


def test_regression_metrics_with_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 1.0, 0.0)], "y double, same double, off double")
    assert evaluate.regression_metrics(df, "y", "same").first()["r2"] == 1.0
    off = evaluate.regression_metrics(df, "y", "off").first()
    assert (off["r2"], off["mae"], off["rmse"]) == (0.0, 1.0, 1.0)
