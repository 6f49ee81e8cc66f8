import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwright.operators import models, moments, tuning
from tabwright.operators.features import MedianScaler, ModeImputer, Preprocessor, feature_names, preparation_stages
from tabwright.operators.roles import Roles, infer_roles
from tabwright.operators.scoring import feature_importances

RNG = np.random.default_rng(5)
N = 400
X = RNG.normal(size=(N, 3)) * [1.0, 2.0, 0.5]


def vectors(spark, y, x=X):
    return spark.createDataFrame([(Vectors.dense(row), float(v)) for row, v in zip(x, y)], ["features", "label"]).cache()


@pytest.fixture(scope="module")
def numbers(spark):
    y = X @ [3.0, -1.0, 0.0] + 10 + RNG.normal(size=N)
    return y, vectors(spark, y)


def test_ridge_has_no_gradient(numbers):
    y, df = numbers
    m = models.PenalisedLinear(kind="ridge", alpha=50.0).fit(df)
    w, b = m.coefficients.toArray(), m.intercept
    residual = y - X @ w - b
    np.testing.assert_allclose(-X.T @ residual + 50.0 * w, 0, atol=1e-3)
    assert abs(residual.sum()) < 1e-6


@pytest.mark.parametrize("kind,alpha,ratio", [("lasso", 0.2, 1.0), ("elasticnet", 0.5, 0.4)])
def test_absolute_penalties_meet_their_optimality_conditions(numbers, kind, alpha, ratio):
    y, df = numbers
    m = models.PenalisedLinear(kind=kind, alpha=alpha, l1_ratio=ratio).fit(df)
    w = m.coefficients.toArray()
    gradient = -X.T @ (y - X @ w - m.intercept) / N + alpha * (1 - ratio) * w
    for g, v in zip(gradient, w):
        if v:
            assert abs(g + alpha * ratio * np.sign(v)) < 1e-4
        else:
            assert abs(g) <= alpha * ratio + 1e-4


def test_linear_and_constant_labels(spark, numbers):
    y, df = numbers
    m = models.PenalisedLinear(kind="linear").fit(df)
    want = np.linalg.lstsq(np.c_[X, np.ones(N)], y, rcond=None)[0]
    np.testing.assert_allclose([*m.coefficients, m.intercept], want, rtol=1e-6)
    flat = models.PenalisedLinear(kind="ridge", alpha=1.0).fit(vectors(spark, np.full(N, 4.0)))
    assert flat.intercept == pytest.approx(4.0) and not flat.coefficients.toArray().any()


@pytest.mark.parametrize("penalty,C,balanced", [("l2", 0.1, False), ("l2", 1.0, True), ("l1", 0.1, False)])
def test_logistic_meets_its_optimality_conditions(spark, penalty, C, balanced):
    y = (X @ [1.0, -0.5, 0.0] + RNG.logistic(size=N) > 1.0).astype(float)
    m = models.PenalisedLogistic(C=C, penalty=penalty, balanced=balanced, tol=1e-10).fit(vectors(spark, y))
    w = m.coefficients.toArray()
    weight = np.where(y == 1, N / (2 * y.sum()), N / (2 * (N - y.sum()))) if balanced else np.ones(N)
    error = weight * (1 / (1 + np.exp(-(X @ w + m.intercept))) - y)
    gradient = C * X.T @ error
    assert abs(error.sum()) < 1e-3
    if penalty == "l2":
        np.testing.assert_allclose(gradient + w, 0, atol=1e-3)
    else:
        for g, v in zip(gradient, w):
            assert abs(g + np.sign(v)) < 1e-3 if v else abs(g) <= 1 + 1e-3


def test_multinomial_gradient_vanishes(spark):
    y = np.argmax(X @ RNG.normal(size=(3, 3)) + RNG.gumbel(size=(N, 3)), axis=1).astype(float)
    m = models.PenalisedLogistic(C=0.1, tol=1e-10).fit(vectors(spark, y))
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    z = X @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    np.testing.assert_allclose(0.1 * (p - np.eye(3)[y.astype(int)]).T @ X + w, 0, atol=1e-3)


def test_unknown_models_are_refused(spark):
    with pytest.raises(ValueError, match="svm"):
        models.build_classifier("svm")
    with pytest.raises(ValueError, match="svm"):
        models.build_regressor("svm")
    with pytest.raises(ValueError, match="svm"):
        tuning.train_classifiers(spark.range(3), "id", F.col("id"), ["svm"])


PEOPLE = pd.DataFrame({
    "age": [25, None, 35, 40, 45], "income": [50000, 60000, None, 80000, 90000],
    "sex": ["Male", "Female", "Male", None, "Male"], "bmi": [22.5, 24.5, 26.5, 28.5, 30.5], "flag": [0, 1, 0, 1, 0]})


def people(spark):
    return spark.createDataFrame(PEOPLE)


def test_imputation_uses_medians_and_modes(spark):
    df = people(spark)
    filled = MedianScaler(inputCols=["age", "income"], outputCols=["a", "i"], centre=False).fit(df).transform(df)
    assert [r["a"] for r in filled.orderBy("bmi").collect()][1] == 37.5
    assert [r["i"] for r in filled.orderBy("bmi").collect()][2] == 70000
    texts = ModeImputer(inputCols=["sex"], outputCols=["s"]).fit(df).transform(df)
    assert [r["s"] for r in texts.orderBy("bmi").collect()][3] == "Male"
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert ModeImputer(inputCols=["x"], outputCols=["y"]).fit(tie).getOrDefault("fills") == ["a"]


def test_preprocessor_keeps_rows_and_leaves_no_nulls(spark):
    roles = Roles(["age", "income", "bmi"], ["sex"], ["flag"])
    got = Preprocessor(roles).fit_transform(people(spark)).toPandas()
    assert list(got.columns) == ["age", "income", "bmi", "sex=Female", "sex=Male", "flag"]
    assert len(got) == 5 and not got.isna().any().any()
    np.testing.assert_allclose(got[["age", "income", "bmi"]].mean(), 0, atol=1e-12)
    np.testing.assert_allclose(got[["age", "income", "bmi"]].std(ddof=0), 1)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    got = MedianScaler(inputCols=["a", "b"], outputCols=["x", "y"]).fit(df).transform(df).first()
    assert (got["x"], got["y"]) == (0.0, 0.0)


def test_vector_matches_wide_form_and_survives_saving(spark, tmp_path):
    df = people(spark)
    roles = infer_roles(df)
    fitted = Pipeline(stages=preparation_stages(roles)).fit(df)
    fitted.write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    wide = Preprocessor(roles).fit_transform(df).toPandas()
    for m in (fitted, again):
        rows = m.transform(df).select(vector_to_array("features").alias("f")).collect()
        assert feature_names(m, roles) == list(wide.columns)
        np.testing.assert_allclose([r["f"] for r in rows], wide.to_numpy())
    unseen = df.limit(1).withColumn("sex", F.lit("Other"))
    vector = again.transform(unseen).select(vector_to_array("features").alias("f")).first()["f"]
    assert vector[feature_names(again, roles).index("sex=Female"):] == [0.0, 0.0]


@pytest.fixture(scope="module")
def patients(spark):
    n = 600
    age = RNG.integers(20, 80, n)
    smoker = RNG.choice(["Never", "Former", "Current"], n)
    risk = (age + 15 * (smoker == "Current") + RNG.normal(0, 4, n) > 55).astype(int)
    grade = np.where(age < 40, "low", np.where(age < 60, "medium", "high"))
    return spark.createDataFrame(pd.DataFrame({
        "id": range(n), "age": age, "smoker": smoker, "risk": risk, "grade": grade,
        "cost": 100.0 * age + 500 * (smoker == "Current")})).cache()


def test_classifier_loop_learns_and_ranks(patients):
    run = tuning.train_classifiers(
        patients, "risk", F.col("id"), ["logreg_l2", "gbr"], drop=["id", "grade", "cost"],
        grids={"logreg_l2": {"C": [1.0]}, "gbr": {"n_estimators": [5], "max_depth": [2]}})
    rows = run.metrics.collect()
    assert rows[0]["model"] == run.best and rows[0]["test_mcc"] == run.best_score > 0.6
    assert all(r["test_roc_auc"] > 0.9 for r in rows)
    totals = run.confusions.groupBy("model", "split").agg(F.sum("n")).collect()
    assert {r[2] for r in totals} == {120}


def test_three_class_boosting_has_scores_and_importances(spark, patients):
    run = tuning.train_classifiers(patients, "grade", F.col("id"), ["gbr"], drop=["id", "risk", "cost"],
                                   grids={"gbr": {"n_estimators": [3], "max_depth": [2]}}, folds=2)
    row = run.metrics.first()
    assert row["test_accuracy"] > 0.95 and row["test_roc_auc_ovr_macro"] > 0.95
    roles = Roles(["age"], ["smoker"])
    top = feature_importances(run.model, feature_names(run.model, roles), spark, 3).collect()
    assert top[0]["name"] == "age" and top[0]["share"] == 1.0


def test_grid_search_takes_the_first_best_point(patients):
    run = tuning.train_regressors(patients, "cost", F.col("id"), ["ridge"], drop=["id", "risk", "grade"],
                                  grids={"ridge": {"alpha": [1000.0, 0.1]}}, folds=2)
    assert run.searches["ridge"].params == {"alpha": 0.1}
    assert run.metrics.first()["test_r2"] > 0.99


def test_learning_curves_grow(patients):
    curves = tuning.learning_curves(
        patients, [tuning.Experiment("risk", "risk", ("grade", "cost"))], F.col("id"),
        {"logreg_l2": {"C": 10.0}}, fractions=[0.1, 1.0], folds=2, fit_rows=200, exclude=["id"]).orderBy("train_size").collect()
    assert [r["train_size"] for r in curves] == [20, 200]
    assert curves[-1]["val_mean"] > 0.85 and curves[-1]["val_std"] is not None


def folded_rows(spark, seed=3, n=240):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(50, 9, n), rng.normal(size=n)
    c = np.where(rng.random(n) < 0.5, "x", np.where(rng.random(n) < 0.8, "y", "only in one fold"))
    rows = []
    for i in range(n):
        text = None if rng.random() < 0.1 else str(c[i]) if c[i] != "only in one fold" or i % 3 == 1 else "z"
        rows.append((i % 3, None if rng.random() < 0.2 else float(a[i]), float(b[i]), 5.0, text, float(i % 2),
                     float(1000 + 2 * a[i] + 3 * b[i] + (c[i] == "x") - (i % 2) + rng.normal())))
    return spark.createDataFrame(rows, "fold int, a double, b double, flat double, t string, flag double, y double").cache()


GRIDS = {"ridge": {"alpha": [0.1, 30.0]}, "lasso": {"alpha": [0.01, 0.5]}, "elasticnet": {"alpha": [0.05, 0.5], "l1_ratio": [0.2, 0.9]}}


def test_moments_score_what_fits_on_the_rows_score(spark, monkeypatch):
    df = folded_rows(spark)
    trainer = tuning.Trainer(Roles(["a", "b", "flat"], ["t"], ["flag"]), "y")
    by_moments = trainer.search(GRIDS, df, "fold", 3)
    monkeypatch.setattr(moments, "MOST_COLUMNS", 3)
    by_rows = trainer.search(GRIDS, df, "fold", 3)
    for name in GRIDS:
        assert by_moments[name].params == by_rows[name].params
        for got, want in zip(by_moments[name].scores, by_rows[name].scores):
            assert got["params"] == want["params"]
            np.testing.assert_allclose(got["fold_scores"], want["fold_scores"], rtol=2e-5)


def test_passes_do_not_grow_with_grid_or_folds(spark):
    df = folded_rows(spark).withColumn("many", F.col("y").cast("int") % 6)
    sc, roles, found = spark.sparkContext, Roles(["b", "flat"], ["t"], ["flag"]), []
    for run, (k, fold) in enumerate([(3, "fold"), (6, "many")]):
        sc.setJobGroup(f"moments-{run}", "")
        solved = moments.fold_moments(df, roles, "y", fold, k)
        solved.scores([("ridge", {"alpha": float(a)}) for a in range(1, 4 + 40 * run)])
        found.append(len(sc.statusTracker().getJobIdsForGroup(f"moments-{run}")))
    sc.setJobGroup("tests", "")
    assert found[1] <= found[0] <= 8


def test_moments_refuse_what_they_cannot_serve(spark):
    df, roles = folded_rows(spark), Roles(["b"])
    assert moments.fold_moments(df, roles, "y", "fold", 3) is not None
    assert moments.fold_moments(df, roles, "y", "fold", 4) is None  # an empty fold
    assert moments.fold_moments(df.withColumn("y", F.when(F.col("b") > 0, F.col("y"))), roles, "y", "fold", 3) is None
    assert moments.fold_moments(df, Roles(["b"], ["t"]), "y", "fold", 3, most=4) is None
    assert moments.fold_moments(df.limit(0), roles, "y", "fold", 3) is None
