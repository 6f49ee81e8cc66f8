import pandas as pd
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright import presets
from tabwright.operators import profile, reports, scoring
from tabwright.plans import jobs
from tabwright.sources import readers, writers
from tabwright.streaming.scoring import read_arrivals, score_stream, write_scores


def cost_model():
    return SQLTransformer(statement="SELECT *, 10.0D * age AS prediction FROM __THIS__")


def risk_model():
    return SQLTransformer(statement="""SELECT *, array(0.999D, 0.001D) AS probability,
        CASE WHEN age > 50 THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__""")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, 60, "Current", 2, 31.25, 500.0, "1"), (2, 30, "Never", 0, 20.0, None, None), (3, 45, "Former", 1, None, 1600.0, "1")],
        "id int, age int, smoker string, chronic_count int, bmi double, annual_medical_cost double, is_high_risk string")


def test_scored_rows(people):
    got = {r["id"]: r for r in scoring.score_rows(people, cost_model(), risk_model(), ["0", "1"]).collect()}
    assert got[1]["error"] == 100.0 and got[1]["band"] == "good" and got[1]["correct"]
    assert got[2]["actual_cost"] == 0.0 and got[2]["actual_risk"] == "" and not got[2]["correct"]
    assert got[3]["band"] == "bad" and got[1]["probabilities"] == {"0": 0.995, "1": 0.005}


def test_reason_texts(people):
    scored = scoring.score_rows(people, cost_model(), risk_model(), ["0", "1"])
    got = {r["id"]: r["reason"] for r in scoring.with_reasons(scored, {"age": 0.5, "bmi": 0.4, "x": 0.0}).collect()}
    assert got[1] == (
        "The model predicts this patient is HIGH RISK with 99.5% confidence. Key drivers: age, bmi. This is primarily due to "
        "age of 60 (older patients carry higher risk), active smoking status, 2 chronic conditions, elevated BMI of 31.3. "
        "Predicted annual cost: $600.")
    assert "young age of 30 (lower baseline risk), non-smoker status, no chronic conditions." in got[2]
    assert "due to overall feature profile." in got[3]


def test_align_fills_and_drops(people):
    schema = T._parse_datatype_string("age double, region string")
    assert [tuple(r) for r in scoring.align(people, schema).orderBy("age").collect()] == [(30.0, None), (45.0, None), (60.0, None)]


def test_streamed_rows_score_like_a_batch(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    stream = read_arrivals(spark, str(tmp_path / "in"), people.schema)
    scored = score_stream(stream, cost_model(), risk_model(), ["0", "1"])
    write_scores(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    batch = scoring.score_rows(people, cost_model(), risk_model(), ["0", "1"])
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
    with pytest.raises(ValueError):
        score_stream(people, cost_model(), risk_model(), ["0", "1"])


def test_number_formats(spark):
    df = spark.createDataFrame([(1234567.89,), (1000.0,), (0.0,), (0.00123,), (3.14159,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(reports.compact_number(F.col("x"))).collect()]
    assert got == ["1,234,567.9", "1,000", "0.00e+0", "1.23e-3", "3.1416", "-0.5000"]
    assert spark.range(1).select(reports.percent(F.lit(0.97245))).first()[0] in ("97.24%", "97.25%")
    names = spark.createDataFrame([("gbr",), ("other",)], "m string").select(reports.model_label(F.col("m"))).collect()
    assert [r[0] for r in names] == ["Gradient Boosting", "other"]


def test_feature_search_puts_unknown_last_both_ways(spark):
    df = spark.createDataFrame([("Age", 3.0), ("wage", None), ("stage", 1.0), ("bmi", 2.0)], "feature string, mean double")
    assert [r[0] for r in reports.search_features(df, "AGE", "mean").collect()] == ["stage", "Age", "wage"]
    assert [r[0] for r in reports.search_features(df, "age", "mean", False).collect()] == ["Age", "stage", "wage"]


def test_catalogue_defaults(spark):
    summary = spark.createDataFrame([("a", 3), ("b", None)], "feature string, count bigint")
    types = spark.createDataFrame([("a", "str")], "feature string, dtype string")
    missing = spark.createDataFrame([("a", 2)], "feature string, missing bigint")
    got = {r["feature"]: (r["count"], r["dtype"], r["missing"]) for r in reports.feature_catalogue(summary, types, missing).collect()}
    assert got == {"a": (3, "str", 2), "b": (0, "unknown", 0)}


def test_best_row_falls_back_to_the_first(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "model string, test_mcc double")
    assert reports.best_row(df, "a", "test_mcc").first()["model"] == "a"
    assert reports.best_row(df, "none", "test_mcc").first()["model"] == "b"


def test_tables_and_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,\"x\"", 1.5, None), ("b", float("nan"), 2)], "t string, x double, n bigint")
    writers.write_table(df, str(tmp_path / "t"), "csv")
    back = readers.read_table(spark, str(tmp_path / "t"), "csv", df.schema).orderBy("t").collect()
    assert [tuple(r) for r in back] == [("a,\"x\"", 1.5, None), ("b", None, 2)]
    (tmp_path / "report.csv").write_text(",count,best_params\nage,5,\"{\"\"C\"\": 0.1}\"\n\nbmi,4,{}\n")
    rows = readers.read_report(spark, str(tmp_path / "report.csv")).collect()
    assert [tuple(r) for r in rows] == [("age", 5, '{"C": 0.1}'), ("bmi", 4, "{}")]


def test_confusion_documents_round_trip(spark, tmp_path):
    (tmp_path / "confusion_rf.json").write_text("""{
      "model": "rf",
      "val": {"labels": ["0", "1"], "matrix": [[5, 0], [1, 2]]},
      "test": {"labels": ["0", "1"], "matrix": [[3, 1], [0, 4]]}
    }""")
    flat = readers.flatten_confusions(readers.read_json(spark, str(tmp_path / "confusion_rf.json"), readers.CONFUSION_SCHEMA))
    assert flat.count() == 8 and flat.agg(F.sum("n")).first()[0] == 16
    document = writers.confusion_documents(flat).first()
    assert document["val"]["matrix"] == [[5, 0], [1, 2]] and document["test"]["labels"] == ["0", "1"]


def test_profile_files_have_the_expected_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", None, 3), ("a", 4.0, 3)], "t string, x double, n bigint")
    jobs.profile_files(df, str(tmp_path))
    summary = {r["feature"]: r for r in readers.read_report(spark, str(tmp_path / "eda_summary.csv")).collect()}
    assert summary["t"]["top"] == "a" and summary["x"]["count"] == 2 and summary["n"]["max"] == 3.0
    missing = {r["feature"]: r["missing"] for r in readers.read_report(spark, str(tmp_path / "eda_missing.csv")).collect()}
    assert missing == {"t": 0, "x": 1, "n": 0}
    features, rows = readers.correlation_document(readers.read_report(spark, str(tmp_path / "eda_corr.csv")))
    assert features == ["x", "n"] and rows.count() == 2
    catalogue = jobs.catalogue_from_files(spark, str(tmp_path)).collect()
    assert {r["feature"]: r["dtype"] for r in catalogue} == {"t": "str", "x": "float64", "n": "int64"}


def test_training_job_files_can_be_loaded_again(spark, tmp_path):
    n = 300
    df = spark.createDataFrame(pd.DataFrame({
        "person_id": range(n), "age": [i % 80 for i in range(n)], "is_high_risk": [int(i % 80 > 40) for i in range(n)],
        "annual_medical_cost": [100.0 * (i % 80) + i % 7 for i in range(n)]}))
    grids = {"logreg_l2": {"C": [1.0]}, "ridge": {"alpha": [0.1]}}
    folder = str(tmp_path / "cls")
    jobs.train_and_save_classifiers(df, folder, "is_high_risk", F.col("person_id"), models=["logreg_l2"],
                                    drop=["person_id", "annual_medical_cost"], grids=grids)
    jobs.train_and_save_regressors(df, str(tmp_path / "reg"), "annual_medical_cost", F.col("person_id"), models=["ridge"],
                                   drop=["person_id", "is_high_risk"], grids=grids)
    loaded = readers.load_experiments(spark, {"high_risk": folder})
    assert loaded["summaries"].first()["best_model"] == "logreg_l2"
    assert loaded["metrics"].first()["test_accuracy"] > 0.9
    assert loaded["confusions"].agg(F.sum("n")).first()[0] == 120
    # Inputs are aligned, classes and drivers come with the model.
    odd = df.drop("is_high_risk").withColumns({"age": F.col("age").cast("string"), "unknown": F.lit(1)})
    again = jobs.score_with_latest(odd, folder, str(tmp_path / "reg")).orderBy("person_id").first()
    assert again["predicted_risk"] == "0" and again["actual_risk"] == "" and again["age"] == "0" and "Key drivers: age." in again["reason"]
    scored = jobs.score_with_latest(df, folder, str(tmp_path / "reg"))
    assert scored.where("correct").count() > 270 and scored.where("band = 'good'").count() > 270


def test_presets_cover_the_main_table():
    columns = presets.NUMERIC_COLUMNS + presets.CATEGORICAL_COLUMNS + presets.BINARY_COLUMNS + presets.PROCEDURE_COLUMNS
    assert len(columns) == len(set(columns)) == 50
    assert set(presets.KEY_FEATURES) <= set(columns)


def test_profile_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 2.0), (None, 2.0), (None, float("nan"))], "t string, x double")
    assert profile.duplicate_rows(df).first()[0] == 2
    constant = profile.correlations(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")).collect()
    assert {(r["feature"], r["other"]): r["r"] for r in constant} == {
        ("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    assert profile.describe_text(df).first()["top"] == "a"
    tied = spark.createDataFrame([("b",), ("a",)], "t string")
    assert profile.describe_text(tied).first()["top"] == "a"
    assert [tuple(r) for r in profile.value_counts(df, "t").collect()] == [("a", 2, 1.0)]


def test_whole_profile_and_prepared_rows(spark, tmp_path):
    n = 200
    df = spark.createDataFrame(pd.DataFrame({
        "person_id": range(n), "age": [20 + i % 60 for i in range(n)], "bmi": [None if i % 9 == 0 else 18.0 + i % 20 for i in range(n)],
        "smoker": [None if i % 11 == 0 else ("Never", "Current")[i % 2] for i in range(n)], "hypertension": [i % 2 for i in range(n)],
        "annual_medical_cost": [100.0 * i for i in range(n)]}))
    found = jobs.profile_table(df)
    assert {"shape", "describe_by_label", "boxes", "shares"} <= set(found)
    rows = {name: t.collect() for name, t in found.items()}
    assert rows["shape"][0]["n_rows"] == n and sum(r["n"] for r in rows["label_counts"]) == n
    assert sum(r["n"] for r in rows["histograms"] if r["feature"] == "age") == n
    assert {r["feature"] for r in rows["describe_by_label"]} == {r["feature"] for r in rows["boxes"]} == {"age", "bmi", "annual_medical_cost"}
    assert sum(r["share"] for r in rows["shares"] if r["feature"] == "smoker") == pytest.approx(2)
    prepared = jobs.prepare_and_save(df, str(tmp_path / "rows"))
    again = spark.read.option("header", True).csv(str(tmp_path / "rows"))
    assert again.columns == prepared.columns == [
        "age", "bmi", "annual_medical_cost", "smoker=Current", "smoker=Never", "hypertension"]
    assert again.count() == n and again.where("bmi IS NULL").count() == 0


def test_large_category_lists_are_refused(spark):
    from tabwright.operators.features import ModeImputer
    from tabwright.operators.tuning import classes_of
    df = spark.range(2000).selectExpr("cast(id as string) t")
    with pytest.raises(ValueError, match="t"):
        ModeImputer(inputCols=["t"], outputCols=["u"], maxCategories=100).fit(df)
    with pytest.raises(ValueError, match="classes"):
        classes_of(df, "t")


def test_large_side_tables_are_written_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from tabwright import storage
    monkeypatch.setattr(storage, "shared_root", lambda session: str(tmp_path))
    wide, small = storage.side_table(spark.range(50), "s", limit=10)
    assert not small and wide.count() == 50 and list(tmp_path.iterdir())
    assert storage.side_table(spark.range(5), "s", limit=10)[1]


def test_shared_folder_is_read_from_the_session():
    from tabwright import storage

    class Conf:
        def get(self, name, default):
            return {"spark.checkpoint.dir": "/shared/run/"}.get(name, default)

    class Cluster:
        conf = Conf()

    assert storage.shared_root(Cluster()) == "/shared/run"

    class Unset(Cluster):
        conf = type("C", (), {"get": lambda self, name, default: default})()
        sparkContext = type("S", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Unset())
