"""Whole jobs: profile a table, train and save, score with the latest models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright import presets
from tabwright.operators import distribution, labels, profile, reports, scoring, tuning
from tabwright.operators.features import Preprocessor, feature_names
from tabwright.operators.roles import NUMERIC, Roles, columns_of_type, present
from tabwright.sources import readers, writers
from tabwright.storage import side_table


def profile_by_label(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, DataFrame]:
    """Description and box statistics of all numbers and label shares of all texts, by a label.

    The table is read as often for many columns as for few: quartiles of all columns are found together and serve both the
    description and the boxes, and one count of ``(column, value, label)`` serves all texts.
    """
    found = {}
    if numeric:
        described, _ = side_table(profile.describe(df, numeric, by=[label]), "described")
        found["describe_by_label"] = described
        found["boxes"] = distribution.box_from_description(df.where(F.col(label).isNotNull()), described, numeric, label)
    if categorical:
        counts, _ = side_table(profile.category_counts(df, categorical, label), "categories")
        found["shares"] = profile.label_shares(counts)
    return found


def profile_table(df: DataFrame, numeric: Sequence[str] = tuple(presets.PROFILE_NUMERIC_COLUMNS),
                  categorical: Sequence[str] = tuple(presets.PROFILE_CATEGORICAL_COLUMNS),
                  bins: int = 40) -> dict[str, DataFrame]:
    """Every table of an exploratory report.

    Quantiles, limits and label counts are evaluated on the way, since other tables build on
    them; how often the table is read does not depend on the number of columns.
    """
    numeric, categorical = present(df, numeric), present(df, categorical)
    labelled = labels.risk_label(df)
    return {
        "shape": profile.shape(df), "missing": profile.most_missing(df, 15),
        "duplicates": profile.duplicate_rows(df), "describe": profile.describe(df),
        "label_counts": profile.value_counts(labelled, "risk_label"),
        "histograms": distribution.histograms(df, {c: bins for c in numeric}),
        "correlations": profile.correlations(df, numeric),
    } | profile_by_label(labelled, "risk_label", numeric, categorical)


def profile_files(df: DataFrame, folder: str) -> None:
    """Summary, missing counts, types and correlations as CSV reports."""
    counts = profile.missing_counts(df)
    numeric = columns_of_type(df, *NUMERIC)
    writers.write_report(profile.describe_all(df), f"{folder}/eda_summary.csv")
    writers.write_report(counts.select("feature", "missing"), f"{folder}/eda_missing.csv")
    writers.write_report(counts.select("feature", "dtype"), f"{folder}/eda_dtypes.csv")
    writers.write_report(profile.correlation_matrix(profile.correlations(df, numeric), numeric), f"{folder}/eda_corr.csv")


def catalogue_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Feature catalogue from the files of ``profile_files``."""
    summary, types, missing = (readers.read_report(spark, f"{folder}/eda_{n}.csv") for n in ("summary", "dtypes", "missing"))
    return reports.feature_catalogue(summary, types, missing)


def prepare_and_save(df: DataFrame, path: str, roles: Roles | None = None, format: str = "csv") -> DataFrame:
    """Impute, scale and encode all rows and write them, each task its own files."""
    roles = roles or Roles(presets.NUMERIC_COLUMNS, presets.CATEGORICAL_COLUMNS,
                           presets.BINARY_COLUMNS + presets.PROCEDURE_COLUMNS).present_in(df)
    prepared = Preprocessor(roles).fit_transform(df)
    writers.write_table(prepared, path, format)
    return prepared


def _save_summary(spark: SparkSession, summary: Mapping, path: str) -> None:
    writers.write_json(spark.createDataFrame(pa.Table.from_pylist([dict(summary)])), path)


def model_card(model: PipelineModel, roles: Roles, inputs: T.StructType, classes: Sequence[str] | None = None) -> dict:
    """What scoring needs besides the model: the columns it was trained on, its classes and importances."""
    return {"inputs": inputs.jsonValue(), "classes": list(classes or []),
            "importances": scoring.model_importances(model, feature_names(model, roles))}


def train_and_save_classifiers(df: DataFrame, folder: str, target: str, key: Column, derive_target: bool = False,
                               **options) -> tuning.Run:
    """Train classifiers and leave metrics, confusions, the best model and a summary in ``folder``."""
    if derive_target:
        df = labels.insurance_quality(df, output=target)
    run = tuning.train_classifiers(df, target, key, **options)
    writers.write_report(run.metrics, f"{folder}/metrics_cls.csv")
    documents = writers.confusion_documents(run.confusions)
    for name in run.searches:
        writers.write_json(documents.where(F.col("model") == name), f"{folder}/confusion_{name}.json")
    saved = writers.save_model(run.model, folder, "best_cls_model", card=model_card(run.model, run.roles, run.inputs, run.classes))
    _save_summary(df.sparkSession, {
        "best_model": run.best, "best_test_mcc": run.best_score, "metrics_csv": f"{folder}/metrics_cls.csv",
        "model_artifact": saved, "target": target, "derived_target": derive_target}, f"{folder}/run_cls_summary.json")
    return run


def train_and_save_regressors(df: DataFrame, folder: str, target: str, key: Column, **options) -> tuning.Run:
    run = tuning.train_regressors(df, target, key, **options)
    writers.write_report(run.metrics, f"{folder}/metrics_reg.csv")
    saved = writers.save_model(run.model, folder, "best_reg_model", card=model_card(run.model, run.roles, run.inputs))
    _save_summary(df.sparkSession, {
        "best_model": run.best, "best_test_rmse": run.best_score, "metrics_csv": f"{folder}/metrics_reg.csv",
        "model_artifact": saved, "target": target}, f"{folder}/run_reg_summary.json")
    return run


def score_with_latest(df: DataFrame, class_folder: str, cost_folder: str, classes: Sequence[str] | None = None,
                      columns: Mapping[str, str] | None = None, **options) -> DataFrame:
    """Score every row with the most recently saved models of two training folders, and say why.

    Input columns, classes and importances come from the models' cards; ``classes`` is needed only
    for a model saved without one. ``columns`` renames the inputs of the findings, see ``with_reasons``.
    """
    spark = df.sparkSession
    paths = [writers.latest_model_path(spark, cost_folder, "best_reg_model"), writers.latest_model_path(spark, class_folder, "best_cls_model")]
    cost, risk = (PipelineModel.load(p) for p in paths)
    cards = [writers.load_card(spark, p) for p in paths]
    classes = classes or cards[1].get("classes")
    if not classes:
        raise ValueError("the class model was saved without its classes, name them")
    schema = None
    if all("inputs" in c for c in cards):
        fields = {f.name: f for c in cards for f in T.StructType.fromJson(c["inputs"]).fields}
        schema = T.StructType(list(fields.values()))
    scored = scoring.score_rows(df, cost, risk, classes, schema=schema, **options)
    return scoring.with_reasons(scored, cards[1].get("importances", {}), columns)
