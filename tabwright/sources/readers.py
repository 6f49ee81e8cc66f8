"""Reading tables and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cleaning import nan_to_null
from tabwright.operators.reports import union_experiments


def read_table(spark: SparkSession, path: str, format: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """A flat table with NaN taken as missing.

    Give a schema for large CSV files: without one Spark reads them an extra time to infer types.
    """
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return nan_to_null(reader.load(path))


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A small CSV report. A first column without a heading holds feature names."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    # Quotes are doubled inside quoted texts, as in JSON parameter columns.
    reader = reader.option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, "feature") if first in ("_c0", "Unnamed: 0") else df


#: One confusion document: labels and a square matrix for each part.
CONFUSION_SCHEMA = (
    "model string, val struct<labels: array<string>, matrix: array<array<bigint>>>, "
    "test struct<labels: array<string>, matrix: array<array<bigint>>>")
SUMMARY_SCHEMA = "best_model string, best_test_mcc double, target string, derived_target boolean"


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
              lines: bool = False) -> DataFrame:
    """JSON documents, one per file over any number of lines, or one per line with ``lines``."""
    return spark.read.option("multiLine", not lines).schema(schema).json(path)


def flatten_confusions(documents: DataFrame) -> DataFrame:
    """Confusion documents as rows ``model, split, actual, predicted, n``."""
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("m")) for s in ("val", "test")])
    rows = documents.select("model", F.explode(parts).alias("p")).select(
        "model", "p.split", F.col("p.m.labels").alias("labels"), F.posexplode("p.m.matrix").alias("i", "row"))
    cells = rows.select("model", "split", "labels", "i", F.posexplode("row").alias("j", "n"))
    return cells.select("model", "split", F.col("labels")[F.col("i")].alias("actual"),
                        F.col("labels")[F.col("j")].alias("predicted"), "n")


def load_experiments(spark: SparkSession, folders: dict[str, str]) -> dict[str, DataFrame]:
    """Metrics, confusions and summaries of several experiments, one table each.

    Every folder holds ``metrics_cls.csv``, ``confusion_<model>.json`` and ``run_cls_summary.json``.
    """
    metrics = {e: read_report(spark, f"{d}/metrics_cls.csv") for e, d in folders.items()}
    confusions = {e: flatten_confusions(read_json(spark, f"{d}/confusion_*.json", CONFUSION_SCHEMA))
                  for e, d in folders.items()}
    summaries = {e: read_json(spark, f"{d}/run_cls_summary.json", SUMMARY_SCHEMA) for e, d in folders.items()}
    return {"metrics": union_experiments(metrics), "confusions": union_experiments(confusions),
            "summaries": union_experiments(summaries)}


def correlation_document(wide: DataFrame) -> tuple[list[str], DataFrame]:
    """Feature order and matrix rows of a wide correlation report."""
    features = [c for c in wide.columns if c != "feature"]
    return features, wide.select("feature", F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("row"))
