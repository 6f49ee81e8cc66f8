"""Writing tables, reports and fitted models."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.evaluate import confusion_grid


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Rows of any number; each task writes its own part files."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few rows as one CSV part file."""
    df.coalesce(1).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few documents, one JSON document per line of one part file."""
    df.coalesce(1).write.mode(mode).json(path)


def confusion_documents(counts: DataFrame) -> DataFrame:
    """One document per model with labels and matrix of both parts, from ``model, split`` counts."""
    grids = confusion_grid(counts, ["model", "split"])
    part = lambda s: F.max(F.when(F.col("split") == s, F.struct("labels", "matrix"))).alias(s)
    return grids.groupBy("model").agg(part("val"), part("test"))


def curve_documents(curves: DataFrame) -> DataFrame:
    """Learning curves with one row per experiment and model and parallel arrays by training size."""
    fields = ["train_size", "train_mean", "train_std", "val_mean", "val_std"]
    packed = curves.groupBy("experiment", "model").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("points"))
    names = dict(zip(fields, ["train_sizes", *fields[1:]]))
    return packed.select("experiment", "model", *[F.col(f"points.{f}").alias(n) for f, n in names.items()])


def save_model(model: PipelineModel, folder: str, prefix: str, stamp: str | None = None, card: Mapping | None = None) -> str:
    """Save under ``folder/prefix_<time>`` and return the path.

    ``card`` is what scoring has to know besides the model (input columns, classes, importances);
    it travels with the model as one JSON document.
    """
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder}/{prefix}_{stamp}"
    model.write().overwrite().save(path)
    if card is not None:
        text = SparkSession.active().createDataFrame([(json.dumps(card),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/card")
    return path


def load_card(spark: SparkSession, path: str) -> dict:
    """The card of a saved model; empty when it was saved without one."""
    try:
        return json.loads(spark.read.text(f"{path}/card").first()["value"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def latest_model_path(spark: SparkSession, folder: str, prefix: str) -> str:
    """Most recently saved model whose name starts with ``prefix``."""
    files = spark.read.format("binaryFile").load(f"{folder}/{prefix}_*/metadata/part-*")
    newest = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise FileNotFoundError(f"no model {prefix}_* in {folder}")
    return newest["path"].split("/metadata/")[0]


def load_latest(spark: SparkSession, folder: str, prefix: str) -> PipelineModel:
    return PipelineModel.load(latest_model_path(spark, folder, prefix))
