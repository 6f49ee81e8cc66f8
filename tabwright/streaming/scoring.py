"""Scoring rows as they arrive, the continuous counterpart of a request-by-request service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabwright.operators.scoring import score_rows
from tabwright.storage import scratch_path


def score_stream(rows: DataFrame, cost_model: Model, class_model: Model, classes: Sequence[str], **columns) -> DataFrame:
    """``score_rows`` on a streaming table; it keeps no state."""
    if not rows.isStreaming:
        raise ValueError("not a streaming table, use score_rows")
    return score_rows(rows, cost_model, class_model, classes, **columns)


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """Files that appear in a folder."""
    return spark.readStream.format(format).schema(schema).load(path)


def write_scores(scored: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append scored rows to a folder, then stop when the waiting input is used up."""
    checkpoint = checkpoint or scratch_path(scored.sparkSession, "stream")
    return (
        scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
