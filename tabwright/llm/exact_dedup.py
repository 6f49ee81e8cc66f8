"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, an external sort places equal ones next to each other, and each row
is compared in full with its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabwright.llm.tables import portions, text_bytes
from tabwright.storage import written

#: Bytes of a text that a splitter holds; the digest orders texts that agree in them, so splitters stay short.
SPLITTER_BYTES = 64

_KEYED = pa.schema([("doc_id", pa.int64()), ("head", pa.binary()), ("digest", pa.binary()), ("body", pa.binary())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("task", pa.int32()), ("run", pa.int64()),
                   ("first", pa.bool_()), ("first_id", pa.int64()), ("run_size", pa.int64()), ("edge", pa.binary())])
_RUNS_SQL = "doc_id long, text_sha256 string, task int, run long, first boolean, first_id long, run_size long, edge binary"
_FLUSH_ROWS = 8192


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches, "text"):
        bodies = [b.lower() for b in text_bytes(part.column("text"))]  # bytes.lower() changes A-Z alone
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([b[:SPLITTER_BYTES] for b in bodies], pa.binary()),
             pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array(bodies, pa.binary())], schema=_KEYED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of one sorted task; the first row of its outer runs carries their text."""
    task = TaskContext.get().partitionId()
    out: list[tuple] = []
    run, body, digest, ids = -1, None, b"", []

    def close(last: bool) -> None:
        edge = body if run == 0 or last else None
        for k, doc_id in enumerate(ids):
            out.append((doc_id, digest.hex(), task, run, k == 0, ids[0], len(ids), edge if k == 0 else None))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUNS)], schema=_RUNS)
        out.clear()
        return batch

    for batch in batches:
        for doc_id, d, b in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("body").to_pylist()):
            if b != body:
                if run >= 0:
                    close(False)
                run, body, digest, ids = run + 1, b, d, []
            ids.append(doc_id)
        if len(out) >= _FLUSH_ROWS:
            yield flush()
    if run >= 0:
        close(True)
        yield flush()


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after lower-casing A-Z; a null text is an empty one. The row with the largest id of each
    group stays; of rows that repeat that id and text, exactly one. A null id is smaller than any other, and ``keep_id`` is
    null only where no row of the group has an id. Other columns are ignored; an empty table gives no rows.

    The range key is a short head of the text, its digest and the id. Equal texts are therefore contiguous over all tasks, yet
    copies of one text, however many, split between tasks. Runs that touch the border of a task (at most two per task) meet
    in one more comparison of whole texts.
    """
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        _keyed, "doc_id long, head binary, digest binary, body binary")
    order = ["head", "digest", F.col("doc_id").desc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions("head", "digest", "body", F.col("doc_id").desc_nulls_last())
    runs = written(ordered.select("doc_id", "digest", "body").mapInArrow(_runs, _RUNS_SQL), "exact-runs")
    edges = runs.filter(F.col("edge").isNotNull())
    whole = edges.groupBy("edge").agg(F.max("first_id").alias("whole_id"), F.sum("run_size").alias("whole_size"),
                                      F.min("task").alias("first_task"))
    spans = edges.select("edge", "task", "run").join(whole, "edge").drop("edge")
    return runs.drop("edge").join(spans, ["task", "run"], "left").select(
        "doc_id", F.coalesce("whole_id", "first_id").alias("keep_id"), F.coalesce("whole_size", "run_size").alias("group_size"),
        (F.col("first") & (F.col("task") == F.coalesce("first_task", "task"))).alias("kept"), "text_sha256")


@F.pandas_udf(StringType())
def _text_sha256(text: pd.Series) -> pd.Series:
    return text.map(lambda v: hashlib.sha256((v or "").encode().lower()).hexdigest())


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat a kept id and text stay once.

    Nulls, empty and very long texts and ties count as in ``exact_duplicates``; an empty table gives an empty one, and columns may have any names.
    """
    def key(doc_id: Column, sha: Column) -> Column:
        # One column, so that the join and the last step share a partitioning.
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")), sha).alias("own")

    kept = exact_duplicates(docs).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")))
    rows = docs.select(F.struct("*").alias("whole"), key(F.col("doc_id"), _text_sha256(F.col("text").cast("string"))))
    return rows.join(kept.hint("merge"), "own").dropDuplicates(["own"]).select("whole.*")
