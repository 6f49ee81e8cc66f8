"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.storage import written

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def portions(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array], rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none has more than ``rows`` rows or, unless a single row has, ``size`` bytes in ``column`` (or what it takes from a batch)."""
    for batch in batches:
        values = column(batch) if callable(column) else batch.column(column)
        filled = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = filled[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(filled, before + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"({WORD})")).cast("long")


def numbered(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``place`` (rows before this one in its group) and ``before`` (their total of ``value``), in the given order.

    Rows are range-partitioned by group and order, so a group spreads over as many tasks as it needs; each task numbers its
    own rows, and what precedes a task comes from one total per task and group. ``order`` should end in something unique:
    which of two equal rows comes first is open. ``group`` must not be null, nulls in ``value`` count as 0.
    """
    ranged = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", task int, place long, before long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, place, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = np.asarray(pc.dictionary_encode(batch.column(group)).indices, np.int64)
            values = np.asarray(pc.fill_null(batch.column(value).cast(pa.int64()), 0), np.int64)
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            ends = np.r_[starts[1:], n]
            ahead = np.cumsum(values) - values
            place_of, total_of = np.arange(n) - np.repeat(starts, ends - starts), ahead - np.repeat(ahead[starts], ends - starts)
            if batch.column(group)[0].as_py() == last:  # the first stretch goes on from the batch before
                place_of[:ends[0]] += place
                total_of[:ends[0]] += total
            last, place, total = batch.column(group)[n - 1].as_py(), int(place_of[-1]) + 1, int(total_of[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(place_of), pa.array(total_of)],
                                             [*batch.schema.names, "task", "place", "before"])

    local = written(ranged.mapInArrow(number, schema), name)
    totals = local.groupBy("task", group).agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.coalesce(F.col(value), F.lit(0))).alias("sum_"))
    earlier = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", group, F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("rows_"),
                            F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("sum_"))
    # At most one row per task and one more per group: ranges cut a group only at the border of a task.
    return (local.join(F.broadcast(offsets), ["task", group])
            .withColumns({"place": F.col("place") + F.col("rows_"), "before": F.col("before") + F.col("sum_")})
            .drop("task", "rows_", "sum_"))
