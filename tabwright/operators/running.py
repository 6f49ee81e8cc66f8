"""Running totals and average ranks over a whole table without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.storage import SIDE_TABLE_ROWS, side_table, written

#: Most rows that one window partition may sort.
WINDOW_ROWS = 1_000_000


def running_totals(
    rows: DataFrame,
    order: str,
    measures: Mapping[str, Column],
    keys: Sequence[str] = (),
    descending: bool = False,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Aggregate ``rows`` to distinct ``order`` values and add running totals.

    For every measure ``m`` the result has ``m``, ``m_before`` (total of the preceding values) and
    ``m_next`` (the measure of the following value, null at the end). Null and NaN have no place
    in an order and are left out. Equal values collapse before any window, so a value that many
    rows share costs one row. Beyond ``window_rows`` distinct values the table is
    range-partitioned and written, each partition is summed on its own, and the totals of the
    preceding partitions are added; their number grows with the table.
    """
    keys = list(keys)
    rows = rows.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double")))
    # Kept on disk, so that neither its size nor its ranges evaluate the source again, and the plan still shows the source.
    table = rows.groupBy(*keys, order).agg(*[m.alias(n) for n, m in measures.items()]).persist(StorageLevel.DISK_ONLY)
    distinct = table.count()
    cut = distinct > window_rows
    if cut:
        parts = math.ceil(2 * distinct / window_rows)
        # The partition number must not change between the uses of the table, so it is written.
        table = written(table.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()), "running-parts")
    else:
        table = table.withColumn("_part", F.lit(0))

    sequence = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy(*keys, "_part").orderBy(sequence)
    result = table.select(
        "*",
        *[(F.sum(m).over(within) - F.col(m)).alias(f"{m}_before") for m in measures],
        *[F.lead(m).over(within).alias(f"{m}_next") for m in measures],
    )
    if not cut:
        return result.drop("_part")

    # At most one row per partition and one more per key.
    first = F.max_by if descending else F.min_by
    totals = table.groupBy(*keys, "_part").agg(
        *[F.sum(m).alias(f"{m}_sum") for m in measures],
        *[first(m, order).alias(f"{m}_first") for m in measures],
    )
    part_order = F.col("_part").desc() if descending else F.col("_part").asc()
    across = Window.partitionBy(*keys).orderBy(part_order)
    offsets = totals.select(
        *keys, "_part",
        *[(F.sum(f"{m}_sum").over(across) - F.col(f"{m}_sum")).alias(f"{m}_offset") for m in measures],
        *[F.lead(f"{m}_first").over(across).alias(f"{m}_entry") for m in measures],
    )
    joined = result.join(offsets, [*keys, "_part"])
    return joined.select(
        *keys, order, *measures,
        *[(F.col(f"{m}_before") + F.col(f"{m}_offset")).alias(f"{m}_before") for m in measures],
        *[F.coalesce(f"{m}_next", f"{m}_entry").alias(f"{m}_next") for m in measures],
    )


def average_ranks(df: DataFrame, column: str, output: str = "rank", hot_values: int = 1_000,
                  window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add the 1-based average rank of ``column``; ties share their mean rank, null stays null.

    The rank table has one row per distinct value. At most ``hot_values`` values can each hold
    more than ``1 / hot_values`` of the rows; those are looked up by broadcast, so the shuffle
    join that serves the rest never meets a large key.
    """
    if output in df.columns:
        raise ValueError(f"column {output!r} exists already")
    value = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    keyed = df.withColumn("_value", value)
    table = running_totals(keyed.select("_value"), "_value", {"_n": F.count(F.lit(1))},
                           window_rows=window_rows)
    ranks = table.select("_value", "_n", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(output))
    total, distinct = keyed.agg(F.count("_value"), F.approx_count_distinct("_value")).first()
    if distinct <= SIDE_TABLE_ROWS:
        return keyed.join(side_table(ranks.drop("_n"), "ranks")[0], "_value", "left").drop("_value")

    ranks = written(ranks, "ranks")
    hot = F.broadcast(ranks.where(F.col("_n") * hot_values > total).drop("_n"))
    cold = ranks.where(F.col("_n") * hot_values <= total).drop("_n")
    frequent = keyed.join(hot, "_value")
    rare = keyed.where(F.col("_value").isNotNull()).join(hot, "_value", "left_anti").join(cold, "_value")
    missing = keyed.where(F.col("_value").isNull()).withColumn(output, F.lit(None).cast("double"))
    columns = [*df.columns, output]
    return frequent.select(columns).unionByName(rare.select(columns)).unionByName(missing.select(columns))
