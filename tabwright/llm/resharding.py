"""Resharding that moves the fewest bytes: a minimum-cost flow between old and new shards, then a rewrite of what changed."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.tables import numbered
from tabwright.storage import written

#: Rows and units of size that one written file holds at most (a single row may be larger).
FILE_ROWS, FILE_SIZE = 1_000_000, 1 << 24
#: Beyond so many files they grow instead, so the table of their first rows stays small enough to broadcast.
MOST_FILES = 10_000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Units sent from each old shard ``i`` to each new shard ``j`` at the least total cost.

    Successive shortest paths with potentials over the bipartite graph of shards. Everything supplied is sent, so the
    capacities must suffice.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not suffice")
    olds, news = range(len(supply)), range(len(capacity))
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    # Nodes: ("o", i) and ("n", j). All costs are at least 0, so potentials may start at 0.
    potential = {("o", i): 0 for i in olds} | {("n", j): 0 for j in news}
    while any(left):
        distance = {("o", i): 0 for i in olds if left[i]}
        came: dict = {}
        heap = [(0, x) for x in distance]
        done = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            kind, k = x
            # A forward edge to every new shard, a backward edge along what already flows into this one.
            edges = [(("n", j), cost(k, j)) for j in news] if kind == "o" else [(("o", i), -cost(i, k)) for i in olds if flow.get((i, k))]
            for y, c in edges:
                reduced = d + c + potential[x] - potential[y]
                if y not in done and reduced < distance.get(y, reduced + 1):
                    distance[y], came[y] = reduced, x
                    heapq.heappush(heap, (reduced, y))
        furthest = max(distance.values())
        for x in potential:
            potential[x] += distance.get(x, furthest)
        end = min((("n", j) for j in news if room[j]), key=lambda x: (potential[x], x))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0][1]], room[end[1]], *(flow[y[1], x[1]] for x, y in steps if x[0] == "n")])
        for x, y in steps:
            if x[0] == "o":
                flow[x[1], y[1]] = flow.get((x[1], y[1]), 0) + amount
            else:
                flow[y[1], x[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(rows: DataFrame, old: str, size: str, capacities: Callable[[int], Sequence[int]] | Sequence[int], order: list[Column]) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in every shard) to rows that lie in the shards named by the int column ``old``.

    ``capacities`` holds one number per new shard, or makes them from the total. The flow decides how many units of ``size``
    leave which shard for which. The rows of an old shard stand in line, the largest first and then by ``order``; the head of
    the line stays and its small rows move, so every shard meets its capacity to within about one small row per transfer.
    ``old`` and ``size`` must not be null. Repeated rows are ordinary rows, an empty table stays empty. Only totals per shard
    and pair of shards reach the driver. ``place`` and ``before`` (rows and units ahead in the line) are added too; ``rows`` must have no
    columns of these names, nor ``task``: ``reshard_layout`` takes any.
    """
    lined = numbered(rows, old, [F.col(size).desc(), *order], size, "reshard")
    spark = rows.sparkSession
    held = {r[0]: r[1] for r in lined.groupBy(old).agg(F.sum(size)).collect()}
    total = sum(held.values())
    wanted = list(capacities(total)) if callable(capacities) else list(capacities)
    olds = sorted(held)
    # A byte costs 1 unless it stays.
    flow = min_cost_flow([held[i] for i in olds], wanted, lambda i, j: int(olds[i] != j))
    cuts, start = [], {i: 0 for i in olds}
    for (k, j), units in sorted(flow.items(), key=lambda x: (x[0][0], olds[x[0][0]] != x[0][1], x[0][1])):
        i = olds[k]
        cuts.append((i, j, start[i], start[i] + units))
        start[i] += units
    # Rows of size 0 stand at the end of the line and go with the last cut. A shard of nothing else has no flow: it stays where it is, if it can.
    if held and not wanted:
        raise ValueError("no new shards")
    cuts += [(i, i if 0 <= i < len(wanted) else 0, 0, 0) for i in olds if not held[i]]
    last = {i: k for k, (i, _, _, _) in enumerate(cuts)}
    cuts = [(*cut, last[cut[0]] == k) for k, cut in enumerate(cuts)]
    # A row goes where its middle lies. At most one cut per old and new shard, so this side of the join is bounded.
    table = spark.createDataFrame(cuts, f"`{old}` int, shard int, from_ long, to_ long, last_ boolean")
    middle = 2 * F.col("before") + F.col(size)
    placed = lined.join(F.broadcast(table), old).filter((middle >= 2 * F.col("from_")) & ((middle < 2 * F.col("to_")) | F.col("last_"))).drop("from_", "to_", "last_")
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy(old, "shard").agg(F.count(F.lit(1))).collect()}
    shifts, filled, passed = [], {}, {}
    for i, j, *_ in cuts:
        n = counts.get((i, j), 0)
        shifts.append((i, j, filled.get(j, 0) - passed.get(i, 0)))
        filled[j], passed[i] = filled.get(j, 0) + n, passed.get(i, 0) + n
    shift = spark.createDataFrame(shifts, f"`{old}` int, shard int, shift_ long")
    return placed.join(F.broadcast(shift), [old, "shard"]).withColumn("slot", F.col("place") + F.col("shift_")).drop("shift_")


#: Columns of a written layout beside the shard, which names the folder: the whole row, a number of its own and its slot.
def layout_schema(row: T.StructType, shard: str) -> T.StructType:
    return T.StructType([T.StructField("row", row), T.StructField("id", T.LongType()), T.StructField("slot", T.LongType()), T.StructField(shard, T.IntegerType())])


def write_layout(rows: DataFrame, shard: Column, folder: str) -> None:
    """Write whole rows below ``folder`` as ``old=N``, N from ``shard``; they get a number of their own and no slot yet."""
    rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id"), F.lit(None).cast("long").alias("slot"),
                shard.cast("int").alias("old")).write.option("compression", "zstd").partitionBy("old").parquet(folder)


def planned(spark: SparkSession, folder: str, row: T.StructType, size: Callable[[str], Column], order: Callable[[str], list[Column]],
            capacities: Callable[[int], Sequence[int]] | Sequence[int]) -> DataFrame:
    """The plan for a written layout: ``old, id, line, size, place, before, shard, slot``, without the rows themselves.

    ``size`` and ``order`` make the size and the order of a row from the name of its struct column. ``line`` compares like the rows stand
    in line: the largest first, then by ``order`` (nulls first), then by ``id``, so no two are equal.
    """
    line = F.struct((-size("row")).alias("less"), *(c.alias(f"o{k}") for k, c in enumerate(order("row"))), "id")
    rows = spark.read.schema(layout_schema(row, "old")).parquet(folder)
    narrow = written(rows.select("old", "id", line.alias("line"), size("row").cast("long").alias("size")), "reshard-sizes")
    return written(reshard(narrow, "old", "size", capacities, [F.col("line")]), "reshard-plan")


def rewrite(plan: DataFrame, folder: str, row: T.StructType, size: Callable[[str], Column], order: Callable[[str], list[Column]], target: str,
            file_size: int = FILE_SIZE, file_rows: int = FILE_ROWS) -> dict[int, str]:
    """Write the shards that lose or gain rows below ``target`` as ``shard=N``; returns the folder of every shard that has rows.

    A shard that nothing leaves or enters keeps its folder and is not read again. What the plan says of a row follows from where the
    row stands in line, so only the first place of every new file is broadcast, at most ``MOST_FILES`` of them and two per pair
    of shards, and the rows are shuffled once. Files hold consecutive slots.
    """
    spark = plan.sparkSession
    pairs = {(r[0], r[1]): r[2] for r in plan.groupBy("old", "shard").agg(F.sum("size")).collect()}  # one per pair of shards
    left, filled = {i for i, j in pairs if i != j}, {j for _, j in pairs}
    entered = {j for i, j in pairs if i != j}
    affected = sorted(filled & (left | entered))
    paths = {j: f"{target}/shard={j}" if j in affected else f"{folder}/old={j}" for j in sorted(filled)}
    if not affected:
        return paths
    file_size = max(file_size, sum(pairs.values()) // MOST_FILES)
    file_rows = max(file_rows, plan.count() // MOST_FILES)
    file = F.floor(F.col("before") / file_size) + F.floor(F.col("place") / file_rows)
    firsts = plan.groupBy("old", "shard", file.alias("file")).agg(F.min("line").alias("first"), F.min("slot").alias("first_slot"))
    # A cut ends where the next of its old shard starts.
    ends = F.lead("first").over(Window.partitionBy("old").orderBy("first"))
    cuts = firsts.withColumn("end", ends).filter(F.col("shard").isin(affected)).withColumnRenamed("old", "of")
    line = F.struct((-size("row")).alias("less"), *(c.alias(f"o{k}") for k, c in enumerate(order("row"))), "id")
    sources = sorted({i for i, j in pairs if j in affected})
    rows = spark.read.schema(layout_schema(row, "old")).parquet(folder).filter(F.col("old").isin(sources)).withColumn("line", line)
    inside = (F.col("old") == F.col("of")) & (F.col("line") >= F.col("first")) & (F.col("end").isNull() | (F.col("line") < F.col("end")))
    ahead = F.row_number().over(Window.partitionBy("shard", "old", "file").orderBy("line")) - 1
    moved = rows.drop("slot").join(F.broadcast(cuts), inside).withColumn("slot", F.col("first_slot") + ahead)
    moved.select("row", "id", "slot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(target)
    return paths


def reshard_layout(spark: SparkSession, folder: str, row: T.StructType, size: Callable[[str], Column], order: Callable[[str], list[Column]],
                   capacities: Callable[[int], Sequence[int]] | Sequence[int], target: str, **files) -> tuple[DataFrame, dict[int, str]]:
    """Plan the resharding of what ``write_layout`` wrote and rewrite the affected shards; returns all rows as ``row, id, slot, shard`` and the folders.

    Rewritten rows are read from their new files. Those of an untouched shard come from its old files, with the slots of the plan. Rows may have columns of any name, since they
    travel as a struct; null and empty texts, very long ones and repeated rows are ordinary rows of their size, and an empty layout stays empty.
    """
    plan = planned(spark, folder, row, size, order, capacities)
    paths = rewrite(plan, folder, row, size, order, target, **files)
    untouched = sorted(j for j, path in paths.items() if not path.startswith(f"{target}/"))
    found = None
    if len(untouched) < len(paths) or not paths:
        new = spark.read.schema(layout_schema(row, "shard"))
        found = new.parquet(target) if paths else spark.createDataFrame([], layout_schema(row, "shard"))
    if untouched:
        kept = spark.read.schema(layout_schema(row, "old")).parquet(folder).filter(F.col("old").isin(untouched)).drop("slot", "old")
        kept = kept.join(plan.filter(F.col("shard").isin(untouched)).select("id", "slot", "shard").hint("merge"), "id")
        found = kept if found is None else found.unionByName(kept)
    return found, paths
