"""Exact order statistics and quantiles with bounded state.

Spark's ``percentile`` keeps one map of all distinct values of a group in a single task, which
does not hold for a continuous column of a very large table. Here each pass counts the rows per
cell of an equal-width grid, a small hash aggregation, and keeps only the cells that hold a wanted
position; a few passes leave so few rows that their values can be sorted. Distributions on which
equal-width cells make no headway are narrowed by quantile sketches instead. All counts are
exact, so neither way changes the result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cleaning import named
from tabwright.operators.running import running_totals
from tabwright.storage import side_table

#: Most rows (after narrowing) or distinct values that one window partition may sort.
ROW_LIMIT = 1_000_000
#: Keys with no more rows than this are sorted without narrowing.
DIRECT_ROWS = 50_000

#: Accuracy of the sketches that bracket quantiles, and the distance, in probability, of the marks on either side.
_MARK_ACCURACY = 5_000
_MARGIN = 0.0006
#: Columns of no more values than this are kept whole; in larger ones the margin is many positions.
_FEW_VALUES = 20_000
_GRID = 4_096
_LEVELS = 4
_CELLS = 1_000
_ACCURACY = 10_000


def _marks(value: Column) -> Column:
    """Evenly spaced approximate quantiles, minimum and maximum included."""
    return F.percentile_approx(value, [i / _CELLS for i in range(_CELLS + 1)], _ACCURACY)


def value_sizes(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ``n`` non-null values and their range ``lo`` to ``hi``."""
    value = F.col("value")
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def order_statistics(values: DataFrame, keys: Sequence[str], requests: DataFrame, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Values at 0-based positions of the ascending order within each key.

    ``values`` holds the key columns and ``value``; ``requests`` holds one row per key with ``n``,
    ``lo``, ``hi`` and the array ``positions``. Returns key, ``position``, ``value``, ``less``
    (values below it) and ``equal`` (values equal to it).
    """
    keys = list(keys)
    values = values.select(*keys, "value").where(F.col("value").isNotNull())
    width = F.col("hi").cast("double") - F.col("lo").cast("double")
    most, unbounded = requests.agg(F.max("n"), F.max(width.isin(float("inf")) | F.isnan(width))).first()
    if most is None or most <= min(DIRECT_ROWS, row_limit):
        wanted = requests.select(*keys, F.transform("positions", lambda p: F.struct(
            p.alias("position"), F.lit(0).cast("bigint").alias("base"))).alias("wanted"))
        return _pick(_value_counts(values, keys), keys, wanted)
    if unbounded:
        return _narrowed(values, keys, requests, row_limit)
    return _by_cells(values, keys, requests, row_limit)


def _value_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("equal"))


def _by_cells(values: DataFrame, keys: list[str], requests: DataFrame, row_limit: int) -> DataFrame:
    """Split the range of each key into cells, keep those with a wanted position, and repeat."""
    whole = values
    ranges = requests.select(*keys, "lo", "hi", F.lit(0).cast("bigint").alias("base"), "positions")
    path = list(keys)
    answers: list[DataFrame] = []
    for level in range(_LEVELS):
        cell = f"_cell{level}"
        values = values.join(ranges.select(*path, "lo", "hi"), path)
        # Any non-decreasing numbering keeps the cells in order; rounding does not matter.
        share = (F.col("value").cast("double") - F.col("lo").cast("double")) / (
            F.col("hi").cast("double") - F.col("lo").cast("double"))
        number = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(_GRID - 1), F.floor(share * _GRID)))).cast("int")
        values = values.select(*path, "value", number.alias(cell))
        value = F.col("value")
        counts = values.groupBy(*path, cell).agg(
            F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        order = Window.partitionBy(*path).orderBy(cell)
        # ``start`` is a column of its own: inside a lambda, a new alias would hide an old column.
        placed = (
            counts.withColumn("before", F.sum("n").over(order) - F.col("n"))
            .join(ranges.select(*path, "base", F.col("positions").alias("asked")), path)
            .withColumn("start", F.col("base") + F.col("before")).drop("base", "before")
        )
        inside = F.filter("asked", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n")))
        path = [*path, cell]
        held, _ = side_table(placed.withColumn("positions", inside).where(F.size("positions") > 0).select(
            *path, "lo", "hi", "n", F.col("start").alias("base"), "positions"), "cells")
        answers.append(held.where(F.col("lo") == F.col("hi")).select(
            *keys, F.explode("positions").alias("position"), F.col("lo").alias("value"), F.col("base").alias("less"),
            F.col("n").alias("equal")))
        ranges = held.where(F.col("lo") < F.col("hi"))
        widest = ranges.agg(F.max("n")).first()[0]
        if widest is None:
            break
        if widest <= row_limit:
            wanted = ranges.select(*path, F.transform("positions", lambda p: F.struct(
                p.alias("position"), F.col("base").alias("base"))).alias("wanted"))
            counted = _value_counts(values.join(ranges.select(*path), path), path)
            answers.append(_pick(counted, path, wanted).select(*keys, "position", "value", "less", "equal"))
            break
    else:
        left = ranges.groupBy(*keys).agg(F.flatten(F.collect_list("positions")).alias("positions"))
        answers.append(_narrowed(whole, keys, requests.drop("positions").join(left, keys), row_limit))
    return reduce(DataFrame.unionByName, answers)


def _pick(counts: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("value")
    ranked = counts.withColumn("less", F.sum("equal").over(order) - F.col("equal"))
    hit = F.filter("wanted", lambda w: (w["position"] - w["base"] >= F.col("less"))
                   & (w["position"] - w["base"] < F.col("less") + F.col("equal")))
    return (
        ranked.join(wanted, keys)
        .select(*keys, F.explode(hit).alias("w"), "value", "less", "equal")
        .select(*keys, F.col("w.position").alias("position"), "value",
                (F.col("less") + F.col("w.base")).alias("less"), "equal")
    )


def _narrowed(values: DataFrame, keys: list[str], requests: DataFrame, limit: int) -> DataFrame:
    sketch = values.groupBy(*keys).agg(_marks(F.col("value")).alias("marks"))
    open_ = (
        requests.join(sketch, keys)
        .select(*keys, F.explode("positions").alias("position"), F.lit(0).cast("bigint").alias("base"),
                F.col("n").alias("inner"), "marks")
    )
    bracketed, _ = side_table(_next_brackets(open_, keys), "brackets")
    answers = None
    while True:
        counted, _ = side_table(_count_brackets(values, keys, bracketed), "brackets")
        below, at_lo, inner = F.col("below"), F.col("at_lo"), F.col("inner")
        pos = F.col("position")
        on_lo = (pos >= below) & (pos < below + at_lo)
        on_hi = (F.col("hi") > F.col("lo")) & (pos >= below + at_lo + inner) & (
            pos < below + at_lo + inner + F.col("at_hi"))
        ends = counted.where(on_lo | on_hi).select(
            *keys, "position", F.when(on_lo, F.col("lo")).otherwise(F.col("hi")).alias("value"),
            F.when(on_lo, below).otherwise(below + at_lo + inner).alias("less"),
            F.when(on_lo, at_lo).otherwise(F.col("at_hi")).alias("equal"))
        within = (pos >= below + at_lo) & (pos < below + at_lo + inner)
        inside = counted.where(within)
        ready = inside.where(F.col("distinct_n") <= limit)
        found = ends if ready.isEmpty() else ends.unionByName(_pick_inside(values, keys, ready))
        answers = found if answers is None else answers.unionByName(found)
        # A bracket that misses its position continues on the side where the position is.
        missed = counted.where(~(on_lo | on_hi | within)).select(
            *keys, "position", F.when(pos < below, F.col("least")).otherwise(F.col("hi")).alias("lo"),
            F.when(pos < below, F.col("lo")).otherwise(F.col("greatest")).alias("hi"),
            "least", "greatest")
        wide = inside.where(F.col("distinct_n") > limit).withColumn("base", below + at_lo)
        remaining, _ = side_table(
            _next_brackets(wide, keys).unionByName(missed), "brackets")
        if remaining.isEmpty():
            return answers
        bracketed = remaining


def _next_brackets(open_: DataFrame, keys: list[str]) -> DataFrame:
    """Two marks around the position, one cell wider than the sketch error on either side."""
    share = (F.col("position") - F.col("base") + 0.5) / F.col("inner")
    cell = F.floor(share * _CELLS).cast("int")
    least = F.col("least") if "least" in open_.columns else F.col("marks")[0]
    greatest = F.col("greatest") if "greatest" in open_.columns else F.col("marks")[_CELLS]
    return open_.select(
        *keys, "position",
        F.col("marks")[F.greatest(cell - 1, F.lit(0))].alias("lo"),
        F.col("marks")[F.least(cell + 2, F.lit(_CELLS))].alias("hi"),
        least.alias("least"), greatest.alias("greatest"),
    )


def _count_brackets(values: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Exact counts below, on and between the bracket ends, and a sketch of what lies between."""
    fields = ["position", "lo", "hi", "least", "greatest"]
    packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("b"))
    value = F.col("value")
    between = (value > F.col("lo")) & (value < F.col("hi"))
    return (
        values.join(packed, keys)
        .select(*keys, "value", F.explode("b").alias("b"))
        .select(*keys, "value", *[F.col(f"b.{f}").alias(f) for f in fields])
        .groupBy(*keys, *fields)
        .agg(
            F.count_if(value < F.col("lo")).alias("below"),
            F.count_if(value == F.col("lo")).alias("at_lo"),
            F.count_if(between).alias("inner"),
            F.count_if(value == F.col("hi")).alias("at_hi"),
            F.approx_count_distinct(F.when(between, value)).alias("distinct_n"),
            _marks(F.when(between, value)).alias("marks"),
        )
    )


def _pick_inside(values: DataFrame, keys: list[str], ready: DataFrame) -> DataFrame:
    base = (F.col("below") + F.col("at_lo")).alias("base")
    packed = ready.groupBy(*keys).agg(
        F.collect_list(F.struct("position", "lo", "hi", base)).alias("b"))
    held = F.filter("b", lambda b: (F.col("value") > b["lo"]) & (F.col("value") < b["hi"]))
    counts = (
        values.join(packed, keys)
        .select(*keys, "value", F.explode(held).alias("b"))
        .groupBy(*keys, F.col("b.position").alias("bracket"), "value")
        .agg(F.count(F.lit(1)).alias("equal"))
    )
    wanted = ready.select(*keys, F.col("position").alias("bracket"), F.array(
        F.struct("position", base)).alias("wanted"))
    return _pick(counts, [*keys, "bracket"], wanted).drop("bracket")


def _number(column: str) -> Column:
    return F.nullif(named(column).cast("double"), F.lit(float("nan")))


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form ``by..., feature, value`` of numeric columns; NaN becomes null."""
    return df.select(*by, *[_number(c).alias(c) for c in columns]).unpivot(list(by), [named(c) for c in columns], "feature", "value")


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    extras: Mapping[str, Callable[[Column], Column]] | None = None,
    row_limit: int = ROW_LIMIT,
) -> DataFrame:
    """Exact linearly interpolated quantiles of many columns, optionally per group.

    Returns ``by..., feature, n`` with one column ``q0, q1, ...`` per probability and the
    ``extras``, further aggregates that the first pass computes along with the counts.

    Two passes over the rows serve all columns: the first sums sketches along with the counts, the second counts what lies below the
    bracket that a sketch gives for each probability and keeps the values inside. More than ``SIDE_TABLE_ROWS`` groups, or a
    bracket that misses its position, go through ``order_statistics``.
    """
    by, probs = list(by), list(probs)
    keys = [*by, "feature"]
    if by:
        df = df.where(_all_present(by))
    numbers = df.select(*by, *[_number(c).alias(c) for c in columns])
    packed, small = side_table(_summaries(numbers, columns, probs, by, dict(extras or {})), "sizes")
    sizes = packed.select(*by, F.explode("summaries").alias("s")).select(*by, "s.*")
    found = _between_marks(numbers, columns, probs, by, packed, sizes, row_limit) if small else None
    if found is None:
        spots = [p for prob in probs for p in (_floor_at(prob), _next_at(prob))]
        requests = sizes.where(F.col("n") > 0).withColumn("positions", F.array_distinct(F.array(*spots)))
        at = order_statistics(melt(df, columns, by), keys, requests, row_limit)
        # A group holds at most two positions per probability, so this list is short.
        found = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("at"))
    joined = sizes.join(found, keys, "left")
    columns_out = [
        _interpolated(F.col("at")[_floor_at(p)], F.col("at")[_next_at(p)], _fraction_at(p)).alias(f"q{i}")
        for i, p in enumerate(probs)
    ]
    return joined.select(*keys, "n", *(extras or {}), *columns_out)


def _summaries(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str],
               extras: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group: of every column the number of values, their range, the ``extras``, and marks around each probability."""
    figures = {"n": F.count, "lo": F.min, "hi": F.max, **extras}
    around = [min(max(p + side * _MARGIN, 0.0), 1.0) for p in probs for side in (-1, 1)]
    summaries = [F.struct(F.lit(c).alias("feature"), *[f(named(c)).alias(n) for n, f in figures.items()],
                          F.percentile_approx(named(c), around, _MARK_ACCURACY).alias("marks_")) for c in columns]
    packed = numbers.groupBy(*by).agg(*[s.alias(f"_{i}") for i, s in enumerate(summaries)])
    return packed.select(*by, F.array(*[F.col(f"_{i}") for i in range(len(columns))]).alias("summaries"))


def _between_marks(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str], packed: DataFrame, sizes: DataFrame,
                   row_limit: int) -> DataFrame | None:
    """``by..., feature, at``: the values at the positions that the probabilities need; None if a bracket misses one."""
    # In few values the sketch may be a position or two off, so that all of them are kept.
    few = F.lit(_FEW_VALUES)
    edges = F.flatten(F.transform("summaries", lambda s: F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda j: F.struct(
        F.when(s["n"] <= few, s["lo"]).otherwise(F.get(s["marks_"], 2 * j)).alias("lo"),
        F.when(s["n"] <= few, s["hi"]).otherwise(F.get(s["marks_"], 2 * j + 1)).alias("hi")))))
    edged = packed.select(*by, edges.alias("edges_"))
    if by:
        rows = numbers.join(F.broadcast(edged), by)
        edge = [(F.col("edges_")[k]["lo"], F.col("edges_")[k]["hi"]) for k in range(len(columns) * len(probs))]
    else:
        rows = numbers
        edge = [tuple(F.lit(x).cast("double") for x in (e["lo"], e["hi"])) for e in edged.first()["edges_"]]
    bracketed = [(k, named(c), *edge[k]) for k, c in enumerate(c for c in columns for _ in probs)]
    hits = F.array_compact(F.array(*[F.when((x >= lo) & (x <= hi), F.struct(F.lit(k).alias("bracket"), x.alias("value"))) for k, x, lo, hi in bracketed]))
    none = F.array(F.lit(None).cast("struct<bracket:int,value:double>"))
    # Every row counts once without a hit, for what it is below of, and once for every bracket that it lies in.
    rows = rows.select("*", F.explode(F.concat(none, hits)).alias("hit_"))
    below = [F.count_if(F.col("hit_").isNull() & (x < lo)).alias(f"below_{k}") for k, x, lo, _ in bracketed]
    counted = rows.groupBy(*by, F.col("hit_.bracket").alias("bracket_"), F.col("hit_.value").alias("value_")).agg(F.count(F.lit(1)).alias("equal_"), *below)
    counted, few_rows = side_table(counted, "brackets")
    if few_rows:
        return _picked_here(counted, sizes, columns, probs, by)
    befores = counted.where(F.col("bracket_").isNull()).select(*by, F.posexplode(F.array(*[F.col(f"below_{k}") for k in range(len(bracketed))])).alias("bracket_", "below_"))
    inside = counted.where(F.col("bracket_").isNotNull()).select(*by, "bracket_", "value_", "equal_")
    totals = running_totals(inside, "value_", {"equal_": F.sum("equal_")}, [*by, "bracket_"], window_rows=row_limit)
    spots = F.array(*[F.struct(F.lit(j).alias("prob"), position.alias("position")) for j, p in enumerate(probs) for position in (_floor_at(p), _next_at(p))])
    number = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i * len(probs)))])[F.col("feature")]
    wanted = sizes.where(F.col("n") > 0).select(*by, "feature", F.explode(F.array_distinct(spots)).alias("s"), number.alias("first_"))
    wanted = wanted.select(*by, "feature", (F.col("first_") + F.col("s.prob")).alias("bracket_"), F.col("s.position").alias("position_"))
    wanted = wanted.join(befores, [*by, "bracket_"])
    place = F.col("position_") - F.col("below_")
    holds = (place >= F.col("equal__before")) & (place < F.col("equal__before") + F.col("equal_"))
    # Brackets of neighbouring probabilities may both hold a position.
    at = wanted.join(totals, [*by, "bracket_"], "left").groupBy(*by, "feature", "position_").agg(F.max(F.when(holds, F.col("value_"))).alias("value_"))
    rows = at.toArrow()  # at most two positions per probability, column and group of the side table
    if rows.column("value_").null_count:
        return None
    found = numbers.sparkSession.createDataFrame(rows, at.schema)
    return found.groupBy(*by, "feature").agg(F.map_from_entries(F.collect_list(F.struct("position_", "value_"))).alias("at"))


def _picked_here(counted: DataFrame, sizes: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str]) -> DataFrame | None:
    """The end of ``_between_marks`` for brackets that a side table holds: a few thousand counts, looked up on the driver."""
    below: dict[tuple, list[int]] = {}
    inside: dict[tuple, list[tuple[float, int]]] = {}
    for r in counted.collect():
        group = tuple(r[c] for c in by)
        if r["bracket_"] is None:
            below[group] = [r[f"below_{k}"] for k in range(len(columns) * len(probs))]
        else:
            inside.setdefault((group, r["bracket_"]), []).append((r["value_"], r["equal_"]))
    placed = {}
    for key, values in inside.items():
        values.sort()
        placed[key] = ([v for v, _ in values], list(accumulate(n for _, n in values)))
    first = {c: i * len(probs) for i, c in enumerate(columns)}
    found = []
    for r in sizes.where(F.col("n") > 0).collect():
        group, at = tuple(r[c] for c in by), {}
        for j, p in enumerate(probs):
            floor = math.floor((r["n"] - 1) * float(p))
            values, ends = placed.get((group, first[r["feature"]] + j), ([], []))
            for position in {floor, min(floor + 1, r["n"] - 1)}:
                place = position - below[group][first[r["feature"]] + j]
                if not 0 <= place < (ends[-1] if ends else 0):
                    return None
                at[position] = values[bisect_right(ends, place)]
        found.append((*group, r["feature"], at))
    fields = [*[f for f in sizes.schema.fields if f.name in by], T.StructField("feature", T.StringType()), T.StructField("at", T.MapType(T.LongType(), T.DoubleType()))]
    return sizes.sparkSession.createDataFrame(found, T.StructType(fields))


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    row_limit: int = ROW_LIMIT) -> dict[str, list[float | None]]:
    """``quantiles`` of whole columns as plain numbers, one short list per column."""
    rows = quantiles(df, columns, probs, row_limit=row_limit).collect()
    found = {r["feature"]: [r[f"q{i}"] for i in range(len(probs))] for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def _all_present(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def _floor_at(prob: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(float(prob))).cast("bigint")


def _next_at(prob: float) -> Column:
    return F.least(_floor_at(prob) + 1, F.col("n") - 1)


def _fraction_at(prob: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(prob)) - _floor_at(prob)


def _interpolated(low: Column, high: Column, fraction: Column) -> Column:
    # At a whole position the next value does not count, infinite or not.
    return F.when(fraction == 0, low).otherwise(low + (high - low) * fraction)
