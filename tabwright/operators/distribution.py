"""Plot data: histograms, bin means, box statistics, scatter extracts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.orderstats import ROW_LIMIT, melt, quantiles
from tabwright.storage import side_table


def _limits(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column, one row from one pass; absent when all is null.

    Equal-width bins have no place for infinite values, so a column that has any is refused.
    """
    row = df.agg(*[f(c).alias(f"{c}{i}") for c in columns for i, f in enumerate((F.min, F.max))]).first()
    found = {c: (row[f"{c}0"], row[f"{c}1"]) for c in columns if row[f"{c}0"] is not None}
    endless = [c for c, ends in found.items() if not all(map(math.isfinite, ends))]
    if endless:
        raise ValueError(f"infinite values in {endless}; filter them before binning")
    return found


def _histogram_range(lo: float, hi: float) -> tuple[float, float]:
    """A range without width is opened by half a unit on both sides."""
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _edges(lo: float, hi: float, bins: int) -> list[float]:
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def _left_closed_bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based bin of equal width; the last bin includes the maximum.

    The estimate from the division is corrected against the bin edges themselves.
    """
    step = (hi - lo) / bins
    guess = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    # ``least`` skips nulls, so a missing value would otherwise land in the last bin.
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(value < lo + guess * step, guess - 1)
        .when((guess < bins - 1) & (value >= lo + (guess + 1) * step), guess + 1)
        .otherwise(guess)
    )


def _numbers(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(name)
                       for name, c in columns.items()])


def histograms(df: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """Equal-width histograms of several columns: ``feature, bin, lo, hi, n``, empty bins kept."""
    numbers = _numbers(df, {c: c for c in bins})
    ranges = {c: _histogram_range(*ends) for c, ends in _limits(numbers, list(bins)).items()}
    spine = pa.Table.from_pylist(
        [{"feature": c, "bin": i, "lo": lo, "hi": hi}
         for c, ends in ranges.items()
         for edges in [_edges(*ends, bins[c])]
         for i, (lo, hi) in enumerate(zip(edges, edges[1:]))],
        pa.schema([("feature", pa.string()), ("bin", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
    binned = numbers.select(*[_left_closed_bin(F.col(c), *ranges[c], bins[c]).alias(c) if c in ranges
                              else F.lit(None).cast("int").alias(c) for c in bins])
    counts = binned.unpivot([], list(bins), "feature", "bin").where(F.col("bin").isNotNull()).groupBy(
        "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.createDataFrame(spine).join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def bin_means(df: DataFrame, x: str, y: str, bins: int = 5) -> DataFrame:
    """Mean of ``y`` per equal-width bin of ``x``; bins are closed on the right and 1-based.

    The lowest edge is lowered by a thousandth of the range so that the minimum is included.
    """
    numbers = _numbers(df, {"x": x, "y": y})
    lo, hi = _limits(numbers, ["x"]).get("x", (0.0, 0.0))
    if lo == hi:
        # A single value is widened by a thousandth of itself, or of one at zero.
        margin = abs(lo) * 0.001 if lo else 0.001
        edges = _edges(lo - margin, hi + margin, bins)
    else:
        edges = _edges(lo, hi, bins)
    start, step = edges[0], (edges[-1] - edges[0]) / bins
    guess = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("x") - start) / step))).cast("int")
    number = (
        F.when((guess > 1) & (F.col("x") <= start + (guess - 1) * step), guess - 1)
        .when((guess < bins) & (F.col("x") > start + guess * step), guess + 1)
        .otherwise(guess)
    )
    means = numbers.where(F.col("x").isNotNull()).groupBy(number.alias("bin")).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"))
    if lo != hi:
        edges[0] -= (hi - lo) * 0.001
    spine = pa.Table.from_pylist(
        [{"bin": i + 1, "lo": a, "hi": b} for i, (a, b) in enumerate(zip(edges, edges[1:]))],
        pa.schema([("bin", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
    return df.sparkSession.createDataFrame(spine).join(means, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def _fences(df: DataFrame, column: str, group: str, row_limit: int) -> DataFrame:
    quartiles = quantiles(df, [column], (0.25, 0.5, 0.75), [group], row_limit=row_limit)
    reach = (F.col("q2") - F.col("q0")) * 1.5
    fences = quartiles.select(group, F.col("q0").alias("q1"), F.col("q1").alias("median"),
                            F.col("q2").alias("q3"), (F.col("q0") - reach).alias("fence_lo"),
                            (F.col("q2") + reach).alias("fence_hi"))
    # A local relation is broadcast, so the rows stay where they are however large a group is.
    return side_table(fences, "fences")[0]


def box_statistics(df: DataFrame, column: str, group: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Quartiles, whiskers and number of outliers of ``column`` per group.

    A whisker ends at the furthest value within 1.5 interquartile ranges of its quartile.
    """
    fences = _fences(df, column, group, row_limit)
    v = F.col(column)
    inside = (v >= F.col("fence_lo")) & (v <= F.col("fence_hi"))
    quartiles = ["q1", "median", "q3"]
    return (
        df.select(group, column).where(v.isNotNull()).join(fences, group)
        .groupBy(group)
        .agg(F.count(v).alias("n"), *[F.first(c).alias(c) for c in quartiles],
             F.min(F.when(inside & (v <= F.col("q1")), v)).alias("low"),
             F.max(F.when(inside & (v >= F.col("q3")), v)).alias("high"),
             F.count_if(~inside).alias("outliers"))
        .select(group, "n", *quartiles, F.coalesce("low", "q1").cast("double").alias("whisker_lo"),
                F.coalesce("high", "q3").cast("double").alias("whisker_hi"), "outliers")
    )


def box_from_description(df: DataFrame, described: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """``box_statistics`` of many columns in one pass: ``feature, group, n, q1, median, q3, whisker_lo, whisker_hi, outliers``.

    The quartiles come from a description of the same columns by the same group.
    """
    reach = (F.col("p75") - F.col("p25")) * 1.5
    fences = side_table(described.select("feature", group, F.col("p25").alias("q1"), F.col("p50").alias("median"), F.col("p75").alias("q3"),
                                         (F.col("p25") - reach).alias("fence_lo"), (F.col("p75") + reach).alias("fence_hi")), "fences")[0]
    v = F.col("value")
    inside = (v >= F.col("fence_lo")) & (v <= F.col("fence_hi"))
    quartiles = ["q1", "median", "q3"]
    return (
        melt(df, columns, [group]).where(v.isNotNull()).join(fences, ["feature", group]).groupBy("feature", group)
        .agg(F.count(v).alias("n"), *[F.first(c).alias(c) for c in quartiles],
             F.min(F.when(inside & (v <= F.col("q1")), v)).alias("low"), F.max(F.when(inside & (v >= F.col("q3")), v)).alias("high"),
             F.count_if(~inside).alias("outliers"))
        .select("feature", group, "n", *quartiles, F.coalesce("low", "q1").alias("whisker_lo"), F.coalesce("high", "q3").alias("whisker_hi"), "outliers")
    )


def box_outliers(df: DataFrame, column: str, group: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """The rows of ``df`` that lie beyond the whiskers of their group."""
    fences = _fences(df, column, group, row_limit).select(group, "fence_lo", "fence_hi")
    outside = (F.col(column) < F.col("fence_lo")) | (F.col(column) > F.col("fence_hi"))
    return df.join(fences, group).where(outside).select(*df.columns)


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """All points of a scatter plot."""
    columns = [F.col(x).alias("x"), F.col(y).alias("y")]
    return df.select(*columns, *([F.col(colour).alias("colour")] if colour else []))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Number of points per cell of a grid, for tables with too many points to draw."""
    points = _numbers(df, {"x": x, "y": y}).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    limits = _limits(points, ["x", "y"])
    cell = {c: _left_closed_bin(F.col(c), *_histogram_range(*limits.get(c, (0.0, 0.0))), bins) for c in ("x", "y")}
    return points.groupBy(cell["x"].alias("x_bin"), cell["y"].alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"))
