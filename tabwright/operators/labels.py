"""Derived labels: cost above the median, and quality grades from tercile scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright import presets
from tabwright.functions.cleaning import first_present, mapped_score, to_number
from tabwright.operators.orderstats import ROW_LIMIT, order_statistics, quantile_values, value_sizes
from tabwright.storage import side_table


def risk_label(df: DataFrame, existing: str = "is_high_risk", costs: Sequence[str] = tuple(presets.COST_COLUMNS),
               output: str = "risk_label", row_limit: int = ROW_LIMIT) -> DataFrame:
    """Copy an existing label, or mark the rows whose cost exceeds the median cost.

    The first of ``costs`` that the table has is used. A missing cost is not above the median.
    """
    if existing in df.columns:
        return df.withColumn(output, F.col(existing))
    cost = next((c for c in costs if c in df.columns), None)
    if cost is None:
        raise ValueError(f"no label {existing!r} and none of the cost columns {list(costs)}")
    median = quantile_values(df, [cost], [0.5], row_limit)[cost][0]
    if median is None:
        return df.withColumn(output, F.lit(0))
    known = ~F.isnan(F.col(cost).cast("double"))
    return df.withColumn(output, F.coalesce(known & (F.col(cost) > median), F.lit(False)).cast("int"))


@dataclass(frozen=True)
class RankBins:
    """Bins of a column by quantiles of its average ranks, stored as cuts in value space.

    Equal values always share a bin, so assigning bins needs neither ranks nor a shuffle.
    ``cuts`` holds (value, inclusive): bin ``i`` takes the values up to cut ``i``.
    """

    column: str
    cuts: tuple[tuple[float, bool], ...]
    bins: int

    def bin(self, lower_is_better: bool = False) -> Column:
        """1-based bin as a double, null for missing values or when no bin exists."""
        value = to_number(F.col(self.column))
        number = F.lit(float(self.bins))
        for i, (cut, inclusive) in reversed(list(enumerate(self.cuts))):
            below = value <= F.lit(cut) if inclusive else value < F.lit(cut)
            number = F.when(below, F.lit(float(i + 1))).otherwise(number)
        if self.bins == 0:
            return F.lit(None).cast("double")
        number = (self.bins + 1) - number if lower_is_better else number
        return F.when(value.isNotNull() & ~F.isnan(value), number)


def fit_rank_bins(df: DataFrame, columns: Sequence[str], bins: int = 3,
                  row_limit: int = ROW_LIMIT) -> dict[str, RankBins]:
    """Find the rank-quantile bins of several columns together.

    Bin edges are quantiles of the average ranks; coinciding edges merge, so heavily tied
    columns get fewer bins.
    """
    values = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    values = values.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in columns])
    long = values.unpivot([], list(columns), "feature", "value")
    sizes, _ = side_table(value_sizes(long, ["feature"]), "sizes")
    # The positions depend on n through double arithmetic, which Python and Spark share.
    counts = {r["feature"]: r["n"] for r in sizes.collect()}
    spots = {c: sorted({p for a, b, _ in _edge_positions(n, bins) for p in (a, b)})
             for c, n in counts.items() if n}
    if not spots:
        return {c: RankBins(c, (), 0) for c in columns}
    positions = F.create_map(*[x for c, p in spots.items() for x in (F.lit(c), F.array(*[
        F.lit(i).cast("bigint") for i in p]))])
    requests = sizes.where(F.col("n") > 0).withColumn("positions", positions[F.col("feature")])
    found: dict[str, dict[int, tuple[float, float]]] = {}
    for r in order_statistics(long, ["feature"], requests, row_limit).collect():
        rank = r["less"] + (r["equal"] + 1) / 2
        found.setdefault(r["feature"], {})[r["position"]] = (r["value"], rank)
    return {c: _rank_bins(c, counts.get(c, 0), bins, found.get(c, {})) for c in columns}


def _edge_positions(n: int, bins: int) -> list[tuple[int, int, float]]:
    """Positions below and above each edge and the fraction between them."""
    if n == 0:
        return []
    places = []
    for i in range(bins + 1):
        h = (n - 1) * ((i / bins) * 100 / 100)
        low = math.floor(h)
        places.append((low, min(low + 1, n - 1), h - low))
    return places


def _rank_bins(column: str, n: int, bins: int, found: Mapping[int, tuple[float, float]]) -> RankBins:
    edges: list[tuple[float, tuple[float, bool]]] = []
    for low, high, fraction in _edge_positions(n, bins):
        (value_a, a), (value_b, b) = found[low], found[high]
        edge = b - (b - a) * (1 - fraction) if fraction >= 0.5 else a + (b - a) * fraction
        if b <= edge:
            cut = (value_b, True)
        elif a <= edge:
            cut = (value_a, True)
        else:
            cut = (value_a, False)
        if not edges or edge != edges[-1][0]:
            edges.append((edge, cut))
    return RankBins(column, tuple(cut for _, cut in edges[1:-1]), max(len(edges) - 1, 0))


def median_bin(df: DataFrame, bins: RankBins, lower_is_better: bool = True) -> float | None:
    """Median of the bin numbers of the known rows, from the row count per bin."""
    counts = df.groupBy(bins.bin(lower_is_better).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r["bin"], r["n"]) for r in counts.collect() if r["bin"] is not None)
    n = sum(count for _, count in rows)
    if n == 0:
        return None
    middle = []
    for position in ((n - 1) // 2, n // 2):
        for bin_, count in rows:
            if position < count:
                middle.append(bin_)
                break
            position -= count
    return sum(middle) / 2


def quality_scores(
    df: DataFrame,
    plan: str = "plan_type",
    network: str = "network_tier",
    deductible: str = "deductible",
    premiums: Sequence[str] = ("monthly_premium", "annual_premium"),
    plan_scores: Mapping[str, float] = presets.PLAN_SCORES,
    network_scores: Mapping[str, float] = presets.NETWORK_SCORES,
    weights: Mapping[str, float] = presets.QUALITY_WEIGHTS,
    fill: float | None = None,
    output: str = "quality_score",
    row_limit: int = ROW_LIMIT,
) -> DataFrame:
    """Weighted sum of plan and network scores and of inverted deductible and premium terciles.

    A missing tercile counts as the median tercile of its column, or as ``fill`` when given.
    """
    missing = [c for c in (deductible, network, plan) if c not in df.columns]
    if missing:
        raise ValueError(f"cannot derive a quality score without {missing}")
    costs = df.select(to_number(F.col(deductible)).alias("deductible"),
                      first_present(df, list(premiums)).alias("premium"))
    fitted = fit_rank_bins(costs, ["deductible", "premium"], 3, row_limit)
    fills = {c: fill if fill is not None else median_bin(costs, fitted[c]) for c in fitted}

    scored = df.withColumns({"_deductible": to_number(F.col(deductible)),
                             "_premium": first_present(df, list(premiums))})
    terciles = {
        c: F.coalesce(RankBins(f"_{c}", fitted[c].cuts, fitted[c].bins).bin(lower_is_better=True),
                      F.lit(fills[c]).cast("double"))
        for c in fitted
    }
    score = (
        F.lit(weights["plan"]) * mapped_score(F.col(plan), plan_scores)
        + F.lit(weights["network"]) * mapped_score(F.col(network), network_scores)
        + F.lit(weights["deductible"]) * terciles["deductible"]
        + F.lit(weights["premium"]) * terciles["premium"]
    )
    return scored.withColumn(output, score).drop("_deductible", "_premium")


def grade(df: DataFrame, column: str, output: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Low, medium or high by tercile of the average ranks of ``column``.

    With two distinct terciles the ranks are cut again at their median into low and high (the
    two terciles stand where that gives one bin); with fewer every known row is medium.
    """
    fitted = fit_rank_bins(df, [column], 3, row_limit)[column]
    if fitted.bins == 2:
        halves = fit_rank_bins(df, [column], 2, row_limit)[column]
        fitted = halves if halves.bins == 2 else fitted
    number = fitted.bin()
    if fitted.bins == 3:
        names = F.when(number == 1, "low").when(number == 2, "medium").when(number == 3, "high")
    elif fitted.bins == 2:
        names = F.when(number == 1, "low").when(number == 2, "high")
    else:
        names = F.when(F.col(column).isNotNull(), "medium")
    return df.withColumn(output, names)


def insurance_quality(df: DataFrame, output: str = "insurance_quality",
                      row_limit: int = ROW_LIMIT, **options) -> DataFrame:
    """``quality_scores`` graded into low, medium and high."""
    scored = quality_scores(df, output="_quality", row_limit=row_limit, **options)
    return grade(scored, "_quality", output, row_limit).drop("_quality")
