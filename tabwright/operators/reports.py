"""Report tables over profiles and result metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright import presets


def feature_catalogue(summary: DataFrame, types: DataFrame, missing: DataFrame) -> DataFrame:
    """Descriptions joined with types and missing counts; unknown types and counts get defaults."""
    wanted = ["feature", "count", "mean", "std", "min", "max", "unique", "top"]
    base = summary.select(*[F.col(c) if c in summary.columns else F.lit(None).alias(c) for c in wanted])
    return (
        base.join(types.select("feature", "dtype"), "feature", "left")
        .join(missing.select("feature", "missing"), "feature", "left")
        .withColumns({"count": F.coalesce("count", F.lit(0)), "dtype": F.coalesce("dtype", F.lit("unknown")),
                      "missing": F.coalesce("missing", F.lit(0))})
    )


def search_features(catalogue: DataFrame, text: str = "", sort: str = "feature", ascending: bool = True) -> DataFrame:
    """Rows whose name contains ``text`` in any case, sorted with unknown values at the end."""
    found = catalogue.where(F.lower("feature").contains(text.lower()))
    order = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    return found.orderBy(order, "feature")


def kind_counts(types: DataFrame) -> DataFrame:
    """Number of text and of other columns."""
    text = F.col("dtype") == "str"
    return types.agg(F.count_if(~text).alias("numeric"), F.count_if(text).alias("categorical"))


def confusion_shares(counts: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Share of each cell in its row, and its size relative to the largest cell of the matrix."""
    row = Window.partitionBy(*by, "actual")
    whole = Window.partitionBy(*by)
    return counts.select(
        *by, "actual", "predicted", "n",
        (F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(row)), F.lit(0.0)) * 100).alias("row_percent"),
        F.coalesce(F.try_divide(F.col("n"), F.max("n").over(whole)), F.lit(0.0)).alias("intensity"))


def long_metrics(wide: DataFrame, split: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """``val_x`` and ``test_x`` columns as rows ``model, split, metric, value``."""
    columns = [c for c in wide.columns if c.startswith(("val_", "test_"))]
    ids = [c for c in ("experiment", "model") if c in wide.columns]
    long = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, columns, "name", "value")
    result = long.select(*ids, F.regexp_extract("name", "^(val|test)_(.*)$", 1).alias("split"),
                         F.regexp_extract("name", "^(val|test)_(.*)$", 2).alias("metric"), "value")
    if split:
        result = result.where(F.col("split") == split)
    return result.where(F.col("metric").isin(list(names))) if names else result


def metric_by_model(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per model."""
    return long.groupBy("metric").agg(
        *[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])


def best_row(metrics: DataFrame, best: str | Column, order: str, ascending: bool = False) -> DataFrame:
    """The row of the named model, or the first row by ``order`` when there is none."""
    named = (F.col("model") == best).cast("int")
    score = F.col(order).asc() if ascending else F.col(order).desc()
    return metrics.orderBy(named.desc(), score, "model").limit(1)


def key_figures(classes: DataFrame, costs: DataFrame, best_class: str, best_cost: str, n_rows: Column,
                n_features: Column) -> DataFrame:
    """One row of headline figures; the two results are one row each and meet as subqueries."""
    by_class = best_row(classes, best_class, "test_mcc").select(F.struct("test_accuracy", "test_mcc")).scalar()
    by_cost = best_row(costs, best_cost, "test_rmse", True).select("test_r2").scalar()
    return classes.sparkSession.range(1).select(
        by_class["test_accuracy"].alias("best_accuracy"), by_class["test_mcc"].alias("best_mcc"),
        by_cost.alias("best_r2"), n_rows.alias("n_rows"), n_features.alias("n_features"))


def compare_experiments(metrics: DataFrame, first: str, second: str, metric: str = "test_accuracy") -> DataFrame:
    """One metric of every model in two experiments side by side, with the difference."""
    sides = [metrics.where(F.col("experiment") == e).select("model", F.col(metric).alias(n))
             for e, n in ((first, "first"), (second, "second"))]
    return sides[0].join(sides[1], "model").withColumn("change", F.col("second") - F.col("first"))


def model_label(model: Column, labels: Mapping[str, str] = presets.MODEL_LABELS) -> Column:
    """Display name of a model id, or the id itself."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(pairs[model], model)


def percent(value: Column) -> Column:
    """A share as a percentage with two places."""
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))


def compact_number(value: Column, decimals: int = 4) -> Column:
    """Thousands with separators, tiny numbers in exponent form, everything else fixed."""
    tiny = F.regexp_replace(F.format_string("%.2e", value), "e([+-])0(\\d)$", "e$1$2")
    return (
        F.when(F.abs(value) >= 1000, F.call_function("format_number", value, F.lit("#,##0.#")))
        .when(F.abs(value) < 0.01, tiny).otherwise(F.format_string(f"%.{decimals}f", value)))


def union_experiments(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of several experiments in one, each row marked with its experiment."""
    named = [t.withColumn("experiment", F.lit(e)) for e, t in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
