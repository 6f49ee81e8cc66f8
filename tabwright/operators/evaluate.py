"""Evaluation of predictions. Class metrics all derive from the small confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.running import WINDOW_ROWS, running_totals


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per actual and predicted class: ``by..., actual, predicted, n``."""
    return df.groupBy(*by, F.col(actual).cast("string").alias("actual"),
                      F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion as ``labels`` and a square ``matrix`` with zeros filled in, one row per key.

    The labels are all actual and predicted classes in ascending order.
    """
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("actual", "predicted"), "n")))
    packed = counts.groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("labels"),
        cells.alias("cells"))
    cell = lambda a, p: F.coalesce(
        F.col("cells")[F.struct(a.alias("actual"), p.alias("predicted"))], F.lit(0).cast("bigint"))
    return packed.select(*by, "labels", F.transform(
        "labels", lambda a: F.transform("labels", lambda p: cell(a, p))).alias("matrix"))


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1, Matthews correlation, total and misclassified rows per key.

    Every class that occurs as actual or predicted enters the mean F1; a class without a true
    positive scores 0, and so does a correlation whose denominator vanishes.
    """
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("t"), none.alias("p"), F.when(hit, n).otherwise(none).alias("tp")),
        F.struct(F.col("predicted").alias("label"), none.alias("t"), n.alias("p"), none.alias("tp")))
    per_label = (
        counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("t", "p", "tp")])
    )
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    sums = per_label.groupBy(*by).agg(
        F.sum(t).alias("s"), F.sum(tp).alias("c"), F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"), F.avg(F.coalesce(F.try_divide(2 * tp, t + p), F.lit(0.0))).alias("f1_macro"))
    s, c = F.col("s"), F.col("c")
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.coalesce(F.try_divide(c * s - F.col("pt"), spread), F.lit(0.0))
    return sums.select(*by, (c / s).alias("accuracy"), "f1_macro", mcc.alias("mcc"),
                       s.cast("bigint").alias("total"), (s - c).cast("bigint").alias("misclassified"))


def binary_rates(counts: DataFrame, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positive and negative rates; null where the denominator is empty."""
    is_pos, said_pos = F.col("actual") == positive, F.col("predicted") == positive
    cell = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cells = counts.groupBy(*by).agg(
        cell(is_pos & said_pos).alias("tp"), cell(~is_pos & ~said_pos).alias("tn"),
        cell(~is_pos & said_pos).alias("fp"), cell(is_pos & ~said_pos).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cells.select(*by, "tp", "tn", "fp", "fn",
                        F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(tn, tn + fp).alias("tnr"),
                        F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(fn, fn + tp).alias("fnr"))


def _score_counts(df: DataFrame, score: str, positive: Column, by: Sequence[str], window_rows: int) -> DataFrame:
    """Rows of either class per distinct score. Missing scores are left out, NaN is refused."""
    value = F.col(score).cast("double")
    known = F.when(F.isnan(value), F.raise_error(F.lit(f"{score!r} has a NaN score, which has no rank"))).otherwise(value)
    rows = df.select(*by, known.alias("score"), positive.cast("int").alias("hit"))
    return running_totals(
        rows.where(F.col("hit").isNotNull()), "score",
        {"pos": F.sum("hit").cast("bigint"), "neg": F.sum(1 - F.col("hit")).cast("bigint")},
        by, descending=True, window_rows=window_rows)


def roc_curve(df: DataFrame, score: str, positive: Column, by: Sequence[str] = (),
              drop_intermediate: bool = True, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """ROC points by descending threshold: ``by..., threshold, fpr, tpr``.

    The first point has an infinite threshold. Points between two others on a straight line are
    left out unless ``drop_intermediate`` is off.
    """
    by = list(by)
    counts = _score_counts(df, score, positive, by, window_rows)
    ends = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if drop_intermediate:
        # A bend is where the next step differs from the last; both ends of the curve stay.
        first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
        bend = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
        counts = counts.where(first | F.col("pos_next").isNull() | bend)
    points = counts.select(*by, F.col("score").alias("threshold"),
                           (F.col("pos_before") + F.col("pos")).alias("tp"),
                           (F.col("neg_before") + F.col("neg")).alias("fp"))
    start = ends.select(*by, F.lit(float("inf")).alias("threshold"),
                        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    every = points.unionByName(start)
    if by:
        joined = every.join(ends, by)
    else:
        totals = ends.select(F.struct("_p", "_n").alias("t")).scalar()
        joined = every.withColumns({"_p": totals["_p"], "_n": totals["_n"]})
    return joined.select(*by, "threshold", F.try_divide("fp", "_n").alias("fpr"),
                         F.try_divide("tp", "_p").alias("tpr"))


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = (),
        window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Area under the ROC curve by trapezoids, ties counting half; null without both classes."""
    counts = _score_counts(df, score, positive, by, window_rows)
    area = F.sum((F.col("pos_before") + F.col("pos") / 2) * F.col("neg"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return counts.groupBy(*by).agg(F.try_divide(area, pairs).alias("auc"))


def auc_ovr_macro(df: DataFrame, label: str, scores: str, classes: Sequence[str], by: Sequence[str] = (),
                  window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Mean over the classes of the AUC of each class against all others.

    ``scores`` is an array column aligned with ``classes``.
    """
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.arrays_zip(names.alias("label"), F.col(scores).alias("score"))
    long = df.select(*by, F.col(label).cast("string").alias("_actual"), F.explode(pairs).alias("z")).select(
        *by, "_actual", F.col("z.label").alias("_class"), F.col("z.score").alias("_score"))
    each = auc(long, "_score", F.col("_actual") == F.col("_class"), [*by, "_class"], window_rows)
    return each.groupBy(*by).agg(F.avg("auc").alias("roc_auc_ovr_macro"))


def curve_picks(curve: DataFrame, picks: int = 5, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``picks`` evenly spaced inner points of a ROC curve, for threshold markers."""
    numbered = running_totals(
        curve, "threshold", {"one": F.lit(1).cast("bigint") * F.count(F.lit(1)),
                             "fpr": F.max("fpr"), "tpr": F.max("tpr")},
        descending=True, window_rows=window_rows).select("threshold", "fpr", "tpr", F.col("one_before").alias("idx"))
    last = curve.agg(F.count(F.lit(1)) - 1).scalar()
    wanted = F.array(*[F.floor(F.lit(float(i)) * (last / float(picks + 1))).cast("bigint")
                       for i in range(1, picks + 1)])
    return numbered.where(F.array_contains(wanted, F.col("idx")))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, root mean squared error and R2 from one pass."""
    y, error = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    sums = known.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("v"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*by, "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))
