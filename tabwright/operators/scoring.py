"""Batch scoring: aligned inputs, predictions of both models, probabilities and reasons.

Everything here is a projection of the input rows, so it applies to streams as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright import presets
from tabwright.functions.cleaning import named
from tabwright.operators.roles import present


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns a model was trained on: unknown ones dropped, absent ones null."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def class_scores(predicted: DataFrame, classes: Sequence[str], scores: str = "scores",
                 label: str = "predicted") -> DataFrame:
    """Add the predicted class as text and the class scores as an array in class order.

    Models that give no probabilities (one booster per class) have their margins mapped by the
    logistic function and scaled to add up to 1.
    """
    names = F.array(*[F.lit(c) for c in classes])
    if "probability" in predicted.columns:
        is_array = isinstance(predicted.schema["probability"].dataType, T.ArrayType)
        values = F.col("probability") if is_array else vector_to_array("probability")
    else:
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        values = F.transform(odds, lambda o: o / total)
    return predicted.withColumns({scores: values, label: names[F.col("prediction").cast("int")]})


def clipped(scores: Column, floor: float = presets.PROBABILITY_FLOOR,
            ceiling: float = presets.PROBABILITY_CEILING, digits: int = 4) -> Column:
    """Array of probabilities kept away from 0 and 1 and rounded."""
    return F.transform(scores, lambda p: F.round(F.greatest(F.lit(floor), F.least(F.lit(ceiling), p)), digits))


def compare_cost(predicted: Column, actual: Column | None) -> dict[str, Column]:
    """Rounded prediction, actual value (0 when unknown) and absolute error."""
    known = F.coalesce(actual, F.lit(0.0)) if actual is not None else F.lit(0.0)
    return {"predicted_cost": F.bround(predicted, 2), "actual_cost": F.bround(known, 2),
            "error": F.bround(F.abs(predicted - known), 2)}


def compare_class(predicted: Column, actual: Column | None) -> dict[str, Column]:
    """Predicted class, actual class (empty when unknown) and whether they agree as text."""
    known = F.coalesce(actual.cast("string"), F.lit("")) if actual is not None else F.lit("")
    return {"predicted_risk": predicted, "actual_risk": known, "correct": predicted.cast("string") == known}


def error_band(error: Column, bands: Sequence[tuple[float, str]] = presets.ERROR_BANDS,
               worst: str = presets.WORST_BAND) -> Column:
    """Name of the first band whose limit exceeds the error."""
    band = F.lit(worst)
    for limit, name in reversed(list(bands)):
        band = F.when(error < limit, name).otherwise(band)
    return band


def score_rows(df: DataFrame, cost_model: Model, class_model: Model, classes: Sequence[str],
               cost: str = "annual_medical_cost", label: str = "is_high_risk",
               schema: T.StructType | None = None) -> DataFrame:
    """Score every row with a cost model and a class model in one pass.

    The input columns are kept and joined by prediction, clipped probabilities per class, the
    comparison with the actual values and an error band. With ``schema``, the models see exactly
    its columns: unknown ones are hidden from them, absent ones are null, types are cast.
    """
    fields = df.schema if schema is None else schema
    kept = df.columns
    own = {c: F.col(f"_row.`{c}`") for c in kept}
    inputs = df.select(F.struct("*").alias("_row"), *[
        (named(f.name).cast(f.dataType) if f.name in kept else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields.fields])
    actual_cost = own[cost].cast("double") if cost in kept else None
    actual_label = own.get(label)
    costed = cost_model.transform(inputs).select(*[named(c) for c in inputs.columns], F.col("prediction").alias("_cost"))
    classed = class_scores(class_model.transform(costed), classes, "_scores", "_class")
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), clipped(F.col("_scores")))
    compared = compare_cost(F.col("_cost"), actual_cost) | compare_class(F.col("_class"), actual_label)
    scored = classed.select(*[own[c].alias(c) for c in kept], pairs.alias("probabilities"), *[c.alias(n) for n, c in compared.items()])
    return scored.withColumn("band", error_band(F.col("error")))


def model_importances(model: PipelineModel, names: Sequence[str]) -> dict[str, float]:
    """Importance per feature: a tree model's own, or the size of a linear model's coefficients (of standardised inputs)."""
    learner = model.stages[-1] if isinstance(model, PipelineModel) else model
    members = learner.models if hasattr(learner, "models") else [learner]
    if all(hasattr(m, "featureImportances") for m in members):
        vectors = [m.featureImportances.toArray() for m in members]
    elif hasattr(learner, "coefficientMatrix"):
        vectors = abs(learner.coefficientMatrix.toArray())
    else:
        vectors = [abs(learner.coefficients.toArray())]
    return {name: float(sum(v[i] for v in vectors) / len(vectors)) for i, name in enumerate(names)}


def feature_importances(model: PipelineModel, names: Sequence[str], spark, n: int = 10) -> DataFrame:
    """The ``n`` most important features with their share of the largest importance."""
    rows = [{"name": n, "importance": v} for n, v in model_importances(model, names).items()]
    table = spark.createDataFrame(pa.Table.from_pylist(rows))
    return top_importances(table, n)


def top_importances(table: DataFrame, n: int = 10) -> DataFrame:
    """Rank a ``name, importance`` table and express importances relative to the largest."""
    largest = table.agg(F.max("importance")).scalar()
    return (
        table.withColumn("share", F.try_divide(F.col("importance"), largest))
        .orderBy(F.desc("importance"), "name").limit(n)
        .select("name", F.round("importance", 4).alias("importance"), F.round("share", 4).alias("share"))
    )


def plain_number(column: Column) -> Column:
    """A number as text without a needless fraction."""
    value = column.cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def grouped_number(column: Column, decimals: int = 3) -> Column:
    """A number with thousands separators and at most ``decimals`` places."""
    return F.call_function("format_number", column, F.lit("#,##0." + "#" * decimals))


def reason_parts(age: Column, smoker: Column, chronic: Column, bmi: Column) -> list[Column]:
    """Rule-based findings about a row, null where a rule does not apply."""
    # Limits and wording of the findings.
    age, chronic, bmi = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (age, chronic, bmi))
    text = F.concat
    return [
        F.when(age >= 55, text(F.lit("age of "), plain_number(age), F.lit(" (older patients carry higher risk)")))
        .when(age <= 30, text(F.lit("young age of "), plain_number(age), F.lit(" (lower baseline risk)"))),
        F.when(smoker == "Current", "active smoking status").when(smoker == "Never", "non-smoker status"),
        F.when(chronic >= 2, text(plain_number(chronic), F.lit(" chronic conditions")))
        .when(chronic == 0, "no chronic conditions"),
        F.when(bmi >= 30, text(F.lit("elevated BMI of "), F.format_string("%.1f", bmi))),
    ]


def reason_text(predicted: Column, confidence: Column, drivers: Sequence[str], parts: Sequence[Column],
                cost: Column) -> Column:
    """One sentence per row that names the prediction, its confidence, drivers and findings."""
    # The wording of the explanation.
    found = F.concat_ws(", ", *parts)
    return F.concat(
        F.lit("The model predicts this patient is "),
        F.when(predicted.cast("string") == "1", "HIGH RISK").otherwise("LOW RISK"),
        F.lit(" with "), F.format_string("%.1f", confidence * 100), F.lit("% confidence. Key drivers: "),
        F.lit(", ".join(drivers[:3])), F.lit(". This is primarily due to "),
        F.when(found == "", "overall feature profile").otherwise(found),
        F.lit(". Predicted annual cost: $"), grouped_number(cost), F.lit("."))


def with_reasons(scored: DataFrame, importances: Mapping[str, float],
                 columns: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``confidence`` and ``reason`` to scored rows.

    ``importances`` maps features to their weight, the drivers being the largest positive ones;
    ``columns`` renames the inputs age, smoker, chronic_count and bmi.
    """
    names = {c: c for c in ("age", "smoker", "chronic_count", "bmi")} | dict(columns or {})
    inputs = [F.col(names[c]) if names[c] in scored.columns else F.lit(None)
              for c in ("age", "smoker", "chronic_count", "bmi")]
    ranked = [n for n, v in sorted(importances.items(), key=lambda x: -x[1]) if v > 0]
    confidence = F.array_max(F.map_values("probabilities"))
    return scored.withColumn("confidence", confidence).withColumn("reason", reason_text(
        F.col("predicted_risk"), F.col("confidence"), ranked, reason_parts(*inputs), F.col("predicted_cost")))


def key_features(df: DataFrame, columns: Sequence[str] = tuple(presets.KEY_FEATURES)) -> DataFrame:
    """The columns worth showing for a row, as far as the table has them."""
    return df.select(*present(df, columns))
