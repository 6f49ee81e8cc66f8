"""Scalar clean-up expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(column: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(df[c]), df[c]).alias(c) if c in floats else df[c]
            for c in df.columns
        ]
    )


def is_missing(df: DataFrame, column: str) -> Column:
    """True where the column is null or NaN."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return named(column).isNull() | F.isnan(named(column))
    return named(column).isNull()


def to_number(column: Column) -> Column:
    """Numeric value of a column of any type; text that is no number becomes null."""
    return column.try_cast("double")


def first_present(df: DataFrame, candidates: list[str]) -> Column:
    """The first of ``candidates`` that the table has, as a number; null when it has none."""
    for name in candidates:
        if name in df.columns:
            return to_number(F.col(name))
    return F.lit(None).cast("double")


def mapped_score(column: Column, scores: Mapping[str, float], default: float = 2.0) -> Column:
    """Look a trimmed, lower-cased text up in ``scores``; anything else gets ``default``."""
    pairs = [F.lit(x) for text, score in scores.items() for x in (text.strip().lower(), float(score))]
    if not pairs:
        return F.lit(float(default))
    key = F.lower(F.trim(column.cast("string")))
    return F.coalesce(F.create_map(*pairs)[key], F.lit(float(default)))
