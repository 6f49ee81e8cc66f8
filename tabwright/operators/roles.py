"""Column roles: which columns are numeric, categorical or passed through."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)
NUMERIC_OR_BOOLEAN = (T.NumericType, T.BooleanType)


@dataclass(frozen=True)
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.passthrough]

    def present_in(self, df: DataFrame) -> "Roles":
        """The same roles without the columns the table lacks."""
        return Roles(*(present(df, part) for part in (self.numeric, self.categorical, self.passthrough)))


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """``columns`` that exist in the table, in the order asked for."""
    available = set(df.columns)
    return [c for c in columns if c in available]


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    """Columns whose Spark type is one of ``types`` (abstract types included)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def infer_roles(df: DataFrame, exclude: Iterable[str] = ()) -> Roles:
    """Numbers and booleans are numeric, every other column is categorical."""
    skipped = set(exclude)
    numeric = [c for c in columns_of_type(df, *NUMERIC_OR_BOOLEAN) if c not in skipped]
    categorical = [c for c in df.columns if c not in skipped and c not in set(numeric)]
    return Roles(numeric, categorical)


def without(df: DataFrame, columns: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop columns; names the table lacks are ignored unless ``strict``."""
    names = list(columns)
    if strict:
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)
