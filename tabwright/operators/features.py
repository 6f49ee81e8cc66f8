"""Feature preparation as Spark ML stages: impute, standardise, encode, assemble."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.orderstats import ROW_LIMIT, quantile_values
from tabwright.operators.roles import Roles, infer_roles

#: Most texts of one column that become features, in the vector and in the wide form alike; each is a name held by the driver.
MAX_CATEGORIES = 10_000

NUMERIC_SUFFIX = "__num"
TEXT_SUFFIX = "__cat"


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input columns", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "output columns", TypeConverters.toListString)

    def columns(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols")))


class _Standardised(_Columns):
    medians = Param(Params._dummy(), "medians", "median per input", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean per input", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "population deviation per input", TypeConverters.toListFloat)


def as_number(column: str) -> Column:
    """The column as a double with NaN taken as missing."""
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


class MedianScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing numbers by the exact median, then subtract the mean and divide by the
    population standard deviation. A constant column is only centred; a column without any
    value is filled with 0."""

    centre = Param(Params._dummy(), "centre", "standardise after filling", TypeConverters.toBoolean)
    rowLimit = Param(Params._dummy(), "rowLimit", "see orderstats", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, centre=True, rowLimit=ROW_LIMIT):
        super().__init__()
        self._setDefault(centre=True, rowLimit=ROW_LIMIT)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "MedianScalerModel":
        inputs = self.getOrDefault("inputCols")
        found = quantile_values(df, inputs, [0.5], self.getOrDefault("rowLimit"))
        medians = [found[c][0] if found[c][0] is not None else 0.0 for c in inputs]
        means, scales = [0.0] * len(inputs), [1.0] * len(inputs)
        if self.getOrDefault("centre"):
            filled = [F.coalesce(as_number(c), F.lit(m)) for c, m in zip(inputs, medians)]
            row = df.agg(*[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first()
            means = [row[2 * i] or 0.0 for i in range(len(inputs))]
            scales = [row[2 * i + 1] or 1.0 for i in range(len(inputs))]
        model = MedianScalerModel()
        return model._set(inputCols=inputs, outputCols=self.getOrDefault("outputCols"), medians=medians,
                          means=means, scales=scales)


class MedianScalerModel(Model, _Standardised, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = zip(self.columns(), *(self.getOrDefault(p) for p in ("medians", "means", "scales")))
        return df.withColumns({out: (F.coalesce(as_number(c), F.lit(m)) - F.lit(mean)) / F.lit(scale)
                               for (c, out), m, mean, scale in fitted})


class ModeImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing texts by the most frequent one, the smallest on ties.

    A column with more than ``maxCategories`` texts is refused, since each text becomes a feature
    of its own and their list is held by the driver."""

    maxCategories = Param(Params._dummy(), "maxCategories", "most texts per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, maxCategories=MAX_CATEGORIES):
        super().__init__()
        self._setDefault(maxCategories=MAX_CATEGORIES)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        from tabwright.operators.profile import describe_text

        inputs = self.getOrDefault("inputCols")
        found = describe_text(df, inputs).select("feature", "unique", "top").collect()
        many = [r["feature"] for r in found if r["unique"] > self.getOrDefault("maxCategories")]
        if many:
            raise ValueError(f"too many different texts in {many}; leave these columns out of the features")
        top = {r["feature"]: r["top"] for r in found}
        return ModeImputerModel()._set(inputCols=inputs, outputCols=self.getOrDefault("outputCols"),
                                       fills=[top.get(c) or "" for c in inputs])


class ModeImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "replacement per input", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: F.coalesce(F.col(c).cast("string"), F.lit(fill))
                               for (c, out), fill in zip(self.columns(), self.getOrDefault("fills"))})


def preparation_stages(roles: Roles, output: str = "features", scale: bool = True, max_categories: int = MAX_CATEGORIES) -> list:
    """Stages from raw columns to one feature vector, in the order numeric, text, passthrough.

    A text column becomes one 0/1 feature per value seen in training, in ascending order; a value
    not seen there is all zeros.
    """
    stages: list = []
    parts: list[str] = []
    if roles.numeric:
        numbers = [c + NUMERIC_SUFFIX for c in roles.numeric]
        stages.append(MedianScaler(inputCols=roles.numeric, outputCols=numbers, centre=scale))
        parts += numbers
    if roles.categorical:
        texts = [c + TEXT_SUFFIX for c in roles.categorical]
        codes = [c + "__idx" for c in roles.categorical]
        vectors = [c + "__hot" for c in roles.categorical]
        stages += [
            ModeImputer(inputCols=roles.categorical, outputCols=texts, maxCategories=max_categories),
            StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=codes, outputCols=vectors, dropLast=True),
        ]
        parts += vectors
    stages.append(VectorAssembler(inputCols=[*parts, *roles.passthrough], outputCol=output, handleInvalid="keep"))
    return stages


def feature_names(prepared: PipelineModel | Sequence, roles: Roles) -> list[str]:
    """Names of the vector's entries: a number keeps its name, a text value is ``column=value``."""
    stages = prepared.stages if isinstance(prepared, PipelineModel) else prepared
    labels: list = []
    for stage in stages:
        if hasattr(stage, "labelsArray"):
            labels = list(stage.labelsArray)
            break
    names = list(roles.numeric)
    for column, values in zip(roles.categorical, labels):
        names += [f"{column}={v}" for v in values]
    return names + list(roles.passthrough)


class Preprocessor:
    """Fixed-role preparation with a wide, named result instead of a vector."""

    def __init__(self, roles: Roles | None = None, scale: bool = True, max_categories: int = MAX_CATEGORIES):
        self.roles = roles
        self.scale = scale
        self.max_categories = max_categories
        self.stages: list = []

    def fit(self, df: DataFrame) -> "Preprocessor":
        self.roles = self.roles or infer_roles(df)
        self.stages = []
        current = df
        if self.roles.numeric:
            numbers = [c + NUMERIC_SUFFIX for c in self.roles.numeric]
            self.stages.append(MedianScaler(
                inputCols=self.roles.numeric, outputCols=numbers, centre=self.scale).fit(df))
        if self.roles.categorical:
            texts = [c + TEXT_SUFFIX for c in self.roles.categorical]
            mode = ModeImputer(inputCols=self.roles.categorical, outputCols=texts, maxCategories=self.max_categories).fit(df)
            current = mode.transform(df)
            self.stages.append(mode)
            self.values = _categories(current, texts)
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if not self.stages and not self.roles.passthrough:
            raise ValueError("fit before transform")
        columns = [F.col(c) for c in keep]
        for stage in self.stages:
            df = stage.transform(df)
        columns += [F.col(c + NUMERIC_SUFFIX).alias(c) for c in self.roles.numeric]
        for c in self.roles.categorical:
            text = c + TEXT_SUFFIX
            columns += [(F.col(text) == v).cast("double").alias(f"{c}={v}") for v in self.values[text]]
        columns += [F.col(c).cast("double").alias(c) for c in self.roles.passthrough]
        return df.select(*columns)

    def fit_transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.fit(df).transform(df, keep)


def _categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Ascending distinct values per text column. ``ModeImputer`` has refused columns with too many."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "value").distinct()
    values: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(long.collect(), key=lambda r: r["value"]):
        values[r["feature"]].append(r["value"])
    return values
