"""Column profiles: shape, types, nulls, duplicates, descriptions, counts, correlations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.cleaning import is_missing, named
from tabwright.operators.orderstats import ROW_LIMIT, quantiles
from tabwright.operators.roles import NUMERIC, columns_of_type, present
from tabwright.storage import side_table

QUARTILES = (0.25, 0.5, 0.75)
#: Aggregate expressions evaluated in one pass before the next batch starts.
PAIRS_PER_PASS = 300
#: Most columns that values are turned into.
MOST_COLUMNS = 10_000
#: Buckets of digests, the most rows that the search for duplicates broadcasts.
DIGEST_BUCKETS = 1 << 20


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows by an explicit order, since a distributed table has none of its own."""
    return df.orderBy(*order).limit(n)


def type_name(data_type: T.DataType) -> str:
    """Report name of a type: text, whole numbers, fractions and booleans as one word each."""
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if isinstance(data_type, T.FractionalType):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return data_type.simpleString()


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature, dtype, n_rows, count, missing, missing_rate`` per column from one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, type_name(df.schema[c].dataType))])
    rate = F.try_divide(F.col("missing"), F.col("_rows"))
    return counted.unpivot(["_rows"], [named(c) for c in columns], "feature", "missing").select(
        "feature", types[F.col("feature")].alias("dtype"), F.col("_rows").alias("n_rows"),
        (F.col("_rows") - F.col("missing")).alias("count"), "missing", rate.alias("missing_rate"))


def column_types(df: DataFrame) -> DataFrame:
    """Type per column, with the number of values found in it."""
    return missing_counts(df).select("feature", "dtype", "count")


def type_counts(types: DataFrame) -> DataFrame:
    """Number of columns per type, most frequent first."""
    return types.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns")).orderBy(
        F.desc("n_columns"), "dtype")


def most_missing(df: DataFrame, n: int = 10) -> DataFrame:
    return missing_counts(df).orderBy(F.desc("missing"), "feature").limit(n)


def missing_summary(counts: DataFrame) -> DataFrame:
    """Total missing cells and the number of columns that have any."""
    return counts.agg(F.sum("missing").alias("missing_cells"),
                      F.count_if(F.col("missing") > 0).alias("columns_with_missing"))


def columns_with_missing(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("missing") > 0).orderBy(F.desc("missing"), "feature")


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row, with the places of its nulls; rows that group together agree in both."""
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    values = [F.array_sort(F.map_entries(named(c))) if c in maps else named(c) for c in df.columns]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return F.xxhash64(nulls, *values), F.xxhash64(F.lit("second"), nulls, *values)


def duplicate_rows(df: DataFrame, digest: Callable[[DataFrame], tuple[Column, Column]] = row_digest) -> DataFrame:
    """Rows that repeat an earlier row in every column; nulls count as equal.

    Only the 16 bytes of a row's digest are shuffled first. Whole rows are shuffled and compared where the digest repeats, so digests that agree by
    chance change nothing. Few repeated digests are broadcast; with many, their buckets, of which there are at most
    ``DIGEST_BUCKETS``, keep other rows out of the shuffle; a row without a copy that shares a bucket adds nothing to the count.
    """
    keys = ["high", "low"]
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[h.alias(k) for h, k in zip(digest(df), keys)])
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*keys)
    repeated, small = side_table(repeated, "digests")
    if small:
        suspects = rows.join(F.broadcast(repeated), keys, "left_semi")
    else:
        bucket = F.pmod("high", F.lit(DIGEST_BUCKETS)).alias("bucket")
        suspects = rows.select("*", bucket).join(F.broadcast(repeated.select(bucket).distinct()), "bucket", "left_semi")
    counts = suspects.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    return counts.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
             row_limit: int = ROW_LIMIT) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, exact quartiles and maximum per column.

    With ``by`` there is one row per group and column; rows without a group are left out.
    """
    columns = present(df, columns or columns_of_type(df, *NUMERIC))
    found = quantiles(df, columns, QUARTILES, by, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
                      row_limit)
    return found.select(*by, "feature", F.col("n").alias("count"), "mean", "std", "min",
                        F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties) and its frequency."""
    columns = present(df, columns or columns_of_type(df, T.StringType))
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value")
    counts = values.groupBy("feature", "value").agg(F.count("value").alias("n"))
    # The least (-frequency, value) is the most frequent value; partial minima keep this cheap.
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))
    return counts.groupBy("feature").agg(
        F.sum("n").alias("count"), F.count("value").alias("unique"), best.alias("best"),
    ).select("feature", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.n")).alias("freq"))


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric and text descriptions in one table, with nulls where a figure has no meaning."""
    parts = []
    if columns_of_type(df, *NUMERIC):
        parts.append(describe(df))
    if columns_of_type(df, T.StringType):
        parts.append(describe_text(df))
    order = ["feature", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*present(whole, order))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, nulls left out, most frequent first."""
    known = df.where(F.col(column).isNotNull())
    total = known.agg(F.count(F.lit(1))).scalar()
    return (
        known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "value")
    )


def _known_values(df: DataFrame, column: str, most: int) -> list:
    """Distinct values of a low-cardinality column, with the cardinality checked."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column!r} has more than {most} values, too many for columns; use crosstab_long")
    return sorted(r[0] for r in rows)


def crosstab_long(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each ``column`` value within each ``row`` value: ``row, value, share``, for any number of values."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = known.groupBy(F.col(row).alias("row"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = known.groupBy(F.col(row).alias("row")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "row").select("row", "value", (F.col("n") / F.col("total")).alias("share"))


def category_counts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows per value and label of many columns from one pass: ``feature, value, label, n``; missing values and labels are left out."""
    texts = df.select(F.col(label).alias("label"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot(["label"], [named(c) for c in columns], "feature", "value")
    return long.where(F.col("value").isNotNull() & F.col("label").isNotNull()).groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def label_shares(counts: DataFrame) -> DataFrame:
    """Share of every label within each value of a column; the share of a 0/1 label's 1 is its rate."""
    totals = counts.groupBy("feature", "value").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["feature", "value"]).select("feature", "value", "label", "n", (F.col("n") / F.col("total")).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None, most_values: int = MOST_COLUMNS) -> DataFrame:
    """``crosstab_long`` with a column per value, of which there may be ``most_values``; the shares of a row add to 1."""
    values = list(values) if values is not None else _known_values(df, column, most_values)
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = known.groupBy(row).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(column) == v).alias(str(v)) for v in values])
    return counts.select(row, *[(F.col(f"`{v}`") / F.col("_n")).alias(str(v)) for v in values])


def rate_by(df: DataFrame, category: str, flag: Column) -> DataFrame:
    """Share of rows with ``flag`` per category, highest first."""
    rated = df.select(F.col(category).alias("value"), flag.cast("double").alias("_flag"))
    return (
        rated.where(F.col("value").isNotNull() & F.col("_flag").isNotNull()).groupBy("value")
        .agg(F.avg("_flag").alias("rate")).orderBy(F.desc("rate"), "value")
    )


def mean_by(df: DataFrame, category: str, column: str) -> DataFrame:
    """Mean of a column per category, lowest first."""
    return (
        df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("value"))
        .agg(F.avg(column).alias("mean")).orderBy("mean", "value")
    )


def flag_totals(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Number of rows with each 0/1 column set, lowest first."""
    sums = df.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in flags])
    return sums.unpivot([], list(flags), "flag", "n").orderBy("n", "flag")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct()


def _pair_correlation(a: str, b: str, complete: dict[str, bool], varies: dict[str, bool]) -> Column:
    """Correlation of two columns that is null, not an error, when the shared rows are constant."""
    if not (varies[a] and varies[b]):
        return F.first(F.lit(None).cast("double"))
    if complete[a] and complete[b]:
        return F.corr(a, b)
    shared_a, shared_b = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(shared_a)) * F.sqrt(F.var_pop(shared_b)))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, long form.

    Each pair uses the rows where both are known; a constant column correlates with nothing.
    """
    columns = present(df, columns or columns_of_type(df, *NUMERIC))
    numbers = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    row = numbers.agg(F.count(F.lit(1)), *[f(c) for c in columns for f in (F.count, F.var_pop)]).first()
    complete = {c: row[1 + 2 * i] == row[0] for i, c in enumerate(columns)}
    varies = {c: bool(row[2 + 2 * i]) for i, c in enumerate(columns)}
    spread = [F.first(F.lit(1.0 if varies[c] else None).cast("double")).alias(f"{i}_{i}") for i, c in enumerate(columns)]
    pairs = [_pair_correlation(a, b, complete, varies).alias(f"{i}_{j}")
             for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    names = F.array(*[F.lit(c) for c in columns])
    parts = []
    for start in range(0, len(spread) + len(pairs), PAIRS_PER_PASS):
        batch = (spread + pairs)[start:start + PAIRS_PER_PASS]
        one_row = numbers.agg(*batch)
        parts.append(one_row.unpivot([], one_row.columns, "pair", "r"))
    long = reduce(DataFrame.unionByName, parts)
    ends = F.split("pair", "_")
    half = long.select(ends[0].cast("int").alias("i"), ends[1].cast("int").alias("j"), "r")
    both = half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"), "r")
    return both.select(names[F.col("p.i")].alias("feature"), names[F.col("p.j")].alias("other"), "r")


def correlation_matrix(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide matrix of a long correlation table, one row per feature in the given order."""
    position = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    wide = long.groupBy("feature").agg(
        *[F.max(F.when(F.col("other") == c, F.col("r"))).alias(c) for c in columns])
    return wide.orderBy(position[F.col("feature")])
