"""Queries for profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import distribution, profile
from tabwright.operators.roles import columns_of_type, present, NUMERIC
from tabwright.plans import jobs
from tabwright.plans.suite import query, rounded, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy_lineitem(spark, folder):
    """Line items with some numbers and some flags removed, as the tables have no nulls."""
    return table(spark, folder, "lineitem").withColumns({
        "l_quantity": F.nullif("l_quantity", F.lit(7.0)),
        "l_discount": F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount")),
        "l_returnflag": F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")),
    })


GAPPY_SQL = """gappy AS (SELECT * REPLACE (nullif(l_quantity, 7) AS l_quantity,
    CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount,
    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""


#: Digits of means and deviations. The sum of a price column differs between engines in its last bits, so its mean is
#: rounded coarsely; all other means are rounded to 8 digits, where means of two-decimal values do not end in a tie.
MEAN_DIGITS = {"l_extendedprice": 3, "o_totalprice": 3}


def describe_sql(source: str, columns: list[str], by: str = "") -> str:
    group = f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    return " UNION ALL ".join(f"""SELECT {by + ',' if by else ''} '{c}' AS feature, count({c}) AS count,
        round(avg({c}), {d}) AS mean, round(stddev_samp({c}), {min(d, 6)}) AS std, round(min({c})::DOUBLE, 6) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max
        FROM {source} {group}""" for c in columns for d in [MEAN_DIGITS.get(c, 8)])


def described(df):
    """A description rounded as ``describe_sql`` rounds."""
    coarse = F.col("feature").isin(list(MEAN_DIGITS))
    mean, std = (F.when(coarse, F.round(c, 3)).otherwise(F.round(c, d)) for c, d in (("mean", 8), ("std", 6)))
    columns = [F.round(F.col(c), 6).alias(c) if t == "double" and c not in ("mean", "std") else
               {"mean": mean.alias("mean"), "std": std.alias("std")}.get(c, F.col(f"`{c}`")) for c, t in df.dtypes]
    return df.select(*columns)


def missing_sql(columns: list[str], types: dict[str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, '{types[c]}' AS dtype, count(*) AS n_rows,
        count({c}) AS count, count(*) - count({c}) AS missing,
        round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate FROM gappy""" for c in columns)


LINEITEM_TYPES = {
    "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64",
    "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
    "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "timestamp_ntz",
}
MISSING_SQL = f"WITH {GAPPY_SQL}, m AS ({missing_sql(list(LINEITEM_TYPES), LINEITEM_TYPES)})"


@query("p1_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query("p2_head", "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5")
def head(spark, folder):
    return profile.head(table(spark, folder, "customer"), ["c_acctbal", "c_custkey"], 5)


@query("p3_column_types", f"{MISSING_SQL} SELECT feature, dtype, count FROM m")
def column_types(spark, folder):
    return profile.column_types(gappy_lineitem(spark, folder))


@query("p4_type_counts", f"{MISSING_SQL} SELECT dtype, count(*) AS n_columns FROM m GROUP BY dtype")
def type_counts(spark, folder):
    return profile.type_counts(profile.column_types(gappy_lineitem(spark, folder)))


@query("p5_most_missing", f"{MISSING_SQL} SELECT * FROM m ORDER BY missing DESC, feature LIMIT 10")
def most_missing(spark, folder):
    return rounded(profile.most_missing(gappy_lineitem(spark, folder), 10))


@query("p6_missing_rates", f"{MISSING_SQL} SELECT feature, missing_rate FROM m ORDER BY missing_rate DESC, feature LIMIT 15")
def missing_rates(spark, folder):
    return rounded(profile.most_missing(gappy_lineitem(spark, folder), 15).select("feature", "missing_rate"))


@query("p7_missing_summary", f"""{MISSING_SQL} SELECT sum(missing)::BIGINT AS missing_cells,
    count(*) FILTER (missing > 0) AS columns_with_missing FROM m""")
def missing_summary(spark, folder):
    return profile.missing_summary(profile.missing_counts(gappy_lineitem(spark, folder)))


@query("p7_columns_with_missing", f"{MISSING_SQL} SELECT * FROM m WHERE missing > 0")
def columns_with_missing(spark, folder):
    return rounded(profile.columns_with_missing(profile.missing_counts(gappy_lineitem(spark, folder))))


@query("p8_duplicate_rows", f"""WITH {GAPPY_SQL}, twice AS (SELECT * FROM gappy UNION ALL SELECT * FROM gappy WHERE l_linenumber IN (1, 5)),
    g AS (SELECT count(*) AS n FROM twice GROUP BY {', '.join(LINEITEM_TYPES)}) SELECT sum(n - 1)::BIGINT AS duplicates FROM g""")
def duplicate_rows(spark, folder):
    """Some rows, nulls among them, stand twice in all their columns."""
    df = gappy_lineitem(spark, folder)
    return profile.duplicate_rows(df.unionByName(df.where(F.col("l_linenumber").isin(1, 5))))


@query("p8_duplicate_keys", f"""WITH {GAPPY_SQL}, g AS (SELECT count(*) AS n FROM gappy
    GROUP BY l_returnflag, l_quantity, l_linestatus) SELECT sum(n - 1)::BIGINT AS duplicates FROM g""")
def duplicate_keys(spark, folder):
    return profile.duplicate_rows(gappy_lineitem(spark, folder).select("l_returnflag", "l_quantity", "l_linestatus"))


@query("p9_describe", f"WITH {GAPPY_SQL} {describe_sql('gappy', MEASURES)}")
def describe(spark, folder):
    return described(profile.describe(gappy_lineitem(spark, folder), MEASURES))


@query("p10_describe_all", f"""WITH counts AS (
        SELECT 'o_orderstatus' AS feature, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
    best AS (SELECT feature, sum(n)::BIGINT AS count, count(*) AS "unique" FROM counts GROUP BY feature),
    top AS (SELECT feature, value, n FROM counts QUALIFY row_number() OVER (
        PARTITION BY feature ORDER BY n DESC, value) = 1),
    num AS ({describe_sql('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])})
    SELECT feature, count, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq, mean, std, min, p25, p50,
        p75, max FROM num
    UNION ALL SELECT best.feature, count, "unique", value, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM best JOIN top ON best.feature = top.feature""")
def describe_all(spark, folder):
    return described(profile.describe_all(table(spark, folder, "orders")))


@query("p11_value_counts", f"""WITH {GAPPY_SQL} SELECT l_returnflag AS value, count(*) AS n,
    round(count(*) / (SELECT count(l_returnflag) FROM gappy)::DOUBLE, 6) AS share
    FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def value_counts(spark, folder):
    return rounded(profile.value_counts(gappy_lineitem(spark, folder), "l_returnflag"))


@query("p12_describe_by_group", f"WITH {GAPPY_SQL} {describe_sql('gappy', MEASURES, 'l_returnflag')}")
def describe_by_group(spark, folder):
    return described(profile.describe(gappy_lineitem(spark, folder), MEASURES, by=["l_returnflag"]))


@query("p13_crosstab", f"""WITH {GAPPY_SQL} SELECT l_returnflag,
    round(count(*) FILTER (l_linestatus = 'F') / count(*)::DOUBLE, 6) AS "F",
    round(count(*) FILTER (l_linestatus = 'O') / count(*)::DOUBLE, 6) AS "O"
    FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def crosstab(spark, folder):
    return rounded(profile.crosstab(gappy_lineitem(spark, folder), "l_returnflag", "l_linestatus"))


@query("p13_crosstab_long", f"""WITH {GAPPY_SQL}, c AS (SELECT l_linenumber AS "row", l_suppkey AS value, count(*) AS n FROM gappy GROUP BY 1, 2)
    SELECT "row", value, round(n / sum(n) OVER (PARTITION BY "row")::DOUBLE, 8) AS share FROM c""")
def crosstab_long(spark, folder):
    return rounded(profile.crosstab_long(gappy_lineitem(spark, folder), "l_linenumber", "l_suppkey"), 8)


@query("p14_rate_by_category", f"""WITH {GAPPY_SQL} SELECT l_linestatus AS value,
    round(avg((l_returnflag = 'R')::INT), 6) AS rate FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def rate_by(spark, folder):
    return rounded(profile.rate_by(gappy_lineitem(spark, folder), "l_linestatus", F.col("l_returnflag") == "R"))


@query("p15_correlations", f"WITH {GAPPY_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS other, "
    + ("1.0::DOUBLE AS r" if a == b else f"(SELECT round(corr({a}, {b}), 6) FROM gappy) AS r")
    for a in MEASURES for b in MEASURES))
def correlations(spark, folder):
    return rounded(profile.correlations(gappy_lineitem(spark, folder), MEASURES))


@query("p16_correlation_matrix", f"WITH {GAPPY_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(
        (f"1.0::DOUBLE AS {b}" if a == b else f"round(corr({a}, {b}), 6) AS {b}") for b in MEASURES)
    + f" FROM gappy HAVING count({a}) > 0" for a in MEASURES))
def correlation_matrix(spark, folder):
    long = profile.correlations(gappy_lineitem(spark, folder), MEASURES)
    return rounded(profile.correlation_matrix(long, MEASURES))


def histogram_sql(column: str, source: str, bins: int) -> str:
    return f"""SELECT '{column}' AS feature, bin, round(any_value(lo), 4) AS lo, round(any_value(hi), 4) AS hi,
            count({column}) AS n
        FROM (SELECT i::INT AS bin, lo + i * ((hi - lo) / {bins}) AS lo,
                CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS hi
            FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}), range({bins}) r(i)) b
        LEFT JOIN {source} ON {column} >= lo AND ({column} < hi OR (bin = {bins - 1} AND {column} = hi))
        GROUP BY bin"""


@query("p17_histograms", f"WITH {GAPPY_SQL} {histogram_sql('l_extendedprice', 'gappy', 40)} UNION ALL "
       f"{histogram_sql('l_quantity', 'gappy', 7)}")
def histograms(spark, folder):
    return rounded(distribution.histograms(gappy_lineitem(spark, folder), {"l_extendedprice": 40, "l_quantity": 7}), 4)


FENCES_SQL = """q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM spread GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
    j AS (SELECT s.*, q1, median, q3, lo, hi FROM spread s JOIN f USING (o_orderpriority))"""
# Squaring stretches the prices so that some lie beyond the whiskers.
SPREAD_SQL = """spread AS (SELECT o_orderkey, o_orderpriority,
    o_totalprice * o_totalprice * o_totalprice / 1e10 AS o_totalprice FROM orders)"""


def spread_orders(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", (price * price * price / 1e10).alias("o_totalprice"))


@query("p18_box_statistics", f"""WITH {SPREAD_SQL}, {FENCES_SQL}
    SELECT o_orderpriority, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
        round(any_value(q3), 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice >= lo), 4) AS whisker_lo,
        round(max(o_totalprice) FILTER (o_totalprice <= hi), 4) AS whisker_hi,
        count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS outliers FROM j GROUP BY 1""")
def box_statistics(spark, folder):
    return rounded(distribution.box_statistics(spread_orders(spark, folder), "o_totalprice", "o_orderpriority"), 4)


@query("p18_box_outliers", f"""WITH {SPREAD_SQL}, {FENCES_SQL}
    SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM j
    WHERE o_totalprice < lo OR o_totalprice > hi""")
def box_outliers(spark, folder):
    return rounded(distribution.box_outliers(spread_orders(spark, folder), "o_totalprice", "o_orderpriority"), 4)


@query("p19_bin_means", """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    e AS (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / 5) - CASE WHEN i = 1 THEN (hi - lo) * 0.001::DOUBLE ELSE 0 END AS lo,
        CASE WHEN i = 5 THEN hi ELSE lo + i * ((hi - lo) / 5) END AS hi FROM l, range(1, 6) r(i))
    SELECT bin::INT AS bin, round(any_value(lo), 4) AS lo, round(any_value(hi), 4) AS hi, count(o_custkey) AS n,
        round(avg(o_custkey), 4) AS mean
    FROM e LEFT JOIN orders ON o_totalprice > lo AND o_totalprice <= hi GROUP BY bin""")
def bin_means(spark, folder):
    return rounded(distribution.bin_means(table(spark, folder, "orders"), "o_totalprice", "o_custkey", 5), 4)


@query("p20_mean_by_category", """SELECT o_orderpriority AS value, round(avg(o_totalprice), 3) AS mean
    FROM orders GROUP BY 1""")
def mean_by(spark, folder):
    return rounded(profile.mean_by(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice"), 3)


KINDS = ["signup", "purchase", "error", "view", "click"]


@query("p21_flag_totals", " UNION ALL ".join(
    f"SELECT 'is_{k}' AS flag, count(*) FILTER (event_type = '{k}') AS n FROM events" for k in KINDS))
def flag_totals(spark, folder):
    flags = {f"is_{k}": (F.col("event_type") == k).cast("int") for k in KINDS}
    return profile.flag_totals(table(spark, folder, "events").select(*[c.alias(n) for n, c in flags.items()]), list(flags))


@query("p22_scatter", "SELECT o_totalprice AS x, o_custkey AS y, o_orderpriority AS colour FROM orders")
def scatter(spark, folder):
    return distribution.scatter(table(spark, folder, "orders"), "o_totalprice", "o_custkey", "o_orderpriority")


@query("p22_scatter_density", """WITH l AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
        min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem)
    SELECT least(floor((l_quantity - xl) / (xh - xl) * 20), 19)::INT AS x_bin,
        least(floor((l_extendedprice - yl) / (yh - yl) * 20), 19)::INT AS y_bin, count(*) AS n
    FROM lineitem, l GROUP BY 1, 2""")
def scatter_density(spark, folder):
    return distribution.scatter_density(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 20)


@query("p23_distinct_values", "SELECT DISTINCT p_type AS value FROM part")
def distinct_values(spark, folder):
    return profile.distinct_values(table(spark, folder, "part"), "p_type")


@query("p24_present_columns", """SELECT 'l_tax' AS feature, round(avg(l_tax), 8) AS mean FROM lineitem
    UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 8) FROM lineitem""")
def present_columns(spark, folder):
    df = table(spark, folder, "lineitem")
    wanted = present(df, ["l_tax", "no_such_column", "l_quantity"])
    return rounded(profile.describe(df, wanted).select("feature", "mean"), 8)


@query("p25_columns_by_type", """SELECT 'p_partkey' AS feature, max(p_partkey)::DOUBLE AS max FROM part
    UNION ALL SELECT 'p_size', max(p_size)::DOUBLE FROM part
    UNION ALL SELECT 'p_retailprice', round(max(p_retailprice), 6) FROM part""")
def columns_by_type(spark, folder):
    df = table(spark, folder, "part")
    return rounded(profile.describe(df, columns_of_type(df, *NUMERIC)).select("feature", "max"))


NUMBERS, TEXTS = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]


def e1_sql() -> str:
    boxes = " UNION ALL ".join(f"""SELECT '{c}' AS feature, dear, {c} AS v, quantile_cont({c}, 0.25) OVER (PARTITION BY dear) AS q1,
        quantile_cont({c}, 0.75) OVER (PARTITION BY dear) AS q3 FROM lab WHERE {c} IS NOT NULL""" for c in NUMBERS)
    counts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, dear, count(*) AS n FROM lab WHERE {c} IS NOT NULL GROUP BY ALL" for c in TEXTS)
    lines = [f"SELECT 'describe' AS part, feature, dear::VARCHAR AS grp, '{f}' AS figure, {f}::DOUBLE AS number FROM described" for f in ("count", "mean", "p25", "p50", "p75")]
    lines += [f"SELECT 'box', feature, dear::VARCHAR, '{f}', round({f}::DOUBLE, 6) FROM box" for f in ("whisker_lo", "whisker_hi", "outliers")]
    lines += ["SELECT 'share', feature, value || '=' || dear, 'share', round(n / sum(n) OVER (PARTITION BY feature, value)::DOUBLE, 8) FROM counts"]
    return f"""WITH {GAPPY_SQL}, lab AS (SELECT *, (l_extendedprice > 40000)::INT AS dear FROM gappy), described AS ({describe_sql('lab', NUMBERS, 'dear')}),
        spread AS ({boxes}), fenced AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM spread),
        box AS (SELECT feature, dear, min(v) FILTER (v >= lo) AS whisker_lo, max(v) FILTER (v <= hi) AS whisker_hi,
            count(*) FILTER (v < lo OR v > hi) AS outliers FROM fenced GROUP BY ALL), counts AS ({counts}) """ + " UNION ALL ".join(lines)


@query("e1_profile", e1_sql())
def profile_report(spark, folder):
    """The parts of the exploratory report that depend on a label, as one long table."""
    df = gappy_lineitem(spark, folder).withColumn("dear", (F.col("l_extendedprice") > 40000).cast("int"))
    found = jobs.profile_by_label(df, "dear", NUMBERS, TEXTS)
    figures = lambda part, t, names: t.select(F.lit(part).alias("part"), "feature", F.col("dear").cast("string").alias("grp"), *[
        F.col(n).cast("double").alias(n) for n in names]).unpivot(["part", "feature", "grp"], names, "figure", "number")
    numbers = figures("describe", described(found["describe_by_label"]), ["count", "mean", "p25", "p50", "p75"])
    boxes = figures("box", rounded(found["boxes"]), ["whisker_lo", "whisker_hi", "outliers"])
    shares = found["shares"].select(F.lit("share").alias("part"), "feature", F.concat_ws("=", "value", F.col("label").cast("string")).alias("grp"),
                                    F.lit("share").alias("figure"), F.round("share", 8).alias("number"))
    return numbers.unionByName(boxes).unionByName(shares)
