"""Queries for labels, feature preparation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.cleaning import first_present, mapped_score, to_number
from tabwright.functions.hashing import key_hash, row_key
from tabwright.operators import labels, sampling
from tabwright.operators.features import MedianScaler, ModeImputer, Preprocessor, feature_names, preparation_stages
from tabwright.operators.roles import Roles, infer_roles, without
from tabwright.operators.running import average_ranks
from tabwright.plans.suite import query, rounded, table

PLAN = {"PROMO": 3, "STANDARD": 2, "ECONOMY": 1}
NETWORK = {**{f"brand#{i}": 3 for i in range(1, 9)}, **{f"brand#{i}": 1 for i in range(15, 26)}}

PLANS_SQL = """plans AS (SELECT p_partkey, ' ' || p_type || ' ' AS plan, p_brand AS network,
    CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS deductible,
    CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS premium FROM part)"""


def plans(spark, folder):
    """Parts as insurance plans, with some deductibles that are no number and some premiums missing."""
    return table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("plan"), F.col("p_brand").alias("network"),
        F.when(F.col("p_partkey") % 13 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("deductible"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("premium"))


PLAN_SCORE_SQL = """CASE trim(lower(plan)) WHEN 'promo' THEN 3.0::DOUBLE WHEN 'standard' THEN 2.0::DOUBLE
    WHEN 'economy' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"""
NETWORK_SCORE_SQL = """CASE WHEN regexp_extract(network, '#(.*)', 1)::INT <= 8 THEN 3.0::DOUBLE
    WHEN regexp_extract(network, '#(.*)', 1)::INT >= 15 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"""


def bins_sql(name: str, source: str, value: str) -> str:
    """Rank-tercile bins of ``value`` in ``source`` as CTEs ending in ``name(p_partkey, v, bin, k)``."""
    return f"""{name}_v AS (SELECT p_partkey, {value} AS v FROM {source}),
    {name}_f AS (SELECT v, count(*) AS eq, sum(count(*)) OVER (ORDER BY v) AS upto FROM {name}_v
        WHERE v IS NOT NULL GROUP BY v),
    {name}_r AS (SELECT p_partkey, {name}_v.v, (upto - eq)::DOUBLE + (eq + 1) / 2::DOUBLE AS r
        FROM {name}_v JOIN {name}_f ON {name}_v.v = {name}_f.v),
    {name}_o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS pos, count(*) OVER () AS n FROM {name}_r),
    {name}_h AS (SELECT i, n, (n - 1) * ((i::DOUBLE / 3) * 100 / 100) AS h
        FROM range(4) x(i), (SELECT DISTINCT n FROM {name}_o)),
    {name}_e AS (SELECT i, CASE WHEN h - floor(h) >= 0.5::DOUBLE THEN b.r - (b.r - a.r) * (1 - (h - floor(h)))
            ELSE a.r + (b.r - a.r) * (h - floor(h)) END AS edge
        FROM {name}_h JOIN {name}_o a ON a.pos = floor(h) JOIN {name}_o b ON b.pos = least(floor(h) + 1, {name}_h.n - 1)),
    {name}_l AS (SELECT list(DISTINCT edge) AS edges FROM {name}_e),
    {name} AS (SELECT p_partkey, {name}_r.v, r, greatest(1, len(list_filter(edges, lambda e: e < r)))::DOUBLE AS bin,
        len(edges) - 1 AS k FROM {name}_r, {name}_l)"""


@query("l1_risk_label", """SELECT o_orderkey, (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INT
    AS risk_label FROM orders""")
def risk_label(spark, folder):
    df = table(spark, folder, "orders")
    return labels.risk_label(df, costs=["no_such_cost", "o_totalprice"]).select("o_orderkey", "risk_label")


@query("l2_mapped_scores", f"""WITH {PLANS_SQL} SELECT p_partkey, {PLAN_SCORE_SQL} AS plan_score,
    {NETWORK_SCORE_SQL} AS network_score FROM plans""")
def mapped_scores(spark, folder):
    return plans(spark, folder).select("p_partkey", mapped_score(F.col("plan"), PLAN).alias("plan_score"),
                                       mapped_score(F.col("network"), NETWORK).alias("network_score"))


@query("l3_numeric_cast", f"WITH {PLANS_SQL} SELECT p_partkey, try_cast(deductible AS DOUBLE) AS deductible FROM plans")
def numeric_cast(spark, folder):
    return plans(spark, folder).select("p_partkey", to_number(F.col("deductible")).alias("deductible"))


@query("l4_first_present", f"WITH {PLANS_SQL} SELECT p_partkey, premium, NULL::DOUBLE AS absent FROM plans")
def first_of(spark, folder):
    df = plans(spark, folder)
    return df.select("p_partkey", first_present(df, ["monthly", "premium"]).alias("premium"),
                     first_present(df, ["monthly"]).alias("absent"))


@query("l5_average_ranks", """WITH f AS (SELECT l_quantity, count(*) AS eq, sum(count(*)) OVER (ORDER BY l_quantity) AS upto
        FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_quantity, (upto - eq + (eq + 1) / 2::DOUBLE)::DOUBLE AS rank
    FROM lineitem JOIN f USING (l_quantity)""")
def ranks(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return average_ranks(df, "l_quantity")


@query("l5_average_ranks_of_prices", """WITH f AS (SELECT o_totalprice, count(*) AS eq,
        sum(count(*)) OVER (ORDER BY o_totalprice) AS upto FROM orders GROUP BY 1)
    SELECT o_orderkey, (upto - eq + (eq + 1) / 2::DOUBLE)::DOUBLE AS rank FROM orders JOIN f USING (o_totalprice)""")
def price_ranks(spark, folder):
    return average_ranks(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select(
        "o_orderkey", "rank")


@query("l6_tercile_bins", f"""WITH {PLANS_SQL}, {bins_sql('d', 'plans', 'try_cast(deductible AS DOUBLE)')},
    {bins_sql('m', 'plans', 'premium')}
    SELECT p.p_partkey, (d.k + 1) - d.bin AS deductible_bin, (m.k + 1) - m.bin AS premium_bin
    FROM plans p LEFT JOIN d ON p.p_partkey = d.p_partkey LEFT JOIN m ON p.p_partkey = m.p_partkey""")
def tercile_bins(spark, folder):
    df = plans(spark, folder)
    fitted = labels.fit_rank_bins(df, ["deductible", "premium"])
    return df.select("p_partkey", *[fitted[c].bin(lower_is_better=True).alias(f"{c}_bin") for c in fitted])


QUALITY_SQL = f"""{PLANS_SQL}, {bins_sql('d', 'plans', 'try_cast(deductible AS DOUBLE)')},
    {bins_sql('m', 'plans', 'premium')},
    scored AS (SELECT p.p_partkey, 0.35::DOUBLE * ({PLAN_SCORE_SQL}) + 0.30::DOUBLE * ({NETWORK_SCORE_SQL})
        + 0.20::DOUBLE * coalesce((d.k + 1) - d.bin, (SELECT quantile_cont((k + 1) - bin, 0.5) FROM d))
        + 0.15::DOUBLE * coalesce((m.k + 1) - m.bin, (SELECT quantile_cont((k + 1) - bin, 0.5) FROM m)) AS score
        FROM plans p LEFT JOIN d ON p.p_partkey = d.p_partkey LEFT JOIN m ON p.p_partkey = m.p_partkey),
    {bins_sql('g', 'scored', 'score')}"""


@query("l7_insurance_quality", f"""WITH {QUALITY_SQL} SELECT p_partkey, round(v, 6) AS score,
    CASE bin WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS quality FROM g""")
def quality(spark, folder):
    options = dict(plan="plan", network="network", deductible="deductible", premiums=["monthly", "premium"],
                   plan_scores=PLAN, network_scores=NETWORK)
    scored = labels.quality_scores(plans(spark, folder), output="score", **options)
    return rounded(labels.grade(scored, "score", "quality").select("p_partkey", "score", "quality"))


# Heavy ties leave two terciles, so the ranks are cut again at their median; where that cuts nothing off, the upper tercile stays.
TIED_SQL = """tied AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN 0 WHEN p_size <= 35 THEN 1 ELSE 2 END AS v FROM part),
    k AS (SELECT p_partkey, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM tied),
    e AS (SELECT CASE WHEN quantile_cont(r, 0.5) > min(r) THEN quantile_cont(r, 0.5) ELSE quantile_cont(r, 2 / 3::DOUBLE) END AS mid FROM k)"""


@query("l7_two_grades", f"""WITH {TIED_SQL} SELECT p_partkey, v, CASE WHEN r <= mid THEN 'low' ELSE 'high' END AS quality FROM k, e""")
def two_grades(spark, folder):
    size = F.col("p_size")
    tied = table(spark, folder, "part").select("p_partkey", F.when(size <= 25, 0).when(size <= 35, 1).otherwise(2).alias("v"))
    return labels.grade(tied, "v", "quality")


GAPPY_PARTS_SQL = """gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS size,
    CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price,
    CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS type, (p_size > 25)::INT AS large FROM part)"""


def gappy_parts(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        "p_partkey", F.when(key % 10 != 0, F.col("p_size")).alias("size"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("price"),
        F.when(key % 9 != 0, F.col("p_type")).alias("type"), (F.col("p_size") > 25).cast("int").alias("large"))


FILLED_SQL = f"""{GAPPY_PARTS_SQL}, filled AS (SELECT p_partkey, large,
    coalesce(size, (SELECT quantile_cont(size::DOUBLE, 0.5) FROM gaps)) AS size,
    coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gaps)) AS price,
    coalesce(type, (SELECT type FROM gaps WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)) AS type
    FROM gaps)"""
SCALED_SQL = """(size - (SELECT avg(size) FROM filled)) / (SELECT stddev_pop(size) FROM filled)""", \
    """(price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled)"""
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("f1_median_impute", f"WITH {FILLED_SQL} SELECT p_partkey, round(size, 6) AS size, round(price, 6) AS price FROM filled")
def median_impute(spark, folder):
    df = gappy_parts(spark, folder)
    model = MedianScaler(inputCols=["size", "price"], outputCols=["size_f", "price_f"], centre=False).fit(df)
    return rounded(model.transform(df).select(
        "p_partkey", F.col("size_f").alias("size"), F.col("price_f").alias("price")))


@query("f2_mode_impute", f"WITH {FILLED_SQL} SELECT p_partkey, type FROM filled")
def mode_impute(spark, folder):
    df = gappy_parts(spark, folder)
    model = ModeImputer(inputCols=["type"], outputCols=["type_f"]).fit(df)
    return model.transform(df).select("p_partkey", F.col("type_f").alias("type"))


@query("f3_standardise", f"""WITH {FILLED_SQL} SELECT p_partkey, round({SCALED_SQL[0]}, 6) AS size,
    round({SCALED_SQL[1]}, 6) AS price FROM filled""")
def standardise(spark, folder):
    df = gappy_parts(spark, folder)
    model = MedianScaler(inputCols=["size", "price"], outputCols=["size_f", "price_f"]).fit(df)
    return rounded(model.transform(df).select(
        "p_partkey", F.col("size_f").alias("size"), F.col("price_f").alias("price")))


def wide_sql(source: str) -> str:
    hot = ", ".join(f"(type = '{t}')::INT::DOUBLE AS \"type={t}\"" for t in TYPES)
    return f"SELECT p_partkey, {hot} FROM {source}"


@query("f4_one_hot", f"""WITH {FILLED_SQL}, fitted AS (SELECT p_partkey, CASE WHEN type <> 'SMALL' THEN type END AS type FROM filled)
    SELECT p_partkey, {', '.join(f"coalesce((type = '{t}')::INT::DOUBLE, 0) AS " + '"' + f"type={t}" + '"' for t in TYPES if t != 'SMALL')}
    FROM fitted""")
def one_hot(spark, folder):
    """A value absent from the training rows is all zeros."""
    df = gappy_parts(spark, folder)
    mode = ModeImputer(inputCols=["type"], outputCols=["type_f"]).fit(df)
    df = mode.transform(df).select("p_partkey", F.col("type_f").alias("type"))
    prepared = Preprocessor(Roles([], ["type"])).fit(df.where("type <> 'SMALL'"))
    return prepared.transform(df, keep=["p_partkey"])


@query("f5_assembled", f"""WITH {FILLED_SQL} SELECT p_partkey, position - 1 AS position, feature, round(value, 6) AS value FROM (
    SELECT p_partkey, unnest(['size', 'price', {', '.join(f"'type={t}'" for t in TYPES)}, 'large']) AS feature,
        unnest([{SCALED_SQL[0]}, {SCALED_SQL[1]}, {', '.join(f"(type = '{t}')::INT::DOUBLE" for t in TYPES)}, large::DOUBLE]) AS value,
        unnest(range(1, {len(TYPES) + 4})) AS position FROM filled)""")
def assembled(spark, folder):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = gappy_parts(spark, folder)
    roles = Roles(["size", "price"], ["type"], ["large"])
    fitted = Pipeline(stages=preparation_stages(roles)).fit(df)
    names = F.array(*[F.lit(n) for n in feature_names(fitted, roles)])
    long = fitted.transform(df).select("p_partkey", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return rounded(long.select("p_partkey", F.col("position").cast("bigint").alias("position"),
                               names[F.col("position")].alias("feature"), "value"))


@query("f6_preprocessed", f"""WITH {FILLED_SQL} SELECT p_partkey, round({SCALED_SQL[0]}, 6) AS size,
    round({SCALED_SQL[1]}, 6) AS price, {', '.join(f"(type = '{t}')::INT::DOUBLE AS " + '"' + f"type={t}" + '"' for t in TYPES)},
    large::DOUBLE AS large FROM filled""")
def preprocessed(spark, folder):
    roles = Roles(["size", "price"], ["type"], ["large"])
    return rounded(Preprocessor(roles).fit_transform(gappy_parts(spark, folder), keep=["p_partkey"]))


@query("f7_inferred_roles", f"""WITH {FILLED_SQL} SELECT p_partkey, round(size, 6) AS size, round(price, 6) AS price,
    large::DOUBLE AS large, {', '.join(f"(type = '{t}')::INT::DOUBLE AS " + '"' + f"type={t}" + '"' for t in TYPES)} FROM filled""")
def inferred(spark, folder):
    df = gappy_parts(spark, folder)
    roles = infer_roles(df, exclude=["p_partkey"])
    return rounded(Preprocessor(roles, scale=False).fit_transform(df, keep=["p_partkey"]))


@query("f8_dropped_columns", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def dropped(spark, folder):
    return without(table(spark, folder, "part"), ["p_size", "p_retailprice", "no_such_column"])


def hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 13))::BIGINT"


HASHED_SQL = f"h AS (SELECT *, {hash_sql('o_orderkey')} AS h FROM orders)"


@query("t1_random_split", f"""WITH {HASHED_SQL} SELECT o_orderkey, CASE WHEN h / 4503599627370496::DOUBLE < 0.2 THEN 'test'
    WHEN h / 4503599627370496::DOUBLE < 0.4 THEN 'val' ELSE 'train' END AS part FROM h""")
def random_split(spark, folder):
    return sampling.random_split(table(spark, folder, "orders"), F.col("o_orderkey")).select("o_orderkey", "part")


def allocation_sql(name: str, sizes: str, total: str) -> str:
    """Largest-remainder allocation of ``total`` over ``sizes(s, n)``."""
    return f"""{name}_x AS (SELECT s, n, {total} AS total, ({total}) * n / (SELECT sum(n) FROM {sizes})::DOUBLE AS share FROM {sizes}),
    {name}_y AS (SELECT *, row_number() OVER (ORDER BY floor(share) - share, s) AS place,
        total - sum(floor(share)) OVER () AS extra FROM {name}_x),
    {name} AS (SELECT s, n, (floor(share) + (place <= extra)::INT)::BIGINT AS given FROM {name}_y)"""


def exact_sql(stratum: str) -> str:
    return f"""{HASHED_SQL}, sizes AS (SELECT {stratum} AS s, count(*) AS n FROM h GROUP BY 1),
    {allocation_sql('te', 'sizes', 'ceil(0.2 * (SELECT sum(n) FROM sizes))')},
    rest AS (SELECT s, n - given AS n FROM te),
    {allocation_sql('va', 'rest', 'ceil(0.25 * (SELECT sum(n) FROM rest))')},
    placed AS (SELECT *, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY h, o_orderkey) AS place FROM h),
    parts AS (SELECT p.*, CASE WHEN place <= te.given THEN 'test' WHEN place <= te.given + va.given THEN 'val'
        ELSE 'train' END AS part FROM placed p JOIN te ON p.s = te.s JOIN va ON p.s = va.s)"""


@query("t2_stratified_split", f"WITH {exact_sql('o_orderstatus')} SELECT o_orderkey, o_orderstatus, part FROM parts")
def stratified_split(spark, folder):
    return sampling.exact_split(table(spark, folder, "orders"), F.col("o_orderkey"), stratum="o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "part")


@query("t3_stratified_subsample", f"""WITH {HASHED_SQL}, sizes AS (SELECT o_orderpriority AS s, count(*) AS n FROM h GROUP BY 1),
    {allocation_sql('a', 'sizes', '1234')},
    placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS place FROM h)
    SELECT o_orderkey, o_orderpriority FROM placed JOIN a ON o_orderpriority = s WHERE place <= given""")
def subsample(spark, folder):
    return sampling.subsample(table(spark, folder, "orders"), F.col("o_orderkey"), 1234, stratum="o_orderpriority").select(
        "o_orderkey", "o_orderpriority")


def folds_sql(source: str, stratum: str, k: int = 3) -> str:
    """Consecutive blocks of the hash order within each stratum, dealt as evenly as possible."""
    return f"""fs AS (SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1),
    fo AS (SELECT s, n, sum(n) OVER (ORDER BY s) - n AS start FROM fs),
    fb AS (SELECT s, f, ceil(greatest(0, n - ((f - start) % {k} + {k}) % {k}) / {k}::DOUBLE) AS size FROM fo, range({k}) r(f)),
    fe AS (SELECT s, f, sum(size) OVER (PARTITION BY s ORDER BY f) AS stop FROM fb),
    fp AS (SELECT *, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY h, o_orderkey) - 1 AS idx FROM {source}),
    folded AS (SELECT fp.*, (SELECT count(*) FROM fe WHERE fe.s = fp.s AND fe.f < {k - 1} AND fe.stop <= fp.idx)::INT AS fold FROM fp)"""


@query("t4_stratified_folds", f"WITH {HASHED_SQL}, {folds_sql('h', 'o_orderstatus')} SELECT o_orderkey, fold FROM folded")
def stratified_folds(spark, folder):
    return sampling.folds(table(spark, folder, "orders"), F.col("o_orderkey"), 3, stratum="o_orderstatus").select(
        "o_orderkey", "fold")


CONST_SQL = HASHED_SQL.replace("SELECT *,", "SELECT *, 'all' AS everything,")


@query("t4_plain_folds", f"WITH {CONST_SQL}, {folds_sql('h', 'everything', 4)} SELECT o_orderkey, fold FROM folded")
def plain_folds(spark, folder):
    return sampling.folds(table(spark, folder, "orders"), F.col("o_orderkey"), 4).select("o_orderkey", "fold")


@query("t5_random_row", f"""WITH {HASHED_SQL}, t AS (SELECT *, {hash_sql('o_orderkey', 7)} AS pick FROM h
        WHERE h / 4503599627370496::DOUBLE < 0.2)
    SELECT o_orderkey, o_custkey, o_totalprice FROM t ORDER BY pick, o_orderkey LIMIT 1""")
def random_row(spark, folder):
    split = sampling.random_split(table(spark, folder, "orders"), F.col("o_orderkey"))
    return sampling.random_row(split.where("part = 'test'"), F.col("o_orderkey"), 7).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("t6_nested_prefixes", f"""WITH {HASHED_SQL}, {folds_sql('h', 'o_orderstatus')},
    trains AS (SELECT f.fold AS held, o.o_totalprice, row_number() OVER (PARTITION BY f.fold ORDER BY o.h, o.o_orderkey) AS place
        FROM (SELECT DISTINCT fold FROM folded) f JOIN folded o ON o.fold <> f.fold),
    steps AS (SELECT DISTINCT floor(x * (SELECT count(*) FROM folded WHERE fold <> 0)::DOUBLE)::BIGINT AS size
        FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS x))
    SELECT held AS fold, size AS train_size, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total_price
    FROM steps JOIN trains ON place <= size GROUP BY 1, 2""")
def nested_prefixes(spark, folder):
    from tabwright.presets import CURVE_FRACTIONS

    key = F.col("o_orderkey")
    hashed = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice", key_hash(key, 42).alias("h"))
    folded = sampling.folds(hashed, F.col("h"), 3, None, "o_orderstatus")
    steps = sampling.nested_prefixes(folded, F.col("h"), CURVE_FRACTIONS, None)
    # One aggregation per fold and stretch between neighbouring cuts; a set is the sum of its stretches.
    cuts = [F.lit(c).cast("bigint") for c in sorted({s["cut"] for s in steps})]
    stretch = sum([(c <= F.col("h")).cast("int") for c in cuts], F.lit(0))
    cells = folded.groupBy("fold", stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    sets = spark.createDataFrame([(s["fold"], s["size"], s["cut"]) for s in steps], "held bigint, train_size bigint, cut bigint")
    sets = sets.withColumn("first", sum([(c < F.col("cut")).cast("int") for c in cuts], F.lit(0)))
    # Every cell counts in the sets of all other folds.
    others = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda f: f != F.col("fold"))
    inside = cells.withColumn("held", F.explode(others.cast("array<bigint>"))).join(sets, "held").where(F.col("stretch") <= F.col("first"))
    return rounded(inside.groupBy(F.col("held").cast("int").alias("fold"), "train_size").agg(
        F.sum("n").alias("n_rows"), F.sum("total").alias("total_price")), 2)


@query("t_row_key_hash", f"""SELECT l_orderkey, l_linenumber, count(*) AS copies,
    {hash_sql("(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR)")} AS h FROM lineitem GROUP BY 1, 2""")
def row_key_hash(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("copies")).withColumn("h", key_hash(row_key("l_orderkey", "l_linenumber"), 42))
