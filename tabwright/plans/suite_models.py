"""Queries for sources, sinks, learners, tuning and curves."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import evaluate, labels, models, profile, reports, sampling, scoring, tuning
from tabwright.operators.features import feature_names
from tabwright.operators.roles import Roles
from tabwright.plans import jobs
from tabwright.plans.suite import query, rounded, table
from tabwright.plans.suite_evaluate import METRICS_SQL, PREDICTED_SQL, WIDE_SQL, counts_of, metrics_of, wide_metrics
from tabwright.plans.suite_labels import HASHED_SQL, exact_sql, folds_sql, hash_sql
from tabwright.plans.suite_profile import describe_sql, described
from tabwright.sources import readers, writers
from tabwright.storage import scratch_path, use_checkpoints, written

# ---- sources and sinks ---------------------------------------------------------------------


@query("s1_csv_scan", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
    round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1""")
def csv_scan(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    path = scratch_path(spark, "csv")
    writers.write_table(df, path, "csv")
    back = readers.read_table(spark, path, "csv", df.schema)
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("s2_report_scan", describe_sql("orders", ["o_totalprice", "o_custkey"]))
def report_scan(spark, folder):
    path = scratch_path(spark, "report")
    writers.write_report(described(profile.describe(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"])), path)
    return readers.read_report(spark, path)


@query("s3_json_scan", f"""WITH {PREDICTED_SQL}, l AS (SELECT unnest(['A', 'N', 'R']) AS label)
    SELECT m.model, m.split, a.label AS actual, p.label AS predicted, coalesce(n, 0)::BIGINT AS n
    FROM (SELECT DISTINCT model, split FROM conf) m, l a, l p LEFT JOIN conf c
        ON c.model = m.model AND c.split = m.split AND c.actual = a.label AND c.predicted = p.label""")
def json_scan(spark, folder):
    path = scratch_path(spark, "confusion")
    writers.write_json(writers.confusion_documents(counts_of(spark, folder)), path)
    return readers.flatten_confusions(readers.read_json(spark, path, readers.CONFUSION_SCHEMA, lines=True))


def saved_experiments(spark, folder):
    """Three rules as three experiments, each with its metrics, confusion and summary files."""
    root = scratch_path(spark, "experiments")
    wide, documents = wide_metrics(spark, folder), writers.confusion_documents(counts_of(spark, folder))
    folders = {}
    for name in ("quantity", "discount", "hit"):
        folders[name] = f"{root}/{name}"
        mine = wide.where(F.col("model") == name)
        writers.write_report(mine, f"{folders[name]}/metrics_cls.csv")
        writers.write_json(documents.where(F.col("model") == name), f"{folders[name]}/confusion_{name}.json")
        writers.write_json(mine.select(F.col("model").alias("best_model"), F.col("test_mcc").alias("best_test_mcc"),
                                       F.lit("l_returnflag").alias("target"), F.lit(False).alias("derived_target")),
                           f"{folders[name]}/run_cls_summary.json")
    return readers.load_experiments(spark, folders)


@query("s4_all_experiments", f"""WITH {WIDE_SQL}, t AS (SELECT model, sum(n)::BIGINT AS n_rows FROM conf GROUP BY 1)
    SELECT model AS experiment, model, round(test_accuracy, 8) AS test_accuracy, round(test_mcc, 8) AS best_test_mcc, n_rows
    FROM wide JOIN t USING (model)""")
def all_experiments(spark, folder):
    found = saved_experiments(spark, folder)
    rows = found["confusions"].groupBy("experiment").agg(F.sum("n").alias("n_rows"))
    joined = found["metrics"].join(found["summaries"], "experiment").join(rows, "experiment")
    return rounded(joined.select("experiment", "model", "test_accuracy", "best_test_mcc", "n_rows"), 8)


@query("s5_written_tables", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def written_tables(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    paths = {f: scratch_path(spark, f) for f in ("parquet", "csv")}
    for f, path in paths.items():
        writers.write_table(df, path, f)
    first = readers.read_table(spark, paths["parquet"], "parquet")
    second = readers.read_table(spark, paths["csv"], "csv", df.schema)
    # Every row of one file must be in the other, so joining both keeps the totals.
    return first.join(second.select("o_orderkey", F.col("o_totalprice").alias("again")), "o_orderkey").where(
        F.col("o_totalprice") == F.col("again")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s6_json_reports", f"""WITH {METRICS_SQL} SELECT 'rules' AS experiment, model,
    list(CASE split WHEN 'val' THEN 1 ELSE 2 END ORDER BY split DESC)::BIGINT[] AS train_sizes,
    list(round(accuracy, 8) ORDER BY split DESC) AS val_mean FROM met GROUP BY model""")
def json_reports(spark, folder):
    size = F.when(F.col("split") == "val", 1).otherwise(2).cast("bigint")
    value = F.round("accuracy", 8)
    curves = metrics_of(spark, folder).select(
        F.lit("rules").alias("experiment"), "model", size.alias("train_size"), value.alias("train_mean"),
        F.lit(0.0).alias("train_std"), value.alias("val_mean"), F.lit(0.0).alias("val_std"))
    path = scratch_path(spark, "curves")
    writers.write_json(writers.curve_documents(curves), path)
    schema = "experiment string, model string, train_sizes array<bigint>, val_mean array<double>"
    return readers.read_json(spark, path, schema, lines=True)


def line_fit_sql(x: str, y: str, source: str) -> str:
    return f"(SELECT regr_slope({y}, {x}) AS w, regr_intercept({y}, {x}) AS b FROM {source})"


def linear_data(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"),
                                             F.col("p_retailprice").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


@query("s7_saved_model", f"""SELECT p_partkey, round(f.w * p_size + f.b, 4) AS prediction
    FROM part, {line_fit_sql('p_size', 'p_retailprice', 'part')} f""")
def saved_model(spark, folder):
    """Two models are saved and the later one is found and applied."""
    df = linear_data(spark, folder)
    root = scratch_path(spark, "models")
    stage = VectorAssembler(inputCols=["x"], outputCol="features")
    raw = df.drop("features")
    for kind, stamp in (("ridge", "1"), ("linear", "2")):
        learner = models.PenalisedLinear(kind=kind, alpha=1e6)
        writers.save_model(Pipeline(stages=[stage, learner]).fit(raw), root, "cost", stamp)
    found = writers.load_latest(spark, root, "cost")
    return rounded(found.transform(raw).select("p_partkey", "prediction"), 4)


# ---- learners with a closed form -----------------------------------------------------------

MOMENTS_SQL = """m AS (SELECT count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my,
    count(*) * var_pop(p_size) AS sxx, count(*) * covar_pop(p_size, p_retailprice) AS sxy FROM part)"""


def coefficients(spark, folder, **options):
    fitted = models.PenalisedLinear(**options).fit(linear_data(spark, folder))
    # The fitted line is applied to the table, so the result has the size of the table.
    scored = fitted.transform(linear_data(spark, folder))
    return scored.select("p_partkey", F.round("prediction", 3).alias("prediction"))


def penalised_sql(slope: str) -> str:
    return f"WITH {MOMENTS_SQL}, s AS (SELECT *, {slope} AS w FROM m) SELECT p_partkey, round(my + w * (p_size - mx), 3) AS prediction FROM part, s"


def soft(threshold: str) -> str:
    return f"sign(sxy / n) * greatest(0, abs(sxy / n) - {threshold})"


@query("m5_linear", penalised_sql("sxy / sxx"))
def linear(spark, folder):
    return coefficients(spark, folder, kind="linear")


@query("m6_ridge", penalised_sql("sxy / (sxx + 100000.0::DOUBLE)"))
def ridge(spark, folder):
    return coefficients(spark, folder, kind="ridge", alpha=100000.0)


@query("m7_lasso", penalised_sql(f"{soft('0.5::DOUBLE')} / (sxx / n)"))
def lasso(spark, folder):
    return coefficients(spark, folder, kind="lasso", alpha=0.5)


@query("m8_elastic_net", penalised_sql(f"{soft('(2.0::DOUBLE * 0.2::DOUBLE)')} / (sxx / n + 2.0::DOUBLE * 0.8::DOUBLE)"))
def elastic_net(spark, folder):
    return coefficients(spark, folder, kind="elasticnet", alpha=2.0, l1_ratio=0.2)


@query("m11_class_weights", """SELECT p_type, count(*) AS n, round((SELECT count(*) FROM part)
    / ((SELECT count(DISTINCT p_type) FROM part) * count(*))::DOUBLE, 8) AS weight FROM part GROUP BY 1""")
def class_weights(spark, folder):
    return rounded(models.class_weights(table(spark, folder, "part"), "p_type"), 8)


# ---- tuning --------------------------------------------------------------------------------

ORDER_HASH = "('0x' || substr(md5(p_partkey::VARCHAR || ':42'), 1, 13))::BIGINT"
PART_FOLDS_SQL = f"""hp AS (SELECT p_partkey AS o_orderkey, p_size AS x, p_retailprice AS y, 'all' AS everything, {ORDER_HASH} AS h FROM part)"""


def ridge_scores_sql(source: str, alphas: str) -> str:
    """Root mean squared error per fold of a ridge on one standardised column."""
    return f"""st AS (SELECT f.fold AS held, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
            count(*) * covar_pop(x, y) / stddev_pop(x) AS szy
        FROM (SELECT DISTINCT fold FROM {source}) f JOIN {source} d ON d.fold <> f.fold GROUP BY 1),
    sc AS (SELECT alpha, held, sqrt(avg(power(y - (my + szy / (n + alpha) * (x - mx) / sx), 2))) AS rmse
        FROM (SELECT unnest({alphas})::DOUBLE AS alpha), st JOIN {source} d ON d.fold = st.held GROUP BY 1, 2)"""


@query("m12_grid_search", f"""WITH {PART_FOLDS_SQL}, {folds_sql('hp', 'everything', 3)},
    {ridge_scores_sql('folded', '[0.1, 1.0, 10.0, 100.0]')}
    SELECT alpha, round(-avg(rmse), 4) AS mean_score,
        alpha = (SELECT alpha FROM sc GROUP BY alpha ORDER BY avg(rmse), alpha LIMIT 1) AS best FROM sc GROUP BY alpha""")
def grid_search(spark, folder):
    import pyarrow as pa

    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    folded = sampling.folds(df, F.col("p_partkey"), 3)
    trainer = tuning.Trainer(Roles(["p_size"]), "p_retailprice")
    found = trainer.search({"ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]}}, folded, "fold", 3)["ridge"]
    rows = [{"alpha": s["params"]["alpha"], "mean_score": round(s["mean_score"], 4),
             "best": s["params"] == found.params} for s in found.scores]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


SPLIT_PARTS_SQL = f"""{PART_FOLDS_SQL}, pl AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS place, count(*) OVER () AS n FROM hp),
    pa AS (SELECT *, CASE WHEN place <= ceil(0.2 * n) THEN 'test'
        WHEN place <= ceil(0.2 * n) + ceil(0.25 * (n - ceil(0.2 * n))) THEN 'val' ELSE 'train' END AS part FROM pl),
    tr AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) * covar_pop(x, y) / stddev_pop(x) AS szy
        FROM pa WHERE part = 'train'),
    pr AS (SELECT model, part, y, my + szy / (tr.n + alpha) * (x - mx) / sx AS f
        FROM pa, tr, (VALUES ('linear', 0.0::DOUBLE), ('ridge', 50.0::DOUBLE)) v(model, alpha) WHERE part <> 'train'),
    me AS (SELECT model, part, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse,
        1 - avg((y - f) * (y - f)) / var_pop(y) AS r2 FROM pr GROUP BY 1, 2)"""


@query("m13_model_loop", f"""WITH {SPLIT_PARTS_SQL} SELECT model, """ + ", ".join(
    f"round(max({m}) FILTER (part = '{s}'), {6 if m == 'r2' else 3}) AS {s}_{m}" for s in ("val", "test") for m in ("mae", "rmse", "r2"))
    + """, CASE model WHEN 'linear' THEN '{}' ELSE '{"alpha": 50.0}' END AS best_params FROM me GROUP BY model""")
def model_loop(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    run = tuning.train_regressors(df, "p_retailprice", F.col("p_partkey"), ["linear", "ridge"], drop=["p_partkey"],
                                  grids={"ridge": {"alpha": [50.0]}})
    return run.metrics.select("model", "best_params", *[
        F.round(f"{s}_{m}", 6 if m == "r2" else 3).alias(f"{s}_{m}") for s in ("val", "test") for m in ("mae", "rmse", "r2")])


# ---- learners on one grouping column, which have to reproduce figures of the groups ----------


def fitted_scores(df, roles, target, classes, name, params, key):
    """Class scores of a model on its own training rows, one column per class."""
    fitted = tuning.Trainer(roles, target, classes).fit(name, params, df)
    scored = scoring.class_scores(fitted.transform(df), classes)
    return scored.select(*key, *[F.round(F.col("scores")[i], 3).alias(f"p_{c}") for i, c in enumerate(classes)])


def rich_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 200000).cast("int").alias("rich"))


RICH_SQL = """rates AS (SELECT o_orderpriority, avg((o_totalprice > 200000)::INT) AS p FROM orders GROUP BY 1)"""
PRIORITY = Roles([], ["o_orderpriority"])
#: A penalty so weak that the fit follows the group rates.
FREE = {"C": 1e9, "tol": 1e-12}


@query("m1_logistic_group_rates", f"""WITH {RICH_SQL} SELECT o_orderkey, round(1 - p, 3) AS p_0, round(p, 3) AS p_1
    FROM orders JOIN rates USING (o_orderpriority)""")
def logistic_group_rates(spark, folder):
    return fitted_scores(rich_orders(spark, folder), PRIORITY, "rich", ["0", "1"], "logreg_l2", FREE, ["o_orderkey"])


@query("m1_logistic_balanced_rates", f"""WITH {RICH_SQL}, a AS (SELECT avg((o_totalprice > 200000)::INT) AS q FROM orders),
    b AS (SELECT o_orderpriority, (p / q) / (p / q + (1 - p) / (1 - q)) AS p FROM rates, a)
    SELECT o_orderkey, round(1 - p, 3) AS p_0, round(p, 3) AS p_1 FROM orders JOIN b USING (o_orderpriority)""")
def logistic_balanced_rates(spark, folder):
    return fitted_scores(rich_orders(spark, folder), PRIORITY, "rich", ["0", "1"], "logreg_l2",
                         {**FREE, "class_weight": "balanced"}, ["o_orderkey"])


@query("m1_multinomial_group_rates", """WITH r AS (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS f,
        avg((o_orderstatus = 'O')::INT) AS o, avg((o_orderstatus = 'P')::INT) AS p FROM orders GROUP BY 1)
    SELECT o_orderkey, round(f, 3) AS p_F, round(o, 3) AS p_O, round(p, 3) AS p_P FROM orders JOIN r USING (o_orderpriority)""")
def multinomial_group_rates(spark, folder):
    return fitted_scores(rich_orders(spark, folder), PRIORITY, "o_orderstatus", ["F", "O", "P"], "logreg_l2", FREE, ["o_orderkey"])


@query("m2_logistic_l1_group_rates", f"""WITH {RICH_SQL} SELECT o_orderkey, round(1 - p, 3) AS p_0, round(p, 3) AS p_1
    FROM orders JOIN rates USING (o_orderpriority)""")
def logistic_l1_group_rates(spark, folder):
    return fitted_scores(rich_orders(spark, folder), PRIORITY, "rich", ["0", "1"], "logreg_l1", FREE, ["o_orderkey"])


def dear_lines(spark, folder):
    """A 0/1 feature (large quantity) that says much about the label, but not all."""
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("double").alias("x"),
                                                 (F.col("l_quantity") + 5 * F.col("l_linenumber") > 45).cast("double").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def penalised_rates(spark, folder, penalty, c):
    df = dear_lines(spark, folder)
    scored = models.PenalisedLogistic(C=c, penalty=penalty, tol=1e-12).fit(df).transform(df)
    return scored.select("l_orderkey", "l_linenumber", F.round(vector_to_array("probability")[1], 4).alias("p"))


DEAR_SQL = """d AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS x, (l_quantity + 5 * l_linenumber > 45)::INT AS y FROM lineitem),
    t AS (SELECT count(*) FILTER (x)::DOUBLE AS n1, sum(y) FILTER (x)::DOUBLE AS s1, count(*) FILTER (NOT x)::DOUBLE AS n0,
        sum(y) FILTER (NOT x)::DOUBLE AS s0 FROM d)"""


# With a positive slope, the absolute penalty moves 1 / C positives from one group to the other until both rates meet.
@query("m2_logistic_l1_penalised", f"""WITH {DEAR_SQL}, r AS (SELECT (s1 - 250) / n1 AS p1, (s0 + 250) / n0 AS p0, (s1 + s0) / (n1 + n0) AS p FROM t)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN p1 <= p0 THEN p WHEN x THEN p1 ELSE p0 END, 4) AS p FROM d, r""")
def logistic_l1_penalised(spark, folder):
    return penalised_rates(spark, folder, "l1", 0.004)


# The squared penalty moves delta positives where delta times C is the difference of the log odds; found by bisection.
@query("m1_logistic_l2_penalised", f"""WITH RECURSIVE {DEAR_SQL},
    b(i, lo, hi) AS (SELECT 0, 0::DOUBLE, s1 - n1 * (s0 + s1) / (n0 + n1) FROM t
        UNION ALL SELECT i + 1, CASE WHEN rising THEN m ELSE lo END, CASE WHEN rising THEN hi ELSE m END
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, ln((s1 - (lo + hi) / 2) / (n1 - s1 + (lo + hi) / 2))
                - ln((s0 + (lo + hi) / 2) / (n0 - s0 - (lo + hi) / 2)) > 0.004 * (lo + hi) / 2 AS rising FROM b, t) WHERE i < 60),
    r AS (SELECT (s1 - lo) / n1 AS p1, (s0 + lo) / n0 AS p0 FROM b, t WHERE i = 60)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN x THEN p1 ELSE p0 END, 4) AS p FROM d, r""")
def logistic_l2_penalised(spark, folder):
    return penalised_rates(spark, folder, "l2", 0.004)


LINES = Roles(["l_linenumber"])


def numbered_lines(spark, folder):
    use_checkpoints(spark)
    return table(spark, folder, "lineitem").select(
        "l_linenumber", "l_returnflag", "l_extendedprice", (F.col("l_quantity") > 20).cast("int").alias("big"))


@query("m3_forest_group_classes", """WITH c AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
    m AS (SELECT l_linenumber, l_returnflag AS predicted FROM c QUALIFY row_number() OVER (
        PARTITION BY l_linenumber ORDER BY n DESC, l_returnflag) = 1)
    SELECT l_linenumber, predicted FROM lineitem JOIN m USING (l_linenumber)""")
def forest_group_classes(spark, folder):
    """Without resampling every tree of a forest on one column predicts the commonest class of a group."""
    df, classes = numbered_lines(spark, folder), ["A", "N", "R"]
    fitted = tuning.Trainer(LINES, "l_returnflag", classes).fit(
        "rf", {"n_estimators": 3, "max_depth": 6, "bootstrap": False}, df)
    return scoring.class_scores(fitted.transform(df), classes).select("l_linenumber", "predicted")


@query("m9_forest_group_means", """WITH m AS (SELECT l_linenumber, avg(l_extendedprice) AS prediction FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(prediction, 3) AS prediction FROM lineitem JOIN m USING (l_linenumber)""")
def forest_group_means(spark, folder):
    df = numbered_lines(spark, folder)
    fitted = tuning.Trainer(LINES, "l_extendedprice").fit("rf", {"n_estimators": 3, "max_depth": 6, "bootstrap": False}, df)
    return fitted.transform(df).select("l_linenumber", F.round("prediction", 3).alias("prediction"))


@query("m4_boosted_group_scores", """WITH s AS (SELECT l_linenumber, CASE WHEN l_quantity > 20 THEN 1 ELSE -1 END AS s FROM lineitem),
    one AS (SELECT l_linenumber, avg(s) AS f FROM s GROUP BY 1),
    two AS (SELECT l_linenumber, any_value(f) + 0.1::DOUBLE * avg(4 * s / (1 + exp(2 * s * f))) AS f
        FROM s JOIN one USING (l_linenumber) GROUP BY 1)
    SELECT l_linenumber, round(1 - 1 / (1 + exp(-2 * f)), 3) AS p_0, round(1 / (1 + exp(-2 * f)), 3) AS p_1
    FROM lineitem JOIN two USING (l_linenumber)""")
def boosted_group_scores(spark, folder):
    """Two rounds of boosting on one column whose every value becomes a leaf."""
    return fitted_scores(numbered_lines(spark, folder), LINES, "big", ["0", "1"], "gbr",
                         {"n_estimators": 2, "learning_rate": 0.1, "max_depth": 6}, ["l_linenumber"])


@query("m4_boosted_three_class_scores", """WITH o AS (SELECT l_linenumber,
        1 / (1 + exp(-2 * avg(CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END))) AS a,
        1 / (1 + exp(-2 * avg(CASE l_returnflag WHEN 'N' THEN 1 ELSE -1 END))) AS n,
        1 / (1 + exp(-2 * avg(CASE l_returnflag WHEN 'R' THEN 1 ELSE -1 END))) AS r FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(a / (a + n + r), 3) AS p_A, round(n / (a + n + r), 3) AS p_N, round(r / (a + n + r), 3) AS p_R
    FROM lineitem JOIN o USING (l_linenumber)""")
def boosted_three_class_scores(spark, folder):
    return fitted_scores(numbered_lines(spark, folder), LINES, "l_returnflag", ["A", "N", "R"], "gbr_one_vs_rest",
                         {"n_estimators": 1, "max_depth": 6}, ["l_linenumber"])


def softmax_round_sql(before: str, after: str) -> str:
    """A round whose leaves are the line numbers: Newton steps of every class from the margins in ``before``."""
    return f"""{before}_p AS (SELECT l_linenumber, k, f, exp(f) / sum(exp(f)) OVER (PARTITION BY l_linenumber) AS p FROM {before}),
    {before}_r AS (SELECT l_linenumber, k, f, n, (l_returnflag = k)::INT - p AS r FROM {before}_p JOIN c USING (l_linenumber)),
    {after} AS (SELECT l_linenumber, k, f + 0.1::DOUBLE * 2 / 3 * sum(n * r) / sum(n * abs(r) * (1 - abs(r))) AS f FROM {before}_r GROUP BY l_linenumber, k, f)"""


@query("m4_softmax_scores", f"""WITH c AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
    start AS (SELECT l_linenumber, k, f FROM (SELECT DISTINCT l_linenumber FROM c),
        (SELECT l_returnflag AS k, ln(count(*) / (SELECT count(*) FROM lineitem)) AS f FROM lineitem GROUP BY 1)),
    {softmax_round_sql('start', 'one')}, {softmax_round_sql('one', 'two')}, {softmax_round_sql('two', 'three')},
    e AS (SELECT l_linenumber, sum(exp(f)) AS total, sum(exp(f)) FILTER (k = 'A') AS a, sum(exp(f)) FILTER (k = 'N') AS n, sum(exp(f)) FILTER (k = 'R') AS r
        FROM three GROUP BY 1)
    SELECT l_linenumber, round(a / total, 3) AS p_A, round(n / total, 3) AS p_N, round(r / total, 3) AS p_R FROM lineitem JOIN e USING (l_linenumber)""")
def softmax_scores(spark, folder):
    """Three rounds of joint boosting of three classes on one column whose every value becomes a leaf."""
    return fitted_scores(numbered_lines(spark, folder), LINES, "l_returnflag", ["A", "N", "R"], "gbr",
                         {"n_estimators": 3, "learning_rate": 0.1, "max_depth": 6}, ["l_linenumber"])


@query("m10_boosted_group_means", """WITH m AS (SELECT l_linenumber, avg(l_extendedprice) AS prediction FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(prediction, 3) AS prediction FROM lineitem JOIN m USING (l_linenumber)""")
def boosted_group_means(spark, folder):
    df = numbered_lines(spark, folder)
    fitted = tuning.Trainer(LINES, "l_extendedprice").fit("gbr", {"n_estimators": 3, "max_depth": 6}, df)
    return fitted.transform(df).select("l_linenumber", F.round("prediction", 3).alias("prediction"))


# ---- loops over learners that predict the commonest class of a group -----------------------

MAJORITY = {"n_estimators": [1], "max_depth": [5], "bootstrap": [False]}
GRADED_SQL = f"""h AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS priority, o_custkey % 6 AS desk,
    (o_totalprice > 200000)::INT AS rich, {hash_sql('o_orderkey')} AS h FROM orders)"""


def graded_orders(spark, folder):
    use_checkpoints(spark)
    return table(spark, folder, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 6).alias("desk"),
        (F.col("o_totalprice") > 200000).cast("int").alias("rich"))


def majority_sql(name: str, feature: str, train: str, keys: str = "") -> str:
    """Commonest class of each value of ``feature`` in ``train``, the lower class on ties."""
    k = keys + ", " if keys else ""
    return f"""{name} AS (SELECT {k}{feature}, CASE WHEN sum(rich) * 2 > count(*) THEN 1 ELSE 0 END AS predicted
        FROM {train} GROUP BY ALL)"""


def judged_sql(feature: str, prefix: str) -> str:
    """Class metrics of the majority rule on the validation and test parts."""
    return f"""{majority_sql(prefix + 'm', feature, "(SELECT * FROM parts WHERE part = 'train')")},
    {prefix}c AS (SELECT part AS split, rich AS actual, predicted, count(*) AS n FROM parts JOIN {prefix}m USING ({feature})
        WHERE part <> 'train' GROUP BY ALL),
    {prefix}s AS (SELECT split, actual AS label, n AS t, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM {prefix}c
        UNION ALL SELECT split, predicted, 0, n, 0 FROM {prefix}c),
    {prefix}l AS (SELECT split, label, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(tp)::DOUBLE AS tp FROM {prefix}s GROUP BY ALL),
    {prefix} AS (SELECT split, sum(tp) / sum(t) AS accuracy, avg(2 * tp / (t + p)) AS f1_macro,
        coalesce((sum(tp) * sum(t) - sum(t * p)) / nullif(sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))), 0), 0) AS mcc
        FROM {prefix}l GROUP BY ALL)"""


PARTED_SQL = exact_sql("rich").replace(HASHED_SQL, GRADED_SQL)


@query("m13_majority_loop", f"""WITH {PARTED_SQL}, {judged_sql('priority', 'j')} SELECT 'rf' AS model, """ + ", ".join(
    f"round(max({m}) FILTER (split = '{s}'), 8) AS {s}_{m}" for s in ("val", "test") for m in ("accuracy", "f1_macro", "mcc")) + " FROM j")
def majority_loop(spark, folder):
    run = tuning.train_classifiers(graded_orders(spark, folder), "rich", F.col("o_orderkey"), ["rf"], drop=["o_orderkey", "desk"],
                                   grids={"rf": MAJORITY})
    return rounded(run.metrics.select("model", *[f"{s}_{m}" for s in ("val", "test") for m in ("accuracy", "f1_macro", "mcc")]), 8)


@query("m12_macro_f1_search", f"""WITH {PARTED_SQL}, tr AS (SELECT o_orderkey, h, rich, priority FROM parts WHERE part = 'train'), {folds_sql('tr', 'rich')},
    tried AS (SELECT depth, f.fold AS held, o.fold, rich, CASE WHEN depth = 0 THEN 'any' ELSE priority::VARCHAR END AS k
        FROM (SELECT unnest([0, 6]) AS depth) g, (SELECT DISTINCT fold FROM folded) f, folded o),
    rule AS (SELECT depth, held, k, CASE WHEN sum(rich) * 2 > count(*) THEN 1 ELSE 0 END AS predicted FROM tried WHERE fold <> held GROUP BY ALL),
    c AS (SELECT depth, held, rich AS actual, predicted, count(*) AS n FROM tried JOIN rule USING (depth, held, k) WHERE fold = held GROUP BY ALL),
    sides AS (SELECT depth, held, actual AS label, n AS t, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM c
        UNION ALL SELECT depth, held, predicted, 0, n, 0 FROM c),
    each AS (SELECT depth, held, label, 2 * sum(tp)::DOUBLE / (sum(t) + sum(p)) AS f1 FROM sides GROUP BY ALL),
    per_fold AS (SELECT depth, held, avg(f1) AS f1 FROM each GROUP BY ALL), points AS (SELECT depth, avg(f1) AS mean_score FROM per_fold GROUP BY ALL)
    SELECT depth::BIGINT AS max_depth, round(mean_score, 8) AS mean_score, row_number() OVER (ORDER BY mean_score DESC, depth) = 1 AS chosen FROM points""")
def macro_f1_search(spark, folder):
    """A grid of one-tree forests, each point scored by its mean macro F1 over the folds."""
    grid = {"n_estimators": [1], "bootstrap": [False], "max_depth": [0, 6]}
    run = tuning.train_classifiers(graded_orders(spark, folder), "rich", F.col("o_orderkey"), ["rf"], drop=["o_orderkey", "desk"], grids={"rf": grid})
    search = run.searches["rf"]
    rows = [(s["params"]["max_depth"], s["mean_score"], s["params"] == search.params) for s in search.scores]
    return rounded(spark.createDataFrame(rows, "max_depth bigint, mean_score double, chosen boolean"), 8)


@query("m14_majority_curves", f"""WITH {GRADED_SQL}, {folds_sql('h', 'rich')},
    trains AS (SELECT f.fold AS held, o.*, row_number() OVER (PARTITION BY f.fold ORDER BY o.h, o.o_orderkey) AS place
        FROM (SELECT DISTINCT fold FROM folded) f JOIN folded o ON o.fold <> f.fold),
    steps AS (SELECT DISTINCT floor(x * (SELECT count(*) FROM folded WHERE fold <> 0)::DOUBLE)::BIGINT AS train_size
        FROM (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS x)),
    seen AS (SELECT train_size, trains.* FROM steps JOIN trains ON place <= train_size),
    {majority_sql('m', 'priority', 'seen', 'train_size, held')},
    scores AS (SELECT train_size, held, avg((rich = predicted)::INT) AS t, NULL AS v FROM seen JOIN m USING (train_size, held, priority) GROUP BY 1, 2
        UNION ALL SELECT train_size, held, NULL, avg((rich = predicted)::INT) FROM m JOIN folded f ON f.fold = held AND f.priority = m.priority
        GROUP BY 1, 2)
    SELECT 'rich' AS experiment, 'rf' AS model, train_size, round(avg(t), 8) AS train_mean, round(stddev_pop(t), 8) AS train_std,
        round(avg(v), 8) AS val_mean, round(stddev_pop(v), 8) AS val_std FROM scores GROUP BY train_size""")
def majority_curves(spark, folder):
    return rounded(tuning.learning_curves(
        graded_orders(spark, folder), [tuning.Experiment("rich", "rich", ("desk",))], F.col("o_orderkey"),
        {"rf": {k: v[0] for k, v in MAJORITY.items()}}, fractions=[0.1, 0.5, 1.0], exclude=["o_orderkey"]), 8)


@query("m15_majority_ablation", f"""WITH {PARTED_SQL}, {judged_sql('priority', 'ja')}, {judged_sql('desk', 'jb')}
    SELECT 'rf' AS model, round(a.accuracy, 8) AS first, round(b.accuracy, 8) AS second, round(b.accuracy - a.accuracy, 8) AS change
    FROM ja a JOIN jb b USING (split) WHERE split = 'test'""")
def majority_ablation(spark, folder):
    experiments = [tuning.Experiment("priority", "rich", ("desk", "o_orderkey")), tuning.Experiment("desk", "rich", ("priority", "o_orderkey"))]
    metrics, _ = tuning.run_experiments(graded_orders(spark, folder), experiments, F.col("o_orderkey"), models=["rf"], grids={"rf": MAJORITY})
    return rounded(reports.compare_experiments(metrics, "priority", "desk"), 8)


# ---- learners without one ------------------------------------------------------------------


def task(spark, folder):
    """Orders with their number of lines, mean quantity and a label from the median price."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.avg("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("worth"), F.min("l_returnflag").alias("flag"))
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "lines", "quantity", "worth", "flag")
    # The label's median and every fit read the join again, so it is written once.
    rich = labels.risk_label(written(orders, "task-rows"), costs=["worth"], output="rich")
    return rich.select("o_orderkey", "o_totalprice", "o_orderpriority", "lines", "quantity", "worth", "flag", "rich")


NUMBERS = Roles(["lines", "quantity"], ["o_orderpriority"])


def split_task(spark, folder):
    return sampling.random_split(task(spark, folder), F.col("o_orderkey"))


def classifier_scores(spark, folder, name, params, target):
    """Fit on the training part and count correct and wrong rows of every class in the test part."""
    use_checkpoints(spark)
    parts = split_task(spark, folder)
    classes = tuning.classes_of(parts, target)
    trainer = tuning.Trainer(NUMBERS, target, classes)
    fitted = trainer.fit(name, params, parts.where("part = 'train'"))
    scored = scoring.class_scores(fitted.transform(parts.where("part = 'test'")), classes)
    return evaluate.confusion(scored, target, "predicted")


@query("m1_logistic_l2")
def logistic_l2(spark, folder):
    return classifier_scores(spark, folder, "logreg_l2", {"C": 1.0, "class_weight": "balanced"}, "rich")


@query("m1_logistic_l2_three_classes")
def logistic_l2_multi(spark, folder):
    return classifier_scores(spark, folder, "logreg_l2", {"C": 1.0}, "flag")


@query("m2_logistic_l1")
def logistic_l1(spark, folder):
    return classifier_scores(spark, folder, "logreg_l1", {"C": 0.1}, "rich")


@query("m3_forest_classifier")
def forest_classifier(spark, folder):
    return classifier_scores(spark, folder, "rf", {"n_estimators": 10, "max_depth": 6}, "flag")


@query("m4_boosted_classifier")
def boosted_classifier(spark, folder):
    return classifier_scores(spark, folder, "gbr", {"n_estimators": 8, "max_depth": 3}, "rich")


@query("m4_boosted_three_classes")
def boosted_multi(spark, folder):
    return classifier_scores(spark, folder, "gbr", {"n_estimators": 4, "max_depth": 2}, "flag")


def regressor_scores(spark, folder, name, params):
    use_checkpoints(spark)
    parts = split_task(spark, folder)
    trainer = tuning.Trainer(NUMBERS, "worth")
    fitted = trainer.fit(name, params, parts.where("part = 'train'"))
    scored = fitted.transform(parts.where("part <> 'train'"))
    return evaluate.regression_metrics(scored, "worth", "prediction", ["part"])


@query("m9_forest_regressor")
def forest_regressor(spark, folder):
    return regressor_scores(spark, folder, "rf", {"n_estimators": 10, "max_depth": 8, "min_samples_split": 10})


@query("m10_boosted_regressor")
def boosted_regressor(spark, folder):
    return regressor_scores(spark, folder, "gbr", {"n_estimators": 10, "max_depth": 3})


@query("m13_classifier_loop")
def classifier_loop(spark, folder):
    run = tuning.train_classifiers(task(spark, folder), "rich", F.col("o_orderkey"), ["logreg_l2", "rf"],
                                   drop=["o_orderkey", "worth", "o_totalprice", "flag"],
                                   grids={"logreg_l2": {"C": [0.1, 10.0]}, "rf": {"n_estimators": [5], "max_depth": [3, 5]}})
    return run.metrics


@query("m14_learning_curves")
def learning_curves(spark, folder):
    experiment = tuning.Experiment("rich", "rich", ("worth", "o_totalprice", "flag"))
    return tuning.learning_curves(task(spark, folder), [experiment], F.col("o_orderkey"),
                                  {"logreg_l2": {"C": 10.0}, "rf": {"n_estimators": 5, "max_depth": 4}},
                                  fractions=[0.1, 0.5, 1.0], exclude=["o_orderkey"])


@query("m15_ablation")
def ablation(spark, folder):
    """The same label with and without the column it is derived from."""
    hidden = ("o_orderkey", "o_totalprice", "flag", "o_orderpriority")
    experiments = [tuning.Experiment("all", "rich", hidden), tuning.Experiment("removed", "rich", (*hidden, "worth"))]
    metrics, _ = tuning.run_experiments(task(spark, folder), experiments, F.col("o_orderkey"), models=["rf"],
                                        grids={"rf": {"n_estimators": [5], "max_depth": [4]}})
    return reports.compare_experiments(metrics, "all", "removed")


@query("b2_scored_with_latest", f"""WITH {DEAR_SQL}, f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w,
        regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
    c AS (SELECT x, p > 0.5 AS high, round(greatest(0.005, least(0.995, greatest(p, 1 - p))), 4) AS sure
        FROM (SELECT x, avg(y) AS p FROM d GROUP BY 1))
    SELECT l_orderkey, l_linenumber, round(w * l_quantity + b, 2) AS predicted_cost, CASE WHEN high THEN '1' ELSE '0' END AS predicted_risk,
        'The model predicts this patient is ' || CASE WHEN high THEN 'HIGH RISK' ELSE 'LOW RISK' END || ' with ' || printf('%.1f', sure * 100)
        || '% confidence. Key drivers: large. This is primarily due to young age of 0 (lower baseline risk), no chronic conditions' AS reason
    FROM lineitem JOIN c ON x = (l_quantity > 25), f""")
def scored_with_latest(spark, folder):
    """Two saved models with a closed form, applied to rows with another type and an unknown column, without the label."""
    use_checkpoints(spark)
    root = scratch_path(spark, "latest")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                                    (F.col("l_quantity") > 25).cast("int").alias("large"), (F.col("l_quantity") + 5 * F.col("l_linenumber") > 45).cast("int").alias("dear"))
    for target, roles, classes, name, params, prefix in (
            ("l_extendedprice", Roles(["l_quantity"]), None, "linear", {}, "best_reg_model"),
            ("dear", Roles(["large"]), ["0", "1"], "rf", {"n_estimators": 1, "max_depth": 2, "bootstrap": False}, "best_cls_model")):
        fitted = tuning.Trainer(roles, target, classes).fit(name, params, lines)
        writers.save_model(fitted, root, prefix, card=jobs.model_card(fitted, roles, lines.select(*roles.columns).schema, classes))
    rows = lines.drop("dear").withColumns({"large": F.col("large").cast("string"), "unknown": F.lit("x")})
    scored = jobs.score_with_latest(rows, root, root, cost="l_extendedprice", label="dear")
    return scored.select("l_orderkey", "l_linenumber", "predicted_cost",
                         "predicted_risk", F.split("reason", r"\. Predicted")[0].alias("reason"))


@query("b2_scored_by_fitted_models")
def scored_by_models(spark, folder):
    use_checkpoints(spark)
    parts = split_task(spark, folder)
    train = parts.where("part = 'train'")
    cost = tuning.Trainer(NUMBERS, "worth").fit("linear", {}, train)
    risk = tuning.Trainer(NUMBERS, "rich", ["0", "1"]).fit("logreg_l2", {"C": 1.0}, train)
    scored = scoring.score_rows(parts.where("part = 'test'"), cost, risk, ["0", "1"], cost="worth", label="rich")
    return scored.select("o_orderkey", "predicted_cost", "error", "predicted_risk", "correct", "band")


@query("b6_model_importances")
def model_importances(spark, folder):
    use_checkpoints(spark)
    trainer = tuning.Trainer(NUMBERS, "rich", ["0", "1"])
    fitted: PipelineModel = trainer.fit("gbr", {"n_estimators": 5, "max_depth": 3}, split_task(spark, folder))
    return scoring.feature_importances(fitted, feature_names(fitted, NUMBERS), spark)
