"""Queries for evaluation, scoring and report tables."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tabwright.operators import evaluate, profile, reports, scoring
from tabwright.plans.suite import query, rounded, table
from tabwright.storage import scratch_path
from tabwright.streaming.scoring import read_arrivals, score_stream, write_scores

SPLIT_SQL = "CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END"
PREDICTED_SQL = f"""pred AS (
    SELECT 'quantity' AS model, {SPLIT_SQL} AS split, l_returnflag AS actual,
        CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted FROM lineitem
    UNION ALL SELECT 'discount', {SPLIT_SQL}, l_returnflag,
        CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END FROM lineitem
    UNION ALL SELECT 'hit', {SPLIT_SQL}, l_returnflag,
        CASE WHEN l_linenumber <= 4 THEN l_returnflag ELSE 'A' END FROM lineitem),
    conf AS (SELECT model, split, actual, predicted, count(*) AS n FROM pred GROUP BY ALL)"""
METRICS_SQL = f"""{PREDICTED_SQL},
    sides AS (SELECT model, split, actual AS label, n AS t, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM conf
        UNION ALL SELECT model, split, predicted, 0, n, 0 FROM conf),
    lab AS (SELECT model, split, label, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(tp)::DOUBLE AS tp FROM sides GROUP BY ALL),
    met AS (SELECT model, split, sum(tp) / sum(t) AS accuracy, avg(2 * tp / (t + p)) AS f1_macro,
        (sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) AS mcc,
        sum(t)::BIGINT AS total, (sum(t) - sum(tp))::BIGINT AS misclassified FROM lab GROUP BY ALL)"""


def predictions(spark, folder):
    """Three rules that guess the return flag, as rows model, split, actual, predicted."""
    def steps(value, low, high):
        return F.when(value < low, "A").when(value < high, "N").otherwise("R")

    rules = {"quantity": steps(F.col("l_quantity"), 17, 34), "discount": steps(F.col("l_discount"), 0.03, 0.07),
             "hit": F.when(F.col("l_linenumber") <= 4, F.col("l_returnflag")).otherwise("A")}
    guesses = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), g.alias("predicted")) for m, g in rules.items()]))
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split"),
        F.col("l_returnflag").alias("actual"), guesses.alias("g")).select("split", "actual", "g.*")


def counts_of(spark, folder):
    return evaluate.confusion(predictions(spark, folder), "actual", "predicted", ["model", "split"])


def metrics_of(spark, folder):
    return evaluate.class_metrics(counts_of(spark, folder), ["model", "split"])


@query("v1_confusion", f"WITH {PREDICTED_SQL} SELECT * FROM conf")
def confusion(spark, folder):
    return counts_of(spark, folder)


@query("v1_confusion_grid", f"""WITH {PREDICTED_SQL}, l AS (SELECT unnest(['A', 'N', 'R']) AS label),
    cells AS (SELECT m.model, m.split, a.label AS actual, list(coalesce(n, 0) ORDER BY p.label) AS cells
        FROM (SELECT DISTINCT model, split FROM conf) m, l a, l p LEFT JOIN conf c
            ON c.model = m.model AND c.split = m.split AND c.actual = a.label AND c.predicted = p.label GROUP BY ALL)
    SELECT model, split, list(actual ORDER BY actual) AS labels, list(cells ORDER BY actual) AS matrix FROM cells GROUP BY ALL""")
def confusion_grid(spark, folder):
    return evaluate.confusion_grid(counts_of(spark, folder), ["model", "split"])


@query("v2_accuracy", f"WITH {METRICS_SQL} SELECT model, split, round(accuracy, 8) AS accuracy FROM met")
def accuracy(spark, folder):
    return rounded(metrics_of(spark, folder).select("model", "split", "accuracy"), 8)


@query("v3_macro_f1", f"WITH {METRICS_SQL} SELECT model, split, round(f1_macro, 8) AS f1_macro FROM met")
def macro_f1(spark, folder):
    return rounded(metrics_of(spark, folder).select("model", "split", "f1_macro"), 8)


@query("v4_mcc", f"WITH {METRICS_SQL} SELECT model, split, round(mcc, 8) AS mcc FROM met")
def mcc(spark, folder):
    return rounded(metrics_of(spark, folder).select("model", "split", "mcc"), 8)


RATES_SQL = f"""{PREDICTED_SQL}, r AS (SELECT model, split, sum(n) FILTER (actual = 'R' AND predicted = 'R') AS tp,
        sum(n) FILTER (actual <> 'R' AND predicted <> 'R') AS tn, sum(n) FILTER (actual <> 'R' AND predicted = 'R') AS fp,
        sum(n) FILTER (actual = 'R' AND predicted <> 'R') AS fn FROM conf GROUP BY ALL),
    z AS (SELECT model, split, coalesce(tp, 0)::BIGINT AS tp, coalesce(tn, 0)::BIGINT AS tn, coalesce(fp, 0)::BIGINT AS fp,
        coalesce(fn, 0)::BIGINT AS fn FROM r)"""


@query("v5_binary_rates", f"""WITH {RATES_SQL} SELECT *, round(tp / nullif(tp + fn, 0)::DOUBLE, 8) AS tpr,
    round(tn / nullif(tn + fp, 0)::DOUBLE, 8) AS tnr, round(fp / nullif(fp + tn, 0)::DOUBLE, 8) AS fpr,
    round(fn / nullif(fn + tp, 0)::DOUBLE, 8) AS fnr FROM z""")
def binary_rates(spark, folder):
    return rounded(evaluate.binary_rates(counts_of(spark, folder), "R", ["model", "split"]), 8)


def roc_sql(source: str, score: str, hit: str) -> str:
    return f"""s AS (SELECT {score} AS score, count(*) FILTER ({hit}) AS pos, count(*) FILTER (NOT ({hit})) AS neg
        FROM {source} GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
        row_number() OVER w AS i FROM s WINDOW w AS (ORDER BY score DESC)),
    kept AS (SELECT score AS threshold, fp / (SELECT sum(neg) FROM s)::DOUBLE AS fpr, tp / (SELECT sum(pos) FROM s)::DOUBLE AS tpr
        FROM c WHERE i = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg),
    curve AS (SELECT * FROM kept UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)"""


def lineitem_scores(spark, folder):
    return table(spark, folder, "lineitem")


ROC_SQL = roc_sql("lineitem", "l_quantity", "l_returnflag = 'R'")
PRICE_ROC_SQL = roc_sql("lineitem", "l_extendedprice", "l_returnflag = 'R'")


@query("v6_roc_curve", f"WITH {ROC_SQL} SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM curve")
def roc_curve(spark, folder):
    return rounded(evaluate.roc_curve(lineitem_scores(spark, folder), "l_quantity", F.col("l_returnflag") == "R"), 8)


@query("v6_roc_curve_of_prices", f"WITH {PRICE_ROC_SQL} SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM curve")
def roc_curve_of_prices(spark, folder):
    return rounded(evaluate.roc_curve(lineitem_scores(spark, folder), "l_extendedprice", F.col("l_returnflag") == "R"), 8)


AREA = "sum((tp - pos + pos / 2::DOUBLE) * neg) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE)"


@query("v7_auc", f"WITH {PRICE_ROC_SQL} SELECT round({AREA}, 8) AS auc FROM c")
def auc(spark, folder):
    return rounded(evaluate.auc(lineitem_scores(spark, folder), "l_extendedprice", F.col("l_returnflag") == "R"), 8)


@query("v7_auc_by_group", f"""WITH s AS (SELECT l_linestatus, l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
        count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY l_linestatus ORDER BY score DESC) AS tp FROM s)
    SELECT l_linestatus, round({AREA}, 8) AS auc FROM c GROUP BY 1""")
def auc_by_group(spark, folder):
    return rounded(evaluate.auc(lineitem_scores(spark, folder), "l_quantity", F.col("l_returnflag") == "R", ["l_linestatus"]), 8)


@query("v8_auc_ovr_macro", f"""WITH l AS (
        SELECT 'A' AS class, -l_quantity AS score, l_returnflag = 'A' AS hit FROM lineitem
        UNION ALL SELECT 'N', l_discount, l_returnflag = 'N' FROM lineitem
        UNION ALL SELECT 'R', l_extendedprice, l_returnflag = 'R' FROM lineitem),
    s AS (SELECT class, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM l GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS tp FROM s),
    a AS (SELECT class, {AREA} AS auc FROM c GROUP BY class)
    SELECT round(avg(auc), 8) AS roc_auc_ovr_macro FROM a""")
def auc_ovr(spark, folder):
    df = table(spark, folder, "lineitem").withColumn(
        "scores", F.array(-F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")))
    return rounded(evaluate.auc_ovr_macro(df, "l_returnflag", "scores", ["A", "N", "R"]), 8)


@query("v9_regression_metrics", """WITH p AS (SELECT o_orderpriority, o_totalprice AS y, 1.5 * o_custkey + 200000 AS f FROM orders)
    SELECT o_orderpriority, round(avg(abs(y - f)), 4) AS mae, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse,
        round(1 - avg((y - f) * (y - f)) / var_pop(y), 8) AS r2 FROM p GROUP BY 1""")
def regression_metrics(spark, folder):
    df = table(spark, folder, "orders").withColumn("f", F.col("o_custkey") * 1.5 + 200000)
    found = evaluate.regression_metrics(df, "o_totalprice", "f", ["o_orderpriority"])
    return found.select("o_orderpriority", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                        F.round("r2", 8).alias("r2"))


@query("v10_curve_picks", f"""WITH {PRICE_ROC_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS idx,
        count(*) OVER () - 1 AS last FROM curve)
    SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, idx FROM numbered
    WHERE idx IN (SELECT floor(i::DOUBLE * (last / 6::DOUBLE)) FROM range(1, 6) r(i))""")
def curve_picks(spark, folder):
    curve = evaluate.roc_curve(lineitem_scores(spark, folder), "l_extendedprice", F.col("l_returnflag") == "R")
    return rounded(evaluate.curve_picks(curve, 5), 8)


@query("v11_split_results", f"""WITH {METRICS_SQL} SELECT model, split, round(accuracy, 8) AS accuracy,
    round(f1_macro, 8) AS f1_macro, round(mcc, 8) AS mcc, total, misclassified FROM met""")
def split_results(spark, folder):
    return rounded(metrics_of(spark, folder), 8)


# ---- scoring -------------------------------------------------------------------------------

PATIENTS_SQL = """people AS (SELECT o_orderkey, o_totalprice, o_orderkey % 90 AS age,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Current' WHEN '2-HIGH' THEN 'Never' ELSE 'Former' END AS smoker,
    o_custkey % 4 AS chronic_count, CASE WHEN o_orderkey % 17 <> 0 THEN 15 + (o_custkey % 200) / 8.0::DOUBLE END AS bmi,
    CASE WHEN o_orderkey % 19 <> 0 THEN (o_totalprice > 250000)::INT END AS risk FROM orders)"""


def patients(spark, folder):
    """Orders dressed as people, joined with nothing, one row each."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", (key % 90).alias("age"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Current").when(F.col("o_orderpriority") == "2-HIGH", "Never")
        .otherwise("Former").alias("smoker"), (customer % 4).alias("chronic_count"),
        F.when(key % 17 != 0, F.lit(15) + (customer % 200) / F.lit(8.0)).alias("bmi"),
        F.when(key % 19 != 0, (F.col("o_totalprice") > 250000).cast("int")).alias("risk"))


# Fixed coefficients stand in for fitted models, so that SQL can repeat the scoring.
COST = "1000.0D * age + 50000.0D * chronic_count + 100000.0D"
RISK = "(1.0D / (1.0D + exp(-(age - 45.0D) / 6.0D)))"


def fixed_models():
    """A cost model and a class model given by formulas."""
    cost = SQLTransformer(statement=f"SELECT *, {COST} AS prediction FROM __THIS__")
    risk = SQLTransformer(statement=f"""SELECT *, array(1 - {RISK}, {RISK}) AS probability,
        CASE WHEN {RISK} > 0.5D THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__""")
    return cost, risk


SCORED_SQL = f"""{PATIENTS_SQL}, raw AS (SELECT *, 1000.0::DOUBLE * age + 50000.0::DOUBLE * chronic_count + 100000 AS cost,
        1 / (1 + exp(-(age - 45) / 6::DOUBLE)) AS p FROM people),
    scored AS (SELECT *, round(least(0.995, greatest(0.005, 1 - p)), 4) AS p0, round(least(0.995, greatest(0.005, p)), 4) AS p1,
        round(cost, 2) AS predicted_cost, round(o_totalprice, 2) AS actual_cost, round(abs(cost - o_totalprice), 2) AS error,
        CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS predicted_risk, coalesce(risk::VARCHAR, '') AS actual_risk FROM raw)"""
BAND_SQL = "CASE WHEN error < 500 THEN 'good' WHEN error < 1000 THEN 'warn' ELSE 'bad' END"


def scored_patients(spark, folder):
    return scoring.score_rows(patients(spark, folder), *fixed_models(), ["0", "1"],
                              cost="o_totalprice", label="risk")


@query("b1_aligned_columns", "SELECT p_partkey, p_size::DOUBLE AS p_size, NULL::VARCHAR AS region, p_type FROM part")
def aligned(spark, folder):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("p_partkey bigint, p_size double, region string, p_type string")
    return scoring.align(table(spark, folder, "part"), schema)


@query("b2_scored_rows", f"""WITH {SCORED_SQL} SELECT o_orderkey, predicted_cost, predicted_risk, p0, p1 FROM scored""")
def scored_rows(spark, folder):
    p = F.col("probabilities")
    return scored_patients(spark, folder).select("o_orderkey", "predicted_cost", "predicted_risk", p["0"].alias("p0"), p["1"].alias("p1"))


@query("b2_scored_stream", f"""WITH {SCORED_SQL} SELECT o_orderkey, predicted_cost, actual_cost, predicted_risk, p0, p1, {BAND_SQL} AS band FROM scored""")
def scored_stream(spark, folder):
    """The rows arrive as files in two batches; the stream ends between them and goes on from its checkpoint."""
    people = patients(spark, folder)
    arrivals, scores, state = (scratch_path(spark, name) for name in ("arrivals", "scores", "state"))
    for batch in (0, 1):
        people.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == batch).write.mode("append").parquet(arrivals)
        scored = score_stream(read_arrivals(spark, arrivals, people.schema), *fixed_models(), ["0", "1"], cost="o_totalprice", label="risk")
        write_scores(scored, scores, state).awaitTermination()
    p = F.col("probabilities")
    return spark.read.schema(scored.schema).parquet(scores).select(
        "o_orderkey", "predicted_cost", "actual_cost", "predicted_risk", p["0"].alias("p0"), p["1"].alias("p1"), "band")


@query("b3_clipped_probabilities", f"WITH {SCORED_SQL} SELECT o_orderkey, p0, p1 FROM scored")
def clipped(spark, folder):
    p = F.col("probabilities")
    return scored_patients(spark, folder).select("o_orderkey", p["0"].alias("p0"), p["1"].alias("p1"))


@query("b4_compared_rows", f"""WITH {SCORED_SQL} SELECT o_orderkey, predicted_cost, actual_cost, error, predicted_risk,
    actual_risk, predicted_risk = actual_risk AS correct FROM scored""")
def compared(spark, folder):
    return scored_patients(spark, folder).select("o_orderkey", "predicted_cost", "actual_cost", "error", "predicted_risk",
                                                 "actual_risk", "correct")


@query("b5_error_bands", f"WITH {SCORED_SQL} SELECT {BAND_SQL} AS band, count(*) AS n FROM scored GROUP BY 1")
def bands(spark, folder):
    return scored_patients(spark, folder).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("b6_top_importances", """WITH i AS (SELECT p_brand || '/' || p_type AS name, sum(p_size) / (SELECT sum(p_size) FROM part)::DOUBLE
        AS importance FROM part GROUP BY 1)
    SELECT name, round(importance, 4) AS importance, round(importance / (SELECT max(importance) FROM i), 4) AS share
    FROM i ORDER BY i.importance DESC, name LIMIT 10""")
def top_importances(spark, folder):
    part = table(spark, folder, "part")
    total = part.agg(F.sum("p_size")).scalar()
    weights = part.groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("name")).agg(F.sum("p_size").alias("s"))
    return scoring.top_importances(weights.select("name", (F.col("s") / total).alias("importance")), 10)


# The sentences that explain a score, as the scoring module words them.
REASON_SQL = """'The model predicts this patient is ' || CASE WHEN predicted_risk = '1' THEN 'HIGH RISK' ELSE 'LOW RISK' END
    || ' with ' || format('{:.1f}', round(greatest(p0, p1) * 100, 1)) || '% confidence. Key drivers: age, bmi, smoker. This is primarily due to '
    || coalesce(nullif(concat_ws(', ',
        CASE WHEN age >= 55 THEN 'age of ' || age || ' (older patients carry higher risk)'
             WHEN age <= 30 THEN 'young age of ' || age || ' (lower baseline risk)' END,
        CASE smoker WHEN 'Current' THEN 'active smoking status' WHEN 'Never' THEN 'non-smoker status' END,
        CASE WHEN chronic_count >= 2 THEN chronic_count || ' chronic conditions'
             WHEN chronic_count = 0 THEN 'no chronic conditions' END,
        CASE WHEN bmi >= 30 THEN 'elevated BMI of ' || format('{:.1f}', round(bmi, 1)) END), ''), 'overall feature profile')
    || '. Predicted annual cost: $' || format('{:,}', predicted_cost::BIGINT) || '.'"""


@query("b7_reasons", f"WITH {SCORED_SQL} SELECT o_orderkey, greatest(p0, p1) AS confidence, {REASON_SQL} AS reason FROM scored")
def reasons(spark, folder):
    explained = scoring.with_reasons(scored_patients(spark, folder), {"smoker": 0.1, "age": 0.6, "bmi": 0.3, "none": 0.0})
    return explained.select("o_orderkey", "confidence", "reason")


@query("b8_key_features", f"WITH {PATIENTS_SQL} SELECT age, bmi, smoker, chronic_count FROM people")
def key_features(spark, folder):
    return scoring.key_features(patients(spark, folder))


# ---- report tables -------------------------------------------------------------------------

ORDER_TYPES = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "str", "o_totalprice": "float64",
               "o_orderpriority": "str"}


def catalogue_sql() -> str:
    rows = []
    for c, t in ORDER_TYPES.items():
        if t == "str":
            rows.append(f"""SELECT '{c}' AS feature, count({c}) AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std,
                NULL::DOUBLE AS min, NULL::DOUBLE AS max, count(DISTINCT {c}) AS "unique",
                (SELECT {c} FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, '{t}' AS dtype,
                0::BIGINT AS missing FROM orders""")
        else:
            rows.append(f"""SELECT '{c}', count({c}), round(avg({c}), 4), round(stddev_samp({c}), 4), min({c})::DOUBLE,
                max({c})::DOUBLE, NULL, NULL, '{t}', 0 FROM orders""")
    rows.sort(key=lambda r: "unique" not in r)
    return "catalogue AS (" + " UNION ALL ".join(rows) + ")"


def catalogue_of(spark, folder):
    df = table(spark, folder, "orders").select(*ORDER_TYPES)
    counts = profile.missing_counts(df)
    return reports.feature_catalogue(profile.describe_all(df), counts.select("feature", "dtype"), counts)


@query("r1_feature_catalogue", f"WITH {catalogue_sql()} SELECT * FROM catalogue")
def catalogue(spark, folder):
    return rounded(catalogue_of(spark, folder), 4)


@query("r2_feature_search", f"""WITH {catalogue_sql()} SELECT feature, mean, missing FROM catalogue
    WHERE lower(feature) LIKE '%or%' ORDER BY mean DESC NULLS LAST, feature""")
def feature_search(spark, folder):
    found = reports.search_features(catalogue_of(spark, folder), "OR", "mean", False)
    return rounded(found.select("feature", "mean", "missing"), 4)


@query("r3_kind_counts", f"""WITH {catalogue_sql()} SELECT count(*) FILTER (dtype <> 'str') AS numeric,
    count(*) FILTER (dtype = 'str') AS categorical FROM catalogue""")
def kind_counts(spark, folder):
    return reports.kind_counts(catalogue_of(spark, folder))


@query("r4_confusion_shares", f"""WITH {PREDICTED_SQL} SELECT *,
    round(n / sum(n) OVER (PARTITION BY model, split, actual)::DOUBLE * 100, 6) AS row_percent,
    round(n / max(n) OVER (PARTITION BY model, split)::DOUBLE, 6) AS intensity FROM conf""")
def confusion_shares(spark, folder):
    return rounded(reports.confusion_shares(counts_of(spark, folder)))


def wide_metrics(spark, folder):
    """Class metrics of the rules as one row per model, the shape of a training report."""
    names = ("accuracy", "f1_macro", "mcc")
    return metrics_of(spark, folder).groupBy("model").agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("val", "test") for m in names])


WIDE_SQL = METRICS_SQL + ", wide AS (SELECT model, " + ", ".join(
    f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("val", "test") for m in ("accuracy", "f1_macro", "mcc")) + " FROM met GROUP BY model)"
LONG_SQL = f"""{METRICS_SQL}, long AS (SELECT model, split, unnest(['accuracy', 'f1_macro', 'mcc']) AS metric,
    unnest([accuracy, f1_macro, mcc]) AS value FROM met)"""


@query("r5_long_metrics", f"WITH {LONG_SQL} SELECT model, split, metric, round(value, 8) AS value FROM long WHERE split = 'val'")
def long_metrics(spark, folder):
    return rounded(reports.long_metrics(wide_metrics(spark, folder), "val"), 8)


@query("r6_metric_by_model", f"""WITH {LONG_SQL} SELECT metric, round(max(value) FILTER (model = 'quantity'), 8) AS quantity,
    round(max(value) FILTER (model = 'discount'), 8) AS discount FROM long WHERE split = 'test' GROUP BY 1""")
def metric_by_model(spark, folder):
    long = reports.long_metrics(wide_metrics(spark, folder), "test")
    return rounded(reports.metric_by_model(long, ["quantity", "discount"]), 8)


@query("r7_best_row", f"""WITH {WIDE_SQL} SELECT model, round(test_mcc, 8) AS test_mcc, 'named' AS choice FROM wide WHERE model = 'discount'
    UNION ALL SELECT * FROM (SELECT model, round(test_mcc, 8), 'first' FROM wide ORDER BY wide.test_mcc DESC, model LIMIT 1)""")
def best_row(spark, folder):
    wide = wide_metrics(spark, folder)
    named = reports.best_row(wide, "discount", "test_mcc").withColumn("choice", F.lit("named"))
    first = reports.best_row(wide, "no_such_model", "test_mcc").withColumn("choice", F.lit("first"))
    return rounded(named.unionByName(first).select("model", "test_mcc", "choice"), 8)


COSTS_SQL = """errs AS (SELECT 'ridge' AS model, o_totalprice AS y, o_custkey * 1.5 + 200000 AS f FROM orders
        UNION ALL SELECT 'linear', o_totalprice, o_orderkey * 2.0 + 240000 FROM orders),
    costs AS (SELECT model, sqrt(avg((y - f) * (y - f))) AS test_rmse, 1 - avg((y - f) * (y - f)) / var_pop(y) AS test_r2
        FROM errs GROUP BY 1)"""


@query("r8_key_figures", f"""WITH {WIDE_SQL}, {COSTS_SQL} SELECT
    (SELECT round(test_accuracy, 8) FROM wide WHERE model = 'hit') AS best_accuracy,
    (SELECT round(test_mcc, 8) FROM wide WHERE model = 'hit') AS best_mcc,
    (SELECT round(test_r2, 8) FROM costs ORDER BY costs.test_rmse LIMIT 1) AS best_r2,
    (SELECT count(*) FROM orders) AS n_rows, 6::BIGINT AS n_features""")
def key_figures(spark, folder):
    orders = table(spark, folder, "orders")
    guesses = F.explode(F.array(
        F.struct(F.lit("ridge").alias("model"), (F.col("o_custkey") * 1.5 + 200000).alias("f")),
        F.struct(F.lit("linear").alias("model"), (F.col("o_orderkey") * 2.0 + 240000).alias("f"))))
    scored = orders.select("o_totalprice", guesses.alias("g")).select("o_totalprice", "g.*")
    costs = evaluate.regression_metrics(scored, "o_totalprice", "f", ["model"]).select(
        "model", F.col("rmse").alias("test_rmse"), F.col("r2").alias("test_r2"))
    size = profile.shape(orders)
    return rounded(reports.key_figures(wide_metrics(spark, folder), costs, "hit", "none",
                                       size.select("n_rows").scalar(), size.select("n_columns").scalar()), 8)


@query("r9_compared_experiments", f"""WITH {METRICS_SQL} SELECT a.model, round(a.accuracy, 8) AS first, round(b.accuracy, 8) AS second,
    round(b.accuracy - a.accuracy, 8) AS change FROM met a JOIN met b ON a.model = b.model WHERE a.split = 'val' AND b.split = 'test'""")
def compared_experiments(spark, folder):
    """The two parts of the line items serve as two experiments."""
    found = metrics_of(spark, folder)
    both = reports.union_experiments({
        s: found.where(F.col("split") == s).select("model", F.col("accuracy").alias("test_accuracy")) for s in ("val", "test")})
    return rounded(reports.compare_experiments(both, "val", "test"), 8)


@query("r10_display_formats", """WITH t AS (SELECT p_type, sum(p_retailprice) AS price, avg(p_size) / 50 AS share, 1 / sum(p_retailprice) AS tiny
        FROM part GROUP BY 1)
    SELECT CASE p_type WHEN 'PROMO' THEN 'Promotion' ELSE p_type END AS label, format('{:.2f}', share * 100) || '%' AS share,
        regexp_replace(format('{:,.1f}', price), '\\.0$', '') AS price,
        regexp_replace(format('{:.2e}', tiny), 'e([+-])0(\\d)$', 'e\\1\\2') AS tiny, format('{:.4f}', share) AS plain FROM t""")
def display_formats(spark, folder):
    found = table(spark, folder, "part").groupBy("p_type").agg(
        F.sum("p_retailprice").alias("price"), (F.avg("p_size") / 50).alias("share"), (1 / F.sum("p_retailprice")).alias("tiny"))
    return found.select(
        reports.model_label(F.col("p_type"), {"PROMO": "Promotion"}).alias("label"), reports.percent(F.col("share")).alias("share"),
        reports.compact_number(F.col("price")).alias("price"), reports.compact_number(F.col("tiny")).alias("tiny"),
        reports.compact_number(F.col("share")).alias("plain"))
