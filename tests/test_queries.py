"""Every registered query with SQL gives what the SQL gives, and the plans are as intended."""

import re

import pytest
from compare import connect, difference

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, FOLDER), con, ORACLES[name]) is None


def test_contract(spark):
    assert set(ORACLES) <= set(contract.queries())
    assert contract.entry(spark).count() == 12


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_read_only_the_needed_columns(spark):
    text = plan(contract.queries()["v7_auc"](spark, FOLDER))
    assert re.findall(r"ReadSchema: (.*)", text)[0] == "struct<l_extendedprice:double,l_returnflag:string>"


@pytest.mark.parametrize("name", ["t1_random_split", "l1_risk_label", "l6_tercile_bins", "t2_stratified_split", "t4_stratified_folds",
                                  "b4_compared_rows", "b7_reasons", "f6_preprocessed"])
def test_row_wise_results_move_no_rows(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "Exchange" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


@pytest.mark.parametrize("name", ["p9_describe", "v6_roc_curve", "l5_average_ranks", "p18_box_statistics", "r8_key_figures"])
def test_plans_have_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
