"""Properties of the physical plans that matter on large tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest

from tablecraft.operators import cleaning, encoding, insights, profiling, transforms

PYTHON_OPERATORS = {"knn_join", "knn_classify", "nearest_centroid"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def test_statistics_read_only_their_columns(lineitem):
    plan = plan_of(profiling.column_stats(lineitem, ["l_quantity", "l_tax"], {"m": profiling.F.avg}))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_filters_reach_the_scan(lineitem):
    fitted = transforms.standard(lineitem, ["l_quantity"])
    plan = plan_of(fitted.transform(lineitem).where("l_linenumber = 3").select("l_quantity_scaled"))
    assert "EqualTo(l_linenumber,3)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_row_local_and_lookup_transforms_do_not_shuffle(lineitem):
    for fitted in (
        transforms.binning(lineitem, ["l_quantity"]), transforms.robust(lineitem, ["l_tax"]), encoding.onehot(lineitem, ["l_returnflag"]),
        encoding.target_mean(lineitem, ["l_returnflag"], "l_tax"), encoding.label(lineitem, ["l_linestatus"]),
    ):
        plan = plan_of(fitted.transform(lineitem))
        assert "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_no_python_in_core_plans(spark, sf_dir):
    for name in ("clean_all", "profile_numeric", "chart_topk", "insight_outliers", "mutual_info", "prepare_features", "split_stratified"):
        plan = plan_of(entry.queries()[name](spark, sf_dir))
        assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_top_values_are_limited_before_the_shuffle(lineitem):
    assert plan_of(profiling.top_values(lineitem, ["l_returnflag", "l_linestatus"])).count("WindowGroupLimit") >= 2


def test_cleaning_shuffles_once(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out, _ = cleaning.clean(orders)
    assert plan_of(out).count("hashpartitioning") == 1


def test_report_of_a_table_without_numbers_or_text(spark):
    assert insights.report(spark.range(5)).count() >= 2
    assert insights.report(spark.createDataFrame([("a",), ("b",)], "s string")).count() == 1
