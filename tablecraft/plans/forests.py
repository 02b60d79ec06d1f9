"""Queries of forests with drawn thresholds."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablecraft.operators.extra_trees import ExtraTrees
from tablecraft.plans.tables import rounded, table

#: Enough splits in a row to set every value apart: months of a year, and the five priorities.
MONTHS, PRIORITIES = 12, 5


def extra_trees_months(spark, sf):
    """Mean price by month of ordering: trees that are deep enough set every month apart, so a forest of them predicts the means."""
    rows = table(spark, sf, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("double").alias("label"))
    model = ExtraTrees(numTrees=10, maxDepth=MONTHS - 1, classify=False).fit(rows.withColumn("features", F.array(F.col("month").cast("double"))))
    months = rows.groupBy("month").agg(F.count("*").alias("n")).withColumn("features", F.array(F.col("month").cast("double")))
    return rounded(model.transform(months).select(F.col("month").cast("bigint").alias("month"), "n", "prediction"), 3)


MONTHS_SQL = """SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 3) AS prediction FROM orders GROUP BY 1"""


def extra_trees_shares(spark, sf):
    """The shares of two statuses within each priority, as class probabilities."""
    rows = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    model = ExtraTrees(numTrees=10, maxDepth=PRIORITIES - 1).fit(rows.withColumn("features", F.array("priority")))
    found = model.transform(rows.groupBy("priority").agg(F.count("*").alias("n")).withColumn("features", F.array("priority")))
    share = F.get(vector_to_array("probability"), F.lit(1))
    return rounded(found.select("priority", "n", share.alias("finished")), 9)


SHARES_SQL = """SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, count(*) AS n,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS finished FROM orders GROUP BY 1"""

QUERIES = {
    "extra_trees_months": (extra_trees_months, MONTHS_SQL),
    "extra_trees_shares": (extra_trees_shares, SHARES_SQL),
}
