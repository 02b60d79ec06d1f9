"""Queries of regression by deviance and of isotonic regression."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tablecraft.operators import calibration, catalog, deviance
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.tables import rounded, sql_view, table, view

POWERS = (0.0, 1.0, 1.5, 2.0, 3.0)


def category_models(spark, sf):
    """Quantities by return flag and line status from a Poisson, a gamma and a Tweedie model of one category, which are the means of its groups."""
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("category"), F.col("l_quantity").cast("double").alias("label"))
    coded = StringIndexer(inputCol="category", outputCol="at").fit(rows).transform(rows)
    coded = OneHotEncoder(inputCol="at", outputCol="features").fit(coded).transform(coded).select("category", "features", "label").persist()
    out = coded
    models = {"poisson": catalog.model("PoissonRegressor").create(), "gamma": catalog.model("GammaRegressor").create(), "tweedie": deviance.regression(1.5)}
    for name, model in models.items():
        out = model.setPredictionCol(name).fit(coded).transform(out)
    coded.unpersist()
    return rounded(out.groupBy("category").agg(F.count("*").alias("n"), *[F.max(m).alias(m) for m in models]), 4)


CATEGORY_SQL = """SELECT l_returnflag || l_linestatus AS category, count(*) AS n, round(avg(l_quantity), 4) AS poisson, round(avg(l_quantity), 4) AS gamma, round(avg(l_quantity), 4) AS tweedie
FROM lineitem GROUP BY 1"""


def tweedie_deviances(spark, sf):
    """Mean deviance of predicted prices for variances that grow with different powers of the mean."""
    rows = view(spark, sf, "reg_pred").select(F.col("label") / 1000, F.col("prediction") / 1000).toDF("label", "prediction")
    parts = [deviance.mean_deviance(rows, p) for p in POWERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 6)


_UNIT = {
    0.0: "(y - m) * (y - m)", 1.0: "2 * (y * ln(y / m) - y + m)", 1.5: "4 * pow(sqrt(y) - sqrt(m), 2) / sqrt(m)", 2.0: "2 * (y / m - ln(y / m) - 1)",
    3.0: "pow(y - m, 2) / (y * m * m)",
}
DEVIANCE_SQL = " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS power, count(*) AS n, round(avg({d}), 6) AS deviance FROM (SELECT CAST(label AS DOUBLE) / 1000 AS y, CAST(prediction AS DOUBLE) / 1000 AS m FROM {sql_view('reg_pred')})"
    for p, d in _UNIT.items())


def isotonic_discount(spark, sf):
    """The discount as a function of the quantity that never falls, over all line items."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    fit = calibration.isotonic(rows, "l_quantity", "l_discount", "fitted")
    levels = rows.groupBy(F.col("l_quantity").cast("double").alias("l_quantity")).agg(F.count("*").alias("n"))
    return rounded(fit.transform(levels), 8)


#: The fit at a level is the largest, over the starts up to it, of the smallest mean from there to an end behind it.
ISOTONIC_SQL = """WITH levels AS (SELECT CAST(l_quantity AS DOUBLE) AS q, count(*) AS n, sum(CAST(l_discount AS DOUBLE)) AS s FROM lineitem GROUP BY 1),
sums AS (SELECT q, n, s, sum(n) OVER (ORDER BY q) AS ns, sum(s) OVER (ORDER BY q) AS ss FROM levels),
means AS (SELECT a.q AS a, b.q AS b, (b.ss - a.ss + a.s) / (b.ns - a.ns + a.n) AS m FROM sums a JOIN sums b ON a.q <= b.q),
least AS (SELECT l.q, a, min(m) AS m FROM levels l JOIN means ON a <= l.q AND b >= l.q GROUP BY l.q, a)
SELECT l.q AS l_quantity, any_value(l.n) AS n, round(max(m), 8) AS fitted FROM levels l JOIN least USING (q) GROUP BY l.q"""


def customer_power(spark, sf):
    """The variance power of what customers spend (nothing, or sums of orders), by their balance: profile likelihood over a grid."""
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("double") / 100_000).alias("spent"))
    rows = table(spark, sf, "customer").join(spent, "c_custkey", "left")
    rows = rows.select((F.coalesce("c_acctbal", F.lit(0)).cast("double") / 10_000).alias("balance"), F.coalesce("spent", F.lit(0.0)).alias("label"))
    profile = deviance.power_profile(VectorAssembler(inputCols=["balance"], outputCol="features").transform(rows), (1.2, 1.4, 1.6, 1.8))
    best = deviance.best_power(profile)
    return rounded(local_rows(rows, [(*r, r["power"] == best) for r in profile.collect()], "power double, dispersion double, log_likelihood double, best boolean"), 3)


QUERIES = {
    "category_models": (category_models, CATEGORY_SQL),
    "tweedie_deviances": (tweedie_deviances, DEVIANCE_SQL),
    "isotonic_discount": (isotonic_discount, ISOTONIC_SQL),
    "tweedie_power_profile": (customer_power, None),
}
