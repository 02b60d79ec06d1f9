"""Feature creation, encoding, transformation, extraction and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import creation, encoding, extraction, transforms
from tablecraft.operators.session import FeatureSession
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.tables import rounded, sql_view, table, view

QTY = ("l_quantity", "l_discount", "l_tax")
KEY = ["l_orderkey", "l_linenumber"]
KEY_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
# A lambda for the given-parameter form, and a grid of lambdas to score.
GIVEN_LAMBDA = 0.25
LAMBDA_GRID = (-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1.5, 2.0)
CUSTOMER = sql_view("gappy_customer")


def applied(name: str, keep: list[str], operation, *args, digits: int = 6, **kwargs):
    """A query that fits the operation on a whole table and returns key and new columns."""

    def run(spark, sf):
        from tablecraft.plans.tables import VIEWS

        df = view(spark, sf, name) if name in VIEWS else table(spark, sf, name)
        fitted = operation(df, *args, **kwargs)
        names = [*keep, *[c for c in fitted.columns_out if c not in keep]]
        return rounded(fitted.transform(df).select(*[F.col(f"`{c}`") for c in names]), digits)

    return run


def yeo_sql(x: str, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def yeojohnson_loglik(spark, sf):
    df = table(spark, sf, "events")
    scores = transforms.likelihood_grid(df, ["value"], {"value": list(LAMBDA_GRID)})["value"]
    return rounded(local_rows(df, list(zip(LAMBDA_GRID, scores)), "lambda double, loglik double"), 3)


def yeojohnson_fit(spark, sf):
    df = table(spark, sf, "events")
    fitted = transforms.power(df, ["value", "user_id"])
    return local_rows(df, list(fitted.info["lambdas"].items()), "column string, lambda double")


LOGLIK_SQL = " UNION ALL ".join(
    f"""SELECT {lam}::DOUBLE AS lambda, round(-count(*) / 2.0 * ln(var_pop({yeo_sql('value', lam)})) + ({lam} - 1.0) * sum(sign(value) * ln(1 + abs(value))), 3) AS loglik FROM events"""
    for lam in LAMBDA_GRID
)


def edges_sql(source: str, c: str, n: int) -> str:
    return ", ".join(f"quantile_cont({c}, {i / n}) AS e{i}" for i in range(1, n))


def bin_quantile_sql(source: str, key: str, c: str, n: int) -> str:
    """Bins between the distinct inner edges; edges equal to the minimum or to each other do not split."""
    steps = " + ".join(
        f"CASE WHEN {c} > e{i} AND e{i} > {'lo' if i == 1 else f'e{i - 1}'} AND e{i} < hi THEN 1 ELSE 0 END" for i in range(1, n)
    )
    return f"""SELECT {key}, CAST(CASE WHEN {c} IS NULL THEN -1 ELSE {steps} END AS BIGINT) AS {c}_bin{n}
  FROM {source}, (SELECT min({c}) AS lo, max({c}) AS hi, {edges_sql(source, c, n)} FROM {source})"""


def bin_uniform_sql(source: str, key: str, c: str, n: int) -> str:
    steps = " + ".join(f"CASE WHEN {c} > lo + {i} * ((hi - lo) / {n}) THEN 1 ELSE 0 END" for i in range(1, n))
    return f"""SELECT {key}, CAST(CASE WHEN {c} IS NULL THEN -1 ELSE {steps} END AS BIGINT) AS {c}_bin{n}
  FROM {source}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {source})"""


def fe_summary(spark, sf):
    session = FeatureSession(table(spark, sf, "part"))
    session.apply(encoding.frequency, ["p_brand"])
    session.apply(transforms.log, ["p_retailprice"])
    session.apply(transforms.sqrt, ["p_size"])
    session.undo()
    session.apply(creation.drop_columns, ["p_name"])
    counts = session.summary()
    shape = session.comparison()
    extra = local_rows(session.original, [(k, None, v) for k, v in counts.items()], "aspect string, before bigint, after bigint")
    return shape.unionByName(extra)


FE_SUMMARY_SQL = """SELECT 'rows' AS aspect, count(*) AS before, count(*) AS after FROM part
UNION ALL SELECT * FROM (VALUES ('columns', 6::BIGINT, 7::BIGINT), ('numeric', 3, 5), ('categorical', 3, 2), ('features_added', NULL, 2), ('features_removed', NULL, 1),
  ('original_columns', NULL, 6), ('current_columns', NULL, 7), ('transforms_applied', NULL, 3))"""


def onehot_levels(spark, sf):
    return rounded(_onehot(spark, sf, "orders", ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]))


def _onehot(spark, sf, name, columns, keep, **options):
    df = table(spark, sf, name)
    fitted = encoding.onehot(df, columns, **options)
    return fitted.transform(df).select(*keep, *[F.col(f"`{c}`") for c in fitted.columns_out])


ONEHOT_SQL = "SELECT o_orderkey, " + ", ".join(
    f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS \"{c}_{v}\""
    for c, vs in (("o_orderstatus", ("O", "P")), ("o_orderpriority", ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    for v in vs
) + " FROM orders"


def onehot_capped(spark, sf):
    """Which indicator of the capped encoding is set per row, and the overwritten source column."""
    df = table(spark, sf, "part")
    fitted = encoding.onehot(df, ["p_brand"], drop_first=False)
    out = fitted.transform(df)
    flags = [F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in fitted.columns_out]
    return out.select("p_partkey", "p_brand", F.coalesce(*flags).alias("indicator"), sum(F.col(f"`{c}`") for c in fitted.columns_out).alias("n_set"))


ONEHOT_CAPPED_SQL = """WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 20),
b AS (SELECT p_partkey, CASE WHEN (SELECT count(DISTINCT p_brand) FROM part) <= 20 OR p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE '__OTHER__' END AS p_brand FROM part)
SELECT p_partkey, p_brand, 'p_brand_' || p_brand AS indicator, CAST(1 AS BIGINT) AS n_set FROM b"""


def pca_scores(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(extraction.pca(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3).transform(df).select(*KEY, "PC1", "PC2", "PC3"))


def pca_loadings(spark, sf):
    df = view(spark, sf, "correlated_lineitem")
    return rounded(extraction.loadings_frame(df, extraction.pca(df, df.columns, 3)))


CYCLES = ", ".join(
    f"round({fn}(2 * pi() * {part} / {period}.0::DOUBLE), 6) + 0.0 AS o_orderdate_{name}_{fn}"
    for name, part, period in (("month", "month(o_orderdate)", 12), ("dow", "(isodow(o_orderdate) - 1)", 7), ("hour", "hour(o_orderdate)", 24))
    for fn in ("sin", "cos")
)


def scaled_sql(c: str, suffix: str, shift: str, scale: str, source: str = "lineitem", key: str = KEY_SQL) -> str:
    x = f"coalesce(CAST({c} AS DOUBLE), 0)"
    return f"""SELECT {key}, round(({x} - a) / (CASE WHEN b = 0 THEN 1 ELSE b END), 6) AS {c}_{suffix}
  FROM {source}, (SELECT {shift.replace('{x}', x)} AS a, {scale.replace('{x}', x)} AS b FROM {source})"""


QUERIES = {
    "poly_deg2": (
        applied("lineitem", KEY, creation.polynomial, ["l_quantity", "l_discount"], 2),
        f"SELECT {KEY_SQL}, round(l_quantity * l_quantity, 6) AS \"l_quantity^2\", round(l_quantity * l_discount, 6) AS l_quantity_l_discount, round(l_discount * l_discount, 6) AS \"l_discount^2\" FROM lineitem",
    ),
    "poly_interaction_deg3": (
        applied("lineitem", KEY, creation.polynomial, list(QTY), 3, interaction_only=True),
        f"""SELECT {KEY_SQL}, round(l_quantity * l_discount, 6) AS l_quantity_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_l_tax,
        round(l_discount * l_tax, 6) AS l_discount_l_tax, round(l_quantity * l_discount * l_tax, 6) AS l_quantity_l_discount_l_tax FROM lineitem""",
    ),
    "arith": (
        applied("lineitem", KEY, creation.arithmetic, "l_quantity", "l_tax"),
        f"""SELECT {KEY_SQL}, round(l_quantity + l_tax, 6) AS l_quantity_plus_l_tax, round(l_quantity - l_tax, 6) AS l_quantity_minus_l_tax,
        round(l_quantity * l_tax, 6) AS l_quantity_times_l_tax, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity / l_tax END, 6) AS l_quantity_div_l_tax FROM lineitem""",
    ),
    "row_agg": (
        applied("lineitem", KEY, creation.row_aggregates, list(QTY), ["mean", "sum", "std", "min", "max", "range"]),
        f"""SELECT {KEY_SQL}, round(m, 6) AS agg_mean_{'_'.join(QTY)}, round(s, 6) AS agg_sum_{'_'.join(QTY)},
        round(sqrt(((l_quantity - m) * (l_quantity - m) + (l_discount - m) * (l_discount - m) + (l_tax - m) * (l_tax - m)) / 2), 6) AS agg_std_{'_'.join(QTY)},
        round(least({', '.join(QTY)}), 6) AS agg_min_{'_'.join(QTY)}, round(greatest({', '.join(QTY)}), 6) AS agg_max_{'_'.join(QTY)},
        round(greatest({', '.join(QTY)}) - least({', '.join(QTY)}), 6) AS agg_range_{'_'.join(QTY)}
        FROM (SELECT *, (l_quantity + l_discount + l_tax) AS s, (l_quantity + l_discount + l_tax) / 3 AS m FROM lineitem)""",
    ),
    "label_encode": (
        applied("gappy_customer", ["c_custkey"], encoding.label, ["c_mktsegment"]),
        f"SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment_label FROM {CUSTOMER}",
    ),
    "label_encode_wide": (
        applied("customer", ["c_custkey"], encoding.label, ["c_name"]),
        "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_label FROM customer",
    ),
    "onehot": (onehot_levels, ONEHOT_SQL),
    "onehot_capped": (onehot_capped, ONEHOT_CAPPED_SQL),
    "target_encode": (
        applied("gappy_customer", ["c_custkey"], encoding.target_mean, ["c_mktsegment"], "c_acctbal", digits=4),
        f"""WITH c AS {CUSTOMER}, m AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS v FROM c WHERE c_mktsegment IS NOT NULL GROUP BY 1)
        SELECT c_custkey, round(coalesce(m.v, (SELECT avg(c_acctbal) FROM c)), 4) AS c_mktsegment_target_enc FROM c LEFT JOIN m ON c_mktsegment = k""",
    ),
    "freq_encode": (
        applied("gappy_customer", ["c_custkey"], encoding.frequency, ["c_mktsegment"]),
        f"""WITH c AS {CUSTOMER}, m AS (SELECT c_mktsegment AS k, count(*) / (SELECT count(c_mktsegment) FROM c) AS v FROM c WHERE c_mktsegment IS NOT NULL GROUP BY 1)
        SELECT c_custkey, round(coalesce(m.v, 0), 6) AS c_mktsegment_freq FROM c LEFT JOIN m ON c_mktsegment = k""",
    ),
    "log_transform": (
        applied("gappy_customer", ["c_custkey"], transforms.log, ["c_acctbal", "gappy"]),
        f"SELECT c_custkey, round(ln(1 + greatest(coalesce(c_acctbal, 0), 0)), 6) AS c_acctbal_log, round(ln(1 + greatest(coalesce(gappy, 0), 0)), 6) AS gappy_log FROM {CUSTOMER}",
    ),
    "sqrt_transform": (
        applied("gappy_customer", ["c_custkey"], transforms.sqrt, ["c_acctbal", "gappy"]),
        f"SELECT c_custkey, round(sqrt(greatest(coalesce(c_acctbal, 0), 0)), 6) AS c_acctbal_sqrt, round(sqrt(greatest(coalesce(gappy, 0), 0)), 6) AS gappy_sqrt FROM {CUSTOMER}",
    ),
    "yeojohnson_fixed": (
        applied("gappy_customer", ["c_custkey"], transforms.power, ["c_acctbal"], {"c_acctbal": GIVEN_LAMBDA}),
        f"SELECT c_custkey, round({yeo_sql('c_acctbal', GIVEN_LAMBDA)}, 6) AS c_acctbal_boxcox FROM {CUSTOMER}",
    ),
    "yeojohnson_loglik": (yeojohnson_loglik, LOGLIK_SQL),
    "yeojohnson_fit": (yeojohnson_fit, None),
    "bin_quantile": (
        applied("gappy_customer", ["c_custkey"], transforms.binning, ["gappy"], 5, "quantile"),
        bin_quantile_sql(CUSTOMER, "c_custkey", "gappy", 5),
    ),
    "bin_quantile_ties": (
        applied("lineitem", KEY, transforms.binning, ["l_discount"], 10, "quantile"),
        bin_quantile_sql("lineitem", KEY_SQL, "l_discount", 10),
    ),
    "bin_uniform": (
        applied("gappy_customer", ["c_custkey"], transforms.binning, ["gappy"], 5, "uniform"),
        bin_uniform_sql(CUSTOMER, "c_custkey", "gappy", 5),
    ),
    "pca_scores": (pca_scores, None),
    "pca_loadings": (pca_loadings, None),
    "datetime_features": (
        applied("orders", ["o_orderkey"], extraction.datetime_features, ["o_orderdate", "o_orderpriority"]),
        f"""SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month,
        CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dow,
        CAST(hour(o_orderdate) AS DOUBLE) AS o_orderdate_hour, {CYCLES} FROM orders""",
    ),
    "scale_standard": (
        applied("lineitem", KEY, transforms.standard, ["l_extendedprice"]),
        scaled_sql("l_extendedprice", "scaled", "avg({x})", "stddev_pop({x})"),
    ),
    "scale_minmax": (
        applied("lineitem", KEY, transforms.minmax, ["l_extendedprice"]),
        scaled_sql("l_extendedprice", "minmax", "min({x})", "max({x}) - min({x})"),
    ),
    "scale_robust": (
        applied("lineitem", KEY, transforms.robust, ["l_extendedprice"]),
        scaled_sql("l_extendedprice", "robust", "quantile_cont({x}, 0.5)", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"),
    ),
    "scale_maxabs": (
        applied("gappy_customer", ["c_custkey"], transforms.maxabs, ["c_acctbal", "gappy"]),
        f"""SELECT c_custkey, round(c_acctbal / a, 6) AS c_acctbal_maxabs, round(coalesce(gappy, 0) / b, 6) AS gappy_maxabs
        FROM {CUSTOMER}, (SELECT max(abs(c_acctbal)) AS a, max(abs(coalesce(gappy, 0))) AS b FROM {CUSTOMER})""",
    ),
    "drop_columns": (
        lambda s, d: rounded(creation.drop_columns(table(s, d, "orders"), ["o_orderdate", "unknown"]).transform(table(s, d, "orders"))),
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    ),
    "fe_summary": (fe_summary, FE_SUMMARY_SQL),
}
