"""Feature selection queries."""

from __future__ import annotations

from tablecraft.operators import selection
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.cleaning import LINEITEM_NUMBERS, per_column
from tablecraft.plans.insights import CORRELATED, CORRELATED_COLUMNS
from tablecraft.plans.tables import rounded, table, view

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASS, NUMBER = "l_returnflag", "l_extendedprice"
REGRESSORS = ["l_quantity", "l_discount", "l_tax", "l_partkey"]


def anova_sql(features, source: str = "lineitem", target: str = CLASS) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
  FROM (SELECT {target}, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {source} GROUP BY {target}), (SELECT avg({c}) AS g FROM {source})"""
        for c in features
    )


def f_regression_sql(features, target: str = NUMBER, source: str = "lineitem") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, r * r / (1 - r * r) * (n - 2) AS f_score FROM (SELECT corr({c}, {target}) AS r, count(*) AS n FROM {source})" for c in features
    )


def bins_sql(c: str, source: str, bins: int = 10) -> str:
    """Quantile bin of a column, as an expression over the joined edges of that column (e1..e9, lo, hi)."""
    return " + ".join(
        f"CASE WHEN {c} > e{i} AND e{i} > {'lo' if i == 1 else f'e{i - 1}'} AND e{i} < hi THEN 1 ELSE 0 END" for i in range(1, bins)
    )


def edges_of(c: str, source: str, bins: int = 10) -> str:
    edges = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {i / bins}) AS e{i}" for i in range(1, bins))
    return f"(SELECT min({c}) AS lo, max({c}) AS hi, {edges} FROM {source})"


def mutual_information_sql(features, target: str = CLASS, source: str = "lineitem") -> str:
    parts = []
    for c in features:
        cells = f"SELECT {bins_sql(c, source)} AS x, {target} AS y, count(*) AS n FROM {source}, {edges_of(c, source)} GROUP BY 1, 2"
        parts.append(
            f"""SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx,
  sum(n) OVER (PARTITION BY y) AS ny FROM ({cells}))"""
        )
    return " UNION ALL ".join(parts)


def mutual_information_regression_sql(features, target: str, source: str = "lineitem") -> str:
    parts = []
    for c in features:
        cells = f"""SELECT x, y, count(*) AS n FROM (
  SELECT {bins_sql(c, source)} AS x, yb AS y FROM (SELECT {c}, yb FROM (SELECT a.*, {bins_sql(target, source)} AS yb FROM {source} a, {edges_of(target, source)})), {edges_of(c, source)}) GROUP BY 1, 2"""
        parts.append(
            f"""SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx,
  sum(n) OVER (PARTITION BY y) AS ny FROM ({cells}))"""
        )
    return " UNION ALL ".join(parts)


FILTERS_SQL = f"""WITH code AS (SELECT *, dense_rank() OVER (ORDER BY {CLASS}) - 1 AS y FROM lineitem),
s AS (SELECT '{selection.METHODS[0]}' AS method, feature, mi AS score FROM ({mutual_information_sql(FEATURES)})
  UNION ALL SELECT '{selection.METHODS[1]}', feature, f_score FROM ({anova_sql(FEATURES)})
  UNION ALL {' UNION ALL '.join(f"SELECT '{selection.METHODS[2]}', '{c}', abs(corr({c}, y)) FROM code" for c in FEATURES)}),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(score, 9) DESC, feature) AS rank FROM s)"""


def _scores(fitted, key: str, df, name: str):
    return rounded(local_rows(df, list(fitted.info[key].items()), f"feature string, {name} double"))


def rfe_ranking(spark, sf):
    df = view(spark, sf, "correlated_lineitem")
    fitted = selection.by_elimination(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2"], "net", "regression", 2)
    return local_rows(df, list(fitted.info["rankings"].items()), "feature string, ranking bigint")


def lasso_coefficients(spark, sf):
    df = view(spark, sf, "correlated_lineitem")
    return _scores(selection.by_l1(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2"], "net", "regression"), "coefficients", df, "coefficient")


def tree_importance(spark, sf):
    df = view(spark, sf, "correlated_lineitem")
    fitted = selection.by_tree_importance(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2"], "net", "regression")
    return _scores(fitted, "importances", df, "importance")


def auto_select(spark, sf):
    df = view(spark, sf, "correlated_lineitem")
    fitted = selection.by_consensus(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2"], "net", "regression", 3)
    return _scores(fitted, "average_ranks", df, "avg_rank")


def f_test_select(spark, sf):
    """The table after keeping the two best of four features against a number."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", NUMBER, *REGRESSORS)
    fitted = selection.by_f_test(df, REGRESSORS, NUMBER, "regression", 2)
    info = fitted.info["scores"]
    rows = [(c, v["f_score"], v["p_value"] < 0.05, c in fitted.columns_out) for c, v in info.items()]
    return local_rows(df, rows, "feature string, f_score double, is_significant boolean, is_selected boolean")


QUERIES = {
    "select_variance_scores": (
        lambda s, d: rounded(selection.variance_scores(table(s, d, "lineitem"), list(LINEITEM_NUMBERS[3:])), 4),
        per_column("lineitem", LINEITEM_NUMBERS[3:], "round(var_samp({c}), 4) AS variance"),
    ),
    "select_variance": (
        lambda s, d: rounded(selection.by_variance(table(s, d, "lineitem"), list(LINEITEM_NUMBERS)).transform(table(s, d, "lineitem"))),
        """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
        CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem""",
    ),
    "select_correlation_pairs": (
        lambda s, d: selection.redundant_pairs(view(s, d, "correlated_lineitem"), list(CORRELATED_COLUMNS)),
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{b}' AS dropped, '{a}' AS because_of, round(corr({a}, {b}), 4) AS r FROM {CORRELATED}"
            for i, a in enumerate(CORRELATED_COLUMNS)
            for b in CORRELATED_COLUMNS[i + 1 :]
        )
        + ") WHERE abs(r) > 0.95",
    ),
    "mutual_info": (
        lambda s, d: rounded(selection.mutual_information(table(s, d, "lineitem"), FEATURES, CLASS, "classification")),
        f"SELECT feature, round(mi, 6) AS mi FROM ({mutual_information_sql(FEATURES)})",
    ),
    "mutual_info_regression": (
        lambda s, d: rounded(selection.mutual_information(table(s, d, "lineitem"), REGRESSORS, NUMBER, "regression")),
        f"SELECT feature, round(mi, 6) AS mi FROM ({mutual_information_regression_sql(REGRESSORS, NUMBER)})",
    ),
    "anova_f": (
        lambda s, d: rounded(selection.anova(table(s, d, "lineitem"), FEATURES, CLASS).select("feature", "f_score"), 4),
        f"SELECT feature, round(f_score, 4) AS f_score FROM ({anova_sql(FEATURES)})",
    ),
    "f_regression": (
        lambda s, d: rounded(selection.f_regression(table(s, d, "lineitem"), REGRESSORS, NUMBER).select("feature", "f_score"), 4),
        f"SELECT feature, round(f_score, 4) AS f_score FROM ({f_regression_sql(REGRESSORS)})",
    ),
    "f_test_select": (
        f_test_select,
        # With this many rows F(1, n - 2) at the 5 % level is chi-squared(1) to four digits.
        f"""SELECT feature, round(f_score, 4) AS f_score, f_score > 3.8416 AS is_significant, row_number() OVER (ORDER BY f_score DESC) <= 2 AS is_selected
        FROM ({f_regression_sql(REGRESSORS)})""",
    ),
    "auto_select_filters": (
        lambda s, d: rounded(
            selection.average_ranks(selection.rank_scores(selection.filter_scores(table(s, d, "lineitem"), FEATURES, CLASS, "classification")))
        ),
        f"{FILTERS_SQL} SELECT feature, round(avg(rank), 6) AS avg_rank FROM r GROUP BY feature",
    ),
    "rfe_ranking": (rfe_ranking, None),
    "lasso_coefficients": (lasso_coefficients, None),
    "tree_importance": (tree_importance, None),
    "auto_select": (auto_select, None),
}
