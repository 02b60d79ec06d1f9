"""Insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import insights
from tablecraft.plans.cleaning import LINEITEM_NUMBERS, per_column, value_counts_sql
from tablecraft.plans.tables import rounded, sql_view, table, view

EVENTS = sql_view("flagged_events")
EVENT_NUMBERS, EVENT_TEXT = ("event_id", "user_id", "value", "value_sq"), ("event_type", "props", "flag")
CORRELATED = sql_view("correlated_lineitem")
CORRELATED_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "q2")


def outlier_sql(source: str, columns) -> str:
    """Bounds, counts and extremes per column; columns without spread or outliers are absent."""
    parts = [
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE x < lo OR x > hi) AS n_outliers,
  round(count(*) FILTER (WHERE x < lo OR x > hi) * 100.0 / count(*), 2) AS pct, round(any_value(lo), 2) AS lower_bound,
  round(any_value(hi), 2) AS upper_bound, round(min(x) FILTER (WHERE x < lo OR x > hi), 2) AS min_outlier,
  round(max(x) FILTER (WHERE x < lo OR x > hi), 2) AS max_outlier
  FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL),
  (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, a, b FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a,
   quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {source})) WHERE a <> b"""
        for c in columns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_outliers > 0"


def pairs_sql(source: str, columns) -> str:
    from itertools import combinations

    each = " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, abs(corr({a}, {b})) AS v FROM {source}" for a, b in combinations(columns, 2))
    return f"SELECT c1, c2, round(v, 3) AS r, CASE WHEN v >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM ({each}) WHERE v >= 0.4"


def skew_sql(source: str, columns) -> str:
    each = per_column(source, columns, "skewness({c}) AS v")
    return f"""SELECT "column", round(v, 3) AS skew, CASE WHEN v > 0 THEN 'right (positive)' ELSE 'left (negative)' END AS direction
  FROM ({each}) WHERE abs(v) > 1"""


def imbalance_sql(source: str, columns) -> str:
    return f"""SELECT "column", arg_min(value, (-n, value)) AS dominant_class, round(max(n) * 100.0 / sum(n), 2) AS dominant_pct, count(*) AS n_classes,
  arg_max(value, (-n, value)) AS minority_class, round(min(n) * 100.0 / sum(n), 2) AS minority_pct
  FROM ({value_counts_sql(source, columns)}) GROUP BY "column" HAVING max(n) / sum(n) > 0.6"""


def cardinality_sql(source: str, columns) -> str:
    return f"SELECT * FROM ({per_column(source, columns, 'count(DISTINCT {c}) AS n_unique')}) WHERE n_unique > 50"


def variance_sql(source: str, columns) -> str:
    return f"SELECT \"column\", round(v, 6) AS variance FROM ({per_column(source, columns, 'var_samp({c}) AS v')}) WHERE v < 0.01"


def distribution_sql(source: str, columns) -> str:
    each = per_column(source, columns, "count({c}) AS n, count(DISTINCT {c}) AS d, skewness({c}) AS s, kurtosis({c}) AS k")
    return f"""SELECT "column", CASE WHEN d <= 2 THEN 'Binary' WHEN d <= 10 AND d / n < 0.05 THEN 'Discrete' WHEN abs(s) < 0.5 AND abs(k) < 1 THEN 'Near-Normal'
  WHEN s > 1 THEN 'Right-Skewed' WHEN s < -1 THEN 'Left-Skewed' WHEN k > 3 THEN 'Heavy-Tailed' ELSE 'Mixed' END AS distribution,
  round(s, 3) AS skew, round(k, 3) AS kurtosis FROM ({each})"""


# All insights of the events view: evidence counts decide which rows appear and how severe they are.
REPORT = f"""WITH o AS ({outlier_sql(EVENTS, EVENT_NUMBERS)}), p AS ({pairs_sql(EVENTS, EVENT_NUMBERS)}), s AS ({skew_sql(EVENTS, EVENT_NUMBERS)}),
i AS ({imbalance_sql(EVENTS, EVENT_TEXT)}), h AS ({cardinality_sql(EVENTS, EVENT_TEXT)}), v AS ({variance_sql(EVENTS, EVENT_NUMBERS)}),
raw AS (
  SELECT 0 AS k, 'summary' AS insight_type, 'info' AS severity, 'Dataset Overview' AS title, 1 AS n, '' AS recommendation
  UNION ALL SELECT 1, 'outlier', CASE WHEN max(pct) > 10 THEN 'critical' WHEN max(pct) > 5 THEN 'warning' ELSE 'info' END,
    'Outliers Detected in ' || count(*) || ' Column(s)', count(*), '{insights.ADVICE["outlier"]}' FROM o
  UNION ALL SELECT 2, 'correlation', 'warning', count(*) || ' Strongly Correlated Feature Pair(s)', count(*), '{insights.ADVICE["strong"]}' FROM p WHERE strength = 'strong'
  UNION ALL SELECT 3, 'correlation', 'info', count(*) || ' Moderately Correlated Pair(s)', count(*), '' FROM p WHERE strength = 'moderate'
  UNION ALL SELECT 4, 'skewness', CASE WHEN max(abs(skew)) > 2 THEN 'warning' ELSE 'info' END, count(*) || ' Skewed Distribution(s) Detected', count(*),
    '{insights.ADVICE["skewness"]}' FROM s
  UNION ALL SELECT 5, 'imbalance', CASE WHEN max(dominant_pct) > 90 THEN 'critical' ELSE 'warning' END, 'Class Imbalance in ' || count(*) || ' Column(s)', count(*),
    '{insights.ADVICE["imbalance"]}' FROM i
  UNION ALL SELECT 6, 'high_cardinality', 'warning', 'High Cardinality in ' || count(*) || ' Column(s)', count(*), '{insights.ADVICE["high_cardinality"]}' FROM h
  UNION ALL SELECT 7, 'low_variance', 'warning', 'Near-Zero Variance in ' || count(*) || ' Column(s)', count(*), '{insights.ADVICE["low_variance"]}' FROM v
  UNION ALL SELECT 8, 'distribution', 'info', 'Distribution Analysis', 1, ''),
r AS (SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, k) - 1 AS BIGINT) AS seq,
  insight_type, severity, title, recommendation FROM raw WHERE n > 0)"""

SECTION_ORDER = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(insights.SECTIONS))


def _events(spark, sf):
    return view(spark, sf, "flagged_events")


def insight_findings(spark, sf):
    found = insights.findings(insights.report(_events(spark, sf)))
    return rounded(found.select("section_seq", "section", F.explode("insights").alias("i")).select("section_seq", "section", "i.seq", "i.severity", "i.title"))


QUERIES = {
    "insight_summary": (
        lambda s, d: insights.dataset_summary(table(s, d, "lineitem")),
        "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols, CAST(8 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical FROM lineitem",
    ),
    "insight_outliers": (
        lambda s, d: insights.outliers(_events(s, d)).drop("position"),
        outlier_sql(EVENTS, EVENT_NUMBERS),
    ),
    "insight_correlations": (
        lambda s, d: insights.correlated_pairs(view(s, d, "correlated_lineitem")).drop("position"),
        pairs_sql(CORRELATED, CORRELATED_COLUMNS),
    ),
    "insight_skewness": (
        lambda s, d: insights.skewed_columns(_events(s, d)).drop("position"),
        skew_sql(EVENTS, EVENT_NUMBERS),
    ),
    "insight_imbalance": (
        lambda s, d: insights.imbalanced_columns(view(s, d, "text_labels")),
        imbalance_sql(sql_view("text_labels"), ("toxic", "quality")),
    ),
    "insight_cardinality": (
        lambda s, d: insights.high_cardinality(_events(s, d)),
        cardinality_sql(EVENTS, EVENT_TEXT),
    ),
    "insight_text_cardinality": (
        lambda s, d: insights.high_cardinality(table(s, d, "documents")),
        cardinality_sql("documents", ("text", "lang", "source")),
    ),
    "insight_low_variance": (
        lambda s, d: insights.low_variance(table(s, d, "lineitem")).drop("position"),
        variance_sql("lineitem", LINEITEM_NUMBERS),
    ),
    "insight_distribution": (
        lambda s, d: insights.distribution_types(table(s, d, "lineitem")).drop("position"),
        distribution_sql("lineitem", LINEITEM_NUMBERS),
    ),
    "insight_report": (
        lambda s, d: rounded(insights.report(_events(s, d)).select("seq", "insight_type", "severity", "title")),
        f"{REPORT} SELECT seq, insight_type, severity, title FROM r",
    ),
    "insight_recommendations": (
        lambda s, d: rounded(insights.recommendations(insights.report(_events(s, d)))),
        f"{REPORT} SELECT seq, severity, title AS context, recommendation FROM r WHERE recommendation <> ''",
    ),
    "insight_severity_counts": (
        lambda s, d: insights.severity_counts(insights.report(_events(s, d))),
        f"{REPORT} SELECT l.severity, count(r.seq) AS n FROM (VALUES ('critical'), ('warning'), ('info')) l(severity) LEFT JOIN r ON r.severity = l.severity GROUP BY 1",
    ),
    "insight_executive_summary": (
        lambda s, d: insights.executive_summary(insights.report(_events(s, d))),
        f"""{REPORT}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
        count(*) FILTER (WHERE severity = 'info') AS info FROM r), e AS (SELECT count(*) AS n FROM events)
        SELECT format('{{:,}} rows and 7 columns: 4 numeric, 3 categorical. {{}} critical and {{}} warning finding(s) among {{}} insights.', e.n, critical, warning, total) AS summary,
        critical, warning, info, total FROM t, e""",
    ),
    "insight_findings": (
        insight_findings,
        f"""{REPORT} SELECT CAST(x.i AS BIGINT) AS section_seq, x.section, r.seq, r.severity, r.title FROM r
        JOIN (VALUES {SECTION_ORDER}) x(i, insight_type, section) ON x.insight_type = r.insight_type""",
    ),
}
