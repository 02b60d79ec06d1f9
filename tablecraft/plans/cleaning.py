"""Sources, cleaning and profiling queries."""

from __future__ import annotations

from tablecraft.functions.columns import col
from tablecraft.operators import cleaning, profiling
from tablecraft.plans.tables import rounded, scratch, sql_view, table, view
from tablecraft.sources import files

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
  o_orderpriority FROM orders"""
LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def per_column(source: str, columns, template: str) -> str:
    """One SELECT per column, glued with UNION ALL; {c} stands for the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {template.replace('{c}', c)} FROM {source}" for c in columns)


def _orders_form(df):
    return df.select(
        col("o_orderkey").cast("bigint").alias("o_orderkey"),
        col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        col("o_totalprice").cast("double").alias("o_totalprice"),
        col("o_orderdate").cast("timestamp_ntz").cast("date").cast("string").alias("o_orderdate"),
        "o_orderpriority",
    )


def scan_csv(spark, sf):
    path = scratch(spark)
    files.write_csv(table(spark, sf, "orders"), path)
    return _orders_form(files.load(spark, path, "csv"))


def scan_tsv(spark, sf):
    path = scratch(spark)
    table(spark, sf, "orders").write.option("header", True).option("sep", "\t").csv(path)
    return _orders_form(files.load(spark, path, "tsv"))


def scan_json(spark, sf):
    path = scratch(spark)
    table(spark, sf, "orders").write.json(path)
    return _orders_form(files.load(spark, path, "json"))


def scan_parquet(spark, sf):
    return _orders_form(files.load(spark, f"{sf}/orders.parquet"))


def preview_topn(spark, sf):
    return _orders_form(files.preview(table(spark, sf, "orders"), 100, ["o_orderkey"]))


# --- cleaning ----------------------------------------------------------------------------------

DIRTY = sql_view("dirty_orders")
DIRTY_COLUMNS = ("o_totalprice", "o_orderpriority", "mostly_null", "all_null", "o_orderdate")
DATE_TEXT = "CAST(o_orderdate AS VARCHAR) AS o_orderdate"

STEPS = f"""WITH d AS {DIRTY},
e AS (SELECT o_totalprice, o_orderpriority, mostly_null, o_orderdate FROM d
  WHERE NOT (o_totalprice IS NULL AND o_orderpriority IS NULL AND mostly_null IS NULL AND o_orderdate IS NULL)),
s AS (SELECT o_totalprice, nullif(trim(o_orderpriority), 'nan') AS o_orderpriority, o_orderdate FROM e),
f AS (SELECT coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM s)) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM s WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
    ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority,
  coalesce(year(o_orderdate), 0) AS y, coalesce(month(o_orderdate), 0) AS m, coalesce(day(o_orderdate), 0) AS dd,
  coalesce(isodow(o_orderdate) - 1, 0) AS w, coalesce(hour(o_orderdate), 0) AS h FROM s),
c AS (SELECT DISTINCT * FROM f)"""


def _dirty(spark, sf):
    return view(spark, sf, "dirty_orders")


def _cleaned(spark, sf):
    df = _dirty(spark, sf)
    out, plan = cleaning.clean(df)
    return df, out, plan


def clean_report(spark, sf):
    df, out, plan = _cleaned(spark, sf)
    rep = cleaning.report(plan, out)
    rows = [
        ("empty columns dropped", len(plan.empty)),
        ("empty rows dropped", plan.empty_rows),
        ("date columns expanded", len(plan.dates)),
        ("sparse columns dropped", len(plan.sparse)),
        ("columns filled", len(plan.fills)),
        ("duplicates removed", rep.duplicates_removed),
        ("rows left", rep.rows_after),
        ("missing values left", sum(rep.nulls_after.values())),
    ]
    return profiling.local_rows(df, rows, "step string, amount bigint")


CLEAN_REPORT = f"""{STEPS}
SELECT 'empty columns dropped' AS step, CAST((SELECT CASE WHEN count(all_null) = 0 THEN 1 ELSE 0 END FROM d) AS BIGINT) AS amount
UNION ALL SELECT 'empty rows dropped', (SELECT count(*) FROM d) - (SELECT count(*) FROM e)
UNION ALL SELECT 'date columns expanded', 1
UNION ALL SELECT 'sparse columns dropped', (SELECT CASE WHEN 1 - count(mostly_null) / count(*) > 0.7 THEN 1 ELSE 0 END FROM e)
UNION ALL SELECT 'columns filled', (SELECT CASE WHEN count(o_totalprice) < count(*) THEN 1 ELSE 0 END + CASE WHEN count(o_orderpriority) < count(*) THEN 1 ELSE 0 END FROM s)
UNION ALL SELECT 'duplicates removed', (SELECT count(*) FROM f) - (SELECT count(*) FROM c)
UNION ALL SELECT 'rows left', (SELECT count(*) FROM c)
UNION ALL SELECT 'missing values left', (SELECT count(*) FROM c WHERE o_totalprice IS NULL OR o_orderpriority IS NULL)"""

INT_TARGET = """CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
  WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' END"""
FLOAT_TARGET = "CASE WHEN max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))) <= 5e-4 THEN 'float' END"


def downcast_plan(spark, sf):
    df = table(spark, sf, "lineitem")
    return profiling.local_rows(df, cleaning.downcast_plan(df), "column string, from_type string, to_type string")


def category_flags(spark, sf):
    df = table(spark, sf, "part")
    return profiling.local_rows(df, list(cleaning.category_columns(df).items()), "column string, n_unique bigint")


def datetime_detect(spark, sf):
    df = view(spark, sf, "string_dates")
    return rounded(cleaning.expand_dates(df))


# --- profiling ---------------------------------------------------------------------------------


def _reported(spark, sf):
    df, out, plan = _cleaned(spark, sf)
    return df, out, cleaning.report(plan, out)


def profile_columns(spark, sf):
    return profiling.column_info(table(spark, sf, "orders"))


NULLS_SQL = f"""{STEPS}
SELECT 'o_totalprice' AS "column", (SELECT count(*) - count(o_totalprice) FROM d) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after,
  (SELECT count(*) - count(o_totalprice) FROM d) AS nulls_resolved
""" + "".join(
    f"""UNION ALL SELECT '{c}', (SELECT count(*) - count({c}) FROM d), 0, (SELECT count(*) - count({c}) FROM d)
""" for c in DIRTY_COLUMNS[1:]
)

TOP_SQL = """SELECT "column", CAST(rank AS BIGINT) AS rank, value, n FROM (
  SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({counts})) WHERE rank <= 10"""


def value_counts_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


def histogram_sql(source: str, columns, bins: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(least(CAST(floor(({c} - lo) / (hi - lo) * {bins}.0::DOUBLE) AS BIGINT), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
  FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {source}), (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source})
  GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY 2") for c in columns
    )


def correlation_sql(source: str, columns) -> str:
    from itertools import combinations

    return " UNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, round(corr({a}, {b}), 3) AS r FROM {source}" for a, b in combinations(columns, 2)
    )


NUMERIC_SQL = """count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS q75, round(CAST(max({c}) AS DOUBLE), 3) AS max,
  round(skewness({c}), 3) AS skew, round(kurtosis({c}), 3) AS kurtosis"""

CATEGORICAL_SQL = """SELECT "column", count(*) AS n_unique, arg_min(value, (-n, value)) AS mode, max(n) AS mode_count,
  round(max(n) * 100.0 / sum(n), 2) AS mode_pct FROM ({counts}) GROUP BY "column\""""


QUERIES = {
    "scan_csv": (scan_csv, ORDERS_SQL),
    "scan_tsv": (scan_tsv, ORDERS_SQL),
    "scan_json": (scan_json, ORDERS_SQL),
    "scan_parquet": (scan_parquet, ORDERS_SQL),
    "file_info": (lambda s, d: files.file_info(table(s, d, "orders")), None),
    "preview_topn": (preview_topn, ORDERS_SQL + " ORDER BY orders.o_orderkey LIMIT 100"),
    "null_census": (
        lambda s, d: cleaning.null_census(_dirty(s, d)).select("column", "n_rows", "nulls"),
        per_column(DIRTY, DIRTY_COLUMNS, "count(*) AS n_rows, count(*) - count({c}) AS nulls"),
    ),
    "drop_empty_columns": (
        lambda s, d: rounded(cleaning.drop_empty_columns(_dirty(s, d))),
        f"SELECT o_totalprice, o_orderpriority, mostly_null, {DATE_TEXT} FROM {DIRTY}",
    ),
    "drop_empty_rows": (
        lambda s, d: rounded(cleaning.drop_empty_rows(_dirty(s, d))),
        f"""SELECT o_totalprice, o_orderpriority, mostly_null, all_null, {DATE_TEXT} FROM {DIRTY}
        WHERE NOT (o_totalprice IS NULL AND o_orderpriority IS NULL AND mostly_null IS NULL AND all_null IS NULL AND o_orderdate IS NULL)""",
    ),
    "datetime_expand": (
        lambda s, d: rounded(cleaning.expand_dates(table(s, d, "orders"))),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year,
        CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month, CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day,
        CAST(isodow(o_orderdate) - 1 AS BIGINT) AS o_orderdate_dayofweek, CAST(hour(o_orderdate) AS BIGINT) AS o_orderdate_hour FROM orders""",
    ),
    "datetime_detect": (
        datetime_detect,
        f"""SELECT o_orderkey, o_orderstatus, CAST(coalesce(year(t), 0) AS BIGINT) AS d_year, CAST(coalesce(month(t), 0) AS BIGINT) AS d_month,
        CAST(coalesce(day(t), 0) AS BIGINT) AS d_day, CAST(coalesce(isodow(t) - 1, 0) AS BIGINT) AS d_dayofweek,
        CAST(coalesce(hour(t), 0) AS BIGINT) AS d_hour
        FROM (SELECT o_orderkey, o_orderstatus, TRY_CAST(d AS TIMESTAMP) AS t FROM {sql_view('string_dates')})""",
    ),
    "strip_whitespace": (
        lambda s, d: rounded(cleaning.strip_whitespace(_dirty(s, d))),
        f"SELECT o_totalprice, nullif(trim(o_orderpriority), 'nan') AS o_orderpriority, mostly_null, all_null, {DATE_TEXT} FROM {DIRTY}",
    ),
    "drop_high_null": (
        lambda s, d: rounded(cleaning.drop_high_null(_dirty(s, d))),
        f"SELECT o_totalprice, o_orderpriority, {DATE_TEXT} FROM {DIRTY}",
    ),
    "fill_median": (
        lambda s, d: rounded(cleaning.fill_median(_dirty(s, d).drop("all_null"))),
        f"""WITH d AS {DIRTY} SELECT round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM d)), 6) AS o_totalprice, o_orderpriority,
        round(coalesce(CAST(mostly_null AS DOUBLE), (SELECT quantile_cont(CAST(mostly_null AS DOUBLE), 0.5) FROM d)), 6) AS mostly_null, {DATE_TEXT} FROM d""",
    ),
    "fill_mode": (
        lambda s, d: rounded(cleaning.fill_mode(_dirty(s, d))),
        f"""WITH d AS {DIRTY} SELECT o_totalprice, coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority, mostly_null, all_null, {DATE_TEXT} FROM d""",
    ),
    "drop_duplicates": (
        lambda s, d: cleaning.drop_duplicates(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")),
        "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem",
    ),
    "downcast_plan": (
        downcast_plan,
        f"""SELECT * FROM ({per_column('lineitem', LINEITEM_NUMBERS[:3], "'bigint' AS from_type, " + INT_TARGET + " AS to_type")} UNION ALL
        {per_column('lineitem', LINEITEM_NUMBERS[4:], "'double' AS from_type, " + FLOAT_TARGET + " AS to_type")}) WHERE to_type IS NOT NULL""",
    ),
    "category_flags": (
        category_flags,
        f"SELECT * FROM ({per_column('part', ('p_name', 'p_brand', 'p_type'), 'count(DISTINCT {c}) AS n_unique')}) WHERE n_unique < 20",
    ),
    "clean_all": (
        lambda s, d: rounded(_cleaned(s, d)[1]),
        f"""{STEPS} SELECT round(o_totalprice, 6) AS o_totalprice, o_orderpriority, CAST(y AS BIGINT) AS o_orderdate_year, CAST(m AS BIGINT) AS o_orderdate_month,
        CAST(dd AS BIGINT) AS o_orderdate_day, CAST(w AS BIGINT) AS o_orderdate_dayofweek, CAST(h AS BIGINT) AS o_orderdate_hour FROM c""",
    ),
    "clean_report": (clean_report, CLEAN_REPORT),
    "profile_overview": (
        lambda s, d: profiling.overview(_reported(s, d)[2], table(s, d, "orders")),
        f"""{STEPS}, b AS (SELECT count(*) AS n, 5 * count(*) - count(o_totalprice) - count(o_orderpriority) - count(mostly_null) - count(all_null) - count(o_orderdate) AS nulls FROM d),
        e2 AS (SELECT count(*) AS n FROM e), a AS (SELECT count(*) AS n FROM c)
        SELECT b.n AS rows_before, CAST(5 AS BIGINT) AS cols_before, a.n AS rows_after, CAST(7 AS BIGINT) AS cols_after, b.n - a.n AS rows_removed,
        CAST(-2 AS BIGINT) AS cols_removed, b.nulls AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, b.nulls AS nulls_resolved,
        e2.n - a.n AS duplicates_removed FROM b, e2, a""",
    ),
    "profile_columns": (
        profile_columns,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls_before, count(*) - count({c}) AS nulls_after,
            count(DISTINCT {c}) AS n_unique, CAST(min({c}) AS VARCHAR) AS sample FROM orders"""
            for c, t in zip(ORDER_COLUMNS, ("bigint", "bigint", "string", "double", "timestamp_ntz", "string"))
        ),
    ),
    "profile_numeric": (
        lambda s, d: profiling.numeric_stats(table(s, d, "lineitem")),
        per_column("lineitem", LINEITEM_NUMBERS, NUMERIC_SQL),
    ),
    "profile_categorical": (
        lambda s, d: profiling.categorical_stats(table(s, d, "part")),
        CATEGORICAL_SQL.replace("{counts}", value_counts_sql("part", ("p_name", "p_brand", "p_type"))),
    ),
    "profile_text": (
        lambda s, d: profiling.categorical_stats(table(s, d, "documents")),
        CATEGORICAL_SQL.replace("{counts}", value_counts_sql("documents", ("text", "lang", "source"))),
    ),
    "null_comparison": (lambda s, d: profiling.null_comparison(_reported(s, d)[2], table(s, d, "orders")), NULLS_SQL),
    "column_bytes": (
        lambda s, d: profiling.column_bytes(table(s, d, "documents")),
        per_column("documents", ("doc_id", "n_chars"), "8 * count({c}) AS bytes")
        + " UNION ALL "
        + per_column("documents", ("text", "lang", "source"), "CAST(sum(strlen({c})) AS BIGINT) AS bytes"),
    ),
    "chart_nulls": (
        lambda s, d: profiling.chart_nulls(_reported(s, d)[2], table(s, d, "orders")),
        f"SELECT * FROM ({NULLS_SQL}) WHERE nulls_before > 0",
    ),
    "chart_dtypes": (
        lambda s, d: profiling.dtype_counts(table(s, d, "lineitem")),
        """SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
        ELSE 'timestamp_ntz' END AS dtype, count(*) AS n_columns, count(*) * (SELECT count(*) FROM lineitem) AS n_values FROM (DESCRIBE lineitem) GROUP BY 1""",
    ),
    "chart_histogram": (
        lambda s, d: profiling.histogram(table(s, d, "lineitem")),
        histogram_sql("lineitem", LINEITEM_NUMBERS, 20),
    ),
    "chart_topk": (
        lambda s, d: rounded(profiling.top_values(table(s, d, "part"))),
        TOP_SQL.replace("{counts}", value_counts_sql("part", ("p_name", "p_brand", "p_type"))),
    ),
    "correlation_matrix": (
        lambda s, d: profiling.correlation_matrix(table(s, d, "lineitem")),
        correlation_sql("lineitem", LINEITEM_NUMBERS),
    ),
}
