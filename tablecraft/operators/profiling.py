"""Profiles of a table before and after cleaning, and the data behind its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col, number, numeric_cols, present, string_cols
from tablecraft.functions.statistics import (
    all_pairs,
    column_stats,
    correlations,
    distinct_counts,
    moments,
    quantiles,
    scalars,
    value_counts,
    value_summary,
)
from tablecraft.operators.cleaning import CleanReport

# How much the chart data shows.
HISTOGRAM_BINS = 20
TOP_VALUES = 10
FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def local_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def overview(rep: CleanReport, df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing values before and after cleaning."""
    plan = rep.plan
    before, after = sum(plan.nulls_before.values()), sum(rep.nulls_after.values())
    n_before, n_after = len(plan.columns), len(rep.columns_after)
    row = (
        plan.n_rows, n_before, rep.rows_after, n_after, plan.n_rows - rep.rows_after, n_before - n_after,
        before, after, before - after, rep.duplicates_removed,
    )
    return local_rows(
        df,
        [row],
        "rows_before bigint, cols_before bigint, rows_after bigint, cols_after bigint, rows_removed bigint, "
        "cols_removed bigint, nulls_before bigint, nulls_after bigint, nulls_resolved bigint, duplicates_removed bigint",
    )


def null_comparison(rep: CleanReport, df: DataFrame) -> DataFrame:
    """Per original column: missing values before, after (0 once dropped) and resolved."""
    rows = [
        (c, n, rep.nulls_after.get(c, 0), n - rep.nulls_after.get(c, 0)) for c, n in rep.plan.nulls_before.items()
    ]
    return local_rows(df, rows, "column string, nulls_before bigint, nulls_after bigint, nulls_resolved bigint")


def chart_nulls(rep: CleanReport, df: DataFrame) -> DataFrame:
    return null_comparison(rep, df).where("nulls_before > 0")


def column_info(df: DataFrame, nulls_before: dict[str, int] | None = None) -> DataFrame:
    """Per column: type, present and missing values, distinct values, and the smallest value as a sample; nested columns have no distinct
    count and no sample."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    scalar = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    base = column_stats(
        df,
        scalar,
        {"non_null": F.count, "nulls_after": lambda x: F.count_if(x.isNull()), "sample": lambda x: F.min(x).cast("string")},
        present,
    )
    nested = [c for c in df.columns if c not in scalar]
    if nested:
        held = df.select(*[col(c).isNotNull().alias(c) for c in nested])
        counts = {"non_null": F.count_if, "nulls_after": lambda x: F.count_if(~x), "sample": lambda x: F.min(F.lit(None).cast("string"))}
        wide = column_stats(held, nested, counts, lambda d, c: col(c))
        base = base.unionByName(wide) if scalar else wide
    meta = local_rows(
        df,
        [(c, kinds[c], (nulls_before or {}).get(c)) for c in df.columns],
        "column string, dtype string, known_nulls_before bigint",
    )
    return (
        base.join(F.broadcast(meta), "column")
        .join(F.broadcast(distinct_counts(df, scalar)), "column", "left")
        .select(
            "column",
            "dtype",
            "non_null",
            F.coalesce("known_nulls_before", "nulls_after").alias("nulls_before"),
            "nulls_after",
            "n_unique",
            F.coalesce("sample", F.lit("N/A")).alias("sample"),
        )
    )


def numeric_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """count, mean, std, min, quartiles, max, skew and kurtosis per numeric column."""
    cols = numeric_cols(df) if cols is None else cols
    seen = moments(df, cols)
    quarts = quantiles(df, cols, [0.25, 0.5, 0.75], extent=seen)
    rows = [
        (c, m["n"], m["mean"], None if m["variance"] is None else m["variance"] ** 0.5, m["lo"], *(quarts[c] or [None] * 3), m["hi"], m["skew"], m["kurtosis"])
        for c, m in seen.items()
    ]
    names = ["mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurtosis"]
    table = local_rows(df, rows, "column string, count bigint, " + ", ".join(f"{n} double" for n in names))
    return table.select("column", "count", *[F.round(n, digits).alias(n) for n in names])


def categorical_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct values, mode and its share of all rows (missing ones included) per text column."""
    cols = string_cols(df) if cols is None else cols
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    found = value_summary(value_counts(df, cols))
    names = local_rows(df, [(c,) for c in cols], "column string")
    rows = total.first()["rows"]
    return names.join(F.broadcast(found), "column", "left").select(
        "column",
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.coalesce("mode", F.lit("N/A")).alias("mode"),
        F.coalesce("mode_n", F.lit(0)).alias("mode_count"),
        F.round(F.coalesce(F.col("mode_n"), F.lit(0)) * 100.0 / F.lit(max(rows, 1)), 2).alias("mode_pct"),
    )


def column_bytes(df: DataFrame) -> DataFrame:
    """Bytes of data per column: text length, or fixed width times present values."""

    def size(frame, c):
        kind = frame.schema[c].dataType.simpleString()
        if kind == "string":
            return F.octet_length(col(c)).cast("bigint")
        if kind == "binary":
            return F.octet_length(col(c)).cast("bigint")
        if isinstance(frame.schema[c].dataType, T.ArrayType):
            inner = frame.schema[c].dataType.elementType.simpleString()
            return F.size(col(c)).cast("bigint") * F.lit(FIXED_WIDTH.get(inner, 8))
        return F.when(present(frame, c).isNotNull(), F.lit(FIXED_WIDTH.get(kind, 8)).cast("bigint"))

    return column_stats(df, df.columns, {"bytes": lambda x: F.coalesce(F.sum(x), F.lit(0))}, size).select("column", "bytes")


def dtype_counts(df: DataFrame) -> DataFrame:
    """(dtype, n_columns, n_values): columns and present values per type."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    held = column_stats(df, df.columns, {"n": F.count_if}, lambda d, c: present(d, c).isNotNull())
    meta = local_rows(df, list(kinds.items()), "column string, dtype string")
    return held.join(F.broadcast(meta), "column").groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_values"))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, n) over equal-width bins between each column's minimum and maximum."""
    cols = numeric_cols(df) if cols is None else cols
    span = scalars(df, cols, {"lo": F.min, "hi": F.max})
    cols = [c for c in cols if span[c]["lo"] is not None]

    def bin_of(c):
        lo, hi, x = span[c]["lo"], span[c]["hi"], number(df, c)
        if hi == lo:
            return F.when(x.isNotNull(), F.lit(0).cast("bigint"))
        spot = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
        return F.least(spot, F.lit(bins - 1)).cast("bigint")

    long = df.select(*[bin_of(c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "bin")
    return long.where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per text column; every task keeps only its own k before the shuffle."""
    cols = string_cols(df) if cols is None else cols
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, cols).withColumn("rank", F.row_number().over(by_count))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "value", "n")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Upper triangle (c1, c2, r) of the Pearson correlation matrix."""
    cols = numeric_cols(df) if cols is None else cols
    return correlations(df, all_pairs(cols)).select("c1", "c2", F.round("r", digits).alias("r"))
