"""Detectors: each returns the per-column evidence; report() turns it into ranked insight rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import sketches
from tablecraft.functions.columns import number, numeric_cols, string_cols
from tablecraft.functions.statistics import (
    all_pairs,
    column_stats,
    correlations,
    distinct_counts,
    moments,
    quantiles,
    union_all,
    value_counts,
    value_summary,
)
from tablecraft.operators.profiling import local_rows
from tablecraft.settings import SETTINGS

INSIGHT_SCHEMA = (
    "seq int, insight_type string, severity string, title string, description string, "
    "affected_columns array<string>, metrics map<string,double>, recommendation string"
)

# Severities in order, and report sections in order with their titles.
SEVERITIES = ("critical", "warning", "info")
SECTIONS = (
    ("summary", "Dataset Overview"),
    ("outlier", "Outlier Analysis"),
    ("correlation", "Feature Correlations"),
    ("skewness", "Distribution Skewness"),
    ("imbalance", "Class Balance"),
    ("high_cardinality", "Cardinality Check"),
    ("low_variance", "Variance Analysis"),
    ("distribution", "Distribution Profiles"),
)

# Titles of the insights.
TITLES = {
    "summary": "Dataset Overview",
    "outlier": "Outliers Detected in {n} Column(s)",
    "strong": "{n} Strongly Correlated Feature Pair(s)",
    "moderate": "{n} Moderately Correlated Pair(s)",
    "skewness": "{n} Skewed Distribution(s) Detected",
    "imbalance": "Class Imbalance in {n} Column(s)",
    "high_cardinality": "High Cardinality in {n} Column(s)",
    "low_variance": "Near-Zero Variance in {n} Column(s)",
    "distribution": "Distribution Analysis",
}

ADVICE = {
    "outlier": "Check whether the extreme values are errors; otherwise cap them or scale by median and IQR.",
    "strong": "Linear models suffer from collinear inputs: keep one column per pair or extract components.",
    "skewness": "Try a log, square-root or power transform before fitting models.",
    "imbalance": "If such a column is the target, resample or weight its classes.",
    "high_cardinality": "Encode by frequency or target mean, or group the rare values.",
    "low_variance": "These columns carry next to no signal and can be removed.",
}


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.lit(len(numeric_cols(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(string_cols(df))).cast("bigint").alias("n_categorical"),
    )


def fences(df: DataFrame, cols: list[str], quarts=None) -> dict[str, tuple[float, float]]:
    """Outlier bounds per column: the quartiles widened by 1.5 interquartile ranges."""
    quarts = quarts or quantiles(df, cols, [0.25, 0.75])
    k = SETTINGS.outlier_iqr_multiplier
    return {c: (q[0] - k * (q[-1] - q[0]), q[-1] + k * (q[-1] - q[0])) for c, q in quarts.items() if q}


def outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with values strictly outside their fences (columns without spread are skipped)."""
    cols = numeric_cols(df) if cols is None else cols
    quarts = quantiles(df, cols, [0.25, 0.75])
    bounds = fences(df, cols, {c: q for c, q in quarts.items() if q and q[1] != q[0]})
    schema = (
        "column string, position int, lower_bound double, upper_bound double"
    )
    if not bounds:
        return local_rows(
            df, [], schema + ", n_outliers bigint, pct double, min_outlier double, max_outlier double"
        )

    def outside(frame, c):
        x, (lo, hi) = number(frame, c), bounds[c]
        return F.struct(x.alias("x"), F.when((x < F.lit(lo)) | (x > F.lit(hi)), x).alias("out"))

    found = column_stats(
        df,
        list(bounds),
        {
            "n": lambda s: F.count(s["x"]),
            "n_outliers": lambda s: F.count(s["out"]),
            "min_outlier": lambda s: F.min(s["out"]),
            "max_outlier": lambda s: F.max(s["out"]),
        },
        outside,
    )
    edges = local_rows(df, [(c, cols.index(c), lo, hi) for c, (lo, hi) in bounds.items()], schema)
    return (
        found.drop("position")
        .where("n_outliers > 0")
        .join(F.broadcast(edges), "column")
        .select(
            "column",
            "position",
            "n_outliers",
            F.round(F.col("n_outliers") * 100.0 / F.col("n"), 2).alias("pct"),
            *[F.round(c, 2).alias(c) for c in ("lower_bound", "upper_bound", "min_outlier", "max_outlier")],
        )
    )


def correlated_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column pairs with |r| of at least the moderate threshold."""
    cols = numeric_cols(df) if cols is None else cols
    pairs = all_pairs(cols)
    if not pairs:
        return local_rows(df, [], "position int, c1 string, c2 string, r double, strength string")
    size = F.abs("r")
    strength = F.when(size >= SETTINGS.correlation_strong, "strong").when(
        size >= SETTINGS.correlation_moderate, "moderate"
    )
    return (
        correlations(df, pairs)
        .select("position", "c1", "c2", F.round(size, 3).alias("r"), strength.alias("strength"))
        .where("strength IS NOT NULL")
    )


def shape_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, position, n, variance, skew, kurtosis): what the shape detectors share."""
    seen = moments(df, cols)
    rows = [(c, i, seen[c]["n"], seen[c]["variance"], seen[c]["skew"], seen[c]["kurtosis"]) for i, c in enumerate(cols)]
    return local_rows(df, rows, "column string, position int, n bigint, variance double, skew double, kurtosis double")


def skewed_columns(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    cols = numeric_cols(df) if cols is None else cols
    return (
        (shape_stats(df, cols) if stats is None else stats)
        .where(F.abs("skew") > SETTINGS.skew_threshold)
        .select(
            "column",
            "position",
            F.round("skew", 3).alias("skew"),
            F.when(F.col("skew") > 0, "right (positive)").otherwise("left (negative)").alias("direction"),
        )
    )


def imbalanced_columns(df: DataFrame, cols: list[str] | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Text columns in which one value makes up more than the allowed share of the present values."""
    cols = string_cols(df) if cols is None else cols
    return (
        (value_summary(value_counts(df, cols)) if summary is None else summary)
        .where(F.col("mode_n") / F.col("total") > SETTINGS.imbalance_ratio)
        .select(
            "column",
            F.col("mode").alias("dominant_class"),
            F.round(F.col("mode_n") * 100.0 / F.col("total"), 2).alias("dominant_pct"),
            F.col("n_unique").alias("n_classes"),
            F.col("rarest").alias("minority_class"),
            F.round(F.col("rarest_n") * 100.0 / F.col("total"), 2).alias("minority_pct"),
        )
    )


def high_cardinality(df: DataFrame, cols: list[str] | None = None, summary: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Text columns with many distinct values; `approximate` counts them with mergeable states of bounded size."""
    cols = string_cols(df) if cols is None else cols
    if approximate:
        seen = sketches.distinct_estimates(sketches.states(df, values=cols)).withColumnRenamed("estimate", "n_unique")
    else:
        seen = distinct_counts(df, cols) if summary is None else summary.select("column", "n_unique")
    return seen.where(F.col("n_unique") > SETTINGS.high_cardinality)


def low_variance(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    cols = numeric_cols(df) if cols is None else cols
    return (
        (column_stats(df, cols, {"variance": F.var_samp}) if stats is None else stats)
        .where(F.col("variance") < SETTINGS.low_variance)
        .select("column", "position", F.round("variance", 6).alias("variance"))
    )


def distribution_types(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The shape of each numeric column: first matching rule wins."""
    cols = numeric_cols(df) if cols is None else cols
    stats = shape_stats(df, cols) if stats is None else stats
    skew, kurt, d = F.col("skew"), F.col("kurtosis"), F.col("n_unique")
    shape = (
        F.when(d <= 2, "Binary")
        .when((d <= 10) & (F.try_divide(d, F.col("n")) < 0.05), "Discrete")
        .when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1), "Near-Normal")
        .when(skew > SETTINGS.skew_threshold, "Right-Skewed")
        .when(skew < -SETTINGS.skew_threshold, "Left-Skewed")
        .when(kurt > 3, "Heavy-Tailed")
        .otherwise("Mixed")
    )
    return (
        stats.join(F.broadcast(distinct_counts(df, cols)), "column")
        .where("n > 0")
        .select(
            "column",
            "position",
            shape.alias("distribution"),
            F.round("skew", 3).alias("skew"),
            F.round("kurtosis", 3).alias("kurtosis"),
        )
    )


# --- report ------------------------------------------------------------------------------------


def _text(fmt: str, *parts) -> F.Column:
    return F.format_string(fmt, *parts)


def _rollup(found: DataFrame, kind: str, seq: int, severity, order, line, metric, advice: str, title: str, intro: str, top: int | None = None) -> DataFrame:
    """One insight row from per-column findings (at most one row per column, so the list is small)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("column").alias("c"), line.alias("l"), metric.alias("m"))))
    shown = F.col("rows") if top is None else F.slice("rows", 1, top)
    return (
        found.agg(F.count(F.lit(1)).alias("n"), severity.alias("severity"), rows.alias("rows"))
        .where("n > 0")
        .select(
            F.lit(seq).alias("seq"),
            F.lit(kind).alias("insight_type"),
            "severity",
            F.replace(F.lit(title), F.lit("{n}"), F.col("n").cast("string")).alias("title"),
            F.concat(
                F.replace(F.lit(intro), F.lit("{n}"), F.col("n").cast("string")),
                F.array_join(F.transform(shown, lambda r: r["l"]), "; "),
                F.lit("."),
            ).alias("description"),
            F.transform("rows", lambda r: r["c"]).alias("affected_columns"),
            F.map_from_entries(F.transform("rows", lambda r: F.struct(r["c"], r["m"]))).alias("metrics"),
            F.lit(advice).alias("recommendation"),
        )
    )


def held(small: DataFrame) -> DataFrame:
    """The rows of a per-column (or per-pair) result, computed now."""
    return small.sparkSession.createDataFrame(small.toArrow())


def _graded(grade_value, critical=None, warning=None):
    out = F.lit("info")
    if warning is not None:
        out = F.when(grade_value > warning, "warning").otherwise(out)
    if critical is not None:
        out = F.when(grade_value > critical, "critical").otherwise(out)
    return out


def report(df: DataFrame) -> DataFrame:
    """All insights, critical ones first, then warnings, then information."""
    numbers, text = numeric_cols(df), string_cols(df)
    parts = [_summary_row(df)]
    # One row per column, computed once for all detectors that use them.
    stats = shape_stats(df, numbers) if numbers else None
    summary = held(value_summary(value_counts(df, text)).drop("value_bytes")) if text else None
    if numbers:
        parts.append(
            _rollup(
                outliers(df, numbers), "outlier", 1, _graded(F.max("pct"), 10, 5), -F.col("pct"),
                _text("%s has %d (%.2f%%) from %.2f to %.2f", "column", "n_outliers", "pct", "min_outlier", "max_outlier"),
                F.col("pct"), ADVICE["outlier"], TITLES["outlier"], "Values outside the IQR fences in {n} column(s): ", 3,
            )
        )
    if len(numbers) > 1:
        pairs = held(correlated_pairs(df, numbers)).withColumn("column", F.concat_ws(" ~ ", "c1", "c2"))
        line = _text("%s (r=%.3f)", "column", "r")
        for seq, name, level in ((2, "strong", "warning"), (3, "moderate", "info")):
            found = _rollup(
                pairs.where(F.col("strength") == name), "correlation", seq, F.lit(level), -F.col("r"), line, F.col("r"),
                ADVICE.get(name, ""), TITLES[name], f"{{n}} pair(s) of {name} correlation: ", 5,
            )
            parts.append(
                found.withColumn(
                    "affected_columns",
                    F.array_distinct(F.flatten(F.transform("affected_columns", lambda p: F.split(p, " ~ ")))),
                )
            )
    if numbers:
        parts.append(
            _rollup(
                skewed_columns(df, numbers, stats), "skewness", 4, _graded(F.max(F.abs("skew")), None, 2), -F.abs("skew"),
                _text("%s leans %s at %.3f", "column", "direction", "skew"), F.col("skew"), ADVICE["skewness"],
                TITLES["skewness"], "{n} column(s) with |skew| above 1: ", 5,
            )
        )
    if text:
        parts.append(
            _rollup(
                imbalanced_columns(df, text, summary), "imbalance", 5, F.when(F.max("dominant_pct") > 90, "critical").otherwise("warning"),
                F.lit(0.0), _text("%s: '%s' holds %.2f%%, '%s' %.2f%%", "column", "dominant_class", "dominant_pct", "minority_class", "minority_pct"),
                F.col("dominant_pct"), ADVICE["imbalance"], TITLES["imbalance"], "{n} column(s) dominated by one value: ",
            )
        )
        parts.append(
            _rollup(
                high_cardinality(df, text, summary), "high_cardinality", 6, F.lit("warning"), F.lit(0.0),
                _text("%s (%d distinct)", "column", "n_unique"), F.col("n_unique").cast("double"),
                ADVICE["high_cardinality"], TITLES["high_cardinality"], "{n} column(s) with very many values: ",
            )
        )
    if numbers:
        parts.append(
            _rollup(
                low_variance(df, numbers, stats), "low_variance", 7, F.lit("warning"), F.col("position").cast("double"),
                _text("%s (%.6f)", "column", "variance"), F.col("variance"), ADVICE["low_variance"],
                TITLES["low_variance"], "{n} column(s) hardly vary: ",
            )
        )
        parts.append(
            _rollup(
                distribution_types(df, numbers, stats), "distribution", 8, F.lit("info"), F.col("position").cast("double"),
                _text("%s is %s", "column", "distribution"), F.col("skew"), "", TITLES["distribution"],
                "Shapes of {n} column(s): ",
            ).withColumn("affected_columns", F.array().cast("array<string>"))
        )
    rows = union_all(parts).collect()  # at most nine rows
    rank = {s: i for i, s in enumerate(SEVERITIES)}
    rows = sorted(rows, key=lambda r: (rank[r["severity"]], r["seq"]))
    return local_rows(df, [(i, *r[1:]) for i, r in enumerate(rows)], INSIGHT_SCHEMA)


def _summary_row(df: DataFrame) -> DataFrame:
    names = ("n_rows", "n_cols", "n_numeric", "n_categorical")
    entries = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return dataset_summary(df).select(
        F.lit(0).alias("seq"),
        F.lit("summary").alias("insight_type"),
        F.lit("info").alias("severity"),
        F.lit(TITLES["summary"]).alias("title"),
        _text("%,d rows and %d columns: %d numeric, %d categorical.", *names).alias("description"),
        F.array().cast("array<string>").alias("affected_columns"),
        F.create_map(*entries).alias("metrics"),
        F.lit("").alias("recommendation"),
    )


def recommendations(insights: DataFrame) -> DataFrame:
    return insights.where("recommendation <> ''").select(
        "seq", "severity", F.col("title").alias("context"), "recommendation"
    ).orderBy("seq")


def severity_counts(insights: DataFrame) -> DataFrame:
    """All three severities, also those without insights."""
    levels = local_rows(insights, [(s,) for s in SEVERITIES], "severity string")
    return levels.join(insights.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).alias("n")
    )


def executive_summary(insights: DataFrame) -> DataFrame:
    """One sentence on the table and one on what was found."""
    counts = insights.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        F.max(F.when(F.col("insight_type") == "summary", F.col("description"))).alias("overview"),
    )
    return counts.select(
        F.format_string(
            "%s %d critical and %d warning finding(s) among %d insights.",
            F.coalesce("overview", F.lit("The table was examined.")), "critical", "warning", "total",
        ).alias("summary"),
        *SEVERITIES,
        "total",
    )


def findings(insights: DataFrame) -> DataFrame:
    """Insights grouped under their report section, sections in reading order."""
    sections = local_rows(
        insights, [(i, k, t) for i, (k, t) in enumerate(SECTIONS)], "section_seq int, insight_type string, section string"
    )
    return (
        insights.join(F.broadcast(sections), "insight_type")
        .groupBy("section_seq", "section")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("seq", "severity", "title", "description", "affected_columns", "recommendation"))
            ).alias("insights")
        )
        .orderBy("section_seq")
    )
