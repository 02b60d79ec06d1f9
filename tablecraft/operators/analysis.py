"""What matters about a table when choosing a model for one of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import col, number, numeric_cols, present, string_cols
from tablecraft.functions.statistics import column_stats
from tablecraft.operators.insights import fences
from tablecraft.operators.preparation import task_type

# Limits of the size classes and flags.
SMALL_BELOW, MEDIUM_BELOW = 1_000, 50_000
WIDE_ABOVE, IMBALANCE_BELOW, OUTLIERS_ABOVE = 50, 0.3, 5.0


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n): the rows of each present target value."""
    return df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def analyze(df: DataFrame, target: str) -> DataFrame:
    """One row of facts; outliers are counted over all numeric cells, columns without spread included."""
    task, classes = task_type(df, target)
    clf = "classification" in task
    features = [c for c in df.columns if c != target]
    numbers = [c for c in numeric_cols(df) if c != target]
    text = [c for c in string_cols(df) if c != target]
    bounds = fences(df, numbers) if numbers else {}

    def cell(frame, c):
        x = number(frame, c) if c in bounds else F.lit(None).cast("double")
        lo, hi = bounds.get(c, (0.0, 0.0))
        return F.struct(present(frame, c).isNull().alias("gap"), ((x < F.lit(lo)) | (x > F.lit(hi))).alias("far"))

    cells = column_stats(
        df,
        features,
        {"n": lambda s: F.count(F.lit(1)), "gaps": lambda s: F.count_if(s["gap"]), "far": lambda s: F.count_if(s["far"])},
        cell,
    )
    facts = cells.agg(F.max("n").alias("n_samples"), F.sum("gaps").alias("gaps"), F.sum("far").alias("far"))
    n = F.col("n_samples")
    outlier_pct = F.coalesce(F.try_divide(F.col("far") * 100.0, n * len(numbers)), F.lit(0.0))
    missing_pct = F.coalesce(F.try_divide(F.col("gaps") * 100.0, n * len(features)), F.lit(0.0))
    size = F.when(n < SMALL_BELOW, "small").when(n < MEDIUM_BELOW, "medium").otherwise("large")
    skewed = False
    if clf:
        share = class_distribution(df, target).agg(
            F.count(F.lit(1)).alias("g"), (F.min("n") / F.max("n")).alias("ratio")
        ).first()
        skewed = share["g"] >= 2 and share["ratio"] < IMBALANCE_BELOW
    return facts.select(
        F.lit(task).alias("task"),
        n.alias("n_samples"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.lit(len(numbers)).cast("bigint").alias("n_numeric"),
        F.lit(len(text)).cast("bigint").alias("n_categorical"),
        F.lit(classes if clf else 0).cast("bigint").alias("n_classes"),
        F.lit(skewed).alias("has_imbalance"),
        F.lit(len(features) > WIDE_ABOVE).alias("has_high_dimensionality"),
        (outlier_pct > OUTLIERS_ABOVE).alias("has_outliers"),
        F.round(outlier_pct, 2).alias("outlier_pct"),
        (missing_pct > 0).alias("has_missing"),
        F.round(missing_pct, 2).alias("missing_pct"),
        size.alias("size_category"),
    )


