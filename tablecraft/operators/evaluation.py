"""Metrics of predictions: everything derives from counts of (label, prediction) or one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.operators.profiling import histogram, local_rows
from tablecraft.settings import SETTINGS

RESIDUAL_BINS = 40
TOP_IMPORTANCES = 15


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(col(label).alias("actual"), col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", grid_classes: int = SETTINGS.grid_classes) -> DataFrame:
    """(actual, predicted, n, ratio); ratios are shares of the actual class.

    Up to `grid_classes` classes (they are counted first) give the full grid with its zeros, built from the list of classes; beyond that
    only the pairs that occur are listed, which hold the same information.
    """
    counts = confusion_counts(df, label, prediction)
    names = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    if names.limit(grid_classes + 1).count() > grid_classes:
        return counts.withColumn("ratio", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("actual"))))
    classes = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("actual"), "cs").select("actual", F.explode("cs").alias("predicted"))
    full = grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("actual"))
    return full.withColumn("ratio", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", positive=1) -> DataFrame:
    """(accuracy, precision, recall, f1_score, averaging): of the positive class for two true classes, else support-weighted."""
    counts = confusion_counts(df, label, prediction)
    hit = F.col("actual") == F.col("predicted")
    roles = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                         F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp")),
                F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("r")
    ).select("r.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = roles.groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    per_class = per_class.select(
        "*",
        ratio(F.col("tp"), F.col("called")).alias("p"),
        ratio(F.col("tp"), F.col("support")).alias("r"),
        ratio(2.0 * F.col("tp"), F.col("called") + F.col("support")).alias("f"),
    )
    total = F.sum("support")
    is_pos = F.col("c") == F.lit(positive)

    def averaged(m: str) -> Column:
        weighted = F.try_divide(F.sum(F.col("support") * F.col(m)), total)
        chosen = F.coalesce(F.max(F.when(is_pos, F.col(m))), F.lit(0.0))
        return F.when(F.count_if(F.col("support") > 0) == 2, chosen).otherwise(weighted)

    return per_class.agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"),
        averaged("p").alias("precision"),
        averaged("r").alias("recall"),
        averaged("f").alias("f1_score"),
        F.when(F.count_if(F.col("support") > 0) == 2, "binary").otherwise("weighted").alias("averaging"),
    )


def log_loss(df: DataFrame, probabilities: Column, label: str = "label") -> DataFrame:
    """Mean negative log of the (clipped) probability given to the true class; probabilities is an array column."""
    eps = 2.220446049250313e-16
    p = F.element_at(probabilities, F.col(label).cast("int") + 1)
    return df.agg(F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))).alias("log_loss"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(r2, mse, rmse, mae, mape): mape in percent over rows whose label is not 0."""
    y, e = col(label), col(label) - col(prediction)
    mse = F.avg(e * e)
    return df.agg(
        F.coalesce(1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y)), F.lit(0.0)).alias("r2"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(F.try_divide(e, F.when(y != 0, y)))) * 100).alias("mape"),
    )


def metric_rows(metrics: DataFrame, model: str) -> DataFrame:
    """One-row metrics to (model, metric, value) rows."""
    names = [f.name for f in metrics.schema if f.dataType.simpleString() == "double"]
    return metrics.select(*names).unpivot([], names, "metric", "value").where("value IS NOT NULL").select(
        F.lit(model).alias("model"), "metric", "value"
    )


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(col(label).alias("actual"), col(prediction).alias("predicted"), (col(label) - col(prediction)).alias("residual"))


def residual_range(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Common axis of an actual-against-predicted chart."""
    lo = F.least(F.min(col(label)), F.min(col(prediction)))
    return df.agg(lo.alias("axis_min"), F.greatest(F.max(col(label)), F.max(col(prediction))).alias("axis_max"))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = RESIDUAL_BINS) -> DataFrame:
    return histogram(residuals(df, label, prediction), ["residual"], bins).select("bin", "n")


def importances(df: DataFrame, names: list[str], weights: list[float], top: int = TOP_IMPORTANCES) -> DataFrame:
    rows = sorted(zip(names, weights), key=lambda e: (-e[1], e[0]))[:top]
    return local_rows(df, [(i + 1, c, float(w)) for i, (c, w) in enumerate(rows)], "rank int, feature string, importance double")
