"""Models side by side, and what their metrics and learning curves say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Metrics where less is better, and the bands of the diagnostics.
LOWER_IS_BETTER = ("mse", "rmse", "mae", "mape", "log_loss")
MARGINAL_LEAD = 0.01
ACCURACY_BANDS = ((0.95, "excellent"), (0.85, "good"), (0.7, "moderate"))
R2_BANDS = ((0.9, "excellent"), (0.7, "good"), (0.5, "moderate"))
PRECISION_RECALL_GAP, RMSE_TO_MAE = 0.1, 1.5
SIGNIFICANT_GAP, MILD_GAP, UNDERFIT_GAP = 0.15, 0.05, -0.02
LATE_AFTER, LATE_GAP = 10, 0.05


def compare(metrics: DataFrame, models: list[str]) -> DataFrame:
    """metric x model matrix from (model, metric, value) rows."""
    return metrics.groupBy("metric").pivot("model", models).agg(F.max("value")).orderBy("metric")


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """(metric, best_model, best_value): smallest for errors, largest otherwise; ties in name order."""
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), 1.0).otherwise(-1.0)
    best = F.min(F.struct((F.col("value") * sign).alias("key"), "model", "value"))
    return metrics.where("value IS NOT NULL").groupBy("metric").agg(best.alias("b")).select(
        "metric", F.col("b.model").alias("best_model"), F.col("b.value").alias("best_value")
    )


def winner(metrics: DataFrame, task: str, times: DataFrame | None = None) -> DataFrame:
    """The best model by accuracy or r2 (missing counts as 0), its lead, and the fastest model."""
    primary = "accuracy" if "classification" in task else "r2"
    scores = metrics.groupBy("model").agg(
        F.coalesce(F.max(F.when(F.col("metric") == primary, F.col("value"))), F.lit(0.0)).alias("score")
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "model", "score")))
    out = scores.agg(order.alias("o")).select(
        F.col("o")[0]["model"].alias("winner"),
        F.lit(primary).alias("metric"),
        F.col("o")[0]["score"].alias("score"),
        F.get("o", F.lit(1))["model"].alias("runner_up"),
        (F.col("o")[0]["score"] - F.get("o", F.lit(1))["score"]).alias("lead"),
    )
    out = out.withColumn("is_marginal", F.coalesce(F.col("lead") < MARGINAL_LEAD, F.lit(False)))
    if times is None:
        return out
    fastest = times.orderBy("seconds", "model").first()  # one row per trained model
    return out.withColumn("fastest", F.lit(fastest["model"]))


def _band(value, bands):
    out = F.lit("low")
    for floor, name in reversed(bands):
        out = F.when(value > floor, name).otherwise(out)
    return out


def performance(metrics: DataFrame) -> DataFrame:
    """Per model: a verdict on its main score and on the balance of its errors."""
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    names = ("accuracy", "precision", "recall", "r2", "rmse", "mae")
    wide = metrics.groupBy("model").agg(*[value(m).alias(m) for m in names])
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    balance = (
        F.when(p > r + PRECISION_RECALL_GAP, "conservative").when(r > p + PRECISION_RECALL_GAP, "permissive").otherwise("balanced")
    )
    errors = F.when(F.col("rmse") > F.col("mae") * RMSE_TO_MAE, "outlier errors").otherwise("even errors")
    clf = F.col("accuracy").isNotNull()
    return wide.select(
        "model",
        F.when(clf, _band(F.col("accuracy"), ACCURACY_BANDS)).otherwise(_band(F.coalesce("r2", F.lit(0.0)), R2_BANDS)).alias("verdict"),
        F.when(clf, balance).otherwise(errors).alias("balance"),
    )


def overfitting(history: DataFrame) -> DataFrame:
    """Per model, from (model, epoch, train_score, val_score): final gap, verdict, and late divergence.

    A history holds at most one row per epoch, so the aggregates see short groups. Only scored epochs have a gap; with a single one nothing
    can diverge.
    """
    gap = F.col("train_score") - F.col("val_score")
    scored = F.when(gap.isNotNull(), F.struct("epoch", gap.alias("gap")))
    ordered = history.groupBy("model").agg(F.array_sort(F.collect_list(scored)).alias("h"), F.count(F.lit(1)).alias("n"))
    epochs = F.size("h")
    spans = ordered.where(epochs > 0).select(
        "model",
        F.col("n").alias("epochs"),
        F.element_at("h", -1)["gap"].alias("gap"),
        F.get("h", F.floor(epochs / 2).cast("int"))["gap"].alias("mid_gap"),
    )
    verdict = (
        F.when(F.col("gap") > SIGNIFICANT_GAP, "significant overfitting")
        .when(F.col("gap") > MILD_GAP, "mild overfitting")
        .when(F.col("gap") < UNDERFIT_GAP, "possible underfitting")
        .otherwise("good generalization")
    )
    late = (F.col("epochs") > LATE_AFTER) & (F.col("gap") > F.col("mid_gap") + LATE_GAP)
    return spans.select("model", "epochs", F.round("gap", 6).alias("gap"), verdict.alias("verdict"), late.alias("late_divergence"))


