"""Fitting catalogue models on prepared data, with history, importances, storage and scoring."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import FMClassifier, GBTClassificationModel, GBTClassifier, LinearSVC, OneVsRest, RandomForestClassificationModel
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.operators import catalog, evaluation
from tablecraft.operators.extra_trees import ExtraTreesModel
from tablecraft.operators.neighbors import NearestNeighborsModel
from tablecraft.operators.partial_fit import PartialFitModel
from tablecraft.operators.preparation import Prepared
from tablecraft.operators.profiling import local_rows

HISTORY_SCHEMA = "model string, epoch int, train_score double, val_score double, train_loss double, val_loss double"


@dataclass
class Trained:
    class_name: str
    task: str
    features: list[str]
    model: object
    seconds: float
    predictions: DataFrame  # the test rows with prediction
    history: list[tuple] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        """(model, metric, value) rows on the test rows."""
        if "classification" in self.task:
            rows = evaluation.metric_rows(evaluation.classification_metrics(self.predictions), self.class_name)
            if "probability" in self.predictions.columns:
                loss = evaluation.log_loss(self.predictions, vector_to_array("probability"))
                rows = rows.unionByName(evaluation.metric_rows(loss, self.class_name))
            return rows
        return evaluation.metric_rows(evaluation.regression_metrics(self.predictions), self.class_name)

    def history_frame(self) -> DataFrame:
        return local_rows(self.predictions, [(self.class_name, *h) for h in self.history], HISTORY_SCHEMA)

    def importances(self, top: int = evaluation.TOP_IMPORTANCES) -> DataFrame:
        return evaluation.importances(self.predictions, self.features, feature_weights(self.model, len(self.features)), top)


def feature_weights(model, n: int) -> list[float]:
    """Tree importances, or absolute coefficients averaged over classes; empty for models with neither."""
    inner = getattr(model, "models", None)
    if inner is not None:
        return [float(v) for v in np.mean([feature_weights(m, n) for m in inner], axis=0)]
    if hasattr(model, "featureImportances"):
        return [float(model.featureImportances[i]) for i in range(n)]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(v) for v in abs(model.coefficients.toArray())]
    return []


def _estimator(spec: catalog.Model, n_features: int, n_classes: int, epochs: int | None, overrides: dict):
    params = dict(overrides)
    if epochs is not None and spec.factory in ("GBTClassifier", "GBTRegressor", "MultilayerPerceptronClassifier"):
        params.setdefault("maxIter", epochs)
    if epochs is not None and spec.factory == "PartialFit":
        params.setdefault("epochs", epochs)
    if spec.factory == "MultilayerPerceptronClassifier":
        params.setdefault("layers", [n_features, 100, max(n_classes, 2)])
    estimator = spec.create(**params)
    if isinstance(estimator, (FMClassifier, GBTClassifier, LinearSVC)) and n_classes > 2:
        return OneVsRest(classifier=estimator)
    return estimator


def _score(frame: DataFrame, task: str) -> float:
    if "classification" in task:
        return frame.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("s")).first()["s"] or 0.0
    return evaluation.regression_metrics(frame).first()["r2"]


def _losses(frame: DataFrame, task: str) -> float | None:
    if "classification" in task:
        if "probability" not in frame.columns:
            return None
        return evaluation.log_loss(frame, vector_to_array("probability")).first()["log_loss"]
    return evaluation.regression_metrics(frame).first()["mse"]


def _staged(frame: DataFrame, model, task: str) -> dict[int, tuple[float | None, float | None]]:
    """(score, loss) of a boosted model after each of its trees, all in one pass: a row sums its trees once and meets every prefix."""
    out = frame.select("features", "label")
    for i, tree in enumerate(model.trees):
        tree = tree.copy().setPredictionCol(f"__t{i}")
        out = tree.transform(out)
    steps = F.array(*[F.lit(float(w)) * F.col(f"__t{i}") for i, w in enumerate(model.treeWeights)])
    sums = F.aggregate(steps, F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + x))
    rows = out.select("label", F.posexplode(sums).alias("stage", "m"))
    if "classification" in task:
        margin = (F.col("label") * 2 - 1) * F.col("m") * 2
        # log(1 + exp(-margin)) without overflow
        loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        measures = [F.avg(((F.col("m") > 0).cast("double") == F.col("label")).cast("double")).alias("s"), F.avg(loss).alias("l")]
    else:
        error = F.pow(F.col("label") - F.col("m"), 2)
        measures = [(1 - F.try_divide(F.sum(error), F.var_pop("label") * F.count("label"))).alias("s"), F.avg(error).alias("l")]
    return {r["stage"] + 1: (r["s"], r["l"]) for r in rows.groupBy("stage").agg(*measures).collect()}


def _history(model, train: DataFrame, val: DataFrame, task: str) -> list[tuple]:
    """(epoch, train score, validation score, train loss, validation loss): every tree of a boosted model, prefixes of a forest, and the
    reported iterations of a solver, whose last row carries the scores. Models that keep their rows are scored on validation rows alone."""
    if isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        a, b = _staged(train, model, task), _staged(val, model, task)
        none = (None, None)
        return [(i, a.get(i, none)[0], b.get(i, none)[0], a.get(i, none)[1], b.get(i, none)[1]) for i in range(1, len(model.trees) + 1)]
    if isinstance(model, (RandomForestClassificationModel, RandomForestRegressionModel)):
        return forest_history(model, train, val, task)
    if isinstance(model, (PartialFitModel, ExtraTreesModel)):
        return model.history(train, val)
    val_out = model.transform(val)
    if isinstance(model, NearestNeighborsModel):
        return [(1, None, _score(val_out, task), None, _losses(val_out, task))]
    train_out = model.transform(train)
    final = (_score(train_out, task), _score(val_out, task))
    summary = model.summary if getattr(model, "hasSummary", False) else None
    objective = [float(v) for v in getattr(summary, "objectiveHistory", [])] if summary is not None else []
    rows = [(i + 1, None, None, v, None) for i, v in enumerate(objective)]
    if not rows:
        return [(1, *final, _losses(train_out, task), _losses(val_out, task))]
    last = rows[-1]
    return [*rows[:-1], (last[0], *final, last[3], last[4])]


def train(
    class_name: str, parts: DataFrame, task: str, features: list[str], epochs: int | None = None, history: bool = True, **overrides
) -> Trained:
    """Fits on the train rows of `parts` (features, label, split) and predicts the test rows."""
    spec = catalog.model(class_name)
    fit_rows = parts.where("split = 'train'")
    if spec.class_name == "BernoulliNB":
        binary = Binarizer(threshold=0.0, inputCol="features", outputCol="binary")
        parts = binary.transform(parts).drop("features").withColumnRenamed("binary", "features")
        fit_rows = parts.where("split = 'train'")
    own = not parts.is_cached
    if own:  # several passes follow
        parts = parts.persist()
        fit_rows = parts.where("split = 'train'")
    try:
        classes = 0
        if "classification" in task:
            seen = fit_rows.agg(F.max("label").alias("top"), F.min("label").alias("low")).first()
            if seen["top"] == seen["low"]:
                raise ValueError("the training rows hold a single class")
            classes = int(seen["top"] + 1)
        start = time.perf_counter()
        model = _estimator(spec, len(features), classes, epochs, overrides).fit(fit_rows.drop("split"))
        seconds = time.perf_counter() - start
        rows = _history(model, fit_rows, parts.where("split = 'val'"), task) if history else []
    finally:
        if own:
            parts.unpersist()
    return Trained(class_name, task, features, model, seconds, model.transform(parts.where("split = 'test'")), rows)


def forest_history(model, train_rows: DataFrame, val_rows: DataFrame, task: str, checkpoints: int = 10) -> list[tuple]:
    """Scores of the first 1..n trees of a fitted forest: every prefix is scored in the same pass over the rows."""
    trees = model.trees
    marks = sorted({max(1, round(len(trees) * (i + 1) / checkpoints)) for i in range(checkpoints)})

    def scored(frame: DataFrame) -> dict[int, float]:
        out = frame.select("features", "label")
        for i, tree in enumerate(trees):
            tree = tree.copy().setPredictionCol(f"__t{i}")
            if "classification" in task:
                tree = tree.setProbabilityCol(f"__p{i}").setRawPredictionCol("")
            out = tree.transform(out)
        if "classification" in task:
            votes = F.array(*[vector_to_array(f"__p{i}") for i in range(len(trees))])
            step = lambda last, v: F.when(last.isNull(), v).otherwise(F.zip_with(last, v, lambda x, y: x + y))
            empty = F.array().cast("array<array<double>>")
        else:
            votes = F.array(*[F.col(f"__t{i}") for i in range(len(trees))])
            step = lambda last, v: F.coalesce(last, F.lit(0.0)) + v
            empty = F.array().cast("array<double>")
        sums = F.aggregate(votes, empty, lambda a, v: F.array_append(a, step(F.get(a, F.size(a) - 1), v)))
        rows = out.select("label", F.posexplode(sums).alias("stage", "v")).where((F.col("stage") + 1).isin(marks))
        if "classification" in task:
            score = F.avg((F.array_position("v", F.array_max("v")) - 1 == F.col("label")).cast("double"))
        else:
            error = F.pow(F.col("label") - F.col("v") / (F.col("stage") + 1), 2)
            score = 1 - F.try_divide(F.sum(error), F.var_pop("label") * F.count("label"))
        return {r["stage"] + 1: r["s"] for r in rows.groupBy("stage").agg(score.alias("s")).collect()}

    a, b = scored(train_rows), scored(val_rows)
    return [(m, a.get(m), b.get(m), None, None) for m in marks]


# --- storage -----------------------------------------------------------------------------------


def save(model, path: str) -> None:
    """Stores a fitted Spark ML model; PipelineModel wraps it so that one loader reads all kinds."""
    PipelineModel([model]).write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, prepared: Prepared, model, keep: list[str]) -> DataFrame:
    """Predictions for new rows: the fitted preparation followed by the model."""
    return model.transform(prepared.transform(df, keep)).select(*keep, "prediction")


