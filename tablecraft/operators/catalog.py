"""The models on offer, and the rules that rank them for a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.operators.profiling import local_rows
from tablecraft.settings import SETTINGS

COMPLEXITY = ("Low", "Medium", "Medium-High", "High")


@dataclass(frozen=True)
class Model:
    class_name: str
    display_name: str
    family: str
    complexity: str
    task_type: str  # classifier or regressor
    factory: str
    params: dict[str, Any] = field(default_factory=dict)
    note: str = ""

    def create(self, **overrides):
        """A new estimator with the default parameters, changed as asked."""
        params = {**self.params, **overrides}
        if self.factory == "NearestCentroid":
            from tablecraft.operators.neighbors import NearestCentroid

            return NearestCentroid(**params)
        if self.factory == "KNeighbors":
            from tablecraft.operators.neighbors import NearestNeighbors

            return NearestNeighbors(classify=self.task_type == "classifier", **params)
        if self.factory == "PartialFit":
            from tablecraft.operators.partial_fit import PartialFit

            return PartialFit(**params)
        if self.factory == "ExtraTrees":
            from tablecraft.operators.extra_trees import ExtraTrees

            return ExtraTrees(classify=self.task_type == "classifier", **params)
        if self.factory in OWN_LINEAR:
            from tablecraft.operators import linear_models

            return getattr(linear_models, self.factory)(**params)
        module = C if self.task_type == "classifier" else R
        estimator = getattr(module, self.factory)(**params)
        seeded = any(p.name == "seed" for p in estimator.params)
        return estimator.setSeed(SETTINGS.random_state) if seeded and hasattr(estimator, "setSeed") else estimator


OWN_LINEAR = ("BayesianRidge", "ARDRegression", "LeastAngle", "RANSAC", "TheilSen")
_EPOCHS_NOTE = "learned by epochs of mini-batches, with scores after each"
_TREES = {"numTrees": 100}
_BOOST = {"maxIter": 20}
_BINARY_ONLY = "binary inside; several classes are trained one against the rest"
_DRAWN_NOTE = "split thresholds are drawn between a node's smallest and largest value"
_LINEAR_NOTE = "the same linear model; the penalty replaces the original search"

# Class names, display names and complexities of the models.
CATALOG: tuple[Model, ...] = (
    Model("LogisticRegression", "Logistic Regression", "linear", "Low", "classifier", "LogisticRegression", {"maxIter": 100}),
    Model("RidgeClassifier", "Ridge Classifier", "linear", "Medium", "classifier", "LogisticRegression", {"regParam": 0.1}, _LINEAR_NOTE),
    Model("SGDClassifier", "SGD Classifier", "linear", "Low", "classifier", "PartialFit", {"loss": "log"}, _EPOCHS_NOTE),
    Model("Perceptron", "Perceptron", "linear", "Medium", "classifier", "PartialFit", {"loss": "perceptron", "l2": 0.0}, _EPOCHS_NOTE),
    Model("LinearSVC", "Linear SVC", "svm", "Medium", "classifier", "LinearSVC", {"regParam": 0.01}, _BINARY_ONLY),
    Model("DecisionTreeClassifier", "Decision Tree Classifier", "tree", "Low", "classifier", "DecisionTreeClassifier"),
    Model("RandomForestClassifier", "Random Forest Classifier", "forest", "Medium", "classifier", "RandomForestClassifier", _TREES),
    Model("ExtraTreesClassifier", "Extra Trees Classifier", "forest", "Medium", "classifier", "ExtraTrees", _TREES, _DRAWN_NOTE),
    Model("GradientBoostingClassifier", "Gradient Boosting Classifier", "boosting", "Medium-High", "classifier", "GBTClassifier", _BOOST, _BINARY_ONLY),
    Model("HistGradientBoostingClassifier", "Histogram Gradient Boosting Classifier", "boosting", "High", "classifier", "GBTClassifier", {**_BOOST, "maxBins": 256}, _BINARY_ONLY),
    Model("XGBClassifier", "XGBoost Classifier", "boosting", "High", "classifier", "GBTClassifier", {**_BOOST, "maxDepth": 6}, _BINARY_ONLY),
    Model("LGBMClassifier", "LightGBM Classifier", "boosting", "High", "classifier", "GBTClassifier", {**_BOOST, "maxBins": 255}, _BINARY_ONLY),
    Model("GaussianNB", "Gaussian Naive Bayes", "bayes", "Low", "classifier", "NaiveBayes", {"modelType": "gaussian"}),
    Model("BernoulliNB", "Bernoulli Naive Bayes", "bayes", "Low", "classifier", "NaiveBayes", {"modelType": "bernoulli"}),
    Model("NearestCentroid", "Nearest Centroid", "neighbors", "Medium", "classifier", "NearestCentroid"),
    Model("KNeighborsClassifier", "K-Nearest Neighbors Classifier", "neighbors", "Low", "classifier", "KNeighbors", {"k": 5}),
    Model("MLPClassifier", "MLP Classifier (Neural Network)", "neural", "High", "classifier", "MultilayerPerceptronClassifier", {"maxIter": 100}),
    Model("FMClassifier", "Factorization Machine Classifier", "factorization", "High", "classifier", "FMClassifier", {}, _BINARY_ONLY),
    Model("LinearRegression", "Linear Regression", "linear", "Low", "regressor", "LinearRegression"),
    Model("Ridge", "Ridge Regression", "linear", "Low", "regressor", "LinearRegression", {"regParam": 0.1, "elasticNetParam": 0.0}),
    Model("Lasso", "Lasso Regression", "linear", "Low", "regressor", "LinearRegression", {"regParam": 1.0, "elasticNetParam": 1.0}),
    Model("ElasticNet", "Elastic Net", "linear", "Low", "regressor", "LinearRegression", {"regParam": 1.0, "elasticNetParam": 0.5}),
    Model("Lars", "Lars", "linear", "Medium", "regressor", "LeastAngle"),
    Model("LassoLars", "Lasso Lars", "linear", "Medium", "regressor", "LeastAngle", {"lasso": True, "penalty": 1.0}),
    Model("BayesianRidge", "Bayesian Ridge", "linear", "Medium", "regressor", "BayesianRidge"),
    Model("ARDRegression", "ARD Regression", "linear", "Medium", "regressor", "ARDRegression"),
    Model("SGDRegressor", "SGD Regressor", "linear", "Low", "regressor", "PartialFit", {"loss": "squared"}, _EPOCHS_NOTE),
    Model("HuberRegressor", "Huber Regressor", "robust", "Medium", "regressor", "LinearRegression", {"loss": "huber"}),
    Model("RANSACRegressor", "RANSAC Regressor", "robust", "Medium", "regressor", "RANSAC"),
    Model("TheilSenRegressor", "Theil Sen Regressor", "robust", "Medium", "regressor", "TheilSen"),
    Model("TweedieRegressor", "Tweedie Regressor", "glm", "Medium", "regressor", "GeneralizedLinearRegression", {"family": "gaussian"}),
    Model("PoissonRegressor", "Poisson Regressor", "glm", "Medium", "regressor", "GeneralizedLinearRegression", {"family": "poisson", "link": "log"}, "labels from zero"),
    Model("GammaRegressor", "Gamma Regressor", "glm", "Medium", "regressor", "GeneralizedLinearRegression", {"family": "gamma", "link": "log"}, "positive labels"),
    Model("FMRegressor", "Factorization Machine Regressor", "factorization", "High", "regressor", "FMRegressor", {}, "pairs of features through latent factors"),
    Model("DecisionTreeRegressor", "Decision Tree Regressor", "tree", "Low", "regressor", "DecisionTreeRegressor"),
    Model("RandomForestRegressor", "Random Forest Regressor", "forest", "Medium", "regressor", "RandomForestRegressor", _TREES),
    Model("ExtraTreesRegressor", "Extra Trees Regressor", "forest", "Medium", "regressor", "ExtraTrees", _TREES, _DRAWN_NOTE),
    Model("GradientBoostingRegressor", "Gradient Boosting Regressor", "boosting", "Medium-High", "regressor", "GBTRegressor", _BOOST),
    Model("HistGradientBoostingRegressor", "Histogram Gradient Boosting Regressor", "boosting", "High", "regressor", "GBTRegressor", {**_BOOST, "maxBins": 256}),
    Model("XGBRegressor", "XGBoost Regressor", "boosting", "High", "regressor", "GBTRegressor", {**_BOOST, "maxDepth": 6}),
    Model("LGBMRegressor", "LightGBM Regressor", "boosting", "High", "regressor", "GBTRegressor", {**_BOOST, "maxBins": 255}),
    Model("KNeighborsRegressor", "K-Nearest Neighbors Regressor", "neighbors", "Low", "regressor", "KNeighbors", {"k": 5}),
)


def models_for(task: str) -> list[Model]:
    """The catalogue for a task, simple models first."""
    kind = "classifier" if "classification" in task else "regressor"
    return sorted((m for m in CATALOG if m.task_type == kind), key=lambda m: COMPLEXITY.index(m.complexity))


def model(class_name: str) -> Model:
    for m in CATALOG:
        if m.class_name == class_name:
            return m
    raise ValueError(f"unknown model '{class_name}'")


def catalog_frame(df: DataFrame, task: str | None = None) -> DataFrame:
    """The catalogue, for a task if one is given: what each model is, what stands behind it and how well it fits."""
    offered = CATALOG if task is None else models_for(task)
    rows = []
    for m in offered:
        source = "tablecraft" if m.factory in ("KNeighbors", "NearestCentroid", "PartialFit", "ExtraTrees", *OWN_LINEAR) else "pyspark.ml"
        about = f"{m.display_name}: {m.family} model for {'classes' if m.task_type == 'classifier' else 'numbers'}, {m.complexity.lower()} complexity"
        rows.append((m.class_name, m.display_name, m.family, m.complexity, m.task_type, source, m.factory, about, m.note))
    return local_rows(
        df, rows,
        "class_name string, display_name string, family string, complexity string, task_type string, source string, spark_class string, description string, note string",
    )


# --- recommendation rules ----------------------------------------------------------------------

def _both(*stems: str) -> tuple[str, ...]:
    return tuple(s + end for s in stems for end in ("Classifier", "Regressor"))


BASE_SCORE, LOWEST, HIGHEST = 50, 5, 100
GENERIC_REASON = "A standard model for this task"

# Fixed values: (condition, models, score change, reason or warning, text).
RULES: tuple[tuple[str, tuple[str, ...], int, str, str], ...] = (
    ("small", ("LogisticRegression", "Ridge", "Lasso", "LinearRegression", "GaussianNB", "BernoulliNB", *_both("KNeighbors", "DecisionTree")),
     10, "reason", "Simple enough for few rows"),
    ("small", _both("XGB", "LGBM"), -5, "warning", "Boosting may overfit few rows"),
    ("medium", _both("RandomForest", "GradientBoosting", "XGB"), 10, "reason", "A good match for the number of rows"),
    ("large", _both("SGD", "HistGradientBoosting", "LGBM", "XGB"), 15, "reason", "Scales to many rows"),
    ("large", _both("KNeighbors"), -15, "warning", "Slow on many rows"),
    ("wide", ("Lasso", "ElasticNet", *_both("SGD", "RandomForest")), 8, "reason", "Copes with many columns"),
    ("wide", _both("KNeighbors"), -10, "warning", "Distances lose meaning over many columns"),
    ("imbalanced", tuple(s + "Classifier" for s in ("RandomForest", "GradientBoosting", "XGB", "LGBM", "ExtraTrees", "HistGradientBoosting")),
     8, "reason", "Ensembles cope better with rare classes"),
    ("imbalanced", ("LogisticRegression", "GaussianNB"), -5, "warning", "Rare classes may need resampling"),
    ("outliers", _both("RandomForest", "GradientBoosting", "XGB", "DecisionTree", "ExtraTrees"), 5, "reason", "Trees ignore how far outliers lie"),
    ("outliers", ("LinearRegression", "Ridge", "Lasso", "LogisticRegression"), -5, "warning", "Outliers pull linear models"),
    ("always", _both("RandomForest", "GradientBoosting", "XGB", "LGBM", "ExtraTrees", "HistGradientBoosting"), 5, "reason", "Ensembles do well without tuning"),
    ("always", ("LogisticRegression", "LinearRegression", "Ridge", "Lasso", *_both("DecisionTree")), 3, "reason", "Easy to interpret"),
    ("mixed", _both("RandomForest", "GradientBoosting", "XGB", "LGBM", "HistGradientBoosting"), 5, "reason", "Takes numbers and categories alike"),
)


def rules_frame(df: DataFrame) -> DataFrame:
    rows = [(cond, m, delta, kind, text) for cond, names, delta, kind, text in RULES for m in names]
    return local_rows(df, rows, "condition string, class_name string, delta int, kind string, text string")


def recommend(analysis: DataFrame, top_n: int | None = 5) -> DataFrame:
    """Models ranked for one analysed table: 50 points, changed by every rule that applies, kept in 5..100."""
    holds = {
        "small": F.col("size_category") == "small",
        "medium": F.col("size_category") == "medium",
        "large": F.col("size_category") == "large",
        "wide": F.col("has_high_dimensionality"),
        "imbalanced": F.col("has_imbalance"),
        "outliers": F.col("has_outliers"),
        "always": F.lit(True),
        "mixed": (F.col("n_categorical") > 0) & (F.col("n_numeric") > 0),
    }
    facts = analysis.select(
        F.when(F.col("task").contains("classification"), "classifier").otherwise("regressor").alias("task_type"),
        F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in holds.items()]))).alias("condition"),
    )
    fired = facts.join(F.broadcast(rules_frame(analysis)), "condition")
    rows = [
        (m.class_name, m.display_name, m.task_type, COMPLEXITY.index(m.complexity) * 1000 + i) for i, m in enumerate(CATALOG)
    ]
    offer = local_rows(analysis, rows, "class_name string, display_name string, task_type string, listing int")
    offer = offer.join(F.broadcast(facts.select("task_type").distinct()), "task_type")
    texts = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("text"))))
    scored = (
        offer.join(fired.drop("task_type"), "class_name", "left")
        .groupBy("class_name", "display_name", "listing")
        .agg(F.sum(F.coalesce("delta", F.lit(0))).alias("delta"), texts("reason").alias("reasons"), texts("warning").alias("warnings"))
    )
    score = F.greatest(F.least(F.lit(BASE_SCORE) + F.col("delta"), F.lit(HIGHEST)), F.lit(LOWEST))
    order = Window.orderBy(F.desc("score"), "listing")  # one row per catalogue entry
    ranked = scored.select(
        "class_name", "display_name", "listing", score.cast("double").alias("score"),
        F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(GENERIC_REASON))).alias("reasons"), "warnings",
    ).withColumn("rank", F.row_number().over(order))
    ranked = ranked.select("rank", "class_name", "display_name", "score", "reasons", "warnings")
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked
