"""Feature selection: filters from plain aggregates, wrappers and embedded methods from Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col, filled_number, numeric_cols
from tablecraft.functions.durable import durable
from tablecraft.functions.special import f_survival
from tablecraft.functions.statistics import all_pairs, chunks, column_stats, correlations, scalars, union_all
from tablecraft.operators import lookup
from tablecraft.operators.binned_forest import BinnedForest
from tablecraft.operators.encoding import label_mapping
from tablecraft.operators.fitted import Fitted, keep_selected
from tablecraft.operators.profiling import local_rows
from tablecraft.operators.transforms import bin_index, quantile_edges
from tablecraft.settings import SETTINGS

INFORMATION_BINS = 10
DEPTH = 5


def is_classification(task: str) -> bool:
    return "classification" in task


def _pool(df: DataFrame, columns: list[str]) -> list[str]:
    numbers = set(numeric_cols(df))
    return [c for c in columns if c in numbers]


def _unchanged(operation: str, columns: list[str], why: str) -> Fitted:
    return Fitted(operation, "selection", columns, [], why, lambda frame: frame)


def _selected(operation, columns, pool, selected, info) -> Fitted:
    dropped = [c for c in pool if c not in selected]
    info = {**info, "selected": selected, "dropped": dropped}
    return Fitted(
        operation, "selection", columns, selected, f"Kept {len(selected)} features, dropped {len(dropped)}.",
        lambda frame: keep_selected(frame, pool, selected), info,
    )


# --- filters on the features alone -------------------------------------------------------------


def variance_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_stats(df, _pool(df, columns), {"variance": F.var_samp}, filled_number).select("column", "variance")


def by_variance(df: DataFrame, columns: list[str], threshold: float = SETTINGS.variance_threshold) -> Fitted:
    pool = _pool(df, columns)
    if not pool:
        return _unchanged("Variance Threshold", columns, "There are no columns with numbers.")
    scores = {r["column"]: r["variance"] for r in variance_scores(df, pool).collect()}
    dropped = [c for c in pool if scores[c] is not None and scores[c] < threshold]
    info = {
        "variances": dict(sorted(scores.items(), key=lambda e: (e[1] is None, e[1]))),
        "dropped": dropped,
        "kept": [c for c in pool if c not in dropped],
        "threshold": threshold,
    }
    return Fitted(
        f"Variance Threshold (≥{threshold})", "selection", columns, dropped,
        f"Dropped {len(dropped)} low-variance features.", lambda frame: frame.drop(*dropped), info,
    )


def redundant_pairs(df: DataFrame, columns: list[str], threshold: float = SETTINGS.correlation_drop) -> DataFrame:
    """(dropped, because_of, r): a column goes when any earlier one correlates above the threshold."""
    return (
        correlations(df, all_pairs(_pool(df, columns)), filled_number)
        .where(F.abs("r") > threshold)
        .select(F.col("c2").alias("dropped"), F.col("c1").alias("because_of"), F.round("r", 4).alias("r"))
    )


def by_correlation(df: DataFrame, columns: list[str], threshold: float = SETTINGS.correlation_drop) -> Fitted:
    pool = _pool(df, columns)
    if len(pool) < 2:
        return _unchanged("Correlation Drop", columns, "Needs two numeric columns.")
    reasons: dict[str, dict[str, float]] = {}
    for r in redundant_pairs(df, pool, threshold).collect():
        reasons.setdefault(r["dropped"], {})[r["because_of"]] = r["r"]
    dropped = [c for c in pool if c in reasons]
    info = {"dropped": dropped, "drop_reasons": reasons, "threshold": threshold, "n_features_before": len(pool),
            "n_features_after": len(pool) - len(dropped)}
    return Fitted(
        f"Correlation Filter (>{threshold})", "selection", columns, dropped,
        f"Dropped {len(dropped)} correlated features.", lambda frame: frame.drop(*dropped), info,
    )


# --- filters against the target ----------------------------------------------------------------


def target_class(df: DataFrame, target: str) -> Column:
    """A class as text; a missing number counts as class 0."""
    if isinstance(df.schema[target].dataType, T.StringType):
        return F.coalesce(col(target), F.lit("nan"))
    return filled_number(df, target).cast("bigint").cast("string")


def mutual_information(df: DataFrame, features: list[str], target: str, task: str, bins: int = INFORMATION_BINS) -> DataFrame:
    """(feature, mi) in nats between quantile bins of each feature and the class (or target bin).

    Only (feature, bin, class) counts are shuffled; they are combined on the map side first.
    """
    pool = _pool(df, features)
    clf = is_classification(task)
    edges = quantile_edges(df, pool if clf else [*pool, target], bins, filled_number)

    def binned(c):
        inner = edges[c][1:-1] if edges[c] else []
        return bin_index(filled_number(df, c), inner)

    y = target_class(df, target) if clf else binned(target).cast("string")
    long = df.select(y.alias("__y"), *[binned(c).alias(c) for c in pool]).unpivot(
        ["__y"], [col(c) for c in pool], "feature", "x"
    )
    cells = durable(long.groupBy("feature", "x", "__y").agg(F.count(F.lit(1)).alias("n")))

    def part(keys, sign):
        """Sums of n log n over the counts of some keys; all aggregates combine, so no task holds the cells of a feature."""
        counts = cells.groupBy("feature", *keys).agg(F.sum("n").alias("n"))
        return counts.select("feature", (F.lit(sign) * F.col("n") * F.log("n")).alias("part"), F.when(F.lit(not keys), F.col("n")).alias("n"))

    parts = part(["x", "__y"], 1).unionByName(part(["x"], -1)).unionByName(part(["__y"], -1)).unionByName(part([], 1))
    sums = parts.groupBy("feature").agg(F.sum("part").alias("part"), F.max("n").alias("n"))
    return sums.select("feature", F.greatest(F.lit(0.0), F.col("part") / F.col("n")).alias("mi"))


def anova(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, f_score, d1, d2): between-class over within-class variance.

    Per-class means and variances come from one aggregate; the sums over classes follow from them
    without cancellation.
    """
    pool = _pool(df, features)
    means = scalars(df, pool, {"m": F.avg}, filled_number)
    parts = []
    for chunk in chunks(pool, SETTINGS.columns_per_job):
        x = df.select(target_class(df, target).alias("y"), *[filled_number(df, c).alias(f"x{i}") for i, c in enumerate(chunk)])
        per_class = x.groupBy("y").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(chunk))],
            *[F.coalesce(F.var_pop(f"x{i}"), F.lit(0.0)).alias(f"v{i}") for i in range(len(chunk))],
        )
        n = F.col("n")
        sums = per_class.agg(
            F.count(F.lit(1)).alias("g"),
            F.sum("n").alias("n"),
            *[F.sum(n * F.pow(F.col(f"m{i}") - F.lit(means[c]["m"] or 0.0), 2)).alias(f"b{i}") for i, c in enumerate(chunk)],
            *[F.sum(n * F.col(f"v{i}")).alias(f"w{i}") for i in range(len(chunk))],
        )
        d1, d2 = F.col("g") - 1, F.col("n") - F.col("g")
        structs = [
            F.struct(
                F.lit(c).alias("feature"),
                F.try_divide(F.try_divide(F.col(f"b{i}"), d1), F.try_divide(F.col(f"w{i}"), d2)).alias("f_score"),
                d1.cast("double").alias("d1"),
                d2.cast("double").alias("d2"),
            )
            for i, c in enumerate(chunk)
        ]
        parts.append(sums.select(F.inline(F.array(*structs))))
    return union_all(parts)


def target_correlation(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, r) with the numeric target; NULL for constant features."""
    return correlations(df, [(c, target) for c in _pool(df, features)], filled_number).select(
        F.col("c1").alias("feature"), "r"
    )


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    r2 = F.col("r") * F.col("r")
    return target_correlation(df, features, target).select(
        "feature",
        (F.try_divide(r2, 1 - r2) * F.lit(float(n - 2))).alias("f_score"),
        F.lit(1.0).alias("d1"),
        F.lit(float(n - 2)).alias("d2"),
    )


def _top(scores: dict[str, float | None], pool: list[str], k: int) -> list[str]:
    """Best k features, ties in table order; features without a score come last."""
    order = sorted(pool, key=lambda c: -(scores.get(c) if scores.get(c) is not None else float("-inf")))
    return order[:k]


def by_mutual_information(df: DataFrame, features: list[str], target: str, task: str, k: int = 10) -> Fitted:
    pool = _pool(df, features)
    if not pool or target not in df.columns:
        return _unchanged("Mutual Info", features, "None of the features can be used.")
    scores = {r["feature"]: r["mi"] for r in mutual_information(df, pool, target, task).collect()}
    return _selected(f"Mutual Info Top-{k}", features, pool, _top(scores, pool, k), {"scores": scores, "k": k})


def by_f_test(df: DataFrame, features: list[str], target: str, task: str, k: int = 10) -> Fitted:
    """ANOVA F for classes, F-regression otherwise, with p-values."""
    pool = _pool(df, features)
    if not pool:
        return _unchanged("Statistical Test", features, "None of the features can be used.")
    clf = is_classification(task)
    rows = (anova if clf else f_regression)(df, pool, target).collect()
    scores = {r["feature"]: r["f_score"] for r in rows}
    if all(s is None for s in scores.values()):
        return by_mutual_information(df, features, target, task, k)
    detail = {
        r["feature"]: {
            "f_score": None if r["f_score"] is None else round(r["f_score"], 4),
            "p_value": None if r["f_score"] is None else round(f_survival(r["f_score"], r["d1"], r["d2"]), 6),
        }
        for r in rows
    }
    best = set(_top(scores, pool, min(k, len(pool))))
    name = "ANOVA F-test" if clf else "F-regression"
    return _selected(
        f"{name} Top-{min(k, len(pool))}", features, pool, [c for c in pool if c in best], {"test": name, "scores": detail}
    )


# --- wrappers and embedded methods -------------------------------------------------------------


def learning_columns(df: DataFrame, pool: list[str], target: str, task: str, standardise: bool = False) -> DataFrame:
    """(label, x0, x1, ...) with missing numbers as 0 and text classes as 0-based labels."""
    frame = df
    if is_classification(task) and isinstance(df.schema[target].dataType, T.StringType):
        key = F.coalesce(col(target), F.lit("nan"))
        frame = lookup.apply(df, key, label_mapping(df, target), "__label", F.lit(-1).cast("bigint"))
        y = F.col("__label").cast("double")
    elif is_classification(task):
        y = filled_number(df, target).cast("bigint").cast("double")
    else:
        y = filled_number(df, target)
    xs = {c: filled_number(df, c) for c in pool}
    if standardise:
        s = scalars(df, pool, {"m": F.avg, "s": F.stddev_pop}, filled_number)
        xs = {c: (x - F.lit(s[c]["m"] or 0.0)) / F.lit(s[c]["s"] or 1.0) for c, x in xs.items()}
    return frame.select(y.alias("label"), *[xs[c].alias(f"x{i}") for i, c in enumerate(pool)])


def learning_frame(df: DataFrame, pool: list[str], target: str, task: str, standardise: bool = False) -> DataFrame:
    """(features vector, label) of `learning_columns`."""
    names = [f"x{i}" for i in range(len(pool))]
    flat = learning_columns(df, pool, target, task, standardise)
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("features", "label")


def _forest(task: str, trees: int, depth: int = DEPTH):
    kind = RandomForestClassifier if is_classification(task) else RandomForestRegressor
    return kind(numTrees=trees, maxDepth=depth, seed=SETTINGS.random_state)


def forest_importances(df: DataFrame, pool: list[str], target: str, task: str, trees: int) -> dict[str, float]:
    model = _forest(task, trees).fit(learning_frame(df, pool, target, task))
    return {c: float(model.featureImportances[i]) for i, c in enumerate(pool)}


def by_elimination(
    df: DataFrame, features: list[str], target: str, task: str, n_features: int = 10, step: int = 1, trees: int = 50
) -> Fitted:
    """Refits a forest and drops the least important feature(s) until n_features are left; rank 1 = kept.

    Up to SETTINGS.forest_rows rows the forests are Spark ML's. It holds a count for every row and tree and visits each row for each tree in
    boxed maps, so larger tables are binned once and grow the same kind of forest (bags, bins, drawn features, depth) on the bins."""
    pool = _pool(df, features)
    if not pool:
        return _unchanged("RFE", features, "None of the features can be used.")
    n_features = min(n_features, len(pool))
    left, gone = list(range(len(pool))), []
    large = len(pool) > n_features and df.count() > SETTINGS.forest_rows
    data = (learning_columns if large else learning_frame)(df, pool, target, task)
    data = BinnedForest(data, [f"x{i}" for i in left], is_classification(task)) if large else data.persist()
    try:
        while len(left) > n_features:
            if large:
                weights = data.importances(left, trees, DEPTH, SETTINGS.random_state)
            else:
                sliced = VectorSlicer(inputCol="features", outputCol="kept", indices=left).transform(data)
                weights = _forest(task, trees).setFeaturesCol("kept").fit(sliced).featureImportances
            order = sorted(range(len(left)), key=lambda i: (float(weights[i]), -i))
            worst = [left[i] for i in order[: min(step, len(left) - n_features)]]
            left = [i for i in left if i not in worst]
            gone.append(worst)
    finally:
        if not large:
            data.unpersist()
    ranking = {pool[i]: 1 for i in left}
    ranking |= {pool[i]: 2 + level for level, batch in enumerate(reversed(gone)) for i in batch}
    return _selected(
        f"RFE (n_features={n_features})", features, pool, [pool[i] for i in left],
        {"rankings": {c: ranking[c] for c in pool}, "n_features": n_features},
    )


def l1_coefficients(df: DataFrame, pool: list[str], target: str, task: str, alpha: float, strength: float | None = None, max_iter: int = 1000) -> dict[str, float]:
    """Absolute L1-penalised coefficients on standardised features, averaged over classes.

    alpha is the Lasso penalty for regression; for classes the penalty is strength = 1/C (alpha by default).
    """
    data = learning_frame(df, pool, target, task, standardise=True).persist()
    try:
        if is_classification(task):
            n = data.count()
            c = max(alpha, 1e-6) if strength is None else strength
            model = LogisticRegression(
                elasticNetParam=1.0, regParam=c / n, standardization=False, maxIter=max_iter, tol=1e-8
            ).fit(data)
            weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
        else:
            model = LinearRegression(
                elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=max_iter, tol=1e-8
            ).fit(data)
            weights = abs(model.coefficients.toArray())
    finally:
        data.unpersist()
    return {c: float(w) for c, w in zip(pool, weights)}


def by_l1(df: DataFrame, features: list[str], target: str, task: str, alpha: float = 0.01) -> Fitted:
    pool = _pool(df, features)
    if not pool:
        return _unchanged("Lasso", features, "None of the features can be used.")
    weights = l1_coefficients(df, pool, target, task, alpha)
    selected = [c for c in pool if weights[c] > 1e-6]
    info = {"coefficients": weights, "alpha": alpha, "selected": selected, "dropped": [c for c in pool if c not in selected]}
    name = f"Lasso/L1 Selection (α={alpha})"
    if not selected:
        return Fitted(name, "selection", features, [], "No coefficient is above zero; table unchanged.", lambda f: f, info)
    return _selected(name, features, pool, selected, info)


def by_tree_importance(df: DataFrame, features: list[str], target: str, task: str, threshold: float = 0.01, trees: int = 100) -> Fitted:
    pool = _pool(df, features)
    if not pool:
        return _unchanged("Tree Importance", features, "None of the features can be used.")
    scores = forest_importances(df, pool, target, task, trees)
    order = sorted(pool, key=lambda c: -scores[c])
    selected = [c for c in order if scores[c] >= threshold] or order[:1]
    return _selected(
        f"Tree Importance (≥{threshold})", features, pool, selected, {"importances": {c: scores[c] for c in order}, "threshold": threshold}
    )


# --- consensus ---------------------------------------------------------------------------------

# Names of the ranking methods.
METHODS = ("Mutual Information", "Statistical (ANOVA/F)", "Correlation with Target", "Tree Importance", "Lasso (L1)")


def filter_scores(df: DataFrame, features: list[str], target: str, task: str) -> DataFrame:
    """(method, feature, score) of the three filters; a constant feature scores 0."""
    f_test = anova if is_classification(task) else f_regression
    numeric_target = df
    if isinstance(df.schema[target].dataType, T.StringType) and is_classification(task):
        key = F.coalesce(col(target), F.lit("nan"))
        numeric_target = lookup.apply(df, key, label_mapping(df, target), "__y", F.lit(-1).cast("bigint"))
        numeric_target = numeric_target.drop(target).withColumnRenamed("__y", target)
    parts = [
        mutual_information(df, features, target, task).select("feature", F.col("mi").alias("score")),
        f_test(df, features, target).select("feature", F.col("f_score").alias("score")),
        target_correlation(numeric_target, features, target).select("feature", F.abs("r").alias("score")),
    ]
    return union_all(
        [p.select(F.lit(m).alias("method"), "feature", F.coalesce("score", F.lit(0.0)).alias("score")) for m, p in zip(METHODS, parts)]
    )


def rank_scores(scores: DataFrame) -> DataFrame:
    """Rank per method, best first; equal scores in name order. One row per method and feature."""
    order = Window.partitionBy("method").orderBy(F.desc(F.round("score", 9)), "feature")
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint"))


def average_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("feature").agg(F.avg("rank").alias("avg_rank"))


def consensus_scores(df: DataFrame, features: list[str], target: str, task: str) -> DataFrame:
    """Scores of all five methods; a method that cannot run on this table is left out."""
    pool = _pool(df, features)
    extra = []
    several = "classification" not in task or df.select(col(target)).where(col(target).isNotNull()).distinct().limit(2).count() > 1
    if several:  # a model of one class says nothing about features
        extra += [(METHODS[3], c, s) for c, s in forest_importances(df, pool, target, task, 50).items()]
        extra += [(METHODS[4], c, s) for c, s in l1_coefficients(df, pool, target, task, 0.01, strength=1.0, max_iter=500).items()]
    scores = filter_scores(df, pool, target, task)
    if extra:
        scores = scores.unionByName(local_rows(df, extra, "method string, feature string, score double"))
    return scores


def by_consensus(df: DataFrame, features: list[str], target: str, task: str, top_k: int = 10) -> Fitted:
    """Keeps the features with the best average rank over all methods."""
    pool = _pool(df, features)
    if not pool:
        return _unchanged("Auto Select", features, "There are no features with numbers.")
    top_k = min(top_k, len(pool))
    ranks: dict[str, dict[str, int]] = {}
    for r in rank_scores(consensus_scores(df, pool, target, task)).collect():
        ranks.setdefault(r["method"], {})[r["feature"]] = r["rank"]
    mean = {c: sum(m[c] for m in ranks.values()) / len(ranks) for c in pool}
    order = sorted(pool, key=lambda c: mean[c])
    return _selected(
        f"Auto Feature Selection (Top-{top_k})", features, pool, order[:top_k],
        {"method_rankings": ranks, "average_ranks": {c: mean[c] for c in order}, "top_k": top_k, "n_methods_used": len(ranks)},
    )
