"""Model preparation, training, evaluation and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.statistics import union_all
from tablecraft.operators import analysis, catalog, comparison, evaluation, neighbors, preparation, training
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.cleaning import histogram_sql
from tablecraft.plans.tables import rounded, sql_view, table, view

BINARY, WEIGHTED, REGRESSION, MIXED = (sql_view(v) for v in ("binary_pred", "weighted_pred", "reg_pred", "mixed_text"))


def hash_sql(*keys: str) -> str:
    text = " || '|' || ".join([*[f"CAST({k} AS VARCHAR)" for k in keys], "'42'"])
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


SPACE = 2**48
SPLIT_SQL = "CASE WHEN h < {a} THEN 'test' WHEN h < {b} THEN 'val' ELSE 'train' END".format(a=int(0.2 * SPACE), b=int((0.2 + 0.1) * SPACE))


# --- preparation -------------------------------------------------------------------------------


def task_type(spark, sf):
    mixed = view(spark, sf, "mixed_text").select("o_orderkey", "o_orderstatus", "all_numbers", "some_numbers", "days", "priority")
    labels = table(spark, sf, "labels").select("quality", (col("toxic") == 1).alias("is_toxic"))
    return preparation.task_types(mixed, mixed.columns).unionByName(preparation.task_types(labels, labels.columns))


def _task_sql(source: str, c: str, text: bool) -> str:
    by_count = "CASE WHEN d = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END"
    rule = f"CASE WHEN d > 20 AND s > 0.95 THEN 'regression' ELSE {by_count} END" if text else f"CASE WHEN d <= 20 THEN {by_count} ELSE 'regression' END"
    share = f"avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL THEN 0 ELSE 1 END) FILTER (WHERE {c} IS NOT NULL)" if text else "1"
    return f"SELECT '{c}' AS \"column\", {rule} AS task, d AS n_unique FROM (SELECT count(DISTINCT {c}) AS d, {share} AS s FROM {source})"


TASK_SQL = " UNION ALL ".join(
    [_task_sql(MIXED, c, c != "o_orderkey") for c in ("o_orderkey", "o_orderstatus", "all_numbers", "some_numbers", "days", "priority")]
    + [_task_sql("labels", "quality", False), "SELECT 'is_toxic', CASE WHEN count(*) >= 0 THEN 'binary_classification' END, 2 FROM labels"]
)


def coerce_numeric(spark, sf):
    df = view(spark, sf, "mixed_text")
    return rounded(preparation.fit_coercion(df, df.columns).transform(df), 3)


COERCE_SQL = f"""WITH m AS {MIXED}, n AS (SELECT *, TRY_CAST(some_numbers AS DOUBLE) AS sn FROM m)
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, round(epoch(o_orderdate), 3) AS o_orderdate, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus,
coalesce(TRY_CAST(all_numbers AS DOUBLE), 0) AS all_numbers, coalesce(sn, (SELECT quantile_cont(sn, 0.5) FROM n)) AS some_numbers,
coalesce(epoch(TRY_CAST(days AS TIMESTAMP)), 0) AS days, CAST(dense_rank() OVER (ORDER BY coalesce(priority, '__MISSING__')) - 1 AS DOUBLE) AS priority FROM n"""


def prepare_features(spark, sf):
    df = table(spark, sf, "orders")
    prepared = preparation.prepare(df, "o_totalprice", "regression", exclude=["o_orderkey"])
    return rounded(prepared.flat(df, ["o_orderkey"]), 5)


PREPARED = {
    "o_custkey": "CAST(o_custkey AS DOUBLE)", "o_orderstatus": "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE)",
    "o_orderpriority": "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE)", "o_orderdate_year": "CAST(year(o_orderdate) AS DOUBLE)",
    "o_orderdate_month": "CAST(month(o_orderdate) AS DOUBLE)", "o_orderdate_day": "CAST(day(o_orderdate) AS DOUBLE)",
    "o_orderdate_dow": "CAST(isodow(o_orderdate) - 1 AS DOUBLE)", "o_orderdate_epoch": "epoch(o_orderdate)",
}
PREPARE_SQL = f"""WITH x AS (SELECT o_orderkey, o_totalprice AS label, {', '.join(f'{e} AS {c}' for c, e in PREPARED.items())} FROM orders)
SELECT o_orderkey, round(label, 5) AS label, {', '.join(f'round(({c} - (SELECT avg({c}) FROM x)) / (SELECT stddev_pop({c}) FROM x), 5) AS {c}' for c in PREPARED)} FROM x"""


def split_stratified(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return preparation.stratified_split(df, ["o_orderkey"], "o_orderpriority")


STRATIFIED_SQL = f"""SELECT o_orderkey, o_orderpriority, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'test' WHEN r <= round(n * (0.2::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM (SELECT o_orderkey, o_orderpriority, {hash_sql('o_orderkey')} AS h FROM orders))"""


# --- analysis ----------------------------------------------------------------------------------


def _far(c: str, source: str) -> str:
    return f"""(SELECT count(*) FROM {source}, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {source})) WHERE {c} < lo OR {c} > hi)"""


def analysis_sql(source: str, target: str, numbers, n_text: int, n_features: int) -> str:
    far = " + ".join(_far(c, source) for c in numbers)
    return f"""SELECT CASE WHEN g = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task, n AS n_samples, CAST({n_features} AS BIGINT) AS n_features,
  CAST({len(numbers)} AS BIGINT) AS n_numeric, CAST({n_text} AS BIGINT) AS n_categorical, g AS n_classes, rare / often < 0.3 AS has_imbalance,
  {n_features} > 50 AS has_high_dimensionality, far * 100.0 / (n * {len(numbers)}) > 5 AS has_outliers, round(far * 100.0 / (n * {len(numbers)}), 2) AS outlier_pct,
  false AS has_missing, CAST(0 AS DOUBLE) AS missing_pct, CASE WHEN n < 1000 THEN 'small' WHEN n < 50000 THEN 'medium' ELSE 'large' END AS size_category
  FROM (SELECT count(*) AS g, sum(k)::BIGINT AS n, min(k) AS rare, max(k) AS often FROM (SELECT {target}, count(*) AS k FROM {source} GROUP BY 1)), (SELECT {far} AS far)"""


EVENTS_ANALYSIS = analysis_sql("events", "event_type", ("event_id", "user_id", "value"), 1, 5)
LINEITEM_ANALYSIS = analysis_sql(
    "lineitem", "l_returnflag", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), 1, 10
)


def _text_form(ranked):
    return rounded(
        ranked.select("rank", "class_name", "score", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))
    )


def recommendation_sql(facts: str, kind: str, limit: int | None) -> str:
    rules = ", ".join(f"('{c}', '{m}', {d}, '{k}', '{t}')" for c, names, d, k, t in catalog.RULES for m in names)
    offer = ", ".join(
        f"('{m.class_name}', {catalog.COMPLEXITY.index(m.complexity) * 1000 + i})" for i, m in enumerate(catalog.CATALOG) if m.task_type == kind
    )
    return f"""WITH a AS ({facts}), held AS (SELECT size_category AS c FROM a UNION ALL SELECT 'wide' FROM a WHERE has_high_dimensionality
  UNION ALL SELECT 'imbalanced' FROM a WHERE has_imbalance UNION ALL SELECT 'outliers' FROM a WHERE has_outliers UNION ALL SELECT 'always' FROM a
  UNION ALL SELECT 'mixed' FROM a WHERE n_categorical > 0 AND n_numeric > 0),
  s AS (SELECT m, any_value(o) AS o, greatest(least(50 + coalesce(sum(d), 0), 100), 5)::DOUBLE AS score,
    coalesce(string_agg(t, '; ' ORDER BY t) FILTER (WHERE k = 'reason'), '{catalog.GENERIC_REASON}') AS reasons,
    coalesce(string_agg(t, '; ' ORDER BY t) FILTER (WHERE k = 'warning'), '') AS warnings
    FROM (VALUES {offer}) l(m, o) LEFT JOIN (SELECT rm, d, k, t FROM (VALUES {rules}) r(rc, rm, d, k, t) JOIN held ON rc = c) x ON rm = m GROUP BY m)
  SELECT row_number() OVER (ORDER BY score DESC, o) AS rank, m AS class_name, score, reasons, warnings FROM s {f'QUALIFY rank <= {limit}' if limit else ''}"""


REGRESSION_FACTS = """SELECT count(*) AS n, CASE WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 50000 THEN 'medium' ELSE 'large' END AS size_category,
  false AS has_high_dimensionality, false AS has_imbalance, false AS has_outliers, 3 AS n_categorical, 2 AS n_numeric FROM orders"""


# --- training ----------------------------------------------------------------------------------


def _documents(spark, sf):
    return view(spark, sf, "doc_features")


def _document_parts(spark, sf):
    """Prepared document features with a stratified split."""
    df = _documents(spark, sf)
    prepared = preparation.prepare(df, "quality", "binary_classification", exclude=["doc_id"])
    parts = preparation.stratified_split(prepared.transform(df, ["doc_id"]), ["doc_id"], "label")
    return prepared, parts


def train_predictions(class_name: str, **params):
    def run(spark, sf):
        prepared, parts = _document_parts(spark, sf)
        out = training.train(class_name, parts, prepared.task, prepared.features, history=False, **params)
        return out.predictions.select("doc_id", "label", "prediction")

    return run


def train_linear_predictions(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    prepared = preparation.prepare(df, "l_extendedprice", "regression", exclude=["l_orderkey", "l_linenumber"])
    parts = preparation.hash_split(prepared.transform(df, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])
    out = training.train("LinearRegression", parts, "regression", prepared.features, history=False)
    return rounded(out.predictions.select("l_orderkey", "l_linenumber", "label", "prediction"), 3)


LINEAR_SQL = f"""WITH p AS (SELECT *, {SPLIT_SQL} AS split FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, {hash_sql('l_orderkey', 'l_linenumber')} AS h FROM lineitem)),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE split = 'train')
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(y, 3) AS label, round(a + b * x, 3) AS prediction FROM p, f WHERE split = 'test'"""


def training_history(spark, sf):
    prepared, parts = _document_parts(spark, sf)
    parts = parts.persist()  # shared by both fits
    runs = [training.train(m, parts, prepared.task, prepared.features) for m in ("GradientBoostingClassifier", "LogisticRegression")]
    parts.unpersist()
    return union_all([r.history_frame() for r in runs])


def forest_history(spark, sf):
    prepared, parts = _document_parts(spark, sf)
    out = training.train("RandomForestClassifier", parts, prepared.task, prepared.features, history=False)
    rows = training.forest_history(out.model, parts.where("split = 'train'"), parts.where("split = 'val'"), prepared.task, 5)
    return local_rows(parts, [(m, a, b) for m, a, b, _, _ in rows], "trees int, train_score double, val_score double")


def feature_importance(spark, sf):
    df = table(spark, sf, "lineitem")
    prepared = preparation.prepare(df, "l_extendedprice", "regression", exclude=["l_orderkey"])
    parts = preparation.hash_split(prepared.transform(df, ["l_orderkey"]), ["l_orderkey"])
    return training.train("DecisionTreeRegressor", parts, "regression", prepared.features, history=False).importances()


def trained_log_loss(spark, sf):
    prepared, parts = _document_parts(spark, sf)
    out = training.train("LogisticRegression", parts, prepared.task, prepared.features, history=False)
    return out.metrics().where("metric = 'log_loss'")


# --- comparison --------------------------------------------------------------------------------

# Two simple predictors of the price, by quantity and by part number, and one of the label class.
RIVALS = {"by_quantity": "l_quantity * 2000", "by_part": "l_partkey * 50.0E0"}


def _rivals(spark, sf):
    df = table(spark, sf, "lineitem")
    rows = [
        evaluation.metric_rows(
            evaluation.regression_metrics(df.select(col("l_extendedprice").alias("label"), F.expr(e).alias("prediction"))), name
        )
        for name, e in RIVALS.items()
    ]
    return union_all(rows)


def regression_sql(y: str, p: str, source: str) -> str:
    e = f"({y} - {p})"
    return f"""SELECT 1 - sum({e} * {e}) / (var_pop({y}) * count(*)) AS r2, avg({e} * {e}) AS mse, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae,
  avg(abs({e} / {y})) FILTER (WHERE {y} <> 0) * 100 AS mape FROM {source}"""


METRIC_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS model, * FROM (UNPIVOT ({regression_sql('l_extendedprice', f'({e})', 'lineitem')}) ON r2, mse, rmse, mae, mape INTO NAME metric VALUE value)"
    for name, e in RIVALS.items()
)


def _line_history(spark, sf):
    """Averages of quantity and tax by day of the month as score curves of two models, one of which drifts apart."""
    df = table(spark, sf, "lineitem")
    day = F.dayofmonth("l_shipdate")
    drift = F.when(F.col("l_linestatus") == "O", day / 100.0).otherwise(0.0)
    return df.groupBy(day.alias("epoch"), col("l_linestatus").alias("model")).agg(
        (F.avg("l_quantity") / 50 + F.max(drift)).alias("train_score"), (F.avg("l_tax") * 10).alias("val_score")
    )


def winner(spark, sf):
    rows = _rivals(spark, sf)
    return rounded(comparison.winner(rows, "regression"), 4)


def fit_diagnostics(spark, sf):
    verdicts = comparison.performance(_rivals(spark, sf)).select("model", "verdict", "balance", F.lit(None).cast("boolean").alias("late_divergence"))
    curves = comparison.overfitting(_line_history(spark, sf)).select("model", "verdict", F.lit(None).cast("string").alias("balance"), "late_divergence")
    return verdicts.unionByName(curves)


DIAGNOSTICS_SQL = f"""WITH m AS (PIVOT ({METRIC_ROWS}) ON metric IN ('r2', 'rmse', 'mae') USING max(value) GROUP BY model),
h AS (SELECT l_linestatus AS model, dayofmonth(l_shipdate) AS e, avg(l_quantity) / 50 + max(CASE WHEN l_linestatus = 'O' THEN dayofmonth(l_shipdate) / 100 ELSE 0 END) - avg(l_tax) * 10 AS gap FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY e) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM h),
g AS (SELECT model, max(n) AS n, arg_max(gap, e) AS gap, max(gap) FILTER (pos = n // 2) AS mid FROM i GROUP BY 1)
SELECT model, CASE WHEN r2 > 0.9 THEN 'excellent' WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'moderate' ELSE 'low' END AS verdict,
  CASE WHEN rmse > mae * 1.5 THEN 'outlier errors' ELSE 'even errors' END AS balance, CAST(NULL AS BOOLEAN) AS late_divergence FROM m
UNION ALL SELECT model, CASE WHEN gap > 0.15 THEN 'significant overfitting' WHEN gap > 0.05 THEN 'mild overfitting' WHEN gap < -0.02 THEN 'possible underfitting'
  ELSE 'good generalization' END, NULL, n > 10 AND gap > mid + 0.05 FROM g"""


def metrics_sql(source: str) -> str:
    return f"""WITH p AS (SELECT * FROM {source}), c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
  k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS called,
    (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM c),
  s AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re,
    CASE WHEN called + support = 0 THEN 0 ELSE 2 * tp / (called + support) END AS f FROM k)
  SELECT round(sum(tp) / sum(support), 6) AS accuracy,
    round(CASE WHEN count(*) FILTER (WHERE support > 0) = 2 THEN max(pr) FILTER (WHERE c = 1) ELSE sum(support * pr) / sum(support) END, 6) AS precision,
    round(CASE WHEN count(*) FILTER (WHERE support > 0) = 2 THEN max(re) FILTER (WHERE c = 1) ELSE sum(support * re) / sum(support) END, 6) AS recall,
    round(CASE WHEN count(*) FILTER (WHERE support > 0) = 2 THEN max(f) FILTER (WHERE c = 1) ELSE sum(support * f) / sum(support) END, 6) AS f1_score,
    CASE WHEN count(*) FILTER (WHERE support > 0) = 2 THEN 'binary' ELSE 'weighted' END AS averaging FROM s"""


# --- neighbours --------------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(col("vec_id").alias("id"), col("embedding").cast("array<double>").alias("vector"))


def knn(spark, sf):
    points = _vectors(spark, sf)
    return rounded(neighbors.knn_join(points, points, 5))


def nearest_centroid(spark, sf):
    df = table(spark, sf, "embeddings")
    return neighbors.NearestCentroid("embedding", "label").fit(df).transform(df).select("vec_id", "prediction")


def knn_classify(spark, sf):
    """Predicted class of every vector from its five nearest ones (itself included)."""
    df = table(spark, sf, "embeddings")
    return neighbors.NearestNeighbors(5, True, "embedding", "label").fit(df).transform(df).select("vec_id", "prediction")


KNN_PAIRS = """SELECT a.vec_id AS query, b.vec_id AS point, b.label AS label, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
  FROM embeddings a, embeddings b"""
KNN_SQL = f"""SELECT query, point, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), point) AS rank
FROM ({KNN_PAIRS}) QUALIFY rank <= 5"""

CENTROID_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.label, sum((e.v - c.m) * (e.v - c.m)) AS d FROM e JOIN c ON e.i = c.i GROUP BY 1, 2)
SELECT vec_id, CAST(arg_min(label, (round(d, 10), label)) AS DOUBLE) AS prediction FROM d GROUP BY 1"""


QUERIES = {
    "task_type": (task_type, TASK_SQL),
    "datetime_to_numeric": (
        lambda s, d: rounded(preparation.dates_to_numbers(table(s, d, "events")), 3),
        """SELECT event_id, user_id, event_type, round(value, 3) AS value, props, CAST(year(ts) AS DOUBLE) AS ts_year, CAST(month(ts) AS DOUBLE) AS ts_month,
        CAST(day(ts) AS DOUBLE) AS ts_day, CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dow, round(epoch(ts), 3) AS ts_epoch FROM events""",
    ),
    "coerce_numeric": (coerce_numeric, COERCE_SQL),
    "prepare_features": (prepare_features, PREPARE_SQL),
    "split_hash": (
        lambda s, d: rounded(preparation.hash_split(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])),
        f"SELECT l_orderkey, l_linenumber, {SPLIT_SQL} AS split FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {hash_sql('l_orderkey', 'l_linenumber')} AS h FROM lineitem)",
    ),
    "split_stratified": (split_stratified, STRATIFIED_SQL),
    "ml_analysis": (lambda s, d: analysis.analyze(table(s, d, "events"), "event_type"), EVENTS_ANALYSIS),
    "class_distribution": (
        lambda s, d: analysis.class_distribution(table(s, d, "lineitem"), "l_returnflag"),
        "SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "model_recommendations": (
        lambda s, d: _text_form(catalog.recommend(analysis.analyze(table(s, d, "lineitem"), "l_returnflag"))),
        recommendation_sql(LINEITEM_ANALYSIS, "classifier", 5),
    ),
    "model_catalog": (
        lambda s, d: _text_form(catalog.recommend(analysis.analyze(table(s, d, "orders"), "o_totalprice"), None)),
        recommendation_sql(REGRESSION_FACTS, "regressor", None),
    ),
    "train_linear_predictions": (train_linear_predictions, LINEAR_SQL),
    "train_logreg_predictions": (train_predictions("LogisticRegression"), None),
    "train_rf_predictions": (train_predictions("RandomForestClassifier"), None),
    "train_gbt_predictions": (train_predictions("XGBClassifier"), None),
    "training_history": (training_history, None),
    "forest_history": (forest_history, None),
    "feature_importance": (feature_importance, None),
    "log_loss": (trained_log_loss, None),
    "clf_metrics_binary": (
        lambda s, d: rounded(evaluation.classification_metrics(view(s, d, "binary_pred"), positive=1.0)),
        metrics_sql(BINARY),
    ),
    "clf_metrics_weighted": (
        lambda s, d: rounded(evaluation.classification_metrics(view(s, d, "weighted_pred"), positive=1.0)),
        metrics_sql(WEIGHTED),
    ),
    "reg_metrics": (
        lambda s, d: rounded(evaluation.regression_metrics(view(s, d, "reg_pred")), 3),
        f"SELECT round(r2, 3) AS r2, round(mse, 3) AS mse, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(mape, 3) AS mape FROM ({regression_sql('label', 'prediction', REGRESSION)})",
    ),
    "confusion_matrix": (
        lambda s, d: rounded(evaluation.confusion_matrix(view(s, d, "weighted_pred"))),
        f"""WITH p AS (SELECT * FROM {WEIGHTED}), c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
        g AS (SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM p WHERE label = a.c AND prediction = b.c) AS n FROM c a, c b)
        SELECT actual, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY actual) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY actual) END, 6) AS ratio FROM g""",
    ),
    "residuals": (
        lambda s, d: rounded(evaluation.residuals(view(s, d, "reg_pred"))),
        f"SELECT round(label, 6) AS actual, round(prediction, 6) AS predicted, round(label - prediction, 6) AS residual FROM {REGRESSION}",
    ),
    "residual_range": (
        lambda s, d: rounded(evaluation.residual_range(view(s, d, "reg_pred"))),
        f"SELECT round(least(min(label), min(prediction)), 6) AS axis_min, round(greatest(max(label), max(prediction)), 6) AS axis_max FROM {REGRESSION}",
    ),
    "residual_histogram": (
        lambda s, d: evaluation.residual_histogram(view(s, d, "reg_pred")),
        f"SELECT bin, n FROM ({histogram_sql(f'(SELECT label - prediction AS residual FROM {REGRESSION})', ['residual'], 40)})",
    ),
    "model_comparison": (
        lambda s, d: rounded(comparison.compare(_rivals(s, d), list(RIVALS)), 4),
        f"SELECT metric, round(by_quantity, 4) AS by_quantity, round(by_part, 4) AS by_part FROM (PIVOT ({METRIC_ROWS}) ON model IN ('by_quantity', 'by_part') USING max(value) GROUP BY metric)",
    ),
    "best_per_metric": (
        lambda s, d: rounded(comparison.best_per_metric(_rivals(s, d)), 4),
        f"""SELECT metric, arg_min(model, (CASE WHEN metric = 'r2' THEN -value ELSE value END, model)) AS best_model,
        round(CASE WHEN metric = 'r2' THEN max(value) ELSE min(value) END, 4) AS best_value FROM ({METRIC_ROWS}) GROUP BY metric""",
    ),
    "winner": (
        winner,
        f"""WITH s AS (SELECT model, value, row_number() OVER (ORDER BY value DESC, model) AS r FROM ({METRIC_ROWS}) WHERE metric = 'r2')
        SELECT a.model AS winner, 'r2' AS metric, round(a.value, 4) AS score, b.model AS runner_up, round(a.value - b.value, 4) AS lead, a.value - b.value < 0.01 AS is_marginal
        FROM s a, s b WHERE a.r = 1 AND b.r = 2""",
    ),
    "fit_diagnostics": (fit_diagnostics, DIAGNOSTICS_SQL),
    "nearest_centroid": (nearest_centroid, CENTROID_SQL),
    "knn_join": (knn, KNN_SQL),
    "knn_classify": (
        knn_classify,
        f"""SELECT query AS vec_id, CAST(arg_min(label, (-n, label)) AS DOUBLE) AS prediction FROM (SELECT query, label, count(*) AS n FROM (SELECT query, label,
        row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), point) AS rank FROM ({KNN_PAIRS}) QUALIFY rank <= 5) GROUP BY 1, 2) GROUP BY 1""",
    ),
}
