"""Queries of models learned by epochs, from cross-products and from minimal samples, on the sizes of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import linear_models, partial_fit, preparation, training
from tablecraft.operators.profiling import local_rows
from tablecraft.plans.tables import rounded, table

#: What whole texts measure, the same for Spark and for the reference SQL.
SIZES = {
    "n_chars": ("CAST(n_chars AS DOUBLE)", "CAST(n_chars AS DOUBLE)"),
    "n_words": ("CAST(regexp_count(text, '[^ ]+') AS DOUBLE)", "CAST(len(regexp_extract_all(text, '[^ ]+')) AS DOUBLE)"),
    "n_lines": ("CAST(size(split(text, '\\n')) AS DOUBLE)", "CAST(len(string_split(text, chr(10))) AS DOUBLE)"),
}
SIZES_SQL = f"SELECT doc_id, {', '.join(f'{q} AS {c}' for c, (_, q) in SIZES.items())} FROM documents"
# A planted line, and the share of documents whose label is thrown off it.
SLOPE, HEIGHT, WRONG = 3.0, 7.0, {"ransac": 40, "theil_sen": 20}


def sizes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", *[F.expr(e).alias(c) for c, (e, _) in SIZES.items()])


def epoch_history(spark, sf):
    """Scores and losses of two models after each epoch, learned from what labelled texts measure."""
    df = sizes(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    prepared = preparation.prepare(df, "quality", "binary_classification", exclude=["doc_id"])
    parts = preparation.stratified_split(prepared.transform(df, ["doc_id"]), ["doc_id"], "label").persist()
    runs = [training.train(m, parts, prepared.task, prepared.features, epochs=12) for m in ("SGDClassifier", "Perceptron")]
    parts.unpersist()
    return rounded(runs[0].history_frame().unionByName(runs[1].history_frame()), 6)


def sgd_line(spark, sf):
    """Least squares of the logarithm of words on that of characters beside whether the epochs' result is near it, both on standardised features."""
    df = sizes(spark, sf).select("doc_id", F.log1p("n_chars").alias("n_chars"), F.log1p("n_words").alias("n_words"))
    prepared = preparation.prepare(df, "n_words", "regression", exclude=["doc_id"])
    rows = prepared.transform(df, ["doc_id"])
    model = partial_fit.PartialFit(epochs=40, step=0.1, batch=8).fit(rows)
    g = linear_models.gram(rows)
    slope, height = float(g.xy[0] / g.xx[0, 0]), float(g.mean[1] - g.mean[0] * g.xy[0] / g.xx[0, 0])
    w = model.weights[-1]
    near = abs(w[0, 0] - slope) < 0.05 * abs(slope) and abs(w[1, 0] - height) < 0.05 * abs(height)
    return local_rows(df, [(round(slope, 4), round(height, 4), bool(near))], "slope double, height double, near boolean")


SGD_SQL = f"""WITH s AS (SELECT ln(1 + n_chars) AS n_chars, ln(1 + n_words) AS n_words FROM ({SIZES_SQL})) SELECT round(covar_pop(n_words, n_chars) / stddev_pop(n_chars), 4) AS slope, round(avg(n_words), 4) AS height, true AS near FROM s"""


def lars_last_knot(spark, sf):
    """The end of the path of least angle regression, which is least squares."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["n_chars", "n_lines"], outputCol="features").transform(sizes(spark, sf).withColumnRenamed("n_words", "label"))
    fit = linear_models.LeastAngle().fit(rows.select("doc_id", "features", "label"))
    return local_rows(rows, [(round(float(fit.weights[0]), 6), round(float(fit.weights[1]), 6), round(fit.intercept, 4), len(fit.path))], "n_chars double, n_lines double, intercept double, knots bigint")


LARS_SQL = f"""WITH s AS ({SIZES_SQL}), c AS (SELECT var_pop(n_chars) AS aa, var_pop(n_lines) AS bb, covar_pop(n_chars, n_lines) AS ab, covar_pop(n_chars, n_words) AS ay,
  covar_pop(n_lines, n_words) AS by_, avg(n_chars) AS ma, avg(n_lines) AS mb, avg(n_words) AS my FROM s),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, * FROM c)
SELECT round(wa, 6) AS n_chars, round(wb, 6) AS n_lines, round(my - wa * ma - wb * mb, 4) AS intercept, CAST(3 AS BIGINT) AS knots FROM w"""


def planted(kind: str, model):
    """A line through the sizes of texts, thrown off for a share of them; the fit finds it."""

    def run(spark, sf):
        off = F.pmod(F.xxhash64("doc_id"), F.lit(100)) < WRONG[kind]
        y = F.col("n_chars") * SLOPE + HEIGHT
        df = sizes(spark, sf).select("doc_id", F.array("n_chars").alias("features"), F.when(off, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(100_000)).cast("double") - 200_000).otherwise(y).alias("label"))
        fit = model.fit(df)
        return rounded(local_rows(df, [(float(fit.weights[0]), fit.intercept)], "slope double, height double"), 5)

    return run


PLANTED_SQL = f"SELECT round(regr_slope(n_chars * {SLOPE} + {HEIGHT}, n_chars), 5) AS slope, round(regr_intercept(n_chars * {SLOPE} + {HEIGHT}, n_chars), 5) AS height FROM documents"


def bayesian_prices(spark, sf):
    """Predictions of the words of a text with their deviation."""
    df = sizes(spark, sf)
    prepared = preparation.prepare(df, "n_words", "regression", exclude=["doc_id"])
    rows = prepared.transform(df, ["doc_id"])
    return rounded(linear_models.BayesianRidge().fit(rows).transform(rows).select("doc_id", "label", "prediction", "deviation"), 3)


QUERIES = {
    "epoch_history": (epoch_history, None),
    "sgd_line": (sgd_line, SGD_SQL),
    "lars_last_knot": (lars_last_knot, LARS_SQL),
    "ransac_line": (planted("ransac", linear_models.RANSAC()), PLANTED_SQL),
    "theil_sen_line": (planted("theil_sen", linear_models.TheilSen()), PLANTED_SQL),
    "bayesian_ridge_predictions": (bayesian_prices, None),
}
