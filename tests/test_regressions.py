"""Models by epochs, from cross-products and from minimal samples, against closed forms and numpy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import linear_models as L
from tablecraft.operators import partial_fit as P
from tablecraft.operators import training


def frame(spark, x, y, parts=4):
    rows = [(i, [float(v) for v in r], None if t is None else float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(parts)


def normal(seed, n, p):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, p)), rng


# --- epochs ------------------------------------------------------------------------------------


def test_results_do_not_depend_on_the_partitioning(spark):
    x, rng = normal(1, 900, 3)
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 900)
    models = [P.PartialFit(epochs=4).fit(frame(spark, x, y, parts)) for parts in (1, 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        models.append(P.PartialFit(epochs=4).fit(frame(spark, x, y, 3)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.array_equal(models[0].weights, m.weights) for m in models)


def test_coefficients_are_near_the_closed_form(spark):
    x, rng = normal(2, 4000, 4)
    y = x @ [4.0, -2.0, 0.0, 1.0] + 10 + rng.normal(0, 0.5, 4000)
    model = P.PartialFit(epochs=15).fit(frame(spark, x, y))
    exact = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert np.abs(model.weights[-1][:, 0] - exact).max() < 0.05
    losses = [model.scores(frame(spark, x, y))[e][1] for e in (1, 15)]
    assert losses[1] < losses[0] and losses[1] == pytest.approx(((y - np.c_[x, np.ones(len(x))] @ exact) ** 2).mean(), rel=0.01)


def test_history_is_measured_on_both_parts(spark):
    x, rng = normal(3, 1200, 2)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    df = frame(spark, x, y)
    train, val = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    for loss in (P.LOG, P.PERCEPTRON):
        model = P.PartialFit(loss, epochs=6, step=0.5).fit(train)
        history = model.history(train, val)
        assert [h[0] for h in history] == list(range(1, 7)) and history[-1][2] > 0.95
        for e in (0, 5):
            m = x[::4] @ model.weights[e][:-1] + model.weights[e][-1]
            assert history[e][2] == pytest.approx((m.argmax(axis=1) == y[::4]).mean())
            own, other = np.take_along_axis(m, y[::4, None].astype(int), 1)[:, 0], np.take_along_axis(m, 1 - y[::4, None].astype(int), 1)[:, 0]
            want = np.log1p(np.exp(other - own)).mean() if loss == P.LOG else np.maximum(0, other - own).mean()
            assert history[e][4] == pytest.approx(want)


def test_several_classes_and_predictions(spark):
    x, rng = normal(4, 1500, 2)
    y = (np.arctan2(x[:, 1], x[:, 0]) // (2 * np.pi / 3) + 2).clip(0, 2)
    df = frame(spark, x, y)
    out = P.PartialFit(P.LOG, epochs=15, step=0.5).fit(df).transform(df)
    assert out.where("prediction = label").count() > 1300 and {"prediction", "probability"} < set(out.columns)


def test_odd_rows_of_epochs(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [None, 1.0], 1.0), (3, [0.0, float("nan")], 2.0), (4, [1.0, 1.0], None), (5, None, 1.0)], "id long, features array<double>, label double")
    model = P.PartialFit(epochs=2).fit(df)
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert [i for i, v in got.items() if v is not None] == [1, 4] and model.scores(df.where("id > 1")) == {}
    with pytest.raises(ValueError):
        P.PartialFit().fit(df.where("id = 4"))


def test_models_are_averaged_in_a_tree(spark):
    rows = [(i, i + 1, [float(i), 1.0]) for i in range(1000)]
    got = P.averaged(spark.createDataFrame(rows, "at int, n long, w array<double>").repartition(9), (2, 1))
    assert got[0, 0] == pytest.approx(sum((i + 1) * i for i in range(1000)) / sum(i + 1 for i in range(1000))) and got[1, 0] == pytest.approx(1)


def test_epochs_by_catalogue_name(spark):
    x, rng = normal(5, 800, 2)
    df = frame(spark, x, (x[:, 0] > 0).astype(float)).withColumn("split", F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train"))
    out = training.train("Perceptron", df, "binary_classification", ["a", "b"], epochs=7)
    assert len(out.history) == 7 and all(None not in h for h in out.history)
    weights = {r["feature"]: r["importance"] for r in out.importances().collect()} if "importance" in out.importances().columns else None
    assert out.metrics().where("metric = 'accuracy'").first()["value"] > 0.9 and (weights is None or weights["a"] > weights["b"])


# --- cross-products ----------------------------------------------------------------------------


def test_gram_equals_numpy_far_from_zero(spark):
    x, rng = normal(6, 700, 3)
    x, y = x + 1e6, rng.normal(0, 1, 700) + 1e7
    g = L.gram(frame(spark, x, y, 5))
    z = np.c_[x, y] - np.c_[x, y].mean(axis=0)
    assert g.n == 700 and np.allclose(g.products, z.T @ z, rtol=1e-8, atol=1e-6)


def reference_evidence(x, y, iterations=300):
    """Evidence maximisation on the rows themselves."""
    xc, yc = x - x.mean(0), y - y.mean()
    alpha, lam, w = 1 / yc.var(), 1.0, None
    for _ in range(iterations):
        sigma = np.linalg.inv(alpha * xc.T @ xc + lam * np.eye(x.shape[1]))
        new = alpha * sigma @ xc.T @ yc
        gamma = x.shape[1] - lam * np.trace(sigma)
        lam = (gamma + 2e-6) / (new @ new + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (((yc - xc @ new) ** 2).sum() + 2e-6)
        if w is not None and np.abs(w - new).sum() < 1e-3:
            break
        w = new
    sigma = np.linalg.inv(alpha * xc.T @ xc + lam * np.eye(x.shape[1]))
    return alpha * sigma @ xc.T @ yc, alpha, sigma


def test_bayesian_ridge_equals_numpy(spark):
    x, rng = normal(7, 120, 4)
    y = x @ [2.0, 0.0, -1.0, 0.3] + 5 + rng.normal(0, 0.7, 120)
    df = frame(spark, x, y)
    fit = L.BayesianRidge().fit(df)
    w, alpha, sigma = reference_evidence(x, y)
    assert np.allclose(fit.weights, w, atol=1e-8) and fit.noise == pytest.approx(1 / alpha, rel=1e-8)
    got = {r.id: r for r in fit.transform(df).collect()}
    off = x - x.mean(0)
    want = np.sqrt(1 / alpha + np.einsum("ij,jk,ik->i", off, sigma, off))
    assert all(got[i].deviation == pytest.approx(want[i], rel=1e-8) and got[i].prediction == pytest.approx(y.mean() + off[i] @ w, abs=1e-8) for i in range(120))


def test_ard_prunes_what_the_data_do_not_need(spark):
    x, rng = normal(8, 400, 6)
    y = 3 * x[:, 1] - 2 * x[:, 4] + 1 + rng.normal(0, 0.1, 400)
    fit = L.ARDRegression().fit(frame(spark, x, y))
    assert abs(fit.weights[1] - 3) < 0.03 and abs(fit.weights[4] + 2) < 0.03
    assert sum(abs(w) < 0.02 for w in fit.weights) == 4 and fit.noise == pytest.approx(0.01, rel=0.3)


def test_every_knot_is_optimal(spark):
    x, rng = normal(9, 300, 6)
    x[:, 5] = x[:, 0] * 0.9 + x[:, 1] * 0.5 + rng.normal(0, 0.1, 300)
    y = x @ [3.0, -2.0, 0.5, 0.0, 1.0, -1.0] + rng.normal(0, 0.3, 300)
    df, n = frame(spark, x, y), 300
    scale, xc, yc = x.std(0), x - x.mean(0), y - y.mean()
    for lasso in (False, True):
        fit = L.LeastAngle(lasso).fit(df)
        assert len(fit.path) >= 7 and all(a[0] >= b[0] for a, b in zip(fit.path, fit.path[1:]))
        for penalty, w in fit.path:
            c = xc.T @ (yc - xc @ w) / n / scale
            assert np.abs(c).max() <= penalty + 1e-8
            if lasso:
                assert all(abs(c[j] - np.sign(w[j]) * penalty) < 1e-8 for j in np.flatnonzero(w))
        assert np.allclose(fit.weights, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-8)


def test_lasso_at_a_penalty(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    x, rng = normal(10, 300, 5)
    x = x * [1, 10, 0.1, 5, 1]
    y = x @ [1.0, 0.2, 4.0, 0.0, -2.0] + rng.normal(0, 0.2, 300)
    df = frame(spark, x, y)
    fit = L.LeastAngle(True, 0.3).fit(df)
    sd = x.std(0)
    c = (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ fit.weights) / 300 / sd
    assert np.abs(c).max() == pytest.approx(0.3, abs=1e-9)
    scaled = frame(spark, x / sd, y).withColumn("features", array_to_vector("features"))
    solver = LinearRegression(regParam=0.3, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=2000).fit(scaled)
    assert np.allclose(fit.weights * sd, solver.coefficients.toArray(), atol=1e-3)


def test_constant_and_repeated_features(spark):
    x, rng = normal(11, 200, 2)
    wide = np.c_[x, np.full(200, 4.0), x[:, 0]]
    y = x @ [1.0, 2.0] + 1
    for model in (L.BayesianRidge(), L.ARDRegression(), L.LeastAngle(), L.LeastAngle(True, 0.01), L.RANSAC(), L.TheilSen()):
        fit = model.fit(frame(spark, wide, y))
        p = wide @ fit.weights + fit.intercept
        assert np.isfinite(p).all() and np.abs(p - y).mean() < 0.2, model


# --- robust ------------------------------------------------------------------------------------


def outliers(seed, share, n=600, p=2):
    x, rng = normal(seed, n, p)
    y = x @ np.arange(1, p + 1) + 5
    bad = rng.random(n) < share
    y[bad] = 40 + 30 * rng.random(bad.sum())
    return x, y


def test_ransac_finds_the_line_among_gross_outliers(spark):
    x, y = outliers(12, 0.4)
    fits = [L.RANSAC().fit(frame(spark, x, y, parts)) for parts in (2, 9)]
    assert all(np.allclose([*f.weights, f.intercept], [1, 2, 5], atol=1e-6) for f in fits)
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    huber = LinearRegression(loss="huber").fit(frame(spark, x, y).withColumn("features", array_to_vector("features")))
    assert abs(huber.intercept - 5) > 0.1


def test_ransac_with_noise_and_a_threshold(spark):
    x, y = outliers(13, 0.3)
    y = y + np.random.default_rng(0).normal(0, 0.05, len(y))
    fit = L.RANSAC(threshold=0.2).fit(frame(spark, x, y))
    assert np.allclose([*fit.weights, fit.intercept], [1, 2, 5], atol=0.03)


def test_theil_sen_breakdown(spark):
    x, y = outliers(14, 0.25, p=1)
    fit = L.TheilSen().fit(frame(spark, x, y))
    assert np.allclose([*fit.weights, fit.intercept], [1, 5], atol=1e-3)
    assert abs(np.polyfit(x[:, 0], y, 1)[1] - 5) > 5


def test_theil_sen_equals_a_plain_median_of_planes(spark):
    x, rng = normal(15, 60, 1)
    y = 2 * x[:, 0] + 1 + rng.normal(0, 0.5, 60)
    df = frame(spark, x, y)
    fit = L.TheilSen(steps=300).fit(df)
    rows = sorted(L.usable_rows(df, "features", "label").collect(), key=lambda r: (r.h, r.y))
    w = np.array([L.solved(np.array([[*a.x, a.y], [*b.x, b.y]])) for a, b in zip(rows[::2], rows[1::2])])
    q = np.quantile(w, [0.25, 0.75], axis=0)
    unit = q[1] - q[0]
    loss = lambda v: np.sqrt((((w - v) / unit) ** 2).sum(1)).sum()
    here = np.array([*fit.weights, fit.intercept])
    assert all(loss(here) <= loss(here + np.array(d) * unit * 0.01) + 1e-9 for d in itertools.product((-1, 0, 1), repeat=2))


def test_too_few_rows(spark):
    df = frame(spark, [[1.0, 2.0]], [3.0])
    for model in (L.RANSAC(), L.TheilSen(), L.BayesianRidge(), L.LeastAngle(), L.ARDRegression()):
        assert model.fit(df).transform(df).first()["prediction"] == pytest.approx(3.0)
        with pytest.raises(ValueError):
            model.fit(df.where("id > 5"))


def test_epoch_models_leave_rows_with_a_missing_feature_without_a_prediction(spark):
    rows = spark.createDataFrame([([1.0], 1.0), ([-1.0], 0.0), ([None], 1.0), (None, 0.0), ([float("nan")], 0.0)], "features array<double>, label double")
    for loss in ("log", "perceptron", "squared"):
        out = P.PartialFit(loss, epochs=3).fit(rows).transform(rows)
        assert [r.prediction is None for r in out.collect()] == [False, False, True, True, True]
