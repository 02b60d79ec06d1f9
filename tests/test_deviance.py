"""Deviance models, the variance power and isotonic regression against plain numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablecraft.operators import calibration, deviance, preparation, selection, training


def test_log_gamma():
    x = np.array([1e-3, 0.5, 1, 2, 3.7, 7.9, 8, 55.5, 1e4])
    assert np.allclose(deviance.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("power,dispersion,mean", [(1.2, 0.7, 2.0), (1.5, 1.0, 0.5), (1.8, 0.4, 3.0)])
def test_density_is_one_with_the_right_mean_and_variance(power, dispersion, mean):
    y = np.r_[0.0, np.exp(np.linspace(-25, 5, 40_001))]
    f = np.exp(deviance.log_density(y, np.full(len(y), mean), dispersion, power))
    f[1:] *= y[1:]  # over log y
    step = np.log(y[2]) - np.log(y[1])
    moments = [(f[1:] * y[1:] ** k).sum() * step for k in range(3)]
    assert abs(moments[0] + f[0] - 1) < 1e-3 and abs(moments[1] - mean) < 1e-3
    assert abs(moments[2] - mean**2 - dispersion * mean**power) < 2e-2


def test_profile_finds_the_power_of_sums_of_gamma_amounts(spark):
    rng, power, dispersion = np.random.default_rng(4), 1.5, 0.8
    x = rng.integers(0, 2, 4000)
    mean = np.exp(0.3 + 0.6 * x)
    rate, shape = mean ** (2 - power) / (dispersion * (2 - power)), (2 - power) / (power - 1)
    scale = dispersion * (power - 1) * mean ** (power - 1)
    y = [float(rng.gamma(shape * n, s)) if n else 0.0 for n, s in zip(rng.poisson(rate), scale)]
    rows = spark.createDataFrame([(Vectors.dense([float(a)]), b) for a, b in zip(x, y)] + [(Vectors.dense([0.0]), None)], ["features", "label"])
    profile = deviance.power_profile(rows, (1.2, 1.35, 1.5, 1.65, 1.8))
    assert deviance.best_power(profile) == 1.5
    assert abs({r.power: r.dispersion for r in profile.collect()}[1.5] - dispersion) < 0.1


def test_profile_refuses_what_it_cannot_fit(spark):
    rows = spark.createDataFrame([(Vectors.dense([1.0]), -1.0)], ["features", "label"])
    with pytest.raises(ValueError):
        deviance.power_profile(rows, (1.5,))
    with pytest.raises(ValueError):
        deviance.power_profile(rows, (2.0,))


def test_deviance_leaves_out_what_the_power_does_not_allow(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (None, 1.0)], "label double, prediction double")
    seen = {p: deviance.mean_deviance(df, p).first() for p in (0, 1, 1.5, 2)}
    assert (seen[1]["n"], seen[2]["n"]) == (2, 1) and seen[2]["deviance"] == 0
    assert abs(seen[1]["deviance"] - 1) < 1e-12 and abs(seen[1.5]["deviance"] - 2) < 1e-12


def pooled(y, w):
    blocks = []
    for a, b in zip(y, w):
        blocks.append([a * b, b, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return [s / n for s, n, k in blocks for _ in range(k)]


@pytest.mark.parametrize("increasing", [True, False])
def test_isotonic_equals_pooled_violators(spark, increasing):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 600)
    y = rng.normal((x if increasing else -x) / 20, 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (3.0, None), (float("nan"), 2.0)], "x double, y double")
    fit = calibration.isotonic(df.repartition(7), "x", "y", increasing=increasing)
    levels = sorted(set(x.tolist()))
    sign = 1 if increasing else -1
    expected = [sign * v for v in pooled([sign * y[x == v].mean() for v in levels], [(x == v).sum() for v in levels])]
    got = {r.x: r.calibrated for r in fit.transform(df).where("x IS NOT NULL AND NOT isnan(x)").select("x", "calibrated").distinct().collect()}
    assert np.allclose([got[float(v)] for v in levels], expected)
    assert fit.transform(df).where("x IS NULL OR isnan(x)").where("calibrated IS NOT NULL").count() == 0


def test_calibration_does_not_worsen_the_log_loss(spark):
    p = F.rand(3)
    df = spark.range(6000).select(p.alias("truth")).withColumn("label", (F.rand(5) < F.col("truth")).cast("double")).withColumn("probability", F.pow("truth", F.lit(3)))
    rows = df.persist()
    fit = calibration.calibrate(rows)
    safe = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = lambda c: -F.avg(F.when(F.col("label") == 1, F.log(safe(c))).otherwise(F.log(1 - safe(c))))
    seen = fit.transform(rows).agg(loss("probability").alias("before"), loss("calibrated").alias("after")).first()
    rows.unpersist()
    assert seen["after"] < seen["before"] - 0.05


def test_calibration_needs_rows(spark):
    with pytest.raises(ValueError):
        calibration.calibrate(spark.createDataFrame([], "probability double, label double"))


def test_no_window_over_a_feature_and_no_forced_broadcast_of_classes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 50).cast("string").alias("y"))
    plan = selection.mutual_information(df, ["x"], "y", "multiclass_classification")._jdf.queryExecution().toString()
    assert "Window" not in plan
    hashed = df.select(F.col("y").alias("label"), F.xxhash64("id").alias("hash"))
    assert "ResolvedHint" not in preparation.class_cuts(hashed, {"a": 0.2})._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("name", ["PoissonRegressor", "GammaRegressor", "FMRegressor", "FMClassifier"])
def test_new_models_are_trained_from_the_catalogue(spark, name):
    classes = name == "FMClassifier"
    x = (F.col("id") % 5).cast("double")
    label = (F.col("id") % 5 % 3).cast("double") if classes else x + 1
    rows = spark.range(600).select("id", F.array(x, F.lit(1.0) - x).alias("a"), label.alias("label"))
    parts = preparation.hash_split(rows.select("id", array_to_vector("a").alias("features"), "label"), ["id"])
    task = "multiclass_classification" if classes else "regression"
    done = training.train(name, parts, task, ["a", "b"], history=False)
    seen = done.predictions.agg(F.count("prediction").alias("n"), F.corr("prediction", "label").alias("r")).first()
    assert seen["n"] > 50 and (classes or seen["r"] > 0.9)


def test_density_works_out_what_depends_on_the_number_of_amounts_once(monkeypatch):
    rng = np.random.default_rng(8)
    y, mu = np.where(rng.random(5000) < 0.2, 0.0, rng.gamma(2, 4, 5000)), rng.uniform(1, 9, 5000)
    seen, plain = [], deviance.log_gamma
    monkeypatch.setattr(deviance, "log_gamma", lambda x: seen.append(x.size) or plain(x))
    fast = deviance.log_density(y, mu, 1.3, 1.4)
    assert sum(seen) < 5000  # not once for each of some 25 terms or more of each row
    monkeypatch.setattr(deviance, "CELLS", 60)  # the table does not fit: each term by itself
    assert np.allclose(deviance.log_density(y[:300], mu[:300], 1.3, 1.4), fast[:300], rtol=1e-12, atol=1e-12)
