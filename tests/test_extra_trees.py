"""Extremely randomised trees against plain numbers and on planted columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import storage, training
from tablecraft.operators.extra_trees import ExtraTrees, reached
from tablecraft.plans.registry import all_queries
from tests.check import compare, duck

SCHEMA = "features array<double>, label double"


def planted(n=1500, seed=3):
    """Five columns, of which the second and the fourth decide."""
    x = np.random.default_rng(seed).normal(size=(n, 5))
    return x, ((x[:, 1] > 0.2) ^ (x[:, 3] > 0.8)).astype(float), 3 * x[:, 1] - 2 * np.abs(x[:, 3])


def frame(spark, x, y):
    return spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], SCHEMA)


def same(a, b):
    return all(
        np.array_equal(s.feature, t.feature) and np.array_equal(s.threshold, t.threshold) and np.array_equal(s.left, t.left) and np.array_equal(s.value, t.value)
        for s, t in zip(a.trees, b.trees))


@pytest.mark.parametrize("classify", [True, False])
def test_forest_is_the_same_on_any_partitioning_and_finds_the_planted_columns(spark, classify):
    x, kinds, numbers = planted()
    rows = frame(spark, x, kinds if classify else numbers)
    forest = ExtraTrees(20, 6, classify, columns=3)
    model = forest.fit(rows.repartition(1))
    assert same(model, forest.fit(rows.repartition(7, F.rand(5))))
    weights = model.featureImportances
    assert set(np.argsort(-weights)[:2]) == {1, 3} and abs(weights.sum() - 1) < 1e-12 and weights[[1, 3]].sum() > 0.7
    fresh = planted(600, 9)
    scores = model.scores(frame(spark, fresh[0], fresh[1] if classify else fresh[2]))
    constant = max(fresh[1].mean(), 1 - fresh[1].mean()) if classify else 0.0
    assert list(scores) == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20]
    assert 1 - scores[20] < (1 - constant) / 2  # less than half of what the best constant leaves


def test_leaves_and_predictions_are_means_of_the_rows_that_reach_them(spark):
    x, _, y = planted(400)
    rows = frame(spark, x, y).withColumn("id", F.monotonically_increasing_id())
    model = ExtraTrees(5, 4, False).fit(rows)
    want = np.zeros(len(x))
    for t in model.trees:
        at = reached(x, t.feature, t.threshold, t.left)
        for node in range(len(t.feature)):
            inner, low = t.feature[node], t.left[node]
            if inner >= 0:
                assert low > node and t.feature[low:].size >= 2
            elif (at == node).any():
                assert abs(t.value[node, 0] - y[at == node].mean()) < 1e-8
        assert all((at == leaf).any() for leaf in np.flatnonzero(t.feature < 0))  # thresholds lie within the rows of a node
        want += t.value[at, 0] / 5
    got = {tuple(r.features): r.prediction for r in model.transform(rows).collect()}
    assert all(abs(got[tuple(a)] - w) < 1e-12 for a, w in zip(x.tolist(), want))


def test_one_pass_bound_splits_the_trees_of_a_level(spark, monkeypatch):
    x, kinds, _ = planted(200)
    rows = frame(spark, x, kinds)
    whole = ExtraTrees(6, 4).fit(rows)
    monkeypatch.setattr("tablecraft.operators.extra_trees.SUMS", 40)
    assert same(whole, ExtraTrees(6, 4).fit(rows))


def test_odd_rows(spark):
    odd = [([1.0, float("inf")], 1.0), ([1.0, float("-inf")], 0.0), ([None, 1.0], 1.0), ([float("nan"), 1.0], 1.0), ([1.0, 1.0], None), (None, 1.0), ([1.0, 2.0], float("nan"))]
    rows = spark.createDataFrame(odd, SCHEMA)
    model = ExtraTrees(3, 3).fit(rows)
    got = [r.prediction for r in model.transform(rows).collect()]
    assert got[:2] == [1.0, 0.0] and got[2] is None and got[3] is None and got[5] is None
    alike = ExtraTrees(3, 3, False).fit(spark.createDataFrame([([2.0], 7.0)] * 4, SCHEMA))  # nothing to split
    assert [len(t.feature) for t in alike.trees] == [1, 1, 1] and alike.transform(rows.limit(0)).count() == 0
    assert alike.transform(spark.createDataFrame([([9.0], 0.0)], SCHEMA)).first().prediction == 7.0
    with pytest.raises(ValueError):
        ExtraTrees().fit(rows.limit(0))
    with pytest.raises(ValueError):
        ExtraTrees().fit(spark.createDataFrame([([1.0], -1.0)], SCHEMA))


def test_training_by_name_and_storage(spark, tmp_path):
    x, kinds, numbers = planted(500)
    for name, task, y in (("ExtraTreesClassifier", "binary_classification", kinds), ("ExtraTreesRegressor", "regression", numbers)):
        parts = frame(spark, x, y).withColumn("split", F.when(F.rand(1) < 0.7, "train").when(F.rand(2) < 0.5, "val").otherwise("test"))
        run = training.train(name, parts, task, list("abcde"), numTrees=10)
        assert len(run.history) == 10 and run.history[-1][1] > run.history[-1][2] > 0.4
        assert {r.feature for r in run.importances(2).collect()} == {"b", "d"}
        storage.save_extra_trees(run.model, spark, str(tmp_path / name))
        again = storage.load_extra_trees(spark, str(tmp_path / name))
        assert same(run.model, again) and np.array_equal(run.model.featureImportances, again.featureImportances)


@pytest.mark.parametrize("name", ["extra_trees_months", "extra_trees_shares"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    query, sql = all_queries()[name]
    assert compare(query(spark, sf_dir), duck(sf_dir), sql) is None
