"""The forest on binned rows, against plain recursion and Spark's choices."""

import dataclasses
import math

import numpy as np
import pandas as pd
import pytest

from tablecraft.operators import binned_forest, selection
from tablecraft.settings import SETTINGS

FEATURES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 5))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["f4"] = rng.integers(0, 4, 3000).astype(float)  # few values
    pdf["num"] = 3 * x[:, 1] - 2 * x[:, 3] + rng.normal(scale=0.1, size=3000)
    pdf["cls"] = np.where(pdf["num"] > 1, "yes", np.where(pdf["num"] < -2, "no", "so"))
    pdf.loc[::50, "f0"] = None
    return spark.createDataFrame(pdf).repartition(3).cache()


def test_bags_are_poisson_draws():
    times = np.concatenate([binned_forest.bag(42, t, 0, b, 1 << 16) for t in range(4) for b in range(4)])
    share = np.bincount(times, minlength=8)[:8] / len(times)
    assert share == pytest.approx([math.exp(-1) / math.factorial(i) for i in range(8)], abs=2e-3)
    assert (binned_forest.bag(42, 3, 1, 2, 500) == binned_forest.bag(42, 3, 1, 2, 500)).all()
    assert len({binned_forest.bag(42, t, p, b, 500).tobytes() for t in range(3) for p in range(3) for b in range(3)}) == 27


def test_edges_part_few_values_and_share_out_many():
    assert binned_forest.edges_of([1.0, 1.0, 5.0, 2.0, 5.0]).tolist() == [1.0, 2.0]
    assert binned_forest.edges_of([7.0, 7.0]).tolist() == []
    many = binned_forest.edges_of(list(np.linspace(0, 1, 513)))
    assert len(many) == 31 and np.diff(many) == pytest.approx(1 / 32, abs=2e-3)


def plain(blocks, columns, trees, depth, seed, classify, outputs):
    """The same forest row by row: one node after the other."""
    p = len(columns)
    k = math.ceil(math.sqrt(p)) if classify else math.ceil(p / 3)
    result = np.zeros(p)
    for t in range(trees):
        w = np.concatenate([binned_forest.bag(seed, t, b["part"], b["number"], len(b["y"]) // 4) for b in blocks]).astype(float)
        y = np.concatenate([np.frombuffer(b["y"], np.int32) for b in blocks])
        x = np.concatenate([np.frombuffer(b["x"], np.uint8).reshape(-1, len(b["y"]) // 4) for b in blocks], axis=1)[columns]
        y = np.eye(outputs)[y] if classify else y[:, None].astype(float)
        gains = np.zeros(p)

        def value(rows):
            return ((w[rows, None] * y[rows]).sum(axis=0) ** 2).sum() / w[rows].sum() if w[rows].sum() else 0.0

        def split(rows, level, node):
            if level == depth:
                return
            best = (0.0, None, None)
            for f in np.random.default_rng([seed, level]).random((trees, 1 << level, p)).argsort(axis=2)[t, node, :k]:
                for c in range(binned_forest.BINS - 1):
                    left, right = rows[x[f][rows] <= c], rows[x[f][rows] > c]
                    if w[left].sum() and w[right].sum():
                        best = max(best, (value(left) + value(right) - value(rows), -c, f), key=lambda b: b[0])
            if best[0] > 1e-9 * abs(value(rows)) and best[2] is not None:
                gains[best[2]] += best[0]
                split(rows[x[best[2]][rows] <= -best[1]], level + 1, 2 * node)
                split(rows[x[best[2]][rows] > -best[1]], level + 1, 2 * node + 1)

        split(np.arange(len(w)), 0, 0)
        result += gains / (gains.sum() or 1)
    return result / result.sum()


@pytest.mark.parametrize("task,target", [("regression", "num"), ("classification", "cls")])
def test_importances_equal_plain_recursion(planted, monkeypatch, task, target):
    monkeypatch.setattr(binned_forest, "BLOCK", 1 << 10)  # several blocks a partition
    rows = selection.learning_columns(planted, FEATURES, target, task)
    forest = binned_forest.BinnedForest(rows, [f"x{i}" for i in range(5)], task == "classification")
    blocks = forest.blocks.collect()
    assert sum(len(b["y"]) // 4 for b in blocks) == 3000
    for columns in ([0, 1, 2, 3, 4], [0, 3, 4]):
        got = forest.importances(columns, 3, 3, 42)
        assert got == pytest.approx(plain(blocks, columns, 3, 3, 42, task == "classification", forest.outputs), abs=1e-9)
    assert got.sum() == pytest.approx(1)
    monkeypatch.setattr(binned_forest, "SUMS", 1)  # one tree a reading
    assert (forest.importances(columns, 3, 3, 42) == got).all()


@pytest.mark.parametrize("task,target", [("regression", "num"), ("classification", "cls")])
def test_large_tables_are_ranked_without_the_bags_of_spark(planted, monkeypatch, task, target):
    small = selection.by_elimination(planted, FEATURES, target, task, 2, trees=20)
    monkeypatch.setattr(selection, "SETTINGS", dataclasses.replace(SETTINGS, forest_rows=1000))
    monkeypatch.setattr(selection, "_forest", None)
    large = selection.by_elimination(planted, FEATURES, target, task, 2, trees=20)
    assert set(large.columns_out) == set(small.columns_out) == {"f1", "f3"}
    assert sorted(large.info["rankings"].values()) == [1, 1, 2, 3, 4]


def test_importances_are_close_to_those_of_spark(planted):
    rows = selection.learning_columns(planted, FEATURES, "num", "regression")
    mine = binned_forest.BinnedForest(rows, [f"x{i}" for i in range(5)], False).importances(list(range(5)), 200, 5, 42)
    theirs = selection.forest_importances(planted, FEATURES, "num", "regression", 200)
    assert mine == pytest.approx([theirs[c] for c in FEATURES], abs=0.06)


def test_constant_and_unusable_labels(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(40)], "label double, x0 double")
    assert binned_forest.BinnedForest(rows, ["x0"], False).importances([0], 3, 3, 1).tolist() == [0.0]
    with pytest.raises(ValueError):
        binned_forest.BinnedForest(spark.createDataFrame([(-1.0, 2.0)], "label double, x0 double"), ["x0"], True)
