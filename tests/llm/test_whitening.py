"""Whitening against numpy with exact integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain(rows):
    """(ids, x of the usable rows, n, sums, exact covariance times n * n) with Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept]
    once = sorted({tuple(v) for v in x})
    n, dims = len(once), len(once[0])
    s = [sum(v[d] for v in once) for d in range(dims)]
    cross = [[sum(v[d] * v[e] for v in once) for e in range(dims)] for d in range(dims)]
    return [i for i, _ in kept], x, once, s, [[n * cross[d][e] - s[d] * s[e] for e in range(dims)] for d in range(dims)]


def check(got, rows, components=16):
    ids, x, once, s, exact = plain(rows)
    n, dims = len(once), len(s)
    v = np.array([[c / n**2 for c in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dims)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
    assert set(by) == set(ids) and all(sorted(r.component for r in b) == sorted(list(range(1, k + 1)) * ids.count(i)) for i, b in by.items())
    sign = {}
    for i, row in zip(ids, x):
        off = np.array([(n * c - t) / n for c, t in zip(row, s)])
        for r in by[i]:
            assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(row, s))
            z = off @ vectors[:, r.component - 1] / np.sqrt(values[r.component - 1])
            if abs(z) > 1e-6:
                sign.setdefault(r.component, np.sign(z) * np.sign(r.whitened))
                assert r.whitened == pytest.approx(sign[r.component] * z, abs=1e-6)


def test_query_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = W.op12_whitening(table).collect()
    assert len(got) == 16 * len(rows)
    check(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.4, 5)]) for i in range(80)]
    rows += [(100 + i, rows[7][1]) for i in range(50)]  # copies count once in the fit
    rows += [(7, rows[7][1]), (200, None), (201, [0.1, None, 0.2, 0.3, 0.4]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [-700.5, 900.25, 3.0, 0.0, -1.0])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = W.op12_whitening(table).collect()
    distinct = [r for r in rows if r[0] != 7 or r is rows[7]]
    check([r for r in got if r.vec_id != 7], [r for r in distinct if r[0] != 7])
    assert len([r for r in got if r.vec_id == 7]) == 10


def test_lengths_missing_ids_and_no_variance(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.5, -0.2]), (None, [0.9, 0.9]), (4, [1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    got = W.op12_whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {1, 2, None} and len(got) == 6
    same = [(i, [0.25, 0.5]) for i in range(4)]
    assert W.op12_whitening(spark.createDataFrame(same, SCHEMA)).count() == 0
    line = [(i, [i / 64, 1.0, 2 * i / 64]) for i in range(9)]
    got = W.op12_whitening(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert W.op12_whitening(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.op12_whitening(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


def test_huge_entries_do_not_fail(spark):
    wide = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e15]), (4, [1.0, 2.0])]
    fitted = W.fit(spark.createDataFrame(rows, wide))
    assert fitted.n == 4 and fitted.identity_error < 1e-6
    assert fitted.transform(spark.createDataFrame(rows, wide)).where("deviation IS NOT NULL").count() == 4
    assert W.op12_whitening(spark.createDataFrame(rows, wide)).where("deviation IS NULL").count() > 0  # beyond 64 bits


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for tops in ([1, 5, 100], [2**40, 3, 0], [2**54, 2**54, 7]):
        y = np.stack([rng.integers(0, t + 1, 301, dtype=np.uint64) for t in tops], axis=1)
        y[0] = tops
        sums = {}
        for d, e, limb, v in W.scatter(y, [t.bit_length() for t in tops]):
            sums[d, e] = sums.get((d, e), 0) + (v << W.LIMB * limb)
        for d in range(3):
            for e in range(d, 3):
                assert sums.get((d, e), 0) == sum(int(a) * int(b) for a, b in zip(y[:, d], y[:, e]))


@pytest.mark.parametrize("name", ["whitened", "deviation", "y", "a`b", "component"])
def test_other_columns(spark, name):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3)]) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn(name, F.create_map(F.lit("x"), F.lit("y")))
    out = W.fit(table, components=2).transform(table)
    assert sorted(out.columns) == sorted({"vec_id", "embedding", name, "whitened", "deviation"}) and out.count() == 20
    assert len(out.first().whitened) == 2 and W.op12_whitening(table).count() == 60
