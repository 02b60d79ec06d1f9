"""The approximate neighbour index against the exact join."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import neighbors
from tablecraft.operators import vector_index as V


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)


def clustered(n, seed=1, dims=16, clusters=40):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 4, (clusters, dims))[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dims))


def test_recall_on_all_embeddings(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = V.build(points, bucket=32)
    assert index.bits >= 3 and V.recall(index, points, points, 5, 8) >= 0.9


def test_candidates_stay_bounded_as_points_grow_tenfold(spark):
    """A bucket's points, and so what a query can meet, don't grow; recall stays."""
    sizes, found = [], []
    for n in (600, 6_000):
        points = frame(spark, clustered(n))
        index = V.build(points, bucket=64)
        counts = index.buckets.groupBy("key").agg(F.count("*").alias("n"))
        visits = points.where("id % 50 = 0").select(F.explode(V.keys_of(index.centre, index.planes, 8)(F.col("vector"))).alias("key"), "id")
        sizes.append(visits.join(counts, "key").groupBy("id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0])
        found.append(V.recall(index, points, points.where("id % 50 = 0"), 5, 8))
    assert sizes[1] < 3 * sizes[0] and sizes[1] < 12 * 8 * 64 * 2 and min(found) >= 0.9


def test_distances_are_exact_and_ranked(spark):
    x = clustered(800, 3)
    points = frame(spark, x)
    rows = V.build(points, bucket=64).search(points.where("id < 40"), 5, 4).collect()
    for r in rows:
        assert r.distance == pytest.approx(np.sqrt(((x[r.query] - x[r.point]) ** 2).sum()), abs=1e-9)
    of = [r for r in sorted(rows, key=lambda r: (r["query"], r["rank"])) if r["query"] == 7]
    assert of[0].point == 7 and [r["rank"] for r in of] == [1, 2, 3, 4, 5] and all(a.distance <= b.distance for a, b in zip(of, of[1:]))


def test_probing_every_bucket_is_exact(spark):
    points = frame(spark, clustered(300, 4))
    index = V.build(points, tables=1, bucket=64)
    got = {(r["query"], r["point"]) for r in index.search(points, 3, 1 << index.bits).collect()}
    assert got == {(r["query"], r["point"]) for r in neighbors.knn_join(points, points, 3).collect()}


def test_hot_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    x = np.concatenate([np.zeros((400, 8)), clustered(200, 5, 8)])
    points = frame(spark, x)
    index = V.build(points, bucket=32)
    assert index.hot.count() > 0 and index.buckets.groupBy("key", "block").count().agg(F.max("count")).first()[0] < 120
    got = index.search(points.where("id < 3"), 4, 2).collect()
    assert len(got) == 12 and all(r.distance == 0 for r in got) and {r.point for r in got} == {0, 1, 2, 3}


def test_more_probes_until_the_target(spark):
    points = frame(spark, np.random.default_rng(6).normal(0, 1, (1500, 24)))
    index = V.build(points, tables=4, bucket=64)
    probes, got = V.tuned(index, points, points.where("id % 30 = 0"), 5, 0.9, 32)
    assert got >= 0.9 or probes == 32
    assert probes > 1


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    one = frame(spark, [[1.0, 2.0]])
    assert V.build(none).search(one, 3).count() == 0 and V.build(one).search(none, 3).count() == 0
    assert [tuple(r) for r in V.build(one).search(one, 3).collect()] == [(0, 0, 0.0, 1)]


def test_classification_with_the_index(spark):
    x = clustered(600, 7)
    df = frame(spark, x).select(F.col("vector").alias("features"), (F.col("id") % 3).cast("double").alias("label"))
    near = neighbors.NearestNeighbors(3, approximate=True).fit(df).transform(df)
    exact = neighbors.NearestNeighbors(3).fit(df).transform(df)
    assert near.count() == 600
    both = near.select("features", F.col("prediction").alias("p")).join(exact.select("features", "prediction"), "features")
    assert both.where("p = prediction").count() > 540
