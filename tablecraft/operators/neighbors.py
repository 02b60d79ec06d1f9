"""Nearest centroid and exact k-nearest-neighbour joins over vector columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col
from tablecraft.functions.durable import durable
from tablecraft.settings import SETTINGS


def as_array(df: DataFrame, name: str) -> Column:
    """A vector or number array as array<double>."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return col(name).cast("array<double>")
    return vector_to_array(col(name))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances and a bound of their rounding error. A common centre is taken off first, so the error follows the spread of the
    vectors, not their distance from zero."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b))), 0.0
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    x, y = (a * a).sum(1), (b * b).sum(1)
    d = x[:, None] - 2.0 * (a @ b.T) + y[None, :]
    return np.maximum(d, 0.0), float(8 * (a.shape[1] + 4) * np.finfo(float).eps * (x.max() + y.max()))


#: Sizes of squares between which single precision neither overflows nor vanishes; rows to measure again, for each neighbour, up to which it is
#: used.
SINGLE, AGAIN = (1e-30, 1e30), 16


def single_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The same in single precision, at half the time and with a wider bound; None for sizes that it cannot hold."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    x, y = (a * a).sum(1), (b * b).sum(1)
    size = x.max() + y.max()
    if not SINGLE[0] < size < SINGLE[1]:
        return None
    d = a.astype(np.float32) @ (-2 * b).astype(np.float32).T
    d += x.astype(np.float32)[:, None]
    d += y.astype(np.float32)
    return d, float(8 * (a.shape[1] + 4) * np.finfo(np.float32).eps * size)


def nearest_exact(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of the k nearest rows of b: everything that the error bound leaves possible is measured
    again by differences; equal distances (to 10 decimals) keep the order of b."""
    k = min(k, len(b))

    def possible(d: np.ndarray, error: float) -> np.ndarray:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        return d <= edge + (2 * error + 1e-10)

    single = single_distances(a, b) if len(a) and len(b) else None
    near = None if single is None else possible(*single)
    if near is None or np.count_nonzero(near) > AGAIN * k * len(a):
        near = possible(*squared_distances(a, b))
    i, j = np.nonzero(near)
    gap = a[i] - b[j]
    exact = (gap * gap).sum(axis=1)
    order = np.lexsort((j, np.round(exact, 10), i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], exact[first]


# --- nearest centroid --------------------------------------------------------------------------


def centroids(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, centroid): per-class mean vectors, summed on the map side."""
    vector = array_to_vector(as_array(df, features)) if isinstance(df.schema[features].dataType, T.ArrayType) else col(features)
    means = df.select(col(label).alias("label"), vector.alias("v")).groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select("label", vector_to_array("m").alias("centroid"))


class NearestCentroid:
    """Predicts the class whose mean is closest (the smaller label on ties)."""

    def __init__(self, features: str = "features", label: str = "label"):
        self.features, self.label = features, label

    def fit(self, df: DataFrame) -> "NearestCentroidModel":
        found = centroids(df, self.features, self.label).persist()
        try:
            size = found.agg(F.sum(F.size("centroid").cast("bigint") * 8).alias("bytes")).first()["bytes"] or 0
            if size > SETTINGS.broadcast_bytes:  # measured: too much for the driver and every task, so the centroids are joined as points
                return DistributedCentroidModel(self.features, durable(found.select(F.col("label").cast("double").alias("label"), "centroid")))
            rows = sorted(found.collect(), key=lambda r: r["label"])
        finally:
            found.unpersist()
        return NearestCentroidModel(self.features, [float(r["label"]) for r in rows], np.array([r["centroid"] for r in rows]))


class NearestCentroidModel:
    def __init__(self, features: str, labels: list[float], centers: np.ndarray):
        self.features, self.labels, self.centers = features, np.array(labels), centers

    def transform(self, df: DataFrame) -> DataFrame:
        labels, centers = self.labels, self.centers

        @F.pandas_udf("double")
        def closest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            vectors, out = matrix(vectors), np.zeros(len(vectors))
            for start in range(0, len(vectors), 256):
                row, at, _ = nearest_exact(vectors[start : start + 256], centers, 1)
                out[start + row] = labels[at]
            return pd.Series(out)

        return df.withColumn("prediction", closest(as_array(df, self.features)))


class DistributedCentroidModel:
    """The same for very many classes: every row joins its nearest centroid."""

    def __init__(self, features: str, table: DataFrame):
        self.features, self.table = features, table

    def transform(self, df: DataFrame) -> DataFrame:
        points = durable(self.table.withColumn("id", F.xxhash64("label")))
        numbered = durable(df.withColumn("__row", F.monotonically_increasing_id()))
        queries = numbered.select(F.col("__row").alias("id"), as_array(numbered, self.features).alias("vector"))
        found = knn_join(queries, points.select("id", F.col("centroid").alias("vector")), 1)
        named = found.join(points.select(F.col("id").alias("point"), F.col("label").alias("prediction")), "point").select("query", "prediction")
        return numbered.join(named, numbered["__row"] == named["query"], "left").drop("__row", "query")


# --- k nearest neighbours ----------------------------------------------------------------------


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    pivots: int | None = None,
    block: int = 20_000,
    chunk: int = 20_000,
) -> DataFrame:
    """(query, point, distance, rank): the exact k nearest points of every query.

    Inputs have a unique `id` and an array<double> `vector`. Points are grouped around pivot points; each
    query visits only the groups that the triangle inequality cannot rule out (Lu et al., 2012).
    Large groups are cut into blocks and popular ones into query chunks, so a task holds at most
    about block + chunk vectors; it sends on no more than k candidates per query.
    """
    sizes = points.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    pivots = pivots or int(min(1024, max(4, math.isqrt(max(sizes, 1)) // 4)))
    sample = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
    centers = np.array([r["vector"] for r in sample], dtype=np.float64)
    out_schema = "query bigint, point bigint, distance double"
    if not len(centers):
        return queries.sparkSession.createDataFrame([], f"{out_schema}, rank int")

    @F.pandas_udf("cell int, reach double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "reach": pd.Series([], dtype="float64")})
        vectors = matrix(vectors)
        cell = squared_distances(vectors, centers)[0].argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": np.sqrt(((vectors - centers[cell]) ** 2).sum(axis=1))})

    placed = points.withColumn("a", assign("vector")).select("id", "vector", F.col("a.cell").alias("cell"), F.col("a.reach").alias("reach"))
    nearest = placed.select("cell", "reach").withColumn(
        "r", F.row_number().over(Window.partitionBy("cell").orderBy("reach"))
    ).where(F.col("r") <= k)
    near: dict[int, list[float]] = {}
    for r in nearest.groupBy("cell").agg(F.collect_list("reach").alias("near")).collect():  # at most pivots * k numbers
        near[r["cell"]] = sorted(r["near"])
    spread = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()}
    cells = sorted(spread)
    radius = np.array([spread[c]["radius"] for c in cells])
    pad = np.array([near[c] + [math.inf] * (k - len(near[c])) for c in cells])
    live = centers[cells]

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        ids, picked = np.array(cells, dtype="int32"), []
        vectors = matrix(vectors)
        for start in range(0, len(vectors), 256):
            d, error = squared_distances(vectors[start : start + 256], live)
            d, error = np.sqrt(d), math.sqrt(error)  # a root is off by no more than the root of what its square is off
            bounds = (d[:, :, None] + pad[None, :, :]).reshape(len(d), -1)
            limit = np.sort(bounds, axis=1)[:, min(k, pad.size) - 1 :][:, :1]
            limit = np.where(np.isfinite(limit), limit * (1 + 1e-9) + 1e-9 + 2 * error, math.inf)
            floor = np.maximum(d - radius[None, :], (d - d.min(axis=1, keepdims=True)) / 2)
            picked += [ids[row] for row in floor <= limit]
        return pd.Series(picked)

    visiting = queries.select(F.col("id").alias("q_id"), F.col("vector").alias("q_vector")).select(
        "q_id", "q_vector", F.explode(visits("q_vector")).alias("cell")
    )
    demand = {r["cell"]: r["n"] for r in visiting.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = queries.sparkSession
    grid = spark.createDataFrame(
        [(c, math.ceil(spread[c]["n"] / block), max(1, math.ceil(demand.get(c, 0) / chunk))) for c in cells],
        "cell int, blocks int, chunks int",
    )
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = visiting.join(F.broadcast(grid), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part("q_id", "chunks").alias("chunk"), "q_id", "q_vector"
    )
    right = placed.join(F.broadcast(grid), "cell").select(
        "cell", part("id", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "vector"
    )

    def nearest_of(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(p):
            p = p.sort_values("id")
            x, y = matrix(q["q_vector"]), matrix(p["vector"])
            qid, pid = q["q_id"].to_numpy(), p["id"].to_numpy()
            for start in range(0, len(x), 512):
                row, at, squared = nearest_exact(x[start : start + 512], y, k)
                parts.append(pd.DataFrame({"query": qid[start + row], "point": pid[at], "distance": np.sqrt(squared)}))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "point": [], "distance": []})

    keys = ["cell", "block", "chunk"]
    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest_of, out_schema)
    order = Window.partitionBy("query").orderBy(F.round("distance", 12), "point")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class NearestNeighbors:
    """Majority label (smallest on ties) or mean label of the k nearest training rows, or with `approximate` of those that an index of random
    projections finds; a row that it finds no neighbour for has no prediction."""

    def __init__(self, k: int = 5, classify: bool = True, features: str = "features", label: str = "label", approximate: bool = False, probes: int | None = None):
        self.k, self.classify, self.features, self.label, self.approximate, self.probes = k, classify, features, label, approximate, probes

    def fit(self, df: DataFrame) -> "NearestNeighborsModel":
        kept = df.select(
            F.monotonically_increasing_id().alias("id"), as_array(df, self.features).alias("vector"), col(self.label).cast("double").alias("y")
        )
        return NearestNeighborsModel(self, durable(kept))


class NearestNeighborsModel:
    def __init__(self, spec: NearestNeighbors, points: DataFrame):
        self.spec, self.points, self.index = spec, points, None

    def nearest(self, queries: DataFrame) -> DataFrame:
        points = self.points.select("id", "vector")
        if not self.spec.approximate:
            return knn_join(queries, points, self.spec.k)
        from tablecraft.operators import vector_index

        self.index = self.index or vector_index.build(points)
        return self.index.search(queries, self.spec.k, self.spec.probes or vector_index.PROBES)

    def transform(self, df: DataFrame) -> DataFrame:
        # Row numbers must not change between the join and its result, so the queries are written out once.
        numbered = durable(df.withColumn("__row", F.monotonically_increasing_id()))
        queries = numbered.select(F.col("__row").alias("id"), as_array(numbered, self.spec.features).alias("vector"))
        found = self.nearest(queries)
        labels = self.points.select(F.col("id").alias("point"), "y")
        votes = found.join(labels, "point")
        if self.spec.classify:
            count = votes.groupBy("query", "y").agg(F.count(F.lit(1)).alias("n"))
            answer = count.groupBy("query").agg(F.min(F.struct(-F.col("n"), F.col("y"))).alias("b")).select("query", F.col("b.y").alias("prediction"))
        else:
            answer = votes.groupBy("query").agg(F.avg("y").alias("prediction"))
        return numbered.join(answer, numbered["__row"] == answer["query"], "left").drop("__row", "query")
