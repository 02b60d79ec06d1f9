"""Approximate nearest neighbours by random projections, as an option beside the exact join."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions.durable import durable
from tablecraft.operators.neighbors import knn_join, nearest_exact
from tablecraft.settings import SETTINGS

#: Tables of buckets, points that a bucket should hold, buckets of a table that a query visits, and points of a bucket in one place.
TABLES, BUCKET, PROBES, BLOCK = 12, 256, 12, 4_096
TABLE_SHIFT = 40


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def listed(lists: np.ndarray) -> pa.Array:
    """Rows of equally many numbers as a list column."""
    n, k = lists.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(lists.ravel()))


@dataclass
class VectorIndex:
    """Points by bucket. In each table, the signs of some random projections around the points' mean make a bucket's number; their count
    grows with the logarithm of the points, so buckets stay of one size and a query meets no more points however many there are."""

    n: int
    centre: np.ndarray
    planes: np.ndarray  # tables x bits x dimensions
    buckets: DataFrame  # key, block, id, vector
    hot: DataFrame  # key, blocks: buckets of more than BLOCK points

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def search(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(query, point, distance, rank): up to k of the nearest points of every query (id, vector), among those of the buckets visited.
        Distances are exact; equal ones go by the smaller point. In each table a query visits its own bucket and those whose signs differ
        where it lies nearest to a plane. Queries are streamed past a block of a bucket's points, which sends on k of them at most."""
        if not self.n:
            return queries.sparkSession.createDataFrame([], "query long, point long, distance double, rank int")
        visits = F.explode(keys_of(self.centre, self.planes, probes)(F.col("vector"))).alias("key")
        asked = queries.select("id", "vector", visits).join(bounded(self.hot), "key", "left")
        asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), F.lit(1).alias("kind"), "id", "vector")
        rows = self.buckets.select("key", "block", F.lit(0).alias("kind"), "id", "vector").union(asked)

        def work(batches):
            at, ids, points, held = None, [], None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, block, kind, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                x = vectors_of(batch.column(4))
                edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), True])
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if at != (key[s], block[s]):
                        at, ids, points, held = (key[s], block[s]), [], [], None
                    if kind[s] == 0:
                        ids.append(number[s:e])
                        points.append(x[s:e])
                        continue
                    if not ids:
                        continue
                    held = held or (np.concatenate(ids), np.concatenate(points))
                    order = held[0].argsort(kind="stable")
                    for i in range(s, e, 512):
                        row, found, squared = nearest_exact(x[i : min(e, i + 512)], held[1][order], k)
                        yield pa.RecordBatch.from_arrays([pa.array(number[i + row]), pa.array(held[0][order][found]), pa.array(np.sqrt(squared))], ["query", "point", "distance"])

        dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "kind")
        found = dealt.mapInArrow(work, "query long, point long, distance double").groupBy("query", "point").agg(F.min("distance").alias("distance"))
        order = Window.partitionBy("query").orderBy(F.round("distance", 12), "point")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keys_of(centre: np.ndarray, planes: np.ndarray, probes: int):
    """A function of a vector column: the numbers of the buckets, `probes` of each table, nearest first."""
    tables, bits, dims = planes.shape
    flat, weights = planes.reshape(tables * bits, dims).T, (1 << np.arange(bits)).astype(np.int64)
    near = min(bits, max(1, math.ceil(math.log2(max(probes, 1))) + 2))  # signs that may be turned

    @F.arrow_udf("array<bigint>")
    def keys(vectors: pa.Array) -> pa.Array:
        x = vectors_of(vectors)
        if not len(x):
            return pa.array([], pa.list_(pa.int64()))
        side = ((x - centre) @ flat).reshape(len(x), tables, bits)
        own = (side > 0) @ weights
        if probes > 1:
            order = np.argsort(np.abs(side), axis=2)[:, :, :near]
            cost = np.take_along_axis(np.abs(side), order, axis=2)
            turns = ((np.arange(1 << near)[:, None] >> np.arange(near)) & 1).astype(np.float64)
            total = cost @ turns.T  # of every choice of turned signs
            best = np.argsort(total, axis=2, kind="stable")[:, :, :probes]
            flips = (turns[best].astype(np.int64) * weights[order][:, :, None, :]).sum(axis=3)
            own = own[:, :, None] ^ flips
        else:
            own = own[:, :, None]
        return listed((own + (np.arange(tables, dtype=np.int64) << TABLE_SHIFT)[None, :, None]).reshape(len(x), -1))

    return keys


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SETTINGS.broadcast_rows + 1).count() <= SETTINGS.broadcast_rows else df


def build(points: DataFrame, tables: int = TABLES, bucket: int = BUCKET, seed: int = SETTINGS.random_state) -> VectorIndex:
    """An index of all `points` (unique long id, vector array<double> of one length). Nothing but the mean and the counts of overfull buckets
    is learned from the points. A bucket that copies or a dense region overfill is cut in blocks by a hash of the id, each of which a query
    visits, so no point is left out of a bucket."""
    seen = points.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims, n = seen["dims"] or 1, seen["n"]
    mean = points.agg(Summarizer.mean(array_to_vector("vector")).alias("m")).first()["m"] if n else None
    centre = mean.toArray() if n else np.zeros(dims)
    bits = max(1, min(30, math.ceil(math.log2(max(2.0, n / bucket)))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    keyed = durable(points.select("id", "vector", F.explode(keys_of(centre, planes, 1)(F.col("vector"))).alias("key")))
    hot = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    block: Column = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    return VectorIndex(n, centre, planes, keyed.join(bounded(hot), "key", "left").select("key", block.alias("block"), "id", "vector"), hot)


def recall(index: VectorIndex, points: DataFrame, queries: DataFrame, k: int, probes: int = PROBES) -> float:
    """The share of the exact k nearest points of `queries` that the index finds, equally distant ones counting for each other."""
    exact = knn_join(queries, points, k).groupBy("query").agg(F.max("distance").alias("reach"), F.count("*").alias("n"))
    found = index.search(queries, k, probes).join(exact, "query").where(F.col("distance") <= F.col("reach") * (1 + 1e-12) + 1e-12)
    hits = found.count()
    total = exact.agg(F.sum("n").alias("n")).first()["n"]
    return hits / total if total else 1.0


def tuned(index: VectorIndex, points: DataFrame, queries: DataFrame, k: int, target: float = 0.9, most: int = 64) -> tuple[int, float]:
    """(probes, recall): the fewest probes, doubling from 1, whose measured recall on `queries` reaches the target, or `most`."""
    probes = 1
    while True:
        got = recall(index, points, queries, k, probes)
        if got >= target or probes >= most:
            return probes, got
        probes = min(most, probes * 2)
