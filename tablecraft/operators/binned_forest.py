"""Importances of a random forest on binned rows: Poisson bags, drawn features, all trees grown level by level on sums of all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.durable import durable

BINS = 32
#: Rows of a block. Sums of a block are exact in doubles: 2**16 rows, drawn less than 2**4 times each, of labels of LABEL_BITS.
BLOCK, LABEL_BITS = 1 << 16, 32
#: Points of a feature's distribution, over all rows, among which the bins' edges are found.
POINTS = 512
#: A row is in a bag as often as these marks are at most its draw of 32 bits: Poisson with mean 1.
MARKS = np.array([math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))) for j in range(12)], np.uint64).clip(max=2**32 - 1).astype(np.uint32)
COMMON = 4
#: Tasks a core to which blocks are dealt, at least, and blocks of a task at most (in the mean).
TASKS, SHARE = 3, 32
#: Cells of a block, and numbers that a task may add up in one reading; the trees of a level share readings up to it.
CELLS, SUMS = 1 << 23, 8_000_000


def bag(seed: int, tree: int, part: int, number: int, size: int) -> np.ndarray:
    """How often each row of a block is in the bag of a tree."""
    draw = np.random.Generator(np.random.SFC64([seed, tree, part, number])).integers(0, 1 << 32, size, dtype=np.uint32)
    times = (draw >= MARKS[0]).view(np.uint8)
    for mark in MARKS[1:COMMON]:
        times = times + (draw >= mark).view(np.uint8)
    often = np.flatnonzero(draw >= MARKS[COMMON])
    times[often] = np.searchsorted(MARKS, draw[often], side="right")
    return times


def edges_of(points: list[float]) -> np.ndarray:
    """At most BINS - 1 values; a row's bin is the number of them below its own value. Every value is an edge if there are few."""
    values = np.unique(points)
    return values[:-1] if len(values) <= BINS else np.unique(np.sort(points)[[round(i * len(points) / BINS) for i in range(1, BINS)]])


def chosen(options: list[np.ndarray], ways: list[np.ndarray]) -> np.ndarray:
    """For each row the option of the node that its ways (0 left, 255 right; the first is the root's) lead to."""
    for way in reversed(ways):
        options = [a if a is b else a ^ ((a ^ b) & way) for a, b in zip(options[::2], options[1::2])]
    return options[0]


class BinnedForest:
    """Rows as blocks of bins (a byte a feature) and labels, written once; any number of forests on any of the features then read only these.

    `rows` has `label` and one column a feature, without missing values. The method is that of Spark's forests: bags with Poisson counts of mean 1,
    BINS bins a feature, a third (regression) or the root (classes) of the features drawn for each node, the split with the largest
    decrease of variance or Gini impurity. Bags depend on the seed, the tree and the row's place, features on the seed and the node. Labels of a
    regression become whole numbers, so sums do not depend on their order. A level costs one reading of the blocks; tasks
    send sums whose number depends on trees and depth, never on rows."""

    def __init__(self, rows: DataFrame, features: list[str], classify: bool):
        self.classify, points = classify, [i / POINTS for i in range(POINTS + 1)]
        seen = rows.agg(
            F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("top"), F.avg("label").alias("mean"),
            *[F.percentile_approx(c, points, 10_000).alias(f"p{i}") for i, c in enumerate(features)],
        ).first()
        if not seen["n"] or not math.isfinite(seen["low"]) or not math.isfinite(seen["top"]):
            raise ValueError("labels must be there and finite")
        if classify and (seen["low"] < 0 or seen["top"] > 10_000):
            raise ValueError("classes must be numbered from 0")
        self.outputs = int(seen["top"]) + 1 if classify else 1
        bits = max(1, min(LABEL_BITS, 58 - math.ceil(math.log2(seen["n"] + 1))))
        reach = max(seen["top"] - seen["mean"], seen["mean"] - seen["low"])
        step, middle = (1.0, 0.0) if classify else (reach / (2 ** (bits - 1) - 1) or 1.0, seen["mean"])
        edges = [edges_of(seen[f"p{i}"]) for i in range(len(features))]

        most = max(1 << 10, min(BLOCK, CELLS // max(1, len(features))))

        def packed(batches):
            part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
            for batch in batches:
                y = np.rint((batch.column(0).to_numpy() - middle) / step).astype(np.int32)
                x = np.stack([np.searchsorted(e, batch.column(i + 1).to_numpy(), side="left").astype(np.uint8) for i, e in enumerate(edges)])
                held, size = [*held, (y, x)], size + len(y)
                while size >= most:
                    y, x = (np.concatenate(c, axis=-1) for c in zip(*held))
                    yield block(part, number, y[:most], x[:, :most])
                    held, size, number = [(y[most:], x[:, most:])], size - most, number + 1
            if size:
                yield block(part, number, *(np.concatenate(c, axis=-1) for c in zip(*held)))

        def block(part, number, y, x):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int64()), (number, pa.int64()), (y.tobytes(), pa.binary()), (x.tobytes(), pa.binary()))], ["part", "number", "y", "x"])

        blocks = rows.select(F.col("label").cast("double"), *[F.col(c).cast("double") for c in features]).mapInArrow(
            packed, "part long, number long, y binary, x binary")
        spread = max(TASKS * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(seen["n"] / (most * SHARE)))
        self.blocks = durable(blocks.repartition(spread, "part", "number"))  # a block keeps its name, and so its bags, wherever it goes

    def importances(self, columns: list[int], trees: int, depth: int, seed: int) -> np.ndarray:
        """The share of each of these columns in what splits gain, averaged over trees, of a new forest on these columns alone."""
        p = len(columns)
        k = math.ceil(math.sqrt(p)) if self.classify else math.ceil(p / 3)
        feature, cut, gains, alive = [], [], np.zeros((trees, p)), np.ones((trees, 1), bool)
        for level in range(depth):
            if not alive.any():
                break
            nodes = 1 << level
            drawn = np.random.default_rng([seed, level]).random((trees, nodes, p)).argsort(axis=2)[..., :k]
            sums = self._sums(columns, trees, level, seed, feature, cut, drawn, alive)
            n = sums.sum(axis=-1) if self.classify else sums[..., 0]  # tree, node, feature, bin
            s = sums if self.classify else sums[..., 1:]
            n, s = np.cumsum(n, axis=3), np.cumsum(s, axis=3)
            whole = lambda a, b: (b.astype(float) ** 2).sum(axis=-1) / np.maximum(a, 1)
            right = n[..., -1:] - n
            gain = whole(n, s) + whole(right, s[..., -1:, :] - s) - whole(n[..., -1:], s[..., -1:, :])
            gain = np.where((n > 0) & (right > 0), gain, 0.0)[..., :-1].reshape(trees, nodes, -1)
            best = gain.argmax(axis=2)
            value = np.take_along_axis(gain, best[..., None], axis=2)[..., 0]
            splits = alive & (value > 0)
            where = np.take_along_axis(drawn, (best // (BINS - 1))[..., None], axis=2)[..., 0]
            feature.append(np.where(splits, where, 0))
            cut.append(np.where(splits, best % (BINS - 1), 255).astype(np.uint8))  # all rows of a leaf go left
            np.add.at(gains, (np.nonzero(splits)[0], where[splits]), value[splits])
            alive = np.repeat(splits, 2, axis=1)
        total = gains.sum(axis=1, keepdims=True)
        mean = (gains / np.where(total > 0, total, 1)).sum(axis=0)
        return mean / mean.sum() if mean.sum() else mean

    def _sums(self, columns, trees, level, seed, feature, cut, drawn, alive) -> np.ndarray:
        """Rows and label sums, or class counts, by tree, node, drawn feature and bin."""
        nodes, k, classify, outputs = 1 << level, drawn.shape[2], self.classify, self.outputs
        width = outputs if classify else 2
        size = nodes * BINS
        grows = np.flatnonzero(alive.any(axis=1))
        at_once = max(1, SUMS // (k * size * width))

        def work(batches):
            total = np.zeros((len(growing), k, size, width), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    part, number, yb, xb = (c[i].as_py() for c in batch.columns)
                    y = np.frombuffer(yb, np.int32)
                    x = list(np.frombuffer(xb, np.uint8).reshape(-1, len(y))[columns])
                    y = y.astype(np.int64 if classify else np.float64)
                    for t, into in zip(growing, total):
                        times = bag(seed, int(t), part, number, len(y))
                        ways = []
                        for f, c in zip(feature, cut):
                            ways.append(np.negative(chosen([(x[a] > b).view(np.uint8) for a, b in zip(f[t], c[t])], ways)))
                        node = np.zeros(len(y), np.uint16)
                        for way in ways:
                            node = node * np.uint16(2) + (way & np.uint8(1))
                        node *= np.uint16(BINS)
                        weight = times.astype(np.float64)
                        sums = None if classify else weight * y
                        for j in range(k):
                            key = (node + chosen([x[a] for a in drawn[t, :, j]], ways)).astype(np.intp)
                            if classify:
                                into[j] += np.bincount(key * width + y, weight, size * width).astype(np.int64).reshape(size, width)
                            else:
                                into[j, :, 0] += np.bincount(key, weight, size).astype(np.int64)
                                into[j, :, 1] += np.bincount(key, sums, size).astype(np.int64)
            flat = total.ravel()
            at = np.flatnonzero(flat)
            for lo in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + (1 << 16)]), pa.array(flat[at[lo : lo + (1 << 16)]])], ["at", "v"])

        out = np.zeros((trees, k, size, width), np.int64)
        for lo in range(0, len(grows), at_once):
            growing = grows[lo : lo + at_once]
            got = self.blocks.mapInArrow(work, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # a fixed number of sums
            flat = np.zeros(len(growing) * k * size * width, np.int64)
            flat[got["at"].to_numpy()] = got["v"].to_numpy()
            out[growing] = flat.reshape(len(growing), k, size, width)
        return out.reshape(trees, k, nodes, BINS, width).transpose(0, 2, 1, 3, 4)
