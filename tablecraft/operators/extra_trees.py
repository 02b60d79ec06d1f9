"""Extremely randomised trees: drawn features and drawn thresholds, grown level by level on sums of all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.operators.neighbors import as_array
from tablecraft.settings import SETTINGS

#: Numbers that one pass may add up, in each task and on the driver; trees of a level share passes up to it.
SUMS = 2_000_000
#: Labels of a regression become whole numbers of at most so many bits, so that sums are exact on any partitioning.
LABEL_BITS = 36
#: Values beyond are taken as this, so that ranges stay finite.
FAR = 1e300
SCORED = 10


@dataclass
class Tree:
    """Nodes in the order of their making; `feature` is -1 at leaves, and the child for larger values follows `left`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray  # class shares, or one mean
    importance: np.ndarray


@dataclass
class Growing:
    number: int
    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [None])
    importance: np.ndarray | None = None
    open: list = field(default_factory=lambda: [0])  # nodes of the level that may split

    def arrays(self):
        return np.array(self.feature), np.array(self.threshold), np.array(self.left)


def reached(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node at which each row's way ends."""
    at = np.zeros(len(x), np.int64)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        node = at[moving]
        at[moving] = left[node] + (x[moving, feature[node]] > threshold[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.clip(x, -FAR, FAR), batch.column(1).to_numpy(zero_copy_only=False)


class ExtraTrees:
    """A forest whose nodes draw `columns` features and one threshold for each between the node's smallest and largest value; the best of
    these splits is taken. Every tree learns from all rows.

    Two aggregates a level, over all trees at once: ranges of the drawn features, then class counts (or label sums) left of the thresholds.
    Tasks send sums whose number depends on trees, depth and columns, never on rows. Draws depend on seed, tree and node, and sums are of
    whole numbers, so the forest is the same on any partitioning. Rows with a missing label or feature (NaN counts as missing) are left out.
    Infinite values count as 1e300. Without rows `fit` refuses."""

    def __init__(self, numTrees: int = 100, maxDepth: int = 8, classify: bool = True, columns: int | None = None, minRows: int = 2,
                 seed: int = SETTINGS.random_state, features: str = "features", label: str = "label"):
        self.trees, self.depth, self.classify, self.columns, self.least, self.seed = numTrees, maxDepth, classify, columns, minRows, seed
        self.features, self.label = features, label

    def rows(self, df: DataFrame) -> DataFrame:
        kept = df.select(as_array(df, self.features).alias("x"), col(self.label).cast("double").alias("y"))
        return kept.where("y IS NOT NULL AND NOT isnan(y) AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))")

    def fit(self, df: DataFrame) -> "ExtraTreesModel":
        rows = self.rows(df)
        seen = rows.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("top"), F.max(F.size("x")).alias("p")).first()
        if not seen["n"]:
            raise ValueError("no training rows with a label and all features")
        if self.classify:
            if seen["low"] < 0 or seen["top"] > 10_000:
                raise ValueError("classes must be numbered from 0")
            outputs, low, step = int(seen["top"]) + 1, 0.0, 1.0
            rows = rows.select("x", F.col("y").cast("long").alias("y"))
        else:
            if math.isinf(seen["low"]) or math.isinf(seen["top"]):
                raise ValueError("labels must be finite")
            bits = max(1, min(LABEL_BITS, 62 - math.ceil(math.log2(seen["n"] + 1))))
            outputs, low = 1, seen["low"]
            step = (seen["top"] - low) / 2**bits or 1.0
            rows = rows.select("x", F.round((F.col("y") - low) / step).cast("long").alias("y"))
        p = seen["p"]
        if not p:
            raise ValueError("there are no features")
        k = min(p, self.columns or (max(1, round(math.sqrt(p))) if self.classify else p))
        forest = [Growing(t, importance=np.zeros(p)) for t in range(self.trees)]
        for depth in range(self.depth + 1):
            last = depth == self.depth
            waiting = [t for t in forest if t.open]
            while waiting:
                part, size = [], 0
                while waiting and (not part or size + len(waiting[0].open) * k * (outputs + 1) <= SUMS):
                    size += len(waiting[0].open) * k * (outputs + 1)
                    part.append(waiting.pop(0))
                self._level(rows, part, k, p, outputs, last)
        return ExtraTreesModel([self._finished(t, low, step) for t in forest], self.classify, p, self.features, self.label)

    def _finished(self, t: Growing, low: float, step: float) -> Tree:
        feature, threshold, left = t.arrays()
        value = np.array(t.value, float)
        total = t.importance.sum()
        return Tree(feature, threshold, left, value if self.classify else low + step * value, t.importance / total if total else t.importance)

    def _level(self, rows: DataFrame, part: list[Growing], k: int, p: int, outputs: int, last: bool) -> None:
        """Splits the open nodes of these trees, or makes leaves of them."""
        starts = np.cumsum([0, *(len(t.open) for t in part)])
        draws, columns, spots = starts[-1], [], []
        for t in part:
            for node in t.open:
                rng = np.random.default_rng([self.seed, t.number, node])
                columns.append(rng.permutation(p)[:k])
                spots.append(rng.random(k))
        columns, spots = np.array(columns), np.array(spots)
        ways = [(*t.arrays(), t.open) for t in part]

        def slots(x):
            """For each tree: the rows in its open nodes, and their nodes' numbers among all open nodes."""
            for (feature, threshold, left, nodes), first in zip(ways, starts):
                number = np.full(len(feature), -1)
                number[nodes] = np.arange(first, first + len(nodes))
                at = number[reached(x, feature, threshold, left)]
                held = np.flatnonzero(at >= 0)
                yield held, at[held]

        def ranges(batches):
            low, high = np.full((draws, k), np.inf), np.full((draws, k), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, _ = _rows(batch)
                for held, at in slots(x):
                    if len(held):
                        order = np.argsort(at, kind="stable")
                        held, at = held[order], at[order]
                        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        v, node = x[held[:, None], columns[at]], at[edges]
                        low[node] = np.minimum(low[node], np.minimum.reduceat(v, edges))
                        high[node] = np.maximum(high[node], np.maximum.reduceat(v, edges))
            seen = np.flatnonzero(np.isfinite(low.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low.ravel()[seen]), pa.array(high.ravel()[seen])], ["at", "low", "high"])

        classify, width = self.classify, outputs if self.classify else 2  # counts of classes, or rows and label sum

        def sums(x, y, at, n):
            """Class counts, or rows and label sums, of the keys `at`."""
            if classify:
                return np.bincount(at * width + y, minlength=n * width).astype(np.int64).reshape(n, width)
            return np.stack([np.bincount(at, minlength=n), np.bincount(at, y, minlength=n)], axis=1).astype(np.int64)

        def counts(batches):
            whole, under = np.zeros((draws, width), np.int64), np.zeros((draws * k, width), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _rows(batch)
                for held, at in slots(x):
                    if not len(held):
                        continue
                    base, n = at.min(), at.max() - at.min() + 1
                    whole[base : base + n] += sums(x, y[held], at - base, n)
                    if cuts is not None:
                        left, c = np.nonzero(x[held[:, None], columns[at]] <= cuts[at])
                        under[base * k : (base + n) * k] += sums(x, y[held[left]], (at[left] - base) * k + c, n * k)
            all_sums = np.concatenate([whole.ravel(), under.ravel()])
            seen = np.flatnonzero(all_sums)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(all_sums[seen])], ["at", "v"])

        cuts = None
        if not last:
            got = rows.mapInArrow(ranges, "at long, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
            low, high = np.zeros(draws * k), np.zeros(draws * k)
            low[got["at"].to_numpy()], high[got["at"].to_numpy()] = got["low"].to_numpy(), got["high"].to_numpy()
            low, high = low.reshape(draws, k), high.reshape(draws, k)
            cuts = low + spots * (high - low)
            cuts = np.where(cuts < high, cuts, low)  # the largest value is never left of the threshold
        got = rows.mapInArrow(counts, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(draws * width * (k + 1), np.int64)
        flat[got["at"].to_numpy()] = got["v"].to_numpy()
        whole, under = flat[: draws * width].reshape(draws, width), flat[draws * width :].reshape(draws, k, width)
        n, middle = _means(whole, classify)
        gains, best = np.zeros(draws), np.zeros(draws, int)
        if not last:
            a, left = _means(under, classify)
            b, right = _means(whole[:, None, :] - under, classify)
            gain = a * b / np.maximum(n, 1)[:, None] * ((left - right) ** 2).sum(axis=-1)
            best = gain.argmax(axis=1)
            gains = np.take_along_axis(gain, best[:, None], axis=1)[:, 0]
        for t, first in zip(part, starts):
            opened = []
            for i, node in enumerate(t.open, start=int(first)):
                t.value[node] = middle[i]
                if gains[i] > 0 and n[i] >= self.least:
                    t.feature[node], t.threshold[node], t.left[node] = int(columns[i, best[i]]), float(cuts[i, best[i]]), len(t.feature)
                    t.importance[columns[i, best[i]]] += gains[i]
                    opened += [len(t.feature), len(t.feature) + 1]
                    for _ in range(2):
                        t.feature.append(-1)
                        t.threshold.append(0.0)
                        t.left.append(-1)
                        t.value.append(None)
            t.open = opened


def _means(sums: np.ndarray, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and class shares or the mean label, of sums along the last axis."""
    n = sums.sum(axis=-1) if classify else sums[..., 0]
    return n, (sums if classify else sums[..., 1:]) / np.maximum(n, 1)[..., None]


class ExtraTreesModel:
    """The mean of all trees' class shares, or of their means."""

    def __init__(self, trees: list[Tree], classify: bool, n_features: int, features: str = "features", label: str = "label"):
        self.trees, self.classify, self.n_features, self.features, self.label = trees, classify, n_features, features, label

    @property
    def featureImportances(self) -> np.ndarray:
        """The share of each feature in what splits gain, averaged over trees."""
        mean = np.mean([t.importance for t in self.trees], axis=0)
        return mean / mean.sum() if mean.sum() else mean

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with prediction (and probability for classes); null where a feature is missing."""
        trees, width = self.trees, self.trees[0].value.shape[1]

        @F.arrow_udf("array<double>")
        def outputs(x: pa.Array) -> pa.Array:
            rows = np.clip(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), -FAR, FAR) if len(x) else np.zeros((0, 1))
            total = np.zeros((len(x), width))
            for t in trees:
                total += t.value[reached(rows, t.feature, t.threshold, t.left)]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array((total / len(trees)).ravel()))

        x = as_array(df, self.features)
        whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
        out = df.withColumn("__m", outputs(F.when(whole, x).otherwise(F.array_repeat(F.lit(0.0), self.n_features))))
        if not self.classify:
            return out.withColumn("prediction", F.when(whole, F.get("__m", F.lit(0)))).drop("__m")
        out = out.withColumn("prediction", F.when(whole, F.array_position("__m", F.array_max("__m")) - 1).cast("double"))
        return out.withColumn("probability", F.when(whole, array_to_vector("__m"))).drop("__m")  # no vector is made of a missing array

    def scores(self, df: DataFrame) -> dict[int, float | None]:
        """Accuracy, or r2, of the first 1..n trees, all prefixes in one pass."""
        marks = sorted({max(1, round(len(self.trees) * (i + 1) / SCORED)) for i in range(SCORED)})
        trees, classify = self.trees, self.classify
        rows = ExtraTrees(features=self.features, label=self.label).rows(df)
        centre = (rows.agg(F.avg("y").alias("m")).first()["m"] or 0.0) if not classify else 0.0

        def work(batches):
            total = np.zeros((len(marks), 4))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _rows(batch)
                votes, off = np.zeros((len(y), trees[0].value.shape[1])), y - centre
                for i, t in enumerate(trees, start=1):
                    votes += t.value[reached(x, t.feature, t.threshold, t.left)]
                    if i in marks:
                        measure = (votes.argmax(axis=1) == y).sum() if classify else ((y - votes[:, 0] / i) ** 2).sum()
                        total[marks.index(i)] += [len(y), measure, off.sum(), (off * off).sum()]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), *(pa.array(c) for c in total.T)], ["trees", "n", "s", "y", "yy"])

        sums = rows.mapInArrow(work, "trees int, n double, s double, y double, yy double").groupBy("trees").agg(*[F.sum(c).alias(c) for c in ("n", "s", "y", "yy")])
        out = {}
        for r in sorted(sums.collect(), key=lambda r: r["trees"]):  # a row for each prefix
            if r["n"]:
                spread = r["yy"] - r["y"] ** 2 / r["n"]
                out[r["trees"]] = r["s"] / r["n"] if classify else (1 - r["s"] / spread if spread > 0 else None)
        return out

    def history(self, train: DataFrame, val: DataFrame) -> list[tuple]:
        """(trees, train score, validation score, None, None) of prefixes of the forest."""
        a, b = self.scores(train), self.scores(val)
        return [(m, a.get(m), b.get(m), None, None) for m in sorted(set(a) | set(b))]
