"""Linear models learned epoch by epoch from mini-batches, averaged over shards of the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.durable import durable
from tablecraft.operators.neighbors import as_array

#: Rows of a shard, fewest shards, and models that are averaged in one place.
SHARD_ROWS, LEAST_SHARDS, FAN = 100_000, 8, 256
SQUARED, LOG, PERCEPTRON = "squared", "log", "perceptron"
SUMS = ("n", "loss", "right", "error", "y", "yy")


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x times each model's weights, the last of which is the intercept."""
    return x @ w[:-1] + w[-1]


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def stepped(w: np.ndarray, x: np.ndarray, y: np.ndarray, loss: str, step: float, l2: float) -> np.ndarray:
    """The weights after one mini-batch."""
    m = margins(x, w)
    if loss == SQUARED:
        g = m - y[:, None]
    else:
        truth = np.zeros_like(m)
        truth[np.arange(len(y)), y.astype(int)] = 1.0
        if loss == LOG:
            g = softmax(m) - truth
        else:  # mistakes alone move the weights
            called = np.zeros_like(m)
            called[np.arange(len(y)), m.argmax(axis=1)] = 1.0
            g = called - truth
    change = np.concatenate([x.T @ g / len(x), g.mean(axis=0, keepdims=True)])
    change[:-1] += l2 * w[:-1]
    return w - step * change


def row_losses(m: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Of margins (rows, epochs, outputs): each row's loss after each epoch."""
    if loss == SQUARED:
        return (m[:, :, 0] - y[:, None]) ** 2
    truth = y.astype(int)
    own = np.take_along_axis(m, np.broadcast_to(truth[:, None, None], (*m.shape[:2], 1)), axis=2)[:, :, 0]
    if loss == LOG:
        top = m.max(axis=2)
        return np.log(np.exp(m - top[:, :, None]).sum(axis=2)) + top - own
    other = m.copy()
    np.put_along_axis(other, np.broadcast_to(truth[:, None, None], (*m.shape[:2], 1)), -np.inf, axis=2)
    return np.maximum(0.0, other.max(axis=2) - own)


class PartialFit:
    """Squared loss, softmax log loss or the perceptron's, by stochastic gradient steps.

    Rows belong to shards by a hash of all their columns and have a fixed order in a shard, so results don't depend on how the table is
    partitioned. In each epoch every shard goes through its rows in mini-batches from the common weights; the shards' weights are averaged,
    in a tree where there are many. A task streams its rows and holds one mini-batch and one model. Rows should be told apart by some
    column, such as a key; many equal rows would share a shard. Features should be of one scale. Rows with a missing label or feature are
    left out; NaN counts as missing."""

    def __init__(self, loss: str = SQUARED, epochs: int = 20, step: float = 0.05, decay: float = 0.2, batch: int = 32, l2: float = 1e-4, features: str = "features", label: str = "label"):
        self.loss, self.epochs, self.step, self.decay, self.batch, self.l2 = loss, epochs, step, decay, batch, l2
        self.features, self.label = features, label

    def rows(self, df: DataFrame) -> DataFrame:
        x, y = as_array(df, self.features), col(self.label).cast("double")
        rest = [col(c) for c in df.columns if c not in (self.features, self.label)]
        kept = df.select(x.alias("x"), y.alias("y"), F.xxhash64(x, y, *rest).alias("h1"), F.xxhash64(F.lit(7), x, y, *rest).alias("h2"))
        return kept.where("y IS NOT NULL AND NOT isnan(y) AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))")

    def fit(self, df: DataFrame) -> "PartialFitModel":
        rows = self.rows(df)
        seen = rows.agg(F.count("*").alias("n"), F.max("y").alias("top"), F.min("y").alias("low"), F.max(F.size("x")).alias("p")).first()
        if not seen["n"]:
            raise ValueError("no training rows with a label and all features")
        if self.loss != SQUARED and (seen["low"] < 0 or seen["top"] > 10_000):
            raise ValueError("classes must be numbered from 0")
        outputs = 1 if self.loss == SQUARED else max(2, int(seen["top"]) + 1)
        shards = max(LEAST_SHARDS, math.ceil(seen["n"] / SHARD_ROWS))
        dealt = rows.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "h2", "h1")
        dealt = durable(dealt.select("shard", "x", "y"))
        w, weights = np.zeros((seen["p"] + 1, outputs)), []
        for epoch in range(self.epochs):
            w = averaged(self.epoch(dealt, w, self.step / (1 + self.decay * epoch)), w.shape)
            weights.append(w)
        return PartialFitModel(self.loss, np.stack(weights), self.features, self.label)

    def epoch(self, dealt: DataFrame, start: np.ndarray, step: float) -> DataFrame:
        """(at, n, w): each shard's weights after its rows."""
        loss, batch, l2 = self.loss, self.batch, self.l2

        def out(shard, n, w):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([w.ravel().tolist()], pa.list_(pa.float64()))], ["at", "n", "w"])

        def work(batches):
            shard, w, n, x, y = None, None, 0, None, None
            for rows in batches:
                numbers = rows.column(0).to_numpy()
                if not len(numbers):
                    continue
                xs = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
                ys = rows.column(2).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
                for a, b in zip(edges, edges[1:]):
                    if numbers[a] != shard:
                        if shard is not None:
                            w = stepped(w, x, y, loss, step, l2) if len(y) else w
                            yield out(shard, n, w)
                        shard, w, n, x, y = int(numbers[a]), start, 0, xs[:0], ys[:0]
                    x, y, n = np.concatenate([x, xs[a:b]]), np.concatenate([y, ys[a:b]]), n + b - a
                    for s in range(0, len(y) - batch + 1, batch):
                        w = stepped(w, x[s : s + batch], y[s : s + batch], loss, step, l2)
                    done = len(y) // batch * batch
                    x, y = x[done:], y[done:]
            if shard is not None:
                yield out(shard, n, stepped(w, x, y, loss, step, l2) if len(y) else w)

        return dealt.mapInArrow(work, "at int, n long, w array<double>")


def averaged(models: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The mean of models, weighted by their rows and taken in the order of their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, total = None, 0, None
        def out():
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).tolist()], pa.list_(pa.float64()))], ["at", "n", "w"])
        for rows in batches:
            for r in rows.to_pylist():
                if r["at"] // FAN != group:
                    if group is not None:
                        yield out()
                    group, n, total = r["at"] // FAN, 0, 0.0
                n, total = n + r["n"], total + r["n"] * np.array(r["w"])
        if group is not None:
            yield out()

    models = durable(models)
    while models.count() > FAN:
        models = durable(models.repartition(F.floor(F.col("at") / FAN)).sortWithinPartitions("at").mapInArrow(work, "at int, n long, w array<double>"))
    got = sorted(models.collect(), key=lambda r: r["at"])  # FAN models at most
    return (sum(r["n"] * np.array(r["w"]) for r in got) / sum(r["n"] for r in got)).reshape(shape)


class PartialFitModel:
    """The weights after each epoch; the last ones predict."""

    def __init__(self, loss: str, weights: np.ndarray, features: str = "features", label: str = "label"):
        self.loss, self.weights, self.features, self.label = loss, weights, features, label

    @property
    def coefficientMatrix(self):
        return _Matrix(self.weights[-1][:-1].T)

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with prediction (and probability for the log loss); null where a feature is missing."""
        w, loss = self.weights[-1], self.loss

        @F.arrow_udf("array<double>")
        def outputs(x: pa.Array) -> pa.Array:
            m = margins(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), w) if len(x) else np.zeros((0, w.shape[1]))
            m = softmax(m) if loss == LOG else m
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(m.ravel()))

        x = as_array(df, self.features)
        whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
        blank = F.array_repeat(F.lit(0.0), len(w) - 1)
        out = df.withColumn("__m", outputs(F.when(whole, x).otherwise(blank)))
        if loss == SQUARED:
            return out.withColumn("prediction", F.when(whole, F.get("__m", F.lit(0)))).drop("__m")
        out = out.withColumn("prediction", F.when(whole, F.array_position("__m", F.array_max("__m")) - 1).cast("double"))
        return (out.withColumn("probability", F.when(whole, array_to_vector("__m"))) if loss == LOG else out).drop("__m")

    def scores(self, df: DataFrame) -> dict[int, tuple[float | None, float | None]]:
        """(score, mean loss) of every epoch's weights on rows with label and features, all in one pass: accuracy, or r2 for squared loss."""
        weights, loss = self.weights, self.loss
        rows = PartialFit(loss, features=self.features, label=self.label).rows(df).select("x", "y")
        centre = (rows.agg(F.avg("y").alias("m")).first()["m"] or 0.0) if loss == SQUARED else 0.0
        flat = np.concatenate(list(weights), axis=1)  # the epochs side by side
        epochs, outputs = weights.shape[0], weights.shape[2]

        def work(batches):
            total = np.zeros((epochs, len(SUMS)))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)
                m = margins(x, flat).reshape(len(y), epochs, outputs)
                losses = row_losses(m, y, loss).sum(axis=0)
                right = (m.argmax(axis=2) == y[:, None]).sum(axis=0) if loss != SQUARED else np.zeros(epochs)
                off = y - centre
                total += np.stack([np.full(epochs, len(y)), losses, right, losses, np.full(epochs, off.sum()), np.full(epochs, (off * off).sum())], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, epochs + 1), pa.int32()), *(pa.array(c) for c in total.T)], ["epoch", *SUMS])

        sums = rows.mapInArrow(work, "epoch int, " + ", ".join(f"{s} double" for s in SUMS)).groupBy("epoch").agg(*[F.sum(s).alias(s) for s in SUMS])
        out = {}
        for r in sums.collect():  # a row for each epoch
            if not r["n"]:
                continue
            spread = r["yy"] - r["y"] ** 2 / r["n"]
            score = (1 - r["error"] / spread if spread > 0 else None) if loss == SQUARED else r["right"] / r["n"]
            out[r["epoch"]] = (score, r["loss"] / r["n"])
        return out

    def history(self, train: DataFrame, val: DataFrame) -> list[tuple]:
        """(epoch, train score, validation score, train loss, validation loss), all measured."""
        a, b = self.scores(train), self.scores(val)
        none = (None, None)
        return [(e, a.get(e, none)[0], b.get(e, none)[0], a.get(e, none)[1], b.get(e, none)[1]) for e in range(1, len(self.weights) + 1)]


class _Matrix:
    def __init__(self, values: np.ndarray):
        self.values = values

    def toArray(self) -> np.ndarray:
        return self.values
