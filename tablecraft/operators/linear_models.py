"""Linear regressors from one aggregate of cross-products, and robust ones from minimal samples of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.durable import durable
from tablecraft.functions.statistics import quantiles
from tablecraft.operators.neighbors import as_array

#: Most hypotheses of a consensus search, the share of good rows it counts on, and its confidence.
HYPOTHESES, GOOD_SHARE, CONFIDENCE = 1_000, 0.5, 0.999
#: Rows in a shard whose minimal samples are solved together.
SHARD_ROWS = 50_000


class _Vector:
    def __init__(self, values):
        self.values = np.asarray(values, float)

    def toArray(self) -> np.ndarray:
        return self.values


@dataclass
class LinearFit:
    """Coefficients and intercept; `covariance` and `noise` (a variance) where a fit gives them, around the features' `centre`."""

    weights: np.ndarray
    intercept: float
    features: str = "features"
    covariance: np.ndarray | None = None
    noise: float | None = None
    centre: np.ndarray | None = None
    path: list[tuple[float, np.ndarray]] = field(default_factory=list)

    @property
    def coefficients(self) -> _Vector:
        return _Vector(self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with prediction, and with deviation (of a new observation) if the fit has a covariance; null where a feature is missing."""
        x = as_array(df, self.features)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
        out = df.withColumn("prediction", dot(x, literal(self.weights)) + F.lit(float(self.intercept)))
        if self.covariance is None:
            return out
        root = np.linalg.cholesky(self.covariance + 1e-300 * np.eye(len(self.weights))) if len(self.weights) and np.any(self.covariance) else np.zeros((len(self.weights), 0))
        off = F.zip_with(x, literal(self.centre), lambda a, b: a - b)
        spread = sum((F.pow(dot(off, literal(column)), 2) for column in root.T), F.lit(0.0))
        return out.withColumn("deviation", F.when(F.col("prediction").isNotNull(), F.sqrt(spread + F.lit(float(self.noise)))))


def usable_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """x (array<double>), y and a hash of all columns, for rows with a label and all features."""
    x, y = as_array(df, features), col(label).cast("double")
    rest = [col(c) for c in df.columns if c not in (features, label)]
    rows = df.select(x.alias("x"), y.alias("y"), F.xxhash64(x, y, *rest).alias("h"))
    return rows.where("y IS NOT NULL AND NOT isnan(y) AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))")


@dataclass
class Gram:
    n: int
    mean: np.ndarray  # of the features, and of the label last
    products: np.ndarray  # of centred features and label, summed over rows

    @property
    def xx(self) -> np.ndarray:
        return self.products[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.products[:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.products[-1, -1])


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.concatenate([x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1)


def summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over rows of a vector of numbers; a task sends one row for each number."""

    def work(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(stacked(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "y").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # `size` rows
        out[r["at"]] = r["v"]
    return out


def gram(df: DataFrame, features: str = "features", label: str = "label", rows: DataFrame | None = None) -> Gram:
    """Means in one pass, products of centred columns in a second; what meets is of the size of the columns' square, whatever the rows."""
    rows = usable_rows(df, features, label) if rows is None else rows
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
    n, p = first["n"], (first["p"] or 0) + 1
    if not n:
        raise ValueError("no rows with a label and all features")
    mean = summed(rows, lambda z: z.sum(axis=0), p) / n
    products = summed(rows, lambda z: ((z - mean).T @ (z - mean)).ravel(), p * p).reshape(p, p)
    return Gram(n, mean, (products + products.T) / 2)


def with_intercept(g: Gram, weights: np.ndarray, features: str, **more) -> LinearFit:
    return LinearFit(weights, float(g.mean[-1] - g.mean[:-1] @ weights), features, **more)


class BayesianRidge:
    """Ridge regression whose penalty and noise are found by maximising the evidence; predictions have a deviation."""

    def __init__(self, iterations: int = 300, tolerance: float = 1e-3, prior: float = 1e-6, features: str = "features", label: str = "label"):
        self.iterations, self.tolerance, self.prior, self.features, self.label = iterations, tolerance, prior, features, label

    def fit(self, df: DataFrame) -> LinearFit:
        return self.solve(gram(df, self.features, self.label))

    def solve(self, g: Gram) -> LinearFit:
        values, vectors = np.linalg.eigh(g.xx)
        values = np.maximum(values, 0.0)
        turned = vectors.T @ g.xy
        noise_precision, precision = g.n / max(g.yy, 1e-300), 1.0
        w = None
        for _ in range(self.iterations):
            new = vectors @ (turned / (values + precision / noise_precision))
            error = max(g.yy - 2 * new @ g.xy + new @ g.xx @ new, 0.0)
            known = (noise_precision * values / (precision + noise_precision * values)).sum()
            precision = (known + 2 * self.prior) / (new @ new + 2 * self.prior)
            noise_precision = (g.n - known + 2 * self.prior) / (error + 2 * self.prior)
            if w is not None and np.abs(w - new).sum() < self.tolerance:
                break
            w = new
        w = vectors @ (turned / (values + precision / noise_precision))
        covariance = vectors @ np.diag(1 / (precision + noise_precision * values)) @ vectors.T
        return with_intercept(g, w, self.features, covariance=covariance, noise=1 / noise_precision, centre=g.mean[:-1])


class ARDRegression:
    """The same with a precision for each coefficient: those that the data don't need are pruned to 0."""

    def __init__(self, iterations: int = 300, tolerance: float = 1e-3, prior: float = 1e-6, most: float = 1e4, features: str = "features", label: str = "label"):
        self.iterations, self.tolerance, self.prior, self.most, self.features, self.label = iterations, tolerance, prior, most, features, label

    def fit(self, df: DataFrame) -> LinearFit:
        return self.solve(gram(df, self.features, self.label))

    def solve(self, g: Gram) -> LinearFit:
        p = len(g.xy)
        noise_precision, precision, kept, w = g.n / max(g.yy, 1e-300), np.ones(p), np.ones(p, bool), np.zeros(p)

        def posterior():
            sigma = np.linalg.inv(np.diag(precision[kept]) + noise_precision * g.xx[np.ix_(kept, kept)])
            return sigma, noise_precision * sigma @ g.xy[kept]

        for _ in range(self.iterations):
            sigma, some = posterior()
            new = np.zeros(p)
            new[kept] = some
            error = max(g.yy - 2 * new @ g.xy + new @ g.xx @ new, 0.0)
            known = 1 - precision[kept] * np.diag(sigma)
            precision[kept] = (known + 2 * self.prior) / (some**2 + 2 * self.prior)
            noise_precision = (g.n - known.sum() + 2 * self.prior) / (error + 2 * self.prior)
            kept = kept & (precision < self.most)
            new[~kept] = 0.0
            done, w = np.abs(w - new).sum() < self.tolerance, new
            if done or not kept.any():
                break
        covariance, w = np.zeros((p, p)), np.zeros(p)
        if kept.any():
            sigma, w[kept] = posterior()
            covariance[np.ix_(kept, kept)] = sigma
        return with_intercept(g, w, self.features, covariance=covariance, noise=1 / noise_precision, centre=g.mean[:-1])


def homotopy(g: Gram, drop: bool, least: float = 0.0) -> list[tuple[float, np.ndarray]]:
    """Every knot (largest absolute product of residual and standardised feature, coefficients of standardised features) of least angle
    regression, or of the lasso where a coefficient that reaches 0 leaves (`drop`), down to the penalty `least`."""
    p = len(g.xy)
    w, active, knots = np.zeros(p), [], []
    signs = np.zeros(p)
    tiny = 1e-12 * max(1.0, np.abs(g.xy).max(initial=0.0))
    barred = -1
    while True:
        c = g.xy - g.xx @ w
        level = np.abs(c).max(initial=0.0) if not active else np.abs(c[active]).max()
        if not knots or abs(level - knots[-1][0]) > tiny:
            knots.append((float(level), w.copy()))
        if level <= max(least, tiny):
            break
        for j in range(p):
            if j not in active and j != barred and abs(c[j]) >= level - 1e-10 * max(level, 1e-300) and g.xx[j, j] > 0:
                rest = g.xx[j, j] - (g.xx[j, active] @ np.linalg.lstsq(g.xx[np.ix_(active, active)], g.xx[active, j], rcond=None)[0] if active else 0.0)
                if rest > 1e-10 * g.xx[j, j]:  # otherwise it lies in what the others span
                    active.append(j)
                    signs[j] = np.sign(c[j])
        barred = -1
        if not active:
            break
        way = np.linalg.solve(g.xx[np.ix_(active, active)], signs[active])
        pull = g.xx[:, active] @ way
        reach, leaving = level - least, -1
        for j in range(p):
            if j not in active and g.xx[j, j] > 0:
                for top, bottom in ((level - c[j], 1 - pull[j]), (level + c[j], 1 + pull[j])):
                    if bottom > 1e-12 and tiny < top / bottom < reach:
                        reach = top / bottom
        if drop:
            for k, j in enumerate(active):
                if way[k] * w[j] < 0 and tiny < -w[j] / way[k] < reach:
                    reach, leaving = -w[j] / way[k], k
        w[active] = w[active] + reach * way
        if leaving >= 0:
            barred = active.pop(leaving)
            w[barred] = 0.0
        elif reach >= level - least - tiny:
            knots.append((float(level - reach), w.copy()))
            break
        if len(knots) > 8 * (p + 1):
            break
    return knots


class LeastAngle:
    """Least angle regression (`penalty` 0 goes to least squares) or, with `lasso`, the lasso for `penalty`, with every knot of the path."""

    def __init__(self, lasso: bool = False, penalty: float = 0.0, features: str = "features", label: str = "label"):
        self.lasso, self.penalty, self.features, self.label = lasso, penalty, features, label

    def fit(self, df: DataFrame) -> LinearFit:
        return self.solve(gram(df, self.features, self.label))

    def solve(self, g: Gram) -> LinearFit:
        """Path entries: (penalty as the lasso counts it, on features of deviation 1 and rows in the mean; coefficients in the units of the
        features)."""
        scale = np.sqrt(np.diag(g.xx) / g.n)
        safe = np.where(scale > 0, scale, 1.0)
        unit = Gram(g.n, g.mean, g.products / np.outer(np.r_[safe, 1.0], np.r_[safe, 1.0]))
        knots = homotopy(unit, self.lasso, self.penalty * g.n)
        path = [(level / g.n, w / safe) for level, w in knots]
        return with_intercept(g, path[-1][1], self.features, path=path)


# --- robust fits -------------------------------------------------------------------------------


def solved(z: np.ndarray) -> np.ndarray | None:
    """The plane through as many rows as it has coefficients; None if they don't fix one."""
    a = np.concatenate([z[:, :-1], np.ones((len(z), 1))], axis=1)
    if np.linalg.cond(a) > 1e10:
        return None
    return np.linalg.solve(a, z[:, -1])


class RANSAC:
    """The plane with the most rows near it, fitted to those rows.

    Hypotheses are planes through minimal samples, which are the rows with the least hashes, so they don't depend on the partitioning; all
    of them count their near rows in one pass. `threshold` tells how near; if it isn't given, the median distance of labels from their
    median. The best plane is fitted again to the rows within three robust deviations until the same rows stay."""

    def __init__(self, threshold: float | None = None, hypotheses: int | None = None, rounds: int = 5, features: str = "features", label: str = "label"):
        self.threshold, self.hypotheses, self.rounds, self.features, self.label = threshold, hypotheses, rounds, features, label

    def fit(self, df: DataFrame) -> LinearFit:
        rows = usable_rows(df, self.features, self.label)
        p = rows.agg(F.max(F.size("x")).alias("p")).first()["p"]
        if p is None:
            raise ValueError("no rows with a label and all features")
        tries = self.hypotheses or min(HYPOTHESES, math.ceil(math.log(1 - CONFIDENCE) / math.log(1 - GOOD_SHARE ** (p + 1))))
        sample = rows.orderBy("h", "y").limit(tries * (p + 1)).select("x", "y").collect()  # bounded by HYPOTHESES
        z = np.array([[*r["x"], r["y"]] for r in sample])
        planes = [s for s in (solved(z[i : i + p + 1]) for i in range(0, len(z) - p, p + 1)) if s is not None]
        g = gram(df, rows=rows)
        if not planes:
            return with_intercept(g, np.linalg.lstsq(g.xx, g.xy, rcond=None)[0], self.features)
        threshold = self.threshold
        if threshold is None:
            middle = quantiles(rows, ["y"], [0.5])["y"][0]
            threshold = quantiles(rows.select(F.abs(F.col("y") - F.lit(middle)).alias("d")), ["d"], [0.5])["d"][0]
        planes = np.array(planes).T

        def near(z):
            off = np.abs(z[:, :-1] @ planes[:-1] + planes[-1] - z[:, -1:])
            good = off <= threshold
            return np.concatenate([good.sum(axis=0), np.where(good, off, 0.0).sum(axis=0)])

        counts = summed(rows, near, 2 * planes.shape[1])
        k = planes.shape[1]
        best = planes[:, min(range(k), key=lambda i: (-counts[i], counts[k + i], i))]
        least = 1e-9 * math.sqrt(max(g.yy / g.n, 0.0))
        before = None
        for _ in range(self.rounds):
            error = F.abs(F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in best[:-1]]), lambda a, b: a * b), F.lit(float(best[-1])), lambda s, v: s + v) - F.col("y"))
            judged = rows.withColumn("d", error)
            middle = quantiles(judged, ["d"], [0.5])["d"][0]
            inside = judged.where(F.col("d") <= max(3 * 1.4826 * middle, least))
            again = gram(df, rows=inside.select("x", "y"))
            if again.n <= p:
                break
            w = np.linalg.lstsq(again.xx, again.xy, rcond=None)[0]
            best = np.r_[w, again.mean[-1] - again.mean[:-1] @ w]
            if again.n == before:
                break
            before = again.n
        return LinearFit(best[:-1], float(best[-1]), self.features)


class TheilSen:
    """The spatial median of planes through minimal samples that together use every row once.

    Rows are dealt to shards and ordered in them by hash, and each run of as many rows as a plane needs gives one; the median is found by
    Weiszfeld's steps, each one aggregate over the planes."""

    def __init__(self, steps: int = 60, features: str = "features", label: str = "label"):
        self.steps, self.features, self.label = steps, features, label

    def fit(self, df: DataFrame) -> LinearFit:
        rows = usable_rows(df, self.features, self.label)
        seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
        if not seen["n"]:
            raise ValueError("no rows with a label and all features")
        p, shards = seen["p"], math.ceil(seen["n"] / SHARD_ROWS)
        dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "h", "y")

        def planes(batches):
            rest, shard = np.zeros((0, p + 1)), None
            for b in batches:
                if not b.num_rows:
                    continue
                z, numbers = stacked(b), b.column(2).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
                found = []
                for s, e in zip(edges, edges[1:]):
                    rest = np.concatenate([rest, z[s:e]]) if numbers[s] == shard else z[s:e]
                    shard = numbers[s]
                    done = len(rest) // (p + 1) * (p + 1)
                    found += [w for w in (solved(rest[i : i + p + 1]) for i in range(0, done, p + 1)) if w is not None]
                    rest = rest[done:]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([w[:-1].tolist() for w in found], pa.list_(pa.float64())), pa.array([w[-1] for w in found])], ["x", "y"])

        solutions = durable(dealt.select("x", "y", "shard").mapInArrow(planes, "x array<double>, y double"))
        total = solutions.count()
        if not total:
            g = gram(df, rows=rows)
            return with_intercept(g, np.linalg.lstsq(g.xx, g.xy, rcond=None)[0], self.features)
        flat = solutions.select(*[F.get("x", i).alias(f"c{i}") for i in range(p)], F.col("y").alias(f"c{p}"))
        middle = quantiles(flat, [f"c{i}" for i in range(p + 1)], [0.25, 0.5, 0.75])
        at = np.array([middle[f"c{i}"][1] for i in range(p + 1)])
        unit = np.array([middle[f"c{i}"][2] - middle[f"c{i}"][0] for i in range(p + 1)])
        unit = np.where(unit > 0, unit, 1.0)  # coefficients of different size count alike

        for _ in range(self.steps):
            here = at

            def pulls(w):
                far = np.sqrt((((w - here) / unit) ** 2).sum(axis=1))
                weight = 1 / np.maximum(far, 1e-9)
                return np.r_[(w * weight[:, None]).sum(axis=0), weight.sum()]

            sums = summed(solutions, pulls, p + 2)
            at = sums[:-1] / sums[-1]
            if np.abs((at - here) / unit).max() < 1e-9:
                break
        return LinearFit(at[:-1], float(at[-1]), self.features)
