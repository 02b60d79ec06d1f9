"""Regression by deviance: Poisson, gamma and Tweedie models with a log link, and the variance power that fits a table best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.operators.profiling import local_rows

POWERS = (1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9)
#: Steps of the dispersion, as powers of two around the best so far, in each pass over the rows.
SPANS, POINTS = (2.0, 0.5, 0.125), 9
#: Most terms that are worked out at once.
CELLS = 2_000_000


def unit_deviance(label: Column, mean: Column, power: float) -> Column:
    """How far a mean is from a label where the variance grows with the mean to `power`; null where the power does not allow the pair."""
    y, mu, p = label.cast("double"), mean.cast("double"), float(power)
    if p == 0:
        return F.pow(y - mu, 2)
    if p < 1:
        raise ValueError("no distribution has a variance power between 0 and 1, or below 0 with a log link")
    if p == 1:
        return F.when((y >= 0) & (mu > 0), 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)))
    if p == 2:
        return F.when((y > 0) & (mu > 0), 2 * (F.log(mu / y) + y / mu - 1))
    allowed = (y >= 0 if p < 2 else y > 0) & (mu > 0)
    own = F.when(y > 0, F.pow(y, 2 - p)).otherwise(0.0) / ((1 - p) * (2 - p))
    return F.when(allowed, 2 * (own - y * F.pow(mu, 1 - p) / (1 - p) + F.pow(mu, 2 - p) / (2 - p)))


def mean_deviance(df: DataFrame, power: float, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(power, n, deviance): the mean over the rows that the power allows, and their number."""
    d = unit_deviance(F.col(label), F.col(prediction), power)
    return df.agg(F.lit(float(power)).alias("power"), F.count(d).alias("n"), F.avg(d).alias("deviance"))


def regression(power: float, **params) -> GeneralizedLinearRegression:
    """An estimator with variance `power` (1 Poisson, 2 gamma, between them zeros and positive amounts) and a log link."""
    return GeneralizedLinearRegression(family="tweedie", variancePower=float(power), linkPower=0.0, **params)


# --- profile likelihood of the power -----------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers: Stirling's series, small arguments raised by eight first."""
    z = np.where(x < 8, x + 8, x)
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    low = x < 8
    if low.any():
        out[low] -= np.log(np.prod([x[low] + i for i in range(8)], axis=0))
    return out


def log_density(y: np.ndarray, mu: np.ndarray, dispersion: float, power: float) -> np.ndarray:
    """Log density of sums of a Poisson number of gamma amounts (1 < power < 2) with mean mu and variance dispersion * mu ** power.

    The density of a positive y is a sum over that number, of which the terms around the largest are taken: those beyond nine deviations
    do not reach the last digit."""
    a = (2 - power) / (power - 1)
    out = -(mu ** (2 - power)) / (dispersion * (2 - power))
    at = np.flatnonzero(y > 0)
    at = at[np.argsort(y[at])]  # rows with like numbers of terms together
    top = np.maximum(1.0, y[at] ** (2 - power) / (dispersion * (2 - power)))
    reach = (9 * np.sqrt(top / (1 + a)) + 12).astype(np.int64)
    most, known = int(top.max() + reach.max()) if len(at) else 0, None
    if most <= min(CELLS, (2 * reach + 1).sum()):  # fewer numbers than terms: what depends on the number alone is worked out once for each
        number = np.arange(1.0, most + 1)
        known = np.r_[0.0, log_gamma(number + 1) + log_gamma(a * number)]
    start = 0
    while start < len(at):
        size = max(1, min(len(at) - start, CELLS // int(2 * reach[start] + 1)))
        while size > 1 and size * (2 * int(reach[start + size - 1]) + 1) > CELLS:
            size = max(1, size // 2)
        rows, r = at[start : start + size], int(reach[start + size - 1])
        j = np.floor(top[start : start + size])[:, None] + np.arange(-r, r + 1)[None, :]
        kept = np.where(j >= 1, j, 1.0)
        base = a * np.log(y[rows]) - a * np.log(power - 1) - (1 + a) * np.log(dispersion) - np.log(2 - power)
        fixed = log_gamma(kept + 1) + log_gamma(a * kept) if known is None else known[kept.astype(np.int64)]
        terms = np.where(j >= 1, kept * base[:, None] - fixed, -np.inf)
        most = terms.max(1)
        total = most + np.log(np.exp(terms - most[:, None]).sum(1))
        out[rows] += total - np.log(y[rows]) + y[rows] * mu[rows] ** (1 - power) / ((1 - power) * dispersion)
        start += size
    return out


def _likelihoods(placed: DataFrame, powers, dispersions: np.ndarray) -> np.ndarray:
    """Log likelihood for each power and each of its dispersions, in one pass; a task sends one number for each."""

    def add_up(batches):
        total = np.zeros(dispersions.shape)
        for batch in batches:
            y, *mu = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            for i, p in enumerate(powers):
                total[i] += [log_density(y, mu[i], float(d), p).sum() for d in dispersions[i]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(dispersions.size)
    for r in placed.mapInArrow(add_up, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # powers x points
        out[r["at"]] = r["v"]
    return out.reshape(dispersions.shape)


def power_profile(rows: DataFrame, powers=POWERS) -> DataFrame:
    """(power, dispersion, log_likelihood) of the best model for each of `powers` (between 1 and 2), from rows (features, label).

    Each power has its own fitted means. Its dispersion starts from the mean squared error over the variance and is then moved to the
    largest likelihood in three passes, each over all powers at once and each in finer steps. The power with the largest
    log_likelihood describes the table best. Labels must not be negative; rows without a label are left out."""
    powers = [float(p) for p in powers]
    if not powers or min(powers) <= 1 or max(powers) >= 2:
        raise ValueError("powers must lie between 1 and 2")
    rows = rows.select("features", F.col("label").cast("double").alias("label")).where("label IS NOT NULL AND NOT isnan(label)")
    rows = rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism).persist()  # few bytes, much work: a part for every core
    try:
        seen = rows.agg(F.min("label").alias("least"), F.max("label").alias("most")).first()
        if seen["least"] is None or seen["least"] < 0 or seen["most"] <= 0:
            raise ValueError("labels must be zero or more, and some must be positive")
        placed = rows
        for i, p in enumerate(powers):
            placed = regression(p).setPredictionCol(f"mu{i}").fit(rows).transform(placed)
        placed = placed.select("label", *[f"mu{i}" for i in range(len(powers))]).persist()
        try:
            spread = placed.agg(*[F.avg(F.pow(F.col("label") - F.col(f"mu{i}"), 2) / F.pow(f"mu{i}", F.lit(p))).alias(f"s{i}") for i, p in enumerate(powers)]).first()
            best = np.array([max(spread[f"s{i}"], 1e-12) for i in range(len(powers))])
            for span in SPANS:
                steps = np.linspace(-span, span, POINTS)
                found = _likelihoods(placed, powers, best[:, None] * 2.0**steps)
                top = found.argmax(1)
                best = best * 2.0 ** steps[top]
        finally:
            placed.unpersist()
    finally:
        rows.unpersist()
    return local_rows(rows, [(p, float(best[i]), float(found[i, top[i]])) for i, p in enumerate(powers)], "power double, dispersion double, log_likelihood double")


def best_power(profile: DataFrame) -> float:
    return float(profile.orderBy(F.desc("log_likelihood"), "power").first()["power"])
