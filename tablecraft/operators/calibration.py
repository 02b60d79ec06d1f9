"""Isotonic regression, and scores turned into probabilities by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import col

#: Steps of a probability that calibration tells apart.
RESOLUTION = 100_000


@dataclass(frozen=True)
class Isotonic:
    """A fitted step function of one column; between its steps values are interpolated, beyond its ends they stay."""

    model: IsotonicRegressionModel
    source: str
    output: str
    resolution: int | None

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with the output column, in place of one that has this name; null where the source is missing or not a number."""
        x = _level(df, self.source, self.resolution)
        known = df.withColumn("__x", F.coalesce(x, F.lit(0.0)))
        fitted = self.model.transform(known)
        value = F.when(x.isNotNull(), F.col("__fitted"))
        return fitted.withColumn(self.output, value).drop("__x", "__fitted")


def _level(df: DataFrame, source: str, resolution: int | None):
    x = F.nanvl(col(source).cast("double"), F.lit(None).cast("double"))
    return x if resolution is None else F.round(x * resolution) / resolution


def isotonic(df: DataFrame, source: str, label: str, output: str = "calibrated", increasing: bool = True, resolution: int | None = None) -> Isotonic:
    """The monotone function of `source` with the least squared distance to `label` (pooled violators).

    Rows of one value are reduced to their mean and number before any are pooled, so what is pooled are different values, first in range
    partitions side by side. With `resolution`, values are rounded to that part of one, which bounds their number. Rows where either is
    missing are left out; without any row there is nothing to fit."""
    levels = df.select(_level(df, source, resolution).alias("__x"), F.nanvl(col(label).cast("double"), F.lit(None).cast("double")).alias("__y"))
    levels = levels.where("__x IS NOT NULL AND __y IS NOT NULL").groupBy("__x").agg(F.avg("__y").alias("__y"), F.count("__y").cast("double").alias("__w")).persist()
    try:
        if not levels.limit(1).count():
            raise ValueError("no row has both values")
        model = IsotonicRegression(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__fitted", isotonic=increasing).fit(levels)
    finally:
        levels.unpersist()
    return Isotonic(model, source, output, resolution)


def calibrate(df: DataFrame, probability: str = "probability", label: str = "label", output: str = "calibrated") -> Isotonic:
    """Probabilities of class 1 as they turned out: the isotonic fit of a 0/1 label over probabilities in steps of 1 / RESOLUTION, so at most
    RESOLUTION + 1 different values are pooled, however many rows there are. Fit it on rows that the model has not learned from."""
    return isotonic(df, probability, label, output, resolution=RESOLUTION)
