"""Principal components and calendar features."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import add_columns, filled_number, moment
from tablecraft.functions.statistics import scalars
from tablecraft.operators.cleaning import date_part
from tablecraft.operators.fitted import Fitted, known
from tablecraft.operators.profiling import local_rows
from tablecraft.settings import SETTINGS

# The calendar features and the periods of the cyclical ones.
FEATURE_PARTS = ("year", "month", "day", "dow", "hour")
PERIODS = {"month": 12, "dow": 7, "hour": 24}


def pca(df: DataFrame, columns: list[str], n_components: int = 5) -> Fitted:
    """PC1..PCk: scores on the principal components of the standardised columns.

    Each component is oriented so that its largest loading is positive. Scores are plain column
    arithmetic with the fitted loadings.
    """
    stats = scalars(df, columns, {"n": F.count, "m": F.avg, "s": F.stddev_pop}, filled_number)
    k = max(1, min(n_components, len(columns), stats[columns[0]]["n"]))

    def standardised(frame: DataFrame, c: str):
        return (filled_number(frame, c) - F.lit(stats[c]["m"] or 0.0)) / F.lit(stats[c]["s"] or 1.0)

    names = [f"z{i}" for i in range(len(columns))]
    z = df.select(*[standardised(df, c).alias(n) for c, n in zip(columns, names)])
    model = PCA(k=k, inputCol="z", outputCol="scores").fit(VectorAssembler(inputCols=names, outputCol="z").transform(z))
    loadings = model.pc.toArray().copy()  # columns x k
    for j in range(k):
        if loadings[abs(loadings[:, j]).argmax(), j] < 0:
            loadings[:, j] *= -1
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    labels = [f"PC{j + 1}" for j in range(k)]

    def transform(frame: DataFrame) -> DataFrame:
        score = lambda j: reduce(
            add, [standardised(frame, c) * F.lit(float(loadings[i, j])) for i, c in enumerate(columns)]
        )
        return add_columns(frame, {name: score(j) for j, name in enumerate(labels)})

    table = {name: {c: float(loadings[i, j]) for i, c in enumerate(columns)} for j, name in enumerate(labels)}
    info = {
        "explained_variance_ratio": ratio,
        "cumulative_variance": [sum(ratio[: j + 1]) for j in range(k)],
        "total_variance_explained": sum(ratio),
        "n_components": k,
        "loadings": table,
        "top_features_per_pc": {
            p: dict(sorted(((c, abs(v)) for c, v in w.items()), key=lambda e: -e[1])[:5]) for p, w in table.items()
        },
    }
    return Fitted(
        f"PCA (n_components={k})", "extraction", columns, labels,
        f"{len(columns)} columns to {k} components, {sum(ratio):.1%} of the variance.", transform, info,
    )


def loadings_frame(df: DataFrame, fitted: Fitted) -> DataFrame:
    rows = [
        (p, c, v, fitted.info["explained_variance_ratio"][j])
        for j, (p, w) in enumerate(fitted.info["loadings"].items())
        for c, v in w.items()
    ]
    return local_rows(df, rows, "component string, column string, loading double, variance_ratio double")


def datetime_features(df: DataFrame, columns: list[str], cyclical: bool = True) -> Fitted:
    """Calendar parts as doubles, with sine and cosine of month, weekday and hour; 0 when missing.

    Columns of which fewer than 30 % of the rows hold a date are skipped; the source stays.
    """
    cols = known(df, columns)
    seen = scalars(df, cols, {"n": lambda x: F.count(F.lit(1)), "ok": F.count}, moment)
    cols = [c for c in cols if seen[c]["ok"] >= seen[c]["n"] * SETTINGS.date_feature_ratio]

    def expressions(frame: DataFrame) -> dict:
        out = {}
        for c in cols:
            ts = moment(frame, c)
            out |= {f"{c}_{p}": F.coalesce(date_part(ts, p).cast("double"), F.lit(0.0)) for p in FEATURE_PARTS}
            for p, period in PERIODS.items() if cyclical else ():
                angle = date_part(ts, p).cast("double") * F.lit(2 * math.pi) / F.lit(float(period))
                out[f"{c}_{p}_sin"] = F.coalesce(F.sin(angle), F.lit(0.0))
                out[f"{c}_{p}_cos"] = F.coalesce(F.cos(angle), F.lit(0.0))
        return out

    out = list(expressions(df))
    return Fitted(
        "DateTime Extraction", "extraction", columns, out, f"{len(out)} calendar features (cyclical={cyclical}).",
        lambda frame: add_columns(frame, expressions(frame)),
    )


def datetime_columns(df: DataFrame, ratio: float = 0.7) -> list[str]:
    """Columns offered for calendar features: typed dates, and text mostly parsing as dates."""
    from tablecraft.operators.cleaning import detect_date_columns

    return detect_date_columns(df, ratio)
