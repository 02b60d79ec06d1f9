"""Row-local numeric transforms, power transforms, binning and scaling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import add_columns, filled_number, number
from tablecraft.functions.statistics import quantiles, scalars, unpivoted
from tablecraft.operators.fitted import Fitted, known


def _clipped(frame: DataFrame, c: str) -> Column:
    return F.greatest(filled_number(frame, c), F.lit(0.0))


def _rowwise(df, columns, suffix, fn, operation, category, detail, info=None) -> Fitted:
    cols = known(df, columns)

    def transform(frame: DataFrame) -> DataFrame:
        return add_columns(frame, {f"{c}_{suffix}": fn(frame, c) for c in cols})

    return Fitted(operation, category, columns, [f"{c}_{suffix}" for c in cols], detail, transform, info or {})


def log(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_log: log(1 + x), negative and missing values count as 0."""
    return _rowwise(
        df, columns, "log", lambda d, c: F.log1p(_clipped(d, c)), "Log Transform (log1p)", "transformation",
        f"log1p of {len(columns)} columns.",
    )


def sqrt(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_sqrt: square root, negative and missing values count as 0."""
    return _rowwise(
        df, columns, "sqrt", lambda d, c: F.sqrt(_clipped(d, c)), "Sqrt Transform", "transformation",
        f"Square root of {len(columns)} columns.",
    )


# --- power transform ---------------------------------------------------------------------------


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transform (Yeo and Johnson, 2000) for a fixed lambda."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    rest = 2.0 - lam
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / F.lit(rest)
    return F.when(x >= 0, up).otherwise(down)


def likelihood_grid(df: DataFrame, columns: list[str], grids: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Profile log-likelihoods of every column on its own grid of lambdas, all in one pass.

    Each value meets the grid inside its task; what is shuffled is one partial sum per column, lambda and task.
    """
    cells = unpivoted(df, columns, filled_number)
    ladder = F.array(*[F.array(*[F.lit(lam) for lam in grids[c]]) for c in columns])
    # (1 + |x|)^k = exp(k * log1p(|x|)): one logarithm per value serves all lambdas.
    base = cells.select("position", (F.col("x") >= 0).alias("up"), F.log1p(F.abs("x")).alias("log"))
    tried = base.select("position", "up", "log", F.posexplode(F.get(ladder, F.col("position"))).alias("step", "lam"))
    sign = F.when(F.col("up"), 1.0).otherwise(-1.0)
    k = F.when(F.col("up"), F.col("lam")).otherwise(F.lit(2.0) - F.col("lam"))
    psi = sign * F.coalesce(F.try_divide(F.expm1(k * F.col("log")), k), F.col("log"))
    sums = tried.groupBy("position", "step", "lam").agg(
        F.count("log").alias("n"), F.var_pop(psi).alias("var"), F.sum(sign * F.col("log")).alias("slope")
    )
    loglik = F.when(F.col("var") > 0, -F.col("n") / 2.0 * F.log("var") + (F.col("lam") - 1.0) * F.col("slope"))
    out: dict[str, list[float | None]] = {c: [None] * len(grids[c]) for c in columns}
    for r in sums.select("position", "step", loglik.alias("l")).collect():
        out[columns[r["position"]]][r["step"]] = r["l"]
    return out


def fit_lambdas(df: DataFrame, columns: list[str], points: int = 13, tolerance: float = 5e-5, furthest: float = 1e4) -> dict[str, float]:
    """Maximum-likelihood lambda per column: all columns share every pass, each pass narrows the interval until its step is small.

    The interval moves and grows while the best point lies on its edge; a likelihood that still rises at +-`furthest` has no maximum and
    ends there. Columns without spread are left out.
    """
    span = {c: (-2.0, 2.0) for c in columns}
    best: dict[str, float] = {}
    alive = list(columns)
    while alive:
        grids = {c: [float(v) for v in np.linspace(*span[c], points)] for c in alive}
        values = likelihood_grid(df, alive, grids)
        for c in list(alive):
            scored = [(v, lam) for v, lam in zip(values[c], grids[c]) if v is not None and math.isfinite(v)]
            if not scored:
                alive.remove(c)
                continue
            best[c] = max(scored)[1]
            lo, hi = span[c]
            step = (hi - lo) / (points - 1)
            at_edge = best[c] in (grids[c][0], grids[c][-1])
            if abs(best[c]) > furthest or not at_edge and step <= tolerance:
                alive.remove(c)
            span[c] = (best[c] - (hi - lo), best[c] + (hi - lo)) if at_edge else (best[c] - step, best[c] + step)
    return best


def power(df: DataFrame, columns: list[str], lambdas: dict[str, float] | None = None) -> Fitted:
    """{c}_boxcox: Yeo-Johnson with the fitted (or given) lambda."""
    cols = known(df, columns)
    lambdas = fit_lambdas(df, cols) if lambdas is None else lambdas
    cols = [c for c in cols if c in lambdas]
    return _rowwise(
        df, cols, "boxcox", lambda d, c: yeo_johnson(filled_number(d, c), lambdas[c]), "Box-Cox (Yeo-Johnson) Transform",
        "transformation", f"Power-transformed {len(cols)} columns.", {"lambdas": {c: round(lambdas[c], 4) for c in cols}},
    )


# --- binning -----------------------------------------------------------------------------------


def bin_index(x: Column, inner: list[float]) -> Column:
    """0-based index of the right-closed bin, given the edges between bins."""
    out = F.lit(0)
    for edge in inner:
        out = out + (x > F.lit(edge)).cast("int")
    return out


def quantile_edges(df: DataFrame, columns: list[str], n_bins: int, value=number) -> dict[str, list[float] | None]:
    """Distinct quantile edges per column; None where fewer than two remain."""
    found = quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)], value)
    edges = {c: sorted(set(q)) if q else None for c, q in found.items()}
    return {c: e if e and len(e) > 1 else None for c, e in edges.items()}


def binning(df: DataFrame, columns: list[str], n_bins: int = 5, strategy: str = "quantile") -> Fitted:
    """{c}_bin{n}: index of the equal-count or equal-width bin, -1 for missing values."""
    if n_bins < 2:
        raise ValueError("at least two bins are needed")
    cols = known(df, columns)
    edges: dict[str, list[float] | None]
    if strategy == "quantile":
        edges = quantile_edges(df, cols, n_bins)
    else:
        span = scalars(df, cols, {"lo": F.min, "hi": F.max})
        edges = {c: _width_edges(span[c]["lo"], span[c]["hi"], n_bins) for c in cols}

    def bin_of(frame: DataFrame, c: str) -> Column:
        x = number(frame, c)
        if edges[c] is None:
            return F.lit(-1)
        return F.when(x.isNull(), -1).otherwise(bin_index(x, edges[c][1:-1]))

    return _rowwise(
        df, cols, f"bin{n_bins}", bin_of, f"Binning ({strategy}, {n_bins} bins)", "transformation",
        f"Discretized {len(cols)} columns into {n_bins} bins.", {"edges": edges},
    )


def _width_edges(lo: float | None, hi: float | None, n_bins: int) -> list[float] | None:
    if lo is None:
        return None
    if lo == hi:  # a constant column sits in the middle of a widened range
        pad = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - pad, hi + pad
    return [float(e) for e in np.linspace(lo, hi, n_bins + 1)]


# --- scaling -----------------------------------------------------------------------------------


def _scaled(df, columns, suffix, title, shifts: dict[str, tuple[float, float]]) -> Fitted:
    cols = [c for c in columns if c in shifts]
    return _rowwise(
        df, cols, suffix, lambda d, c: (filled_number(d, c) - F.lit(shifts[c][0])) / F.lit(shifts[c][1] or 1.0),
        title, "scaling", f"Applied {title} to {len(cols)} columns.", {"shift_scale": shifts},
    )


def _fit_scalars(df: DataFrame, columns: list[str], metrics) -> dict[str, dict]:
    cols = known(df, columns)
    stats = scalars(df, cols, metrics, filled_number)
    return {c: {k: v or 0.0 for k, v in stats[c].items() if k in metrics} for c in cols}


def standard(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_scaled: zero mean and unit population deviation."""
    s = _fit_scalars(df, columns, {"m": F.avg, "s": F.stddev_pop})
    return _scaled(df, columns, "scaled", "Standard Scaling (z-score)", {c: (v["m"], v["s"]) for c, v in s.items()})


def minmax(df: DataFrame, columns: list[str]) -> Fitted:
    s = _fit_scalars(df, columns, {"lo": F.min, "hi": F.max})
    return _scaled(df, columns, "minmax", "Min-Max Scaling [0,1]", {c: (v["lo"], v["hi"] - v["lo"]) for c, v in s.items()})


def robust(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_robust: distance from the median in interquartile ranges."""
    cols = known(df, columns)
    q = {c: v or [0.0, 0.0, 0.0] for c, v in quantiles(df, cols, [0.25, 0.5, 0.75], filled_number).items()}
    return _scaled(df, columns, "robust", "Robust Scaling (median/IQR)", {c: (v[1], v[2] - v[0]) for c, v in q.items()})


def maxabs(df: DataFrame, columns: list[str]) -> Fitted:
    s = _fit_scalars(df, columns, {"m": lambda x: F.max(F.abs(x))})
    return _scaled(df, columns, "maxabs", "MaxAbs Scaling [-1,1]", {c: (0.0, v["m"]) for c, v in s.items()})
