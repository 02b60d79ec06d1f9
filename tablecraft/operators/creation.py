"""New columns computed from several columns of the same row."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import add, mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import add_columns, filled_number
from tablecraft.operators.fitted import Fitted


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False) -> Fitted:
    """Products of up to `degree` of the columns, named like a^2, a_b or a^2_b; all columns and degrees that are asked for."""
    if degree < 1:
        raise ValueError("the degree must be 1 or more")
    used = list(columns)
    choose = combinations if interaction_only else combinations_with_replacement
    terms: dict[str, tuple[str, ...]] = {}
    for d in range(1, degree + 1):
        for term in choose(used, d):
            powers = [(c, term.count(c)) for c in dict.fromkeys(term)]
            name = "_".join(c if k == 1 else f"{c}^{k}" for c, k in powers).replace(" ", "_")
            if name not in df.columns and name not in used:
                terms[name] = term

    def transform(frame: DataFrame) -> DataFrame:
        return add_columns(frame, {n: reduce(mul, [filled_number(frame, c) for c in t]) for n, t in terms.items()})

    return Fitted(
        f"Polynomial Features (degree={degree})", "creation", used, list(terms),
        f"{len(terms)} products of {len(used)} columns.", transform,
    )


def arithmetic(df: DataFrame, a: str, b: str, operations: list[str] | None = None) -> Fitted:
    """a plus, minus, times and divided by b; a division by zero gives 0."""
    wanted = ["add", "subtract", "multiply", "divide"] if operations is None else operations
    names = {"add": "plus", "subtract": "minus", "multiply": "times", "divide": "div"}
    chosen = [o for o in wanted if o in names]

    def transform(frame: DataFrame) -> DataFrame:
        x, y = filled_number(frame, a), filled_number(frame, b)
        results = {
            "add": x + y,
            "subtract": x - y,
            "multiply": x * y,
            "divide": F.coalesce(F.try_divide(x, y), F.lit(0.0)),
        }
        return add_columns(frame, {f"{a}_{names[o]}_{b}": results[o] for o in chosen})

    out = [f"{a}_{names[o]}_{b}" for o in chosen]
    return Fitted("Arithmetic Features", "creation", [a, b], out, ", ".join(wanted), transform)


def row_aggregates(df: DataFrame, columns: list[str], functions: list[str] | None = None) -> Fitted:
    """mean, sum, std, min, max or range across the columns of each row."""
    wanted = ["mean", "sum", "std"] if functions is None else functions
    suffix = "_".join(columns[:3]) + ("_etc" if len(columns) > 3 else "")
    known = ("mean", "sum", "std", "min", "max", "range")
    chosen = [f for f in wanted if f in known]
    k = len(columns)

    def transform(frame: DataFrame) -> DataFrame:
        xs = [filled_number(frame, c) for c in columns]
        total = reduce(add, xs)
        mean = total / F.lit(float(k))
        spread = reduce(add, [(x - mean) * (x - mean) for x in xs])
        low = F.least(*xs) if k > 1 else xs[0]
        high = F.greatest(*xs) if k > 1 else xs[0]
        results = {
            "mean": mean,
            "sum": total,
            "std": F.sqrt(spread / F.lit(float(k - 1))) if k > 1 else F.lit(0.0),
            "min": low,
            "max": high,
            "range": high - low,
        }
        return add_columns(frame, {f"agg_{f}_{suffix}": results[f] for f in chosen})

    return Fitted(
        f"Row Aggregation ({', '.join(wanted)})", "creation", columns, [f"agg_{f}_{suffix}" for f in chosen],
        f"{len(chosen)} aggregates across {k} columns.", transform,
    )


def drop_columns(df: DataFrame, columns: list[str]) -> Fitted:
    existing = [c for c in columns if c in df.columns]
    return Fitted(
        "Drop Columns", "utility", existing, [], f"Dropped {len(existing)} columns.", lambda frame: frame.drop(*existing)
    )
