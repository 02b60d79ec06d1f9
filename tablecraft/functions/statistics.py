"""Statistics over many columns at once, as aggregates that combine on the map side."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col, is_floating, number, present
from tablecraft.settings import SETTINGS

Metric = Callable[[Column], Column]


def chunks(items: Sequence, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unpivoted(df: DataFrame, cols: Sequence[str], value: Callable[[DataFrame, str], Column]) -> DataFrame:
    """(position, x): one row per cell of the chosen columns; only those columns are read."""
    names = [f"x{i}" for i in range(len(cols))]
    picked = df.select(*[value(df, c).alias(n) for c, n in zip(cols, names)])
    if isinstance(picked.schema[0].dataType, T.StructType):  # stacked structs must agree on what may be missing
        picked = picked.select(*[F.col(n).cast(picked.schema[n].dataType.simpleString()).alias(n) for n in names])
    return picked.select(F.stack(F.lit(len(cols)), *[e for i, n in enumerate(names) for e in (F.lit(i), F.col(n))]).alias("position", "x"))


def column_stats(
    df: DataFrame,
    cols: Sequence[str],
    metrics: dict[str, Metric],
    value: Callable[[DataFrame, str], Column] = number,
) -> DataFrame:
    """One row per column with the given aggregates, in one pass.

    Cells are grouped by column rather than aggregated side by side: the generated code stays small
    enough to be compiled well for tables of any width, and each task sends on one row per column.
    Values of different types are kept apart by type.
    """
    kinds: dict[str, list[str]] = {}
    for c, f in zip(cols, df.select(*[value(df, c).alias(f"x{i}") for i, c in enumerate(cols)]).schema):
        kinds.setdefault(f.dataType.simpleString(), []).append(c)
    parts = []
    for same in kinds.values():
        rows = unpivoted(df, same, value).groupBy("position").agg(*[fn(F.col("x")).alias(m) for m, fn in metrics.items()])
        names = F.array(*[F.lit(c) for c in same])
        places = F.array(*[F.lit(list(cols).index(c)) for c in same])
        found = rows.select(F.get(names, F.col("position")).alias("column"), F.get(places, F.col("position")).alias("position"), *metrics)
        parts.append(found)
    return union_all(parts)


def scalars(df: DataFrame, cols: Sequence[str], metrics: dict[str, Metric], value=number) -> dict[str, dict]:
    """The same aggregates as plain numbers on the driver: len(cols) * len(metrics) values."""
    if not cols:
        return {}
    out = {r["column"]: r.asDict() for r in column_stats(df, cols, metrics, value).collect()}
    if len(out) < len(cols):  # a table without rows: what the aggregates say of no values
        for c in cols:
            nothing = df.select(value(df, c).alias("x")).where(F.lit(False))
            out[c] = nothing.agg(*[fn(F.col("x")).alias(m) for m, fn in metrics.items()]).first().asDict()
    return out


def moments(df: DataFrame, cols: Sequence[str], value=number) -> dict[str, dict]:
    """n, lo, hi, mean, variance, skew and kurtosis per column, the last two bias-corrected.

    Without spread (or with squares below the smallest double) skew and kurtosis are 0; below three
    (four) values, and where a power overflows, they are missing.

    Two light passes: means first, then the sums of the powers of the centred values. Both run
    several times faster than the built-in higher moments side by side.
    """
    seen = scalars(df, cols, {"n": F.count, "mean": F.avg, "lo": F.min, "hi": F.max}, value)
    if not cols:
        return {}
    centers = F.array(*[F.lit(seen[c]["mean"] or 0.0) for c in cols])
    d = F.col("x") - F.get(centers, F.col("position"))
    cells = unpivoted(df, cols, value).select("position", d.alias("d"))
    square = F.col("d") * F.col("d")
    sums = cells.groupBy("position").agg(
        F.sum(square).alias("s2"), F.sum(square * F.col("d")).alias("s3"), F.sum(square * square).alias("s4")
    )
    for r in sums.collect():
        seen[cols[r["position"]]] |= {"s2": r["s2"], "s3": r["s3"], "s4": r["s4"]}
    for m in seen.values():
        n = m["n"]
        flat = n > 0 and (m["lo"] == m["hi"] or not m["s2"])
        m["variance"] = (0.0 if flat else m["s2"] / (n - 1)) if n > 1 else None
        m["skew"] = (0.0 if flat else _skew(n, m["s2"], m["s3"])) if n >= 3 else None
        m["kurtosis"] = (0.0 if flat else _kurtosis(n, m["s2"], m["s4"])) if n >= 4 else None
    return seen


def _skew(n: int, s2: float, s3: float) -> float | None:
    with np.errstate(all="ignore"):
        g1 = np.float64(s3) / n / np.power(np.float64(s2) / n, 1.5)
    return float(g1) * math.sqrt(n * (n - 1)) / (n - 2) if np.isfinite(g1) else None


def _kurtosis(n: int, s2: float, s4: float) -> float | None:
    with np.errstate(all="ignore"):
        g2 = np.float64(s4) / n / np.square(np.float64(s2) / n) - 3
    return float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)) if np.isfinite(g2) else None


# --- exact quantiles ---------------------------------------------------------------------------


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    value: Callable[[DataFrame, str], Column] = number,
    exact_rows: int | None = None,
    extent: dict[str, dict] | None = None,
) -> dict[str, list[float] | None]:
    """Exact linearly interpolated quantiles per column (None for a column without values).

    Columns with few values use the built-in exact percentile. For all others a histogram between
    minimum and maximum finds the bin of each wanted rank by exact counts, that bin becomes the next
    interval, and the few values left in the last interval are sorted. No task ever holds more than
    the bins or `exact_rows` values, whatever the table size. A known `extent` (n, lo, hi per column) saves a pass.
    """
    exact_rows = SETTINGS.exact_rows if exact_rows is None else exact_rows
    probs = [float(p) for p in probs]
    extent = scalars(df, cols, {"n": F.count, "lo": F.min, "hi": F.max}, value) if extent is None else extent
    out: dict[str, list[float] | None] = {c: None for c in cols if extent[c]["n"] == 0}
    filled = [c for c in cols if extent[c]["n"] > 0]
    small = [c for c in filled if extent[c]["n"] <= exact_rows]
    if small:
        rows = column_stats(df, small, {"q": lambda x: F.percentile(x, F.lit(probs))}, value).collect()
        out |= {r["column"]: list(r["q"]) for r in rows}
    large = [c for c in filled if c not in small]
    if large:
        spots = {c: [p * (extent[c]["n"] - 1) for p in probs] for c in large}
        endless = [c for c in large if math.isinf(extent[c]["lo"]) or math.isinf(extent[c]["hi"])]
        if endless:  # infinite values are counted apart; only finite ones can be bracketed
            finite = lambda x, agg: agg(F.when(F.abs(x) < F.lit(math.inf), x))
            apart = scalars(
                df, endless, {
                    "under": lambda x: F.count_if(x == F.lit(-math.inf)), "over": lambda x: F.count_if(x == F.lit(math.inf)),
                    "lo": lambda x: finite(x, F.min), "hi": lambda x: finite(x, F.max),
                }, value,
            )
        brackets, found = [], {}
        for c in large:
            seen = {"under": 0, "over": 0, **extent[c], **(apart[c] if c in endless else {})}
            ranks = {k for s in spots[c] for k in (math.floor(s), math.ceil(s))}
            found |= {(c, k): -math.inf for k in ranks if k < seen["under"]}
            found |= {(c, k): math.inf for k in ranks if k >= seen["n"] - seen["over"]}
            ranks = {k for k in ranks if (c, k) not in found}
            if ranks:
                brackets.append(Bracket(c, seen["lo"], seen["hi"], seen["under"], seen["n"] - seen["under"] - seen["over"], ranks))
        found |= order_statistics(df, brackets, value, exact_rows)
        for c in large:
            ends = [(found[c, math.floor(s)], found[c, math.ceil(s)], s - math.floor(s)) for s in spots[c]]
            out[c] = [a if w == 0 or a == b else (1 - w) * a + w * b for a, b, w in ends]
    return {c: out[c] for c in cols}


@dataclass
class Bracket:
    """Values of a column between lo and hi: how many lie below, how many within, and the ranks sought there."""

    column: str
    lo: float
    hi: float
    below: int
    within: int
    ranks: set[int]
    stuck: bool = False


def order_statistics(df: DataFrame, brackets: list[Bracket], value, exact_rows: int) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks of the sorted columns."""
    done: dict[tuple[str, int], float] = {}
    ready: list[Bracket] = []
    while brackets:
        done |= {(b.column, r): b.lo for b in brackets if b.lo == b.hi for r in b.ranks}
        ready += [b for b in brackets if b.lo != b.hi and b.within <= exact_rows]
        brackets = [b for b in brackets if b.lo != b.hi and b.within > exact_rows]
        brackets = [n for group in chunks(brackets, 4 * SETTINGS.columns_per_job) for n in _narrowed(df, group, value)]
    for group in chunks(ready, SETTINGS.columns_per_job):
        rows = _binned(df, group, value, 1).groupBy("slot").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        places = [(i, r, r - b.below + 1) for i, b in enumerate(group) for r in b.ranks]
        sought = df.sparkSession.createDataFrame(places, "slot bigint, rank bigint, place int")
        for r in rows.join(F.broadcast(sought), "slot").select("slot", "rank", F.element_at("xs", F.col("place")).alias("v")).collect():
            done[group[r["slot"]].column, r["rank"]] = r["v"]
    return done


def _binned(df: DataFrame, brackets: Sequence[Bracket], value, bins: int, edges: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """(slot, x) of all values inside a bracket; slot = bracket number * bins + bin."""
    columns = list(dict.fromkeys(b.column for b in brackets))
    parts = {c: F.lit(None).cast("bigint") for c in columns}
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    for i, b in enumerate(brackets):
        x = F.col(names[b.column])
        if bins == 1:
            at = F.lit(0).cast("bigint")
        elif edges and i in edges:  # three zones: under, between and over two guessed values
            at = F.when(x < F.lit(edges[i][0]), 0).when(x <= F.lit(edges[i][1]), 1).otherwise(2).cast("bigint")
        else:
            at = F.least(F.floor((x - F.lit(b.lo)) / F.lit(b.hi - b.lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("bigint")
        inside = (x >= F.lit(b.lo)) & (x <= F.lit(b.hi))
        parts[b.column] = F.when(inside, F.lit(i * bins) + at).otherwise(parts[b.column])
    picked = df.select(*[value(df, c).alias(n) for c, n in names.items()])
    cells = [e for c in columns for e in (parts[c], F.col(names[c]))]
    return picked.select(F.stack(F.lit(len(columns)), *cells).alias("slot", "x")).where("slot IS NOT NULL")


def _narrowed(df: DataFrame, brackets: Sequence[Bracket], value, max_bins: int = 4096) -> list[Bracket]:
    """Each bracket replaced by the occupied bins that hold its ranks."""
    bins = max(64, min(max_bins, 200_000 // len(brackets)))
    edges = {}
    stuck = [i for i, b in enumerate(brackets) if b.stuck]
    if stuck:  # values crowd in one bin: guess an interval around the ranks from approximate percentiles
        guesses = []
        for i in stuck:
            b, x = brackets[i], value(df, brackets[i].column)
            held = F.when((x >= F.lit(b.lo)) & (x <= F.lit(b.hi)), x)
            aims = [max((min(b.ranks) - b.below) / b.within - 2e-4, 0.0), min((max(b.ranks) - b.below) / b.within + 2e-4, 1.0)]
            guesses.append(F.percentile_approx(held, F.array(*[F.lit(a) for a in aims]), 10_000).alias(f"g{i}"))
        row = df.agg(*guesses).first()
        edges = {i: tuple(row[f"g{i}"]) for i in stuck}
    counts = _binned(df, brackets, value, bins, edges).groupBy("slot").agg(
        F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    held: dict[int, list] = {}
    for r in counts.collect():  # at most 200,000 rows
        held.setdefault(r["slot"] // bins, []).append(r)
    out = []
    for i, b in enumerate(brackets):
        below, ranks = b.below, sorted(b.ranks)
        for r in sorted(held[i], key=lambda r: r["slot"]):
            here = {k for k in ranks if below <= k < below + r["n"]}
            if here:
                crowded = r["n"] * 16 > b.within and not b.stuck
                out.append(Bracket(b.column, r["lo"], r["hi"], below, r["n"], here, crowded))
            below += r["n"]
    return out


# --- counts of values --------------------------------------------------------------------------


def value_counts(df: DataFrame, cols: Sequence[str], value: Callable[[DataFrame, str], Column] | None = None) -> DataFrame:
    """(column, value, n) for text columns; hot values collapse before the shuffle."""
    pick = value or (lambda d, c: col(c))
    long = df.select(*[pick(df, c).cast("string").alias(c) for c in cols])
    if len(cols) == 1:
        long = long.select(F.lit(cols[0]).alias("column"), col(cols[0]).alias("value"))
    else:
        long = long.unpivot([], [col(c) for c in cols], "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_summary(counts: DataFrame) -> DataFrame:
    """Per column: distinct values, total, most and least frequent value.

    Ties go to the smaller value for the most and to the larger value for the least frequent one.
    Plain min/max aggregates, so no column's values are ever sorted in one task.
    """
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n").alias("total"),
        F.sum(F.octet_length("value").cast("bigint")).alias("value_bytes"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("top"),
        F.max(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("last"),
    ).select(
        "column",
        "n_unique",
        "total",
        "value_bytes",
        F.col("top.value").alias("mode"),
        (-F.col("top.neg")).alias("mode_n"),
        F.col("last.value").alias("rarest"),
        (-F.col("last.neg")).alias("rarest_n"),
    )


def value_hash(df: DataFrame, name: str, *seed: int) -> Column:
    """64 bits of a present value of any type; zeros of both signs are one value."""
    x = present(df, name)
    x = x + F.lit(0.0) if is_floating(df.schema[name].dataType) else x
    return F.when(x.isNotNull(), F.xxhash64(*[F.lit(s) for s in seed], x))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_unique): exact counts over any types. Cells are grouped by 128 bits of their hash, so no value is shuffled or kept,
    however long, and each task sends a different value once."""
    hashes = [h for i, c in enumerate(cols) for h in (value_hash(df, c).alias(f"a{i}"), value_hash(df, c, 1).alias(f"b{i}"))]
    cells = [e for i in range(len(cols)) for e in (F.lit(i), F.col(f"a{i}"), F.col(f"b{i}"))]
    listed = df.sparkSession.createDataFrame(list(enumerate(cols)), "position int, column string")
    if not cols:
        return listed.select("column", F.lit(0).cast("bigint").alias("n_unique"))
    long = df.select(*hashes).select(F.stack(F.lit(len(cols)), *cells).alias("position", "a", "b")).where("a IS NOT NULL")
    counts = long.distinct().groupBy("position").agg(F.count("*").alias("n"))
    return listed.join(counts, "position", "left").select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_unique"))


def distinct_floors(df: DataFrame, cols: Sequence[str], up_to: int) -> dict[str, int]:
    """A number of distinct values that each column certainly reaches: how many of at least 2 * up_to buckets its hashes fall into.

    A task sends some bits for a column, whatever the values, so columns of many values are told in one pass without a shuffle of them."""
    words = min(64, -(-2 * up_to // 64))
    bucket = F.pmod(F.col("x"), F.lit(64 * words))

    def bits(w: int) -> Metric:
        here = F.when(F.floor(bucket / 64) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bucket, F.lit(64)).cast("int")))
        return lambda x: F.bit_or(here)

    seen = scalars(df, cols, {f"w{w}": bits(w) for w in range(words)}, value_hash)
    return {c: sum(((seen[c][f"w{w}"] or 0) & (2**64 - 1)).bit_count() for w in range(words)) for c in cols}


def few_valued(df: DataFrame, cols: Sequence[str], threshold: int) -> dict[str, int]:
    """The columns with fewer distinct values than the threshold, with that number; values of columns that surely have more aren't counted."""
    floors = distinct_floors(df, cols, threshold)
    open_cols = [c for c in cols if floors[c] < threshold]
    if not open_cols:
        return {}
    seen = {r["column"]: r["n_unique"] for r in distinct_counts(df, open_cols).collect()}
    return {c: seen[c] for c in open_cols if seen[c] < threshold}


# --- correlation -------------------------------------------------------------------------------


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], value=number) -> DataFrame:
    """(position, c1, c2, r): Pearson over rows where both values are present; NULL if either is constant there.

    Two passes for any number of columns: means first, then the products of centred values. A task multiplies its rows block by block and
    sends one row of sums per pair, with counts over the common rows, so gaps need no pass of their own.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    seen = scalars(df, names, {"m": F.avg}, value)
    centers = np.array([seen[c]["m"] or 0.0 for c in names])
    at = {c: i for i, c in enumerate(names)}
    left, right = np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs])
    whole = len(pairs) > 4 * len(names)  # else only the wanted products

    def products(x, m, y, n):
        """Sums over rows of x_i * y_j for the wanted pairs, and the like for squares and presences."""
        if whole:
            pick = lambda a, b: (a.T @ b)[left, right]
        else:
            pick = lambda a, b: np.einsum("ri,ri->i", a[:, left], b[:, right])
        return [pick(x, y), pick(m, n), pick(x, n), pick(m, y), pick(x * x, n), pick(m, y * y)]

    def add_up(batches):
        total = np.zeros((6, len(pairs)))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                m = (~np.isnan(x)).astype(float)
                x = np.where(m > 0, x - centers, 0.0)
                with np.errstate(all="ignore"):
                    total += products(x, m, x, m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *map(pa.array, total)], ["position", *SUMS])

    inputs = df.select(*[value(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    sums = inputs.mapInArrow(add_up, "position long, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("position").agg(*[F.sum(c).alias(c) for c in SUMS])
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    spread = (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)  # less is the rounding of a constant
    r = F.when(spread | F.isnan(vx) | F.isnan(vy), F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.sqrt(vx) * F.sqrt(vy)))
    listed = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "position int, c1 string, c2 string")
    return listed.join(sums, "position", "left").select("position", "c1", "c2", r.alias("r"))


SUMS = ("sxy", "n", "sx", "sy", "sxx", "syy")


def all_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def empty_frame(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType.fromDDL(schema))

