"""Whitening of embeddings from exact integer cross-products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.storage import cut

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned; rows whose planes are multiplied at once, a multiple of 64.
COMPONENTS, BLOCK = 16, 8_192
#: Entries are held within this, beyond which doubles are no whole numbers of their own.
LIMIT = 1 << 53
#: Powers of two that one sum of popcounts spans.
LIMB = 20
WIDTHS = (1, 2, 4, 8)
WIDE = "decimal(38,0)"


def usable(vector: Column) -> Column:
    """True for vectors without missing or non-finite entries."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))), F.lit(False))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * np.clip(values, -float(LIMIT), float(LIMIT))), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def pack(y: np.ndarray, widths: list[int]) -> pa.Array:
    """Rows of numbers from 0 as binaries, with as many bytes for a dimension as its range needs."""
    parts = [y[:, d].astype(f"<u{w}").view(np.uint8).reshape(len(y), w) for d, w in enumerate(widths)]
    data = np.ascontiguousarray(np.concatenate(parts, axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(y), [None, pa.py_buffer(data)]).cast(pa.binary())


def unpack(column: pa.Array, widths: list[int]) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), sum(widths))
    at = np.cumsum([0, *widths])
    return np.stack([np.ascontiguousarray(rows[:, at[d] : at[d] + w]).view(f"<u{w}")[:, 0].astype(np.uint64) for d, w in enumerate(widths)], axis=1)


def planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bit planes of every dimension, packed across rows into words, and where each dimension's planes begin."""
    short = -len(y) % 64
    y = np.concatenate([y, np.zeros((short, y.shape[1]), np.uint64)]) if short else y
    rows = [np.packbits(((y[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for d, n in enumerate(bits) for b in range(n)]
    return (np.stack(rows).view(np.uint64) if rows else np.zeros((0, len(y) // 64), np.uint64)), np.cumsum([0, *bits])


def scatter(y: np.ndarray, bits: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(d, e, limb, sum): the sum over rows of y[d] * y[e], d <= e, as sums by limb of LIMB powers of two. Every pair of planes counts the
    rows that have both bits, and the count weighs 2 to the power of their places."""
    plane, at = planes(y, bits)
    place = np.concatenate([np.arange(n) for n in bits]) if len(plane) else np.zeros(0, np.int64)
    limbs = (2 * max(bits, default=0)) // LIMB + 1
    for d, n in enumerate(bits):
        rest = plane[at[d] :]
        both = np.zeros((limbs, len(bits)), np.int64)
        for b in range(n):
            count = np.bitwise_count(plane[at[d] + b] & rest).sum(axis=1, dtype=np.int64)
            power = place[at[d] :] + b
            owner = np.repeat(np.arange(d, len(bits)), bits[d:])
            np.add.at(both, (power // LIMB, owner), count << (power % LIMB))
        for e in range(d, len(bits)):
            for limb in range(limbs):
                if both[limb, e]:
                    yield d, e, limb, int(both[limb, e])


@dataclass
class Whitening:
    """What was fitted: n different vectors with their sums by dimension, and the components, numbered from 1 by falling variance."""

    n: int
    sums: list[int]
    values: np.ndarray  # variances of the components
    vectors: np.ndarray  # a component in each column
    trace: float
    identity_error: float
    column: str

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows of `df` with a usable vector, with `whitened` (array<double>) and `deviation` (the exact squared distance from the mean
        times n * n), in place of columns that have these names."""
        dims, fitted = len(self.sums), self

        @F.arrow_udf("whitened array<double>, deviation string")
        def work(vectors: pa.Array) -> pa.Array:
            x = whole_numbers(matrix(vectors, dims))
            out = fitted.project(x)
            k = out.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(out.ravel()))
            return pa.StructArray.from_arrays([lists, pa.array([str(v) for v in deviations(x, fitted.n, fitted.sums)], pa.string())], ["whitened", "deviation"])

        vector = F.col(self.column).cast("array<double>")
        kept = df.where(usable(vector) & (F.size(vector) == dims))
        if not len(self.values):
            kept = kept.limit(0)
        both = work(vector)
        return kept.withColumn("whitened", both).withColumns({"deviation": F.col("whitened.deviation").try_cast(WIDE), "whitened": F.col("whitened.whitened")})


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean, as doubles. Whole parts are taken off as integers, so nothing is lost to the shift."""
    whole, part = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([p / n for p in part], np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S) squared for each row, exact."""
    whole, part = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    gap = x - np.array(whole, np.int64)
    far = (int(np.abs(gap).max(initial=0)) + 1) * n
    if far * far * max(1, len(sums)) < 2**62:
        off = n * gap - np.array(part, np.int64)
        return (off * off).sum(axis=1).tolist()
    return [sum((n * int(g) - p) ** 2 for g, p in zip(row, part)) for row in gap]


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fits the whitening on each different vector of `embeddings` once.

    Entries become whole numbers floor(64 * c) + 1,000,000. Less each dimension's smallest, they take few bits; the bit planes of all
    dimensions are packed across rows into words, and the weighted popcounts of the words' conjunctions are the exact cross-products. Tasks
    send one sum for each pair of dimensions and Spark adds them, so what meets does not grow with the rows. The covariance is centred as
    integers, n times the cross-products minus the products of sums, and turned into doubles last; eigh gives the components.

    Rows count if their vector is not missing, has no missing or non-finite entries, and is as long as most of these vectors (of the lengths
    that are equally frequent the longest); the others are left out of the fit and of `transform`. Entries beyond 2 ** 53 / 64 are held
    there. Components without variance are left out, so one vector alone, equal vectors or an empty table give no components and no rows.
    Repeated vectors count once, and frequent ones are combined before their shuffle."""
    vector = F.col(column).cast("array<double>")
    rows = embeddings.select(vector.alias("v")).where(usable(F.col("v")))
    by_length = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    most = by_length.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    dims = most[0]["dims"] if most else 0
    none = Whitening(0, [0] * dims, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0, column)
    if not dims:
        return none
    rows = rows.where(F.size("v") == dims)

    def ends(batches):
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(matrix(batch.column(0), dims))
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if (low <= high).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = rows.mapInArrow(ends, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each dimension
    low, top = np.zeros(dims, np.int64), [0] * dims
    for r in found:
        low[r["d"]], top[r["d"]] = r["low"], r["high"] - r["low"]
    bits = [t.bit_length() for t in top]
    widths = [next(w for w in WIDTHS if b <= 8 * w) for b in bits]

    def compact(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pack((whole_numbers(matrix(batch.column(0), dims)) - low).astype(np.uint64), widths)], ["y"])

    once = cut(rows.mapInArrow(compact, "y binary").distinct())

    def products(batches):
        total: dict[tuple[int, int, int], int] = {}
        rest, first, n = [], np.zeros(dims, object), 0

        def add(y):
            nonlocal first, n
            n += len(y)
            first = first + np.array([int(c) for c in (y >> np.uint64(32)).sum(axis=0)], object) * 2**32 + np.array([int(c) for c in (y & np.uint64(2**32 - 1)).sum(axis=0)], object)
            for d, e, limb, value in scatter(y, bits):
                total[d, e, limb] = total.get((d, e, limb), 0) + value

        held = 0
        for batch in batches:
            rest.append(unpack(batch.column(0), widths))
            held += len(rest[-1])
            if held >= BLOCK:
                y = np.concatenate(rest)
                for s in range(0, len(y) - BLOCK + 1, BLOCK):
                    add(y[s : s + BLOCK])
                rest = [y[len(y) // BLOCK * BLOCK :]]
                held = len(rest[0])
        if held:
            add(np.concatenate(rest))
        if n:
            out = [(-1, -1, 0, n), *((d, -1, 0, v) for d, v in enumerate(first)), *((*k, v) for k, v in total.items())]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array([Decimal(v) for v in columns[3]], pa.decimal128(38, 0))], ["d", "e", "limb", "v"])

    sums = once.mapInArrow(products, f"d int, e int, limb int, v {WIDE}").groupBy("d", "e", "limb").agg(F.sum("v").alias("v")).collect()  # as many rows as pairs of dimensions
    first, cross, n = [0] * dims, [[0] * dims for _ in range(dims)], 0
    for r in sums:
        if r["d"] < 0:
            n = int(r["v"])
        elif r["e"] < 0:
            first[r["d"]] = int(r["v"])
        else:
            cross[r["d"]][r["e"]] += int(r["v"]) << LIMB * r["limb"]
    if not n:
        return none
    # n * n times the covariance; subtracting each dimension's smallest changed nothing in it.
    exact = [[n * cross[min(d, e)][max(d, e)] - first[d] * first[e] for e in range(dims)] for d in range(dims)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])
    trace = sum(exact[d][d] for d in range(dims)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0.0) * dims * np.finfo(float).eps]
    fitted = Whitening(n, [s + n * int(b) for s, b in zip(first, low)], values[order], np.ascontiguousarray(vectors[:, order]), trace, 0.0, column)
    if len(order):
        fitted.identity_error = measured_error(once, fitted, low, widths)
    return fitted


def measured_error(once: DataFrame, fitted: Whitening, low: np.ndarray, widths: list[int]) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, summed over the rows themselves."""
    k = len(fitted.values)

    def work(batches):
        first, both, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            if batch.num_rows:
                z = fitted.project(unpack(batch.column(0), widths).astype(np.int64) + low)
                first, both, n = first + z.sum(axis=0), both + z.T @ z, n + len(z)
        if n:
            at = np.arange(k * k)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1 - np.arange(k)], pa.int32()), pa.array(np.r_[both.ravel(), first])], ["at", "v"])

    got = {r["at"]: r["v"] / fitted.n for r in once.mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got.get(-1 - i, 0.0) for i in range(k)])
    covariance = np.array([got.get(i, 0.0) for i in range(k * k)]).reshape(k, k) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding")
    fitted = fit(rows)
    out = fitted.transform(rows).select("vec_id", F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(v) for v in fitted.explained]) if fitted.explained else F.array().cast("array<double>")
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
