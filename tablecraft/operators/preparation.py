"""From a table to a model matrix: task detection, dates to numbers, coercion, scaling, splits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import (
    add_columns,
    col,
    datetime_cols,
    moment,
    number,
    parse_moment,
    string_cols,
)
from tablecraft.functions.hashing import HASH_BITS, row_hash
from tablecraft.functions.statistics import distinct_counts, quantiles, scalars
from tablecraft.operators import lookup
from tablecraft.operators.cleaning import date_part
from tablecraft.operators.encoding import label_mapping
from tablecraft.operators.profiling import local_rows
from tablecraft.settings import SETTINGS

MISSING_CATEGORY = "__MISSING__"
FINITE_BOUND = 1e10


# --- task --------------------------------------------------------------------------------------


def task_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, task, n_unique): what kind of model each column would need as a target."""
    cap = SETTINGS.classification_unique
    kinds = {c: df.schema[c].dataType for c in columns}
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    meta = local_rows(
        df, [(c, isinstance(kinds[c], T.BooleanType), c in text) for c in columns], "column string, is_bool boolean, is_text boolean"
    )
    castable = scalars(df, text, {"share": lambda x: F.avg(x)}, lambda d, c: F.when(col(c).isNotNull(), number(d, c).isNotNull().cast("double")))
    shares = local_rows(df, [(c, castable[c]["share"]) for c in text], "column string, share double")
    d = F.col("n_unique")
    by_count = F.when(d == 2, "binary_classification").otherwise("multiclass_classification")
    task = (
        F.when(F.col("is_bool"), "binary_classification")
        .when(F.col("is_text") & (d > cap) & (F.col("share") > 0.95), "regression")
        .when(F.col("is_text"), by_count)
        .when(d <= cap, by_count)
        .otherwise("regression")
    )
    return (
        distinct_counts(df, columns)
        .join(F.broadcast(meta), "column")
        .join(F.broadcast(shares), "column", "left")
        .select("column", task.alias("task"), F.when(F.col("is_bool"), 2).otherwise(d).cast("bigint").alias("n_unique"))
    )


def task_type(df: DataFrame, target: str) -> tuple[str, int]:
    row = task_types(df, [target]).first()
    return row["task"], row["n_unique"]


# --- numbers -----------------------------------------------------------------------------------

# Suffixes of the numbers a date column turns into.
DATE_NUMBERS = ("year", "month", "day", "dow")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a local timestamp, independent of the session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    fraction = F.date_part(F.lit("SECOND"), ts).cast("double")
    return days * 86400.0 + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + fraction


def dates_to_numbers(df: DataFrame) -> DataFrame:
    """Replace date and timestamp columns by year, month, day, dow and epoch doubles."""
    columns = datetime_cols(df)
    new = []
    for c in columns:
        ts = moment(df, c)
        new += [date_part(ts, p).cast("double").alias(f"{c}_{p}") for p in DATE_NUMBERS]
        new.append(epoch_seconds(ts).alias(f"{c}_epoch"))
    return df.select(*[col(c) for c in df.columns if c not in columns], *new)


def coercions(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """How each column becomes a number: cast, cast_or_median, epoch, label, or none (unsupported type)."""
    text = [c for c in columns if c in string_cols(df)]
    metrics = {
        "n": lambda s: F.count(F.lit(1)),
        "held": lambda s: F.count(s["t"]),
        "numbers": lambda s: F.count(s["x"]),
        "dates": lambda s: F.count(parse_moment(s["t"])),
    }
    seen = scalars(df, text, metrics, lambda d, c: F.struct(col(c).alias("t"), number(d, c).alias("x")))
    plan = {}
    for c in columns:
        kind = df.schema[c].dataType
        if c in seen:
            s = seen[c]
            if s["numbers"] and s["numbers"] == s["held"]:
                plan[c] = "cast"
            elif s["numbers"]:
                plan[c] = "cast_or_median"
            elif s["dates"] > 0.5 * s["n"]:
                plan[c] = "epoch"
            else:
                plan[c] = "label"
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            plan[c] = "cast"
        elif c in datetime_cols(df):
            plan[c] = "epoch"
        else:
            plan[c] = "none"
    return plan


def _finite(x: Column) -> Column:
    """Missing as 0; infinities become a large finite number, finite ones of any size stay."""
    inf = F.lit(math.inf)
    return F.coalesce(F.when(x == inf, FINITE_BOUND).when(x == -inf, -FINITE_BOUND).otherwise(x), F.lit(0.0))


@dataclass
class Coercion:
    plan: dict[str, str]
    medians: dict[str, float]
    labels: dict[str, lookup.Mapping]

    @property
    def columns(self) -> list[str]:
        return [c for c, how in self.plan.items() if how != "none"]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replaces the fitted columns by doubles without missing or infinite values; others pass through."""
        out = df
        for c, mapping in self.labels.items():
            key = F.coalesce(col(c), F.lit(MISSING_CATEGORY))
            out = lookup.apply(out, key, mapping, f"__label_{c}", F.lit(-1).cast("bigint"))
        new = {}
        for c, how in self.plan.items():
            if how == "cast":
                new[c] = _finite(number(df, c))
            elif how == "cast_or_median":
                new[c] = _finite(F.coalesce(number(df, c), F.lit(self.medians[c])))
            elif how == "epoch":
                new[c] = F.coalesce(epoch_seconds(moment(df, c)), F.lit(0.0))
            elif how == "label":
                new[c] = col(f"__label_{c}").cast("double")
        return add_columns(out, new).select(*[col(c) for c in df.columns if self.plan.get(c) != "none"])


def fit_coercion(df: DataFrame, columns: list[str]) -> Coercion:
    plan = coercions(df, columns)
    halves = [c for c, how in plan.items() if how == "cast_or_median"]
    medians = {c: q[0] for c, q in quantiles(df, halves, [0.5]).items()} if halves else {}
    labels = {c: label_mapping(df, c, MISSING_CATEGORY) for c, how in plan.items() if how == "label"}
    return Coercion(plan, medians, labels)


# --- prepared data -----------------------------------------------------------------------------


@dataclass
class Prepared:
    """Numeric, scaled features and a numeric label; every parameter is fitted once and can be re-applied."""

    target: str
    task: str
    features: list[str]
    coercion: Coercion
    shifts: dict[str, tuple[float, float]]
    target_labels: lookup.Mapping | None

    def flat(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Scaled feature columns plus `label`, and the `keep` columns untouched."""
        keep = keep or []
        frame = dates_to_numbers(add_columns(df, {f"__keep_{k}": col(k) for k in keep if k in datetime_cols(df)}))
        held = {k: f"__keep_{k}" if f"__keep_{k}" in frame.columns else k for k in keep}
        frame = add_columns(frame, {f"__id_{k}": col(v) for k, v in held.items()})
        if self.target not in frame.columns:
            frame = frame.withColumn(self.target, F.lit(None).cast("double"))
        if self.target_labels is not None:
            key = F.coalesce(col(self.target).cast("string"), F.lit("nan"))
            frame = lookup.apply(frame, key, self.target_labels, "__label", F.lit(-1).cast("bigint"))
            y = F.col("__label").cast("double")
        else:
            y = _finite(number(frame, self.target))
        frame = frame.withColumn("__y", y).drop("__label")
        numbers = self.coercion.transform(frame)
        scaled = [
            ((col(c) - F.lit(self.shifts[c][0])) / F.lit(self.shifts[c][1])).alias(c) for c in self.features
        ]
        return numbers.select(*[col(f"__id_{k}").alias(k) for k in keep], *scaled, F.col("__y").alias("label"))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(keep..., features vector, label)."""
        keep = keep or []
        flat = self.flat(df, keep)
        names = {c: f"__f{i}" for i, c in enumerate(self.features)}
        flat = flat.select(*[col(k) for k in keep], *[col(c).alias(n) for c, n in names.items()], "label")
        return (
            VectorAssembler(inputCols=list(names.values()), outputCol="features")
            .transform(flat)
            .select(*[col(k) for k in keep], "features", "label")
        )


def prepare(df: DataFrame, target: str, task: str, exclude: list[str] | None = None, fit_on: DataFrame | None = None) -> Prepared:
    """Fits dates, coercion and scaling; on the whole table, or on `fit_on` to keep held-out rows out of it.

    A datetime target is replaced by its first calendar number.
    """
    source = dates_to_numbers(df if fit_on is None else fit_on)
    if target not in source.columns:
        target = f"{target}_{DATE_NUMBERS[0]}"
    pool = [c for c in source.columns if c != target and c not in (exclude or [])]
    coercion = fit_coercion(source, pool)
    features = coercion.columns
    if not features:
        raise ValueError("no column can be turned into a number")
    stats = scalars(coercion.transform(source), features, {"m": F.avg, "s": F.stddev_pop}, lambda d, c: col(c))
    shifts = {c: (stats[c]["m"] or 0.0, stats[c]["s"] or 1.0) for c in features}
    labels = None
    if "classification" in task:
        labels = label_mapping(source, target)
    return Prepared(target, task, features, coercion, shifts, labels)


# --- splits ------------------------------------------------------------------------------------

BUCKET_BITS = 16


def hash_split(df: DataFrame, keys: list[str], test: float = SETTINGS.test_size, val: float = SETTINGS.val_size) -> DataFrame:
    """Adds `split` = train, val or test from the key alone: no shuffle, stable under re-partitioning."""
    space = float(2**HASH_BITS)
    spot = row_hash(keys)
    name = F.when(spot < F.lit(int(test * space)), "test").when(spot < F.lit(int((test + val) * space)), "val")
    return df.withColumn("split", name.otherwise("train"))


def class_cuts(hashed: DataFrame, parts: dict[str, float]) -> DataFrame:
    """(label, <part>...): the hash up to which each class belongs to the part, by exact counts.

    A histogram of 2^16 hash buckets per class (combined on the map side) finds the bucket of each
    cut; only the rows of that one bucket are then ordered.
    """
    bucketed = hashed.withColumn("bucket", F.shiftright("hash", HASH_BITS - BUCKET_BITS))
    counts = bucketed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("label", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    wanted = [
        sizes.select("label", F.lit(p).alias("part"), F.round(F.col("size") * F.lit(share), 0).cast("bigint").alias("want"))
        for p, share in parts.items()
    ]
    want = wanted[0]
    for w in wanted[1:]:
        want = want.unionByName(w)
    spots = spans.join(want, "label").where("want > below AND want <= below + n").select(
        "label", "part", "bucket", (F.col("want") - F.col("below")).alias("place")
    )
    order = Window.partitionBy("label", "part").orderBy("hash")
    edges = (
        bucketed.join(spots, ["label", "bucket"])
        .withColumn("at", F.row_number().over(order))
        .where("at = place")
        .groupBy("label")
        .pivot("part", list(parts))
        .agg(F.max("hash"))
    )
    return sizes.join(edges, "label", "left")


def stratified_split(
    df: DataFrame, keys: list[str], label: str, test: float = SETTINGS.test_size, val: float = SETTINGS.val_size
) -> DataFrame:
    """Adds `split` with the same test and validation share in every class (rows of a class in hash order).

    Falls back to the plain hash split, for all rows, when some class is too small to be divided for testing, or what is left of it for
    validation. The number of classes is not limited. Rows without a label are split by their hash alone.
    """
    hashed = df.select(col(label).cast("string").alias("label"), row_hash(keys).alias("hash")).where("label IS NOT NULL")
    seen = hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).first()
    share = val / (1 - test)
    left = (seen["least"] or 0) - round((seen["least"] or 0) * test)
    enough = (seen["least"] or 0) >= max(2, math.ceil(1 / test)) and (val <= 0 or left >= max(2, math.ceil(1 / share)))
    if seen["classes"] < 2 or not enough:
        return hash_split(df, keys, test, val)
    # The cuts are a map from class to two numbers: broadcast if few, joined by class with hot ones set apart if many.
    cuts = class_cuts(hashed, {"test_cut": test, "val_cut": test + val})
    cuts = cuts.select(F.col("label").alias("key"), F.col("size").alias("n"), F.struct("test_cut", "val_cut").alias("cuts"))
    mapping = lookup.build(cuts, "cuts")
    space = float(2**HASH_BITS)
    alone = F.struct(F.lit(int(test * space)).cast("bigint").alias("test_cut"), F.lit(int((test + val) * space)).cast("bigint").alias("val_cut"))
    out = lookup.apply(df.withColumn("__hash", row_hash(keys)), col(label).cast("string"), mapping, "__cuts", alone)
    name = F.when(F.col("__hash") <= F.col("__cuts.test_cut"), "test").when(F.col("__hash") <= F.col("__cuts.val_cut"), "val")
    return out.withColumn("split", name.otherwise("train")).drop("__hash", "__cuts")
