"""Encodings of categories as numbers, fitted on the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import add_columns, col, number
from tablecraft.functions.hashing import row_hash
from tablecraft.operators import lookup
from tablecraft.operators.fitted import Fitted, known
from tablecraft.operators.profiling import top_values
from tablecraft.settings import SETTINGS

OTHER = "__OTHER__"
MISSING_LABEL = "nan"


def _mapped(frame: DataFrame, steps) -> DataFrame:
    return reduce(lambda out, step: lookup.apply(out, *step), steps, frame)


def label_mapping(df: DataFrame, name: str, missing: str = MISSING_LABEL) -> lookup.Mapping:
    """Text value to 0-based rank in code-point order; missing values count as the given text."""
    counts = lookup.key_counts(df, F.coalesce(col(name).cast("string"), F.lit(missing)))
    return lookup.build(counts)


def label(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_label: the rank of the value among the sorted distinct values (-1 for values not seen in the fit)."""
    cols = known(df, columns)
    maps = {c: label_mapping(df, c) for c in cols}

    def transform(frame: DataFrame) -> DataFrame:
        return _mapped(
            frame,
            [
                (F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL)), maps[c], f"{c}_label", F.lit(-1).cast("bigint"))
                for c in cols
            ],
        )

    return Fitted(
        "Label Encoding", "transformation", columns, [f"{c}_label" for c in cols],
        f"Label encoded {len(cols)} columns.", transform, {"mappings": {c: m.table for c, m in maps.items()}},
    )


def onehot(df: DataFrame, columns: list[str], drop_first: bool = True, max_categories: int = SETTINGS.onehot_max_categories) -> Fitted:
    """{c}_{value} indicator columns in sorted order, the first left out.

    Beyond the cap only the most frequent values stay; the source column itself then holds
    __OTHER__ for the rest, missing values included.
    """
    cols = known(df, columns)
    top: dict[str, list[str]] = {c: [] for c in cols}
    if cols:  # one value more than the cap tells whether it is exceeded
        for r in top_values(df, cols, max_categories + 1).orderBy("column", "rank").collect():
            top[r["column"]].append(r["value"])
    capped = [c for c in cols if len(top[c]) > max_categories]
    kept = {c: top[c][:max_categories] for c in cols}
    levels = {c: sorted(kept[c] + ([OTHER] if c in capped else []), key=lambda v: v.encode()) for c in cols}
    shown = {c: levels[c][1:] if drop_first else levels[c] for c in cols}

    def transform(frame: DataFrame) -> DataFrame:
        value = {
            c: F.when(col(c).cast("string").isin(kept[c]), col(c).cast("string")).otherwise(F.lit(OTHER))
            if c in capped
            else col(c).cast("string")
            for c in cols
        }
        new = {c: value[c] for c in capped}
        for c in cols:
            new |= {f"{c}_{v}": F.when(value[c] == F.lit(v), 1).otherwise(0).cast("bigint") for v in shown[c]}
        return add_columns(frame, new)

    out = [f"{c}_{v}" for c in cols for v in shown[c]]
    return Fitted(
        "One-Hot Encoding", "transformation", columns, out,
        f"Created {len(out)} indicator columns." + (f" Capped: {', '.join(capped)}." if capped else ""),
        transform, {"levels": levels, "capped": capped},
    )


def target_mean(df: DataFrame, columns: list[str], target: str) -> Fitted:
    """{c}_target_enc: the mean target of the value; the overall mean for missing and unseen values."""
    cols = known(df, columns) if target in df.columns else []
    overall = df.agg(F.avg(number(df, target)).alias("m")).first()["m"] if cols else None
    maps = {}
    for c in cols:
        means = (
            df.select(col(c).cast("string").alias("key"), number(df, target).alias("y"))
            .where("key IS NOT NULL")
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
        )
        maps[c] = lookup.build(means, "mean")
    base = F.lit(overall).cast("double")

    def transform(frame: DataFrame) -> DataFrame:
        return _mapped(frame, [(col(c), maps[c], f"{c}_target_enc", base) for c in cols])

    return Fitted(
        "Target Encoding", "transformation", columns, [f"{c}_target_enc" for c in cols],
        f"Encoded {len(cols)} columns by the mean of '{target}'.", transform, {"overall": overall},
    )


def target_mean_out_of_fold(df: DataFrame, keys: list[str], columns: list[str], target: str, folds: int = 5, smoothing: float = 10.0) -> Fitted:
    """{c}_target_oof: the mean target of the value over the rows of all other folds, so that a row never sees its own target.

    A row's fold comes from a hash of its key, so no rows are shuffled for it. Sums by value and fold are counted once; a row's value is the
    sums of its category less those of its own fold, drawn towards the other folds' overall mean with the weight of `smoothing` rows. Values
    found in no other fold, and missing ones, get that mean. `transform` encodes the fitted rows; `info["score"]` encodes new rows, which
    belong to no fold, from all rows. Rows without a target number take part in no sum. Without any target the result is null."""
    cols = known(df, columns) if target in df.columns else []
    fold = F.pmod(row_hash(keys), F.lit(folds)).cast("int")
    y = number(df, target)
    by_fold = {r["fold"]: (r["n"], r["s"]) for r in df.select(fold.alias("fold"), y.alias("y")).where("y IS NOT NULL").groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("s")).collect()}
    n, s = sum(v[0] for v in by_fold.values()), sum(v[1] for v in by_fold.values())
    mean = s / n if n else None
    rest = {f: (n - by_fold.get(f, (0, 0.0))[0], s - by_fold.get(f, (0, 0.0))[1]) for f in range(folds)}
    priors = [rest[f][1] / rest[f][0] if rest[f][0] else None for f in range(folds)]
    prior = F.get(F.array(*[F.lit(p).cast("double") for p in priors]), F.col("fold"))
    own, whole = {}, {}
    for c in cols:
        sums = df.select(col(c).cast("string").alias("value"), fold.alias("fold"), y.alias("y")).where("value IS NOT NULL AND y IS NOT NULL")
        sums = sums.groupBy("value", "fold").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
        total = sums.groupBy("value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s")))).alias("parts"))
        left = total.select("value", "n", "s", F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("fold"), "parts")
        part = F.try_element_at("parts", F.col("fold"))
        left = left.withColumns({"n": F.col("n") - F.coalesce(part["n"], F.lit(0)), "s": F.col("s") - F.coalesce(part["s"], F.lit(0.0))}).where("n > 0")
        smooth = (F.col("s") + smoothing * prior) / (F.col("n") + smoothing)
        own[c] = lookup.build(left.select(F.concat_ws("|", F.col("fold").cast("string"), "value").alias("key"), "n", smooth.alias("mean")), "mean")
        smooth = (F.col("s") + F.lit(smoothing * (mean or 0.0))) / (F.col("n") + smoothing)
        whole[c] = lookup.build(total.select(F.col("value").alias("key"), "n", smooth.alias("mean")), "mean")

    def transform(frame: DataFrame) -> DataFrame:
        base = F.get(F.array(*[F.lit(p).cast("double") for p in priors]), fold)
        steps = [(F.when(col(c).isNotNull(), F.concat_ws("|", fold.cast("string"), col(c).cast("string"))), own[c], f"{c}_target_oof", base) for c in cols]
        return _mapped(frame, steps)

    def score(frame: DataFrame) -> DataFrame:
        return _mapped(frame, [(col(c), whole[c], f"{c}_target_oof", F.lit(mean).cast("double")) for c in cols])

    return Fitted(
        "Out-of-Fold Target Encoding", "transformation", columns, [f"{c}_target_oof" for c in cols],
        f"Encoded {len(cols)} columns by the mean of '{target}' in {folds} folds.", transform, {"overall": mean, "score": score},
    )


def frequency(df: DataFrame, columns: list[str]) -> Fitted:
    """{c}_freq: the share of the value among the present values; 0 for missing and unseen values."""
    cols = known(df, columns)
    totals = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else {}
    maps = {}
    for i, c in enumerate(cols):
        counts = lookup.key_counts(df, col(c))
        maps[c] = lookup.build(counts.withColumn("share", F.col("n") / F.lit(float(max(totals[f"n{i}"], 1)))), "share")

    def transform(frame: DataFrame) -> DataFrame:
        return _mapped(frame, [(col(c), maps[c], f"{c}_freq", F.lit(0.0)) for c in cols])

    return Fitted(
        "Frequency Encoding", "transformation", columns, [f"{c}_freq" for c in cols],
        f"Frequency-encoded {len(cols)} columns.", transform,
    )
