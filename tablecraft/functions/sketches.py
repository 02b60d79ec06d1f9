"""Mergeable summaries of columns: quantiles and distinct counts of parts add up to those of the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import number, present
from tablecraft.functions.statistics import chunks, union_all, unpivoted
from tablecraft.settings import SETTINGS

QUANTILES, DISTINCT = "quantiles", "distinct"
#: Size parameters: of a quantile state, and the binary logarithm of the registers of a distinct state.
K, LG_K = 1_000, 14
STATE_SCHEMA = "column string, kind string, n long, nulls long, state binary"


def rank_error(k: int = K) -> float:
    """The rank of a quantile's estimate is off by no more than this share of the rows, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a distinct count's estimate, as a share of it."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def states(df: DataFrame, numbers: Sequence[str] = (), values: Sequence[str] = (), k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(column, kind, n, nulls, state): a quantile state for each of `numbers` and a distinct state for each of `values`, in one pass each.

    A state has a bounded size whatever the rows; tasks send states, not values. The rows are a plain table: it can be written beside the
    file that it describes, and `merge` adds up the states of many files without reading the files again. Nulls and NaN count as nulls, a
    column without values has no state (null), and an empty table gives a row per column."""
    parts = []
    for names, kind, value in ((numbers, QUANTILES, number), (values, DISTINCT, lambda d, c: present(d, c).cast("string"))):
        for chunk in chunks(list(names), SETTINGS.columns_per_job):
            make = F.kll_sketch_agg_double("x", k) if kind == QUANTILES else F.hll_sketch_agg("x", lg_k)
            listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(chunk)])
            counted = unpivoted(df, chunk, value).groupBy("position").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), make.alias("state"))
            named = df.sparkSession.range(1).select(F.inline(listed)).join(counted, "position", "left")
            parts.append(named.select(
                "column", F.lit(kind).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nulls", F.lit(0)).alias("nulls"), F.when(F.col("n") > 0, F.col("state")).alias("state")))
    return union_all(parts) if parts else df.sparkSession.createDataFrame([], STATE_SCHEMA)


def merge(found: DataFrame) -> DataFrame:
    """One state per column and kind from those of any number of parts. States of different size parameters can be merged."""
    parts = []
    for kind, together in ((QUANTILES, F.kll_merge_agg_double("state")), (DISTINCT, F.hll_union_agg("state", True))):
        sums = found.where(F.col("kind") == kind).groupBy("column", "kind").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))
        made = found.where((F.col("kind") == kind) & F.col("state").isNotNull()).groupBy("column").agg(together.alias("state"))
        parts.append(sums.join(made, "column", "left").select("column", "kind", "n", "nulls", "state"))
    return union_all(parts)


def quantile_estimates(found: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(column, p, estimate) from quantile states; an estimate is a value of the column."""
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    rows = found.where(F.col("kind") == QUANTILES).select("column", F.when(F.col("state").isNotNull(), F.kll_sketch_get_quantile_double("state", asked)).alias("v"))
    return rows.select("column", F.explode(F.transform(asked, lambda p, i: F.struct(p.alias("p"), F.get("v", i).alias("estimate")))).alias("e")).select("column", "e.*")


def distinct_estimates(found: DataFrame) -> DataFrame:
    """(column, estimate) from distinct states."""
    estimate = F.when(F.col("state").isNotNull(), F.hll_sketch_estimate("state")).otherwise(F.lit(0))
    return found.where(F.col("kind") == DISTINCT).select("column", estimate.cast("bigint").alias("estimate"))
