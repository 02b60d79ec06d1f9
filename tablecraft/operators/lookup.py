"""Fitted key-to-value maps and the join that applies them to tables of any size and skew."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.columns import col
from tablecraft.functions.durable import durable
from tablecraft.settings import SETTINGS


@dataclass
class Mapping:
    """Unique text keys with one value each.

    A small map (its rows and bytes were measured) is broadcast. A large one stays distributed,
    next to a short broadcast list of hashes of the keys that are frequent in the fitted table.
    """

    table: DataFrame  # (key string, value)
    small: bool
    hot: DataFrame | None = None


def build(counts: DataFrame, value: str | None = None, rows: int | None = None, size: int | None = None) -> Mapping:
    """A mapping from (key, n, <value>) rows, n being how often the fitted table holds the key.

    Without a value column, the value is the 0-based rank of the key in code-point order.
    """
    rows = SETTINGS.broadcast_rows if rows is None else rows
    size = SETTINGS.broadcast_bytes if size is None else size
    spark = counts.sparkSession
    counts = counts.persist()
    try:
        seen = counts.agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("key").cast("bigint")).alias("bytes")
        ).first()
        if seen["rows"] <= rows and (seen["bytes"] or 0) <= size:
            if value is None:
                held = counts.select("key").toArrow().sort_by("key")
                held = held.append_column("value", pa.array(range(held.num_rows), pa.int64()))
            else:
                held = counts.select("key", F.col(value).alias("value")).toArrow()
            return Mapping(spark.createDataFrame(held), True)
        kept = ranked(counts) if value is None else durable(counts.withColumnRenamed(value, "value"))
    finally:
        counts.unpersist()
    # Keys stand in the broadcast list as hashes of fixed size, however long they are.
    hot = kept.orderBy(F.desc("n"), "key").limit(SETTINGS.hot_keys).select(F.sha2("key", 256).alias("key"), "value")
    return Mapping(kept.select("key", "value"), False, spark.createDataFrame(hot.toArrow()))


def hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def spread_of(df: DataFrame) -> Column:
    """A salt that differs between rows and, for identical rows, between input partitions."""
    return F.pmod(F.xxhash64(*[col(c) for c in hashable(df)]) + F.spark_partition_id(), F.lit(SETTINGS.spread)).cast("int")


def apply(df: DataFrame, key: Column, mapping: Mapping, name: str, default: Column) -> DataFrame:
    """Append column `name`: the mapped value of `key`, or the default for missing and unknown keys."""
    key = key.cast("string")
    if mapping.small:
        side = mapping.table.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
        out = df.withColumn("__k", key).join(F.broadcast(side), F.col("__k") == F.col("__key"), "left")
        return out.withColumn(name, F.coalesce("__value", default)).drop("__k", "__key", "__value")
    hot = mapping.hot.select(F.col("key").alias("__hot_key"), F.col("value").alias("__hot"), F.lit(True).alias("__is_hot"))
    cold = mapping.table.select(F.concat(F.lit("k"), "key").alias("__key"), F.col("value").alias("__value"))
    out = df.withColumn("__k", key).withColumn("__salt", spread_of(df))
    out = out.join(F.broadcast(hot), F.sha2("__k", 256) == F.col("__hot_key"), "left")
    # Rows with a frequent or missing key are answered already: in place of the key they carry a
    # salt that no key equals, which spreads them over all partitions of the second join.
    answered = F.col("__is_hot").isNotNull() | F.col("__k").isNull()
    probe = F.when(answered, F.concat(F.lit("s"), F.col("__salt").cast("string"))).otherwise(F.concat(F.lit("k"), "__k"))
    out = out.withColumn("__probe", probe).join(cold, F.col("__probe") == F.col("__key"), "left")
    return out.withColumn(name, F.coalesce("__hot", "__value", default)).drop(
        "__k", "__salt", "__hot_key", "__hot", "__is_hot", "__probe", "__key", "__value"
    )


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.cast("string").alias("key")).where("key IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("n")
    )


def ranked(counts: DataFrame) -> DataFrame:
    """(key, n, value): the 0-based rank of each of very many keys in code-point order.

    The keys are range-partitioned and written out once; a rank is then the position inside its
    range plus the sizes of the ranges before it.
    """
    ordered = durable(counts.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("key")
    return (
        ordered.join(F.broadcast(starts), "part")
        .withColumn("value", (F.col("start") + F.row_number().over(inside) - 1).cast("bigint"))
        .select("key", "n", "value")
    )
