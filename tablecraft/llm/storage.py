"""Lineage cuts in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of its own only for a local session that names none."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if named is None and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tablecraft-llm-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from reliable files from now on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Counts up to EXACT are told apart one by one, larger ones in steps of about a hundredth; keys of one step by SPREAD groups of their hash.
EXACT, STEPS, SPREAD = 4096, 64, 4096
#: Lists among which the keys at the edge are dealt where their order counts.
LISTS = 16


def most_frequent(counts: DataFrame, limit: int, key: str, ordered: bool = False) -> DataFrame:
    """The rows of `counts` (n, key, ...) with the largest n, at most `limit` of them, without sorting all.

    A histogram of n, of at most some 7,000 steps, tells the step at which `limit` is passed; of that step, keys go by groups of their hash,
    so that what is left out beyond `limit` is one group. If `ordered`, they go by n and key, so the rows are exactly `limit`: a fixed number
    of lists, each cut at the room that is left, meet in one sort. `counts` is read three times at most: cut it before."""
    n = F.col("n")
    step = F.when(n < EXACT, n).otherwise(EXACT + F.floor(STEPS * F.log2(n / EXACT))).cast("long")
    group = F.pmod(F.xxhash64(key), F.lit(SPREAD))

    def passed(rows: DataFrame, by, room: int) -> tuple[int | None, int]:
        """The first value of `by`, in falling order, whose rows do not fit, and the room before it."""
        for at, size in sorted(((r["at"], r["size"]) for r in rows.groupBy(by.alias("at")).agg(F.count("*").alias("size")).collect()), reverse=True):
            if size > room:
                return at, room
            room -= size
        return None, room

    edge, room = passed(counts, step, limit)
    if edge is None:
        return counts
    if ordered:
        ties = counts.where(step == edge)
        place = Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(LISTS))).orderBy(F.desc("n"), key)
        kept = ties.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= room).drop("_place")
        return counts.where(step > edge).union(kept.orderBy(F.desc("n"), key).limit(room))
    last, _ = passed(counts.where(step == edge), group, room)
    return counts.where((step > edge) | ((step == edge) & (group > last)))
