"""Operations on event streams that keep state for as long as late rows are awaited."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablecraft.functions.columns import col, present


def awaited(rows: DataFrame, time: str, lateness: str) -> DataFrame:
    """Rows with a time; those of a stream that fall behind the latest one seen by more than `lateness` will be late. A time without zone is
    read in the session's zone, as only times with one can be awaited."""
    timed = rows.where(col(time).isNotNull())
    if isinstance(rows.schema[time].dataType, (T.TimestampNTZType, T.DateType)):
        timed = timed.withColumn(time, col(time).cast("timestamp"))
    return timed.withWatermark(time, lateness) if rows.isStreaming else timed


def running_profile(stream: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), every: str = "6 hours", lateness: str = "1 day", slide: str | None = None) -> DataFrame:
    """A row for each window of event time (and group): rows, and for each value its count, nulls, mean, sample deviation, least and largest.

    State is one row per open window and group, whatever arrives in it; a window is given once, when no row of it is awaited any more,
    and its state goes. Rows for a window that was given already are dropped, and so are rows without a time. NaN counts as null. The same
    call on a batch gives every window of the batch."""
    window = F.window(col(time), every, slide) if slide else F.window(col(time), every)
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for v in values:
        x = present(stream, v)
        measures += [
            F.count(x).alias(f"{v}_count"), F.count_if(x.isNull()).alias(f"{v}_nulls"), F.avg(x).alias(f"{v}_mean"),
            F.stddev_samp(x).alias(f"{v}_std"), F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"),
        ]
    rows = awaited(stream, time, lateness)
    grouped = rows.groupBy(window.alias("window"), *[col(c) for c in by]).agg(*measures)
    new = [m for v in values for m in (f"{v}_count", f"{v}_nulls", f"{v}_mean", f"{v}_std", f"{v}_min", f"{v}_max")]
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[col(c) for c in by], "n_rows", *[col(c) for c in new])


def first_deliveries(stream: DataFrame, keys: Sequence[str], time: str, lateness: str = "1 day") -> DataFrame:
    """The first delivery of each key, for sources that may deliver a row again.

    State is one small entry per key, which goes when the watermark has passed the row's time by `lateness`; repeats within that time are
    found. Late rows and rows without a time are dropped. In a batch all repeats go, and which row of a key stays is open."""
    rows = awaited(stream, time, lateness)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if stream.isStreaming else rows.dropDuplicates(list(keys))


def sessions(stream: DataFrame, time: str, by: Sequence[str], gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """A row for each run of rows of a group with no pause as long as `gap`: its start, end and rows. A late row may still join two runs that
    are open. Null groups are a group; rows without a time are dropped."""
    rows = awaited(stream, time, lateness)
    grouped = rows.groupBy(F.session_window(col(time), gap).alias("session"), *[col(c) for c in by]).agg(F.count(F.lit(1)).alias("n_rows"))
    return grouped.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *[col(c) for c in by], "n_rows")


def arrivals(spark, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, at most `files` of them in one batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def run_available(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what has arrived since the last run, appends finished results to a Parquet folder, and ends. State, offsets and what was written
    are in `checkpoint`, so the next run goes on from there, also after a failure."""
    query = results.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
