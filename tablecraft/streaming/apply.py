"""Running fitted operations over newly arriving files.

A fitted transform is row-local, or a lookup against a fixed table, so it holds on a streaming
DataFrame as it does on a batch one; nothing is refitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablecraft.operators.fitted import Fitted


def transform_all(df: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    for step in steps:
        df = step.transform(df)
    return df


def run_available(source: DataFrame, steps: Sequence[Fitted], path: str, checkpoint: str) -> StreamingQuery:
    """Transforms everything that has arrived since the last run and appends it to a Parquet folder."""
    out = transform_all(source, steps)
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
