"""Reproducible random numbers of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.settings import SETTINGS

HASH_BITS = 48


def row_hash(keys: list[str], seed: int = SETTINGS.random_state) -> Column:
    """48 reproducible random bits per row from its key and the seed."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")
