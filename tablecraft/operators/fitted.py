"""What a fit returns: its parameters and a lazy transform for any table with the same columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tablecraft.functions.columns import col


@dataclass
class Fitted:
    operation: str
    category: str
    columns_in: list[str]
    columns_out: list[str]
    detail: str
    transform: Callable[[DataFrame], DataFrame]
    info: dict[str, Any] = field(default_factory=dict)


def known(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def keep_selected(df: DataFrame, pool: list[str], selected: list[str]) -> DataFrame:
    """Columns outside the pool first, then the selected ones."""
    return df.select(*[col(c) for c in df.columns if c not in pool], *[col(c) for c in selected])
