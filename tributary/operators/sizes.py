"""Sides of checked size for broadcasts, and quantiles on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import quantiles_by


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast where its rows, once counted, are at most so many; the join is the planner's choice beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, of the values that are not null or NaN; null where there are none."""
    row = quantiles_by(df, [], value, {f"q{k}": q for k, q in enumerate(shares)}).first()
    return list(row) if row else [None] * len(shares)
