"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side that was counted to hold at most ``max_rows`` rows.

    The count stops at the bound. A larger side comes back without a hint and
    is joined by shuffle, where adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that grows with the graph or the paths: joined by sorting, never gathered by the driver for a broadcast."""
    return df.hint("merge")
