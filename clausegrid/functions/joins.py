"""Join sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most_rows`` rows at most; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
