"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 * 1024 * 1024


def fits_broadcast(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Measured size of ``df`` (sum of ``row_bytes``) is within ``limit``."""
    measured = df.agg(F.sum(row_bytes).alias("bytes")).first()["bytes"]
    return (measured or 0) <= limit
