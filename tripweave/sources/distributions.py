"""Hour-of-day distributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS = 24
ABSENT_HOUR_WEIGHT = 0.01


def read_hourly_distribution(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``hour`` or ``start_hour`` and ``percentage``."""
    raw = spark.read.option("header", True).csv(path)
    hour = "hour" if "hour" in raw.columns else "start_hour"
    return raw.select(
        F.col(hour).cast("double").cast("int").alias("hour"),
        F.col("percentage").cast("double").alias("percentage"),
    )


@dataclass(frozen=True)
class HourlyDistribution:
    """Shares of the 24 hours, as literals for use inside expressions.

    ``shares[h]`` is None when the source has no row for hour ``h``.
    """

    shares: tuple[float | None, ...]

    def __post_init__(self):
        if len(self.shares) != HOURS:
            raise ValueError("one share per hour of the day")

    @classmethod
    def of(cls, percentages: dict[int, float]) -> HourlyDistribution:
        total = sum(percentages.values())
        return cls(
            tuple(
                percentages[h] / total if h in percentages else None for h in range(HOURS)
            )
        )

    @classmethod
    def from_frame(cls, df: DataFrame) -> HourlyDistribution:
        """Reduce ``hour, percentage`` rows to one row of 24 shares and read it."""
        return cls(tuple(df.agg(_shares()).first()["shares"]))

    @classmethod
    def by_series(cls, df: DataFrame) -> dict[str, HourlyDistribution]:
        """``from_frame`` for a handful of named series in one job."""
        rows = df.groupBy("series").agg(_shares()).collect()
        return {r["series"]: cls(tuple(r["shares"])) for r in rows}

    def weights(self) -> tuple[float, ...]:
        """Sampling weight of each hour."""
        return tuple(ABSENT_HOUR_WEIGHT if s is None else s for s in self.shares)


def _shares() -> Column:
    total = F.sum("percentage")
    return F.array(
        *[
            F.try_divide(F.max(F.when(F.col("hour") == h, F.col("percentage"))), total)
            for h in range(HOURS)
        ]
    ).alias("shares")
