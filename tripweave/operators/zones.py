"""Zone tables: identity, extent, population."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import fill_int, zero_pad


class Extent(NamedTuple):
    minx: float
    miny: float
    maxx: float
    maxy: float


def total_bounds(zones: DataFrame) -> DataFrame:
    """One row: the box around all zones."""
    return zones.agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )


def extent_of(zones: DataFrame) -> Extent:
    """``total_bounds`` as numbers, so that filters on it reach the file scan."""
    row = total_bounds(zones).first()
    return Extent(row["minx"], row["miny"], row["maxx"], row["maxy"])


def latest_shapes(zones: DataFrame) -> DataFrame:
    """One row per ``geomid``: the last shape given, at the first place given."""
    return zones.groupBy("geomid").agg(
        F.min("zone_ord").alias("zone_ord"), F.max_by("rings", "zone_ord").alias("rings")
    )


def attach_population(zones: DataFrame, population: DataFrame) -> DataFrame:
    """Left join of ``geomid, population``; zones without people get 0."""
    return (
        zones.drop("population")
        .join(population.select("geomid", "population"), "geomid", "left")
        .withColumn("population", fill_int(F.col("population")))
    )


def survey_zone_population(households: DataFrame, width: int = 3) -> DataFrame:
    """People per zone (persons x weight), zone ids zero-padded to ``width``."""
    return (
        households.withColumn("geomid", zero_pad(F.col("distrito"), width))
        .groupBy("geomid")
        .agg(F.sum(F.col("p1_1") * F.col("factor")).alias("population"))
    )
