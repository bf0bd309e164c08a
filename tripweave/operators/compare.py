"""Comparisons: OD tables against surveys, profiles against profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import log10_positive
from tripweave.operators.profile import HOURS, interpolated, series_points

PAIR = ["home_geomid", "work_geomid"]


# -- OD tables ----------------------------------------------------------------


def join_od_sources(lbs: DataFrame, survey: DataFrame) -> DataFrame:
    """Pairs present in both, labelled ``intra`` or ``inter``."""
    return (
        lbs.select(*PAIR, F.col("counts").alias("counts_lbs"))
        .join(survey.select(*PAIR, F.col("counts").alias("counts_eod")), PAIR)
        .withColumn("kind", split_intra_inter())
    )


def split_intra_inter() -> Column:
    return F.when(F.col("home_geomid") == F.col("work_geomid"), "intra").otherwise("inter")


def log_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson r of the log10 counts: overall, intra and inter, in one pass.

    Pairs without a positive count on both sides have no log and are left out;
    ``n_pairs`` tells how many remain. r is null where a side does not vary.
    """
    x, y = log10_positive(F.col("counts_lbs")), log10_positive(F.col("counts_eod"))
    logs = pairs.select("kind", x.alias("x"), y.alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    kinds = {"overall": F.lit(True), "intra": F.col("kind") == "intra", "inter": F.col("kind") == "inter"}
    rows = []
    for name, member in kinds.items():
        px, py = F.when(member, F.col("x")), F.when(member, F.col("y"))
        spread = F.stddev_pop(px) * F.stddev_pop(py)
        rows.append(
            F.struct(
                F.lit(name).alias("kind"),
                F.count_if(member).alias("n_pairs"),
                F.try_divide(F.covar_pop(px, py), spread).alias("r"),
            )
        )
    return logs.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def value_range(pairs: DataFrame, left: str = "counts_lbs", right: str = "counts_eod", margin: float = 1.0) -> DataFrame:
    """Common value range of both series, lower end less ``margin``."""
    return pairs.agg(
        (F.least(F.min(left), F.min(right)) - margin).alias("min_value"),
        F.greatest(F.max(left), F.max(right)).alias("max_value"),
    )


def scaling_table(factors: DataFrame) -> DataFrame:
    return factors.select("geomid", "population", "count_uid", "scaled_users")


def zone_map_table(factors: DataFrame) -> DataFrame:
    return factors.select("geomid", "expansion", "population", "count_uid")


# -- profiles -----------------------------------------------------------------


def profile_statistics(profiles: DataFrame, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Weighted mean and spread of the hour, peak hour (first on ties), peak share."""
    h, p = F.col("trip_start_hour"), F.col("percentage_of_trips")
    mean = F.try_divide(F.sum(h * p), F.sum(p))
    square = F.try_divide(F.sum(h * h * p), F.sum(p))
    peak = F.max(F.struct(p.alias("p"), (-h).alias("minus_h")))
    return profiles.groupBy(*by).agg(
        mean.alias("mean_hour"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_hour"),
        (-peak["minus_h"]).alias("peak_hour"),
        peak["p"].alias("peak_share"),
    )


def stack_series(profiles: dict[str, DataFrame]) -> DataFrame:
    """Named profiles as one long table."""
    stacked = None
    for name, df in profiles.items():
        df = df.withColumn("series", F.lit(name))
        stacked = df if stacked is None else stacked.unionByName(df)
    return stacked


def profile_matrix(profiles: DataFrame) -> DataFrame:
    """A row per series, columns ``h0..h23``."""
    wide = (
        profiles.groupBy("series")
        .pivot("trip_start_hour", list(range(HOURS)))
        .agg(F.max("percentage_of_trips"))
    )
    return wide.select("series", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(HOURS)])


def series_overlay(profiles: DataFrame, surveys: DataFrame) -> DataFrame:
    """Measured and survey series in one long table."""
    measured = profiles.select(
        "series",
        F.lit("lbs").alias("origin"),
        F.col("trip_start_hour").alias("hour"),
        F.col("percentage_of_trips").alias("percentage"),
    )
    return measured.unionByName(
        surveys.select("series", F.lit("survey").alias("origin"), "hour", "percentage")
    )


def dtw(x: str, y: str) -> Column:
    """Dynamic time warping distance of two numeric arrays, absolute cost.

    Folds ``x`` over one row of the cost table at a time.
    """
    infinity = "double('infinity')"
    return F.expr(f"""
aggregate({x}, array(0D) || transform({y}, v -> {infinity}), (above, a) ->
  aggregate(sequence(1, size({y})), array({infinity}), (row, j) ->
    row || array(abs(a - {y}[j - 1]) + least(above[j], row[j - 1], above[j - 1]))))[size({y})]""")


def dtw_pairs(profiles: DataFrame, surveys: DataFrame, pairing: DataFrame) -> DataFrame:
    """DTW of each profile and the survey it is paired with, both on 0..23.

    ``pairing`` holds ``series, survey``; every series is one row of 24 values
    when it is joined.
    """
    left = series_points(profiles, ("series",), "trip_start_hour", "percentage_of_trips").select(
        "series", interpolated().alias("x")
    )
    right = series_points(surveys, ("series",), "hour", "percentage").select(
        F.col("series").alias("survey"), interpolated().alias("y")
    )
    distance = dtw("x", "y")
    return (
        left.join(pairing, "series")
        .join(right, "survey")
        .select("series", "survey", distance.alias("dtw"))
        .withColumn("dtw_normalised", F.col("dtw") / (2 * HOURS))
    )
