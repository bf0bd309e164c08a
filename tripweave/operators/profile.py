"""24-hour profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS = 24


def hourly_profile(trips: DataFrame, by: tuple[str, ...] = (), hour: str = "trip_start_hour") -> DataFrame:
    """Trips and share per hour: always 24 rows per series, zeros included.

    ``rounded_share`` is relative to all trips, with or without an hour.
    """
    return fill_hours(hour_counts(trips, by, hour), by)


def hour_counts(trips: DataFrame, by: tuple[str, ...] = (), hour: str = "trip_start_hour") -> DataFrame:
    """``counts`` (24 slots) and ``all_trips`` per series.

    The 24 counters are one aggregate, so the zero hours need no join and the
    shares no second pass.
    """
    counters = ", ".join(f"count_if({hour} = {h})" for h in range(HOURS))
    return trips.groupBy(*by).agg(
        F.expr(f"array({counters})").alias("counts"), F.count("*").alias("all_trips")
    )


def fill_hours(totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spread ``counts`` (24 slots) and ``all_trips`` into rows with shares."""
    in_hours = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    return totals.select(
        *by, "all_trips", in_hours.alias("in_hours"), F.posexplode("counts").alias("trip_start_hour", "trip_count")
    ).select(
        *by,
        "trip_start_hour",
        "trip_count",
        (F.try_divide("trip_count", "in_hours") * 100).alias("percentage_of_trips"),
        F.round(F.try_divide("trip_count", "all_trips") * 100, 2).alias("rounded_share"),
    )


def hour_spine(profile: DataFrame, by: tuple[str, ...] = (), value: str = "trip_count") -> DataFrame:
    """Complete ``trip_start_hour, value`` rows to the hours 0..23 with zeros."""
    zero = f"cast(0 as {profile.schema[value].dataType.simpleString()})"
    slots = ", ".join(
        f"coalesce(sum(if(trip_start_hour = {h}, {value}, null)), {zero})" for h in range(HOURS)
    )
    return (
        profile.groupBy(*by)
        .agg(F.expr(f"array({slots})").alias("slots"))
        .select(*by, F.posexplode("slots").alias("trip_start_hour", value))
    )


def weighted_hour_share(rows: DataFrame, hour: str, weight: str, by: tuple[str, ...]) -> DataFrame:
    """100 x weight per hour / total weight; rows without an hour count in the total."""
    per_hour = rows.groupBy(*by, F.col(hour).alias("hour")).agg(F.sum(weight).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(*by))
    return (
        per_hour.withColumn("percentage", F.try_divide("weight", total) * 100)
        .filter(F.col("hour").isNotNull() & (F.col("weight") > 0))
        .select(*by, "hour", "percentage")
    )


def series_points(series: DataFrame, by: tuple[str, ...], hour: str, value: str) -> DataFrame:
    """One row per series with its points sorted by hour.

    Points are first reduced to one per hour, which bounds the list.
    """
    return (
        series.groupBy(*by, F.col(hour).cast("int").alias("hour"))
        .agg(F.max(value).alias("value"))
        .filter(F.col("hour").isNotNull())
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("hour", "value"))).alias("points"))
    )


def interpolated(points: str = "points") -> Column:
    """24 values by linear interpolation, flat beyond the first and last point."""
    lower = f"element_at(array(null) || filter({points}, p -> p.hour <= h), -1)"
    upper = f"get(filter({points}, p -> p.hour >= h), 0)"
    return F.expr(f"""
transform(sequence(0, {HOURS - 1}), h ->
  transform(array(named_struct('lo', {lower}, 'hi', {upper})), n -> coalesce(
    n.lo.value + (n.hi.value - n.lo.value) * try_divide(h - n.lo.hour, n.hi.hour - n.lo.hour),
    n.lo.value, n.hi.value))[0])""")


def interp_hours(series: DataFrame, by: tuple[str, ...], hour: str = "hour", value: str = "percentage") -> DataFrame:
    """Series on the hours 0..23."""
    return series_points(series, by, hour, value).select(
        *by, F.posexplode(interpolated()).alias("hour", value)
    )
