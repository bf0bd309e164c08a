"""Survey cleaning: population, workers, OD table and hourly shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators import survey as ops
from tripweave.sources.store import stored

SERIES = ("hw", "ho", "nhb", "all")


def all_hour_shares(
    survey: DataFrame, weekday: bool = True, series: tuple[str, ...] = SERIES
) -> DataFrame:
    """``series, hour, percentage`` of home-work (hw) and home-other (ho) tours,
    non-home-based (nhb) trips and all trips.

    The tour series share one pass over the survey, the trip series another.
    """
    unknown = set(series) - set(SERIES)
    if unknown or not series:
        raise ValueError(f"unknown survey series {sorted(unknown)}, known: {', '.join(SERIES)}")
    trips = ops.valid_trips(survey, weekday)
    tours = {"hw": ops.work_tour(), "ho": ops.other_tour()}
    singles = {"nhb": ops.not_home_based(), "all": F.lit(True)}
    tours = {s: tours[s] for s in series if s in tours}
    singles = {s: singles[s] for s in series if s in singles}
    parts = []
    if tours:
        parts.append(ops.tour_hour_share(trips, tours))
    if singles:
        parts.append(ops.trip_hour_share(trips, singles))
    return reduce(DataFrame.unionByName, parts)


def stored_hour_shares(survey: DataFrame, weekday: bool = True) -> DataFrame:
    """``all_hour_shares`` of all series, made once for the same survey."""
    build = lambda: all_hour_shares(survey, weekday)
    return stored(survey.sparkSession, "hour-shares", weekday, [survey], build)


def hour_shares(survey: DataFrame, series: str, weekday: bool = True) -> DataFrame:
    """``hour, percentage`` of one series."""
    return all_hour_shares(survey, weekday, (series,)).drop("series")


def survey_flows(
    survey: DataFrame, households: DataFrame, weekday: bool = True, purpose: int | None = None
) -> DataFrame:
    return ops.work_flows(survey, ops.zone_population(households), weekday, purpose)


def survey_clean(
    survey: DataFrame, households: DataFrame, weekday: bool = True, purpose: int | None = None
) -> dict[str, DataFrame]:
    """All survey products by name.

    City one uses the weekday test alone; city two no weekday test and
    ``purpose=2``. The purpose applies to workers and OD only.
    """
    flows = survey_flows(survey, households, weekday, purpose)
    return {
        "population": ops.zone_population(households),
        "workers": ops.zone_workers(flows),
        "od_matrix": ops.survey_od(flows),
        **{f"{s}_trips_by_hour": hour_shares(survey, s, weekday) for s in SERIES},
    }
