"""Stops to departure trips to 24-hour profiles."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.profile import HOURS, fill_hours, hour_counts, hourly_profile
from tripweave.operators.sampling import (
    departure_hour,
    departure_timestamp,
    with_gap,
    with_informed_departure,
    with_raw_departure,
    with_uniform_departure,
)
from tripweave.operators.trips import (
    RunMarks,
    exclude_location_type,
    first_last_of_day,
    month_slice,
    origin_date,
    run_marks,
    trip_condition,
    with_next_stop,
)
from tripweave.plans.presets import INFORMED, RAW, Preset
from tripweave.sources.store import origin, stored
from tripweave.sources.tables import reuse_or_build


def condition_of(p: Preset) -> Column:
    t = p.trips
    return trip_condition(t.origins, t.dests, t.weekday_only, t.same_day_only, p.zone)


def with_departure(moves: DataFrame, p: Preset, out: str = "departure") -> DataFrame:
    s = p.sampling
    if s.strategy == RAW:
        return with_raw_departure(moves, out)
    if s.strategy == INFORMED:
        if s.distribution is None:
            raise ValueError(f"{p.name}: informed sampling needs a distribution")
        return with_informed_departure(moves, s.distribution, p.zone, s.salt, out)
    return with_uniform_departure(moves, s.salt, out)


def moves(stops: DataFrame, p: Preset, marks: RunMarks | None = None) -> DataFrame:
    """Stops with their successor, after the exclusions that precede sequencing.

    ``marks`` are the ``run_marks`` of all stops; marks of months that are not
    kept have no stops.
    """
    exclude = lambda df: exclude_location_type(df, p.trips.exclude_type)
    kept = month_slice(exclude(stops), p.month_positions)
    return with_next_stop(kept, None if marks is None else marks.kept(exclude))


def departure_trips(stops: DataFrame, p: Preset, marks: RunMarks | None = None) -> DataFrame:
    """``uid, month, rand_start_ts, trip_start_hour`` (and the key and epoch)."""
    return _finish(with_departure(moves(stops, p, marks).filter(condition_of(p)), p), p)


def _finish(trips: DataFrame, p: Preset, by: tuple[str, ...] = ()) -> DataFrame:
    t = p.trips
    slim = trips.withColumn("origin_date", origin_date(p.zone)).select(
        *by, "month", "uid", "origin_date", "departure", "stop_event", "location_type"
    )
    kept = first_last_of_day(slim, t.first_outbound, t.last_return, by, t.per_direction)
    return kept.select(
        *by,
        "uid",
        "month",
        "stop_event",
        "location_type",
        "departure",
        departure_timestamp().alias("rand_start_ts"),
        departure_hour(zone=p.zone).alias("trip_start_hour"),
    )


def departure_profile(stops: DataFrame, p: Preset) -> DataFrame:
    return hourly_profile(departure_trips(stops, p))


def saved_departure_profile(
    spark: SparkSession, stops: DataFrame, p: Preset, path: str, recompute: bool = False
) -> DataFrame:
    """Profile from the trip table at ``path``, which is built when missing or made by another preset or input."""
    made_from = origin(p, stops)
    trips = reuse_or_build(spark, path, lambda: departure_trips(stops, p), recompute, made_from)
    return hourly_profile(trips)


def stored_profiles(stops: DataFrame, presets: list[Preset]) -> DataFrame:
    """``preset_profiles``, made once for the same presets and stops."""
    build = lambda: preset_profiles(stops, presets)
    return stored(stops.sparkSession, "profiles", presets, [stops], build)


def preset_trips(stops: DataFrame, presets: list[Preset]) -> DataFrame:
    """Trips of several presets, with a ``series`` column.

    Presets that sequence the same stops share one scan and one shuffle; each
    row is then tested and sampled for all of them at once.
    """
    shared = defaultdict(list)
    for p in presets:
        shared[p.trips.exclude_type, p.month_positions].append(p)
    marks = run_marks(stops)
    parts = []
    for group in shared.values():
        sequenced = moves(stops, group[0], marks)
        endings = defaultdict(list)
        for p in group:
            t = p.trips
            endings[t.first_outbound and t.last_return, t.per_direction, p.zone].append(p)
        for alike in endings.values():
            parts.append(_finish(_series_rows(sequenced, alike), alike[0], ("series",)))
    return reduce(DataFrame.unionByName, parts)


def _series_rows(sequenced: DataFrame, presets: list[Preset]) -> DataFrame:
    """A row per preset that a move belongs to, with that preset's departure."""
    rows = sequenced.filter(reduce(or_, [condition_of(p) for p in presets]))
    drawn = [p for p in presets if p.sampling.strategy != RAW]
    if len(drawn) > 1 and len({(p.zone, p.sampling.salt) for p in drawn}) == 1:
        rows = with_gap(rows, drawn[0].zone, drawn[0].sampling.salt)
    entries = []
    for i, p in enumerate(presets):
        rows = with_departure(rows, p, f"departure_{i}")
        entry = F.struct(F.lit(p.name).alias("series"), F.col(f"departure_{i}").alias("departure"))
        entries.append(F.when(condition_of(p), entry))
    return rows.withColumn("entry", F.explode(F.array(*entries))).filter("entry is not null").select(
        *sequenced.columns, "entry.*"
    )


def preset_profiles(stops: DataFrame, presets: list[Preset]) -> DataFrame:
    """24 rows per preset, also for presets without any trip."""
    trips = preset_trips(stops, presets)
    found = hour_counts(trips, ("series",))
    names = stops.sparkSession.createDataFrame([(p.name,) for p in presets], "series string")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), HOURS)
    return fill_hours(
        names.join(found, "series", "left").select(
            "series",
            F.coalesce("counts", zeros).alias("counts"),
            F.coalesce("all_trips", F.lit(0)).alias("all_trips"),
        ),
        ("series",),
    )
