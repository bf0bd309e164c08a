"""From ordered stops to trips."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tripweave.functions import date_of, local_seconds
from tripweave.operators.sizing import fits_broadcast
from tripweave.sources.scratch import scratch_path

# Users are cut into runs of about this many stops, so that no user has to fit one task.
RUN = 1_000_000

_OWNER = ("uid", "month")
_ORDER = ("stop_event", "start_timestamp", "end_timestamp", "cluster_label", "location_type", "weekend")
_NEXT = {
    "cluster_label": "next_label",
    "start_timestamp": "next_start",
    "location_type": "next_type",
    "weekend": "next_weekend",
}


def exclude_location_type(stops: DataFrame, location_type: str | None) -> DataFrame:
    """Drop stops of one type before they are sequenced (H-O-W becomes H-W)."""
    if location_type is None:
        return stops
    return stops.filter(F.col("location_type") != location_type)


def month_slice(stops: DataFrame, positions: tuple[int | None, int | None] | None) -> DataFrame:
    """Keep the months at positions ``[start, stop)`` of the sorted month list.

    As in a slice of a list, an end may be open (None) and negative places
    count from the end of the list.
    """
    if positions is None:
        return stops
    start, stop = positions
    place = lambda p, n: p if p >= 0 else f"greatest({n} + {p}, 0)"
    first = place(start or 0, "size(all_months)")
    last = "size(all_months)" if stop is None else place(stop, "size(all_months)")
    months = (
        stops.select("month")
        .distinct()
        .agg(F.array_sort(F.collect_set("month")).alias("all_months"))
        .select(F.explode(F.expr(f"slice(all_months, {first} + 1, greatest({last} - {first}, 0))")).alias("month"))
    )
    return stops.join(months, "month", "left_semi")


class RunMarks(NamedTuple):
    """Stops that begin runs, in a table of their own; None if there are none."""

    rows: DataFrame | None

    def kept(self, test: Callable[[DataFrame], DataFrame]) -> RunMarks:
        """The marks among the stops that a filter keeps."""
        return RunMarks(None if self.rows is None else test(self.rows))


def run_marks(stops: DataFrame, run: int = RUN) -> RunMarks:
    """About one stop in ``run``, those whose hash divides by it, whatever their keys are.

    Reads the key columns of all stops once, without a shuffle. Most inputs
    have none or few, and then users stay whole or nearly so.
    """
    chosen = F.pmod(F.xxhash64(*_OWNER, *_ORDER), F.lit(run)) == 0
    path, seen = scratch_path(stops.sparkSession, "run-marks"), Observation()
    marked = stops.select(*_OWNER, *_ORDER).filter(chosen)
    marked.observe(seen, F.count("*").alias("marks")).write.parquet(path)
    return RunMarks(stops.sparkSession.read.schema(marked.schema).parquet(path) if seen.get["marks"] else None)


def with_next_stop(stops: DataFrame, marks: RunMarks | None = None) -> DataFrame:
    """Add label, start, type and weekend flag of the user's next stop that month.

    ``marks`` are ``run_marks`` of these stops, or of more and then ``kept`` by
    the same filter; by default they are looked for. A marked stop begins a run
    of its user. Runs are sorted by themselves, and the last stop of one is
    followed by the mark that begins the next, which every stop of the user
    carries along. Rows are the same for any marks and order keys of any type.
    """
    marks = run_marks(stops) if marks is None else marks
    following = F.struct(*[F.col(c).alias(n) for c, n in _NEXT.items()])
    if marks.rows is None:
        whole = Window.partitionBy(*_OWNER).orderBy(*_ORDER)
        sequenced = stops.withColumn("following", F.lead(following).over(whole))
    else:
        in_run = Window.partitionBy(*_OWNER, "run").orderBy(*_ORDER)
        sequenced = (
            _with_runs(stops, marks.rows, following)
            .withColumn("following", F.coalesce(F.lead(following).over(in_run), F.col("next_mark")))
        )
    return sequenced.select(*stops.columns, "following.*")


def _with_runs(stops: DataFrame, marks: DataFrame, following: Column) -> DataFrame:
    """``stops`` with the number of their ``run`` and the ``next_mark`` after it."""
    mark = F.struct(F.struct(*_ORDER).alias("at"), following.alias("following"))
    owners = marks.groupBy(*[F.col(c).alias(f"owner_{c}") for c in _OWNER]).agg(F.sort_array(F.collect_set(mark)).alias("marks"))
    size = F.coalesce(F.octet_length("cluster_label"), F.lit(0)) + F.coalesce(F.octet_length("location_type"), F.lit(0))
    if fits_broadcast(marks, size + 256):
        owners = F.broadcast(owners)
    is_owner = reduce(and_, [F.col(c).eqNullSafe(F.col(f"owner_{c}")) for c in _OWNER])
    # halves the marks until what is left begins after the stop
    before = f"""if(marks is null, 0, aggregate(
      sequence(1, 1 + cast(log2(size(marks)) as int)), named_struct('low', 0, 'high', size(marks)),
      (a, _) -> if(a.low < a.high,
        if(marks[(a.low + a.high) div 2].at <= struct({", ".join(_ORDER)}),
          named_struct('low', cast((a.low + a.high) div 2 + 1 as int), 'high', a.high),
          named_struct('low', a.low, 'high', cast((a.low + a.high) div 2 as int))), a),
      a -> a.low))"""
    return (
        stops.join(owners, is_owner, "left")
        .withColumn("run", F.expr(before))
        .withColumn("next_mark", F.expr("get(marks, run).following"))
        .drop("marks", *[f"owner_{c}" for c in _OWNER])
    )


# -- predicates on a stop and its successor -----------------------------------


def is_real_move() -> Column:
    return F.expr(
        "next_label is not null and cluster_label <> next_label and end_timestamp is not null"
        " and next_start is not null and next_start > end_timestamp"
    )


def is_weekday_move() -> Column:
    return F.expr("not weekend and not next_weekend")


def od_type_pair(origins: tuple[str, ...], dests: tuple[str, ...]) -> Column:
    """Origin and destination types; a single differing pair also counts reversed."""
    pairs = {(o, d) for o in origins for d in dests}
    if len(origins) == len(dests) == 1:
        pairs |= {(d, o) for o, d in pairs}
    return reduce(
        or_,
        [(F.col("location_type") == o) & (F.col("next_type") == d) for o, d in sorted(pairs)],
    )


def origin_type_only(origins: tuple[str, ...]) -> Column:
    """Starts at one of the types and ends at another type."""
    return F.col("location_type").isin(*origins) & (F.col("next_type") != F.col("location_type"))


def dest_type_only(dests: tuple[str, ...]) -> Column:
    return F.col("next_type").isin(*dests)


def type_condition(
    origins: tuple[str, ...] | None, dests: tuple[str, ...] | None
) -> Column | None:
    if origins and dests:
        return od_type_pair(origins, dests)
    if origins:
        return origin_type_only(origins)
    if dests:
        return dest_type_only(dests)
    return None


def origin_date(zone: str = "UTC") -> Column:
    return F.expr(date_of(local_seconds("end_timestamp", zone)))


def is_same_day(zone: str = "UTC") -> Column:
    return origin_date(zone) == F.expr(date_of(local_seconds("next_start", zone)))


def trip_condition(
    origins: tuple[str, ...] | None = None,
    dests: tuple[str, ...] | None = None,
    weekday_only: bool = True,
    same_day_only: bool = True,
    zone: str = "UTC",
) -> Column:
    """All tests that make a stop and its successor a trip, as one condition."""
    parts = [
        is_real_move(),
        is_weekday_move() if weekday_only else None,
        type_condition(origins, dests),
        is_same_day(zone) if same_day_only else None,
    ]
    return reduce(and_, [p for p in parts if p is not None])


# -- first and last trip of the day -------------------------------------------


def direction() -> Column:
    """``H_to_W`` for trips from home, ``W_to_H`` for all others."""
    return F.when(F.col("location_type") == "H", "H_to_W").otherwise("W_to_H")


def first_last_of_day(
    trips: DataFrame,
    first_outbound: bool,
    last_return: bool,
    by: tuple[str, ...] = (),
    per_direction: bool = False,
) -> DataFrame:
    """Keep the day's first trip if outbound and its last trip if a return.

    With only one of the two flags nothing is dropped. ``per_direction`` ranks
    outbound and return trips separately instead of together. Ties in departure
    are ordered by ``stop_event``. Needs ``origin_date`` and ``departure``; is
    an aggregate, so it combines before the shuffle.
    """
    if not (first_outbound and last_return):
        return trips
    keys = [*by, *_OWNER, "origin_date"]
    rest = [c for c in trips.columns if c not in {*keys, "departure", "stop_event"}]
    row = F.struct("departure", "stop_event", *rest)
    outbound = direction() == "H_to_W"
    if per_direction:
        earliest, latest = F.min(F.when(outbound, row)), F.max(F.when(~outbound, row))
    else:
        earliest, latest = F.min(row), F.max(row)
    ends = trips.groupBy(*keys).agg(earliest.alias("earliest"), latest.alias("latest"))
    from_home = F.coalesce(F.col("latest.location_type") == "H", F.lit(False))
    chosen = F.array(
        F.when(F.col("earliest.location_type") == "H", F.col("earliest")),
        F.when(~from_home, F.col("latest")),
    )
    return ends.select(*keys, F.explode(chosen).alias("trip")).filter("trip is not null").select(*keys, "trip.*")


def month_audit(stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Stops in and trips out per month."""
    rows_in = stops.groupBy("month").agg(F.count("*").alias("stops"))
    rows_out = trips.groupBy("month").agg(F.count("*").alias("trips"))
    return rows_in.join(rows_out, "month", "left").na.fill(0, ["trips"])
