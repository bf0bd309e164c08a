from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripweave.operators import trips
from tripweave.plans import departure as dep
from tripweave.plans.presets import RAW, UNIFORM, Preset, Sampling, TripFilter, preset

SCHEMA = (
    "uid bigint, stop_event bigint, start_timestamp bigint, end_timestamp bigint, "
    "cluster_label string, location_type string, weekend boolean, month int"
)
MONDAY = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())


def stop(uid, event, hour, kind, label=None, month=1, day=0, weekend=False, stay=0.5):
    start = MONDAY + day * 86400 + int(hour * 3600)
    return (uid, event, start, start + int(stay * 3600), label or f"{kind}{event}", kind, weekend, month)


def stops(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def hours(df):
    return sorted((r["uid"], r["trip_start_hour"]) for r in df.collect())


def commute(**changes):
    return Preset("t", TripFilter(("H",), ("W",), **changes), Sampling(RAW), "hw")


@pytest.mark.parametrize("width", [1, 2, 7, 1 << 20])
def test_next_stop_matches_plain_window(spark, width):
    df = spark.range(600).select(
        (F.col("id") % 3).alias("uid"),
        ((F.col("id") * 7919) % 601).alias("stop_event"),
        F.col("id").alias("start_timestamp"),
        (F.col("id") + 1).alias("end_timestamp"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("cluster_label"),
        F.lit("H").alias("location_type"),
        (F.col("id") % 4 == 0).alias("weekend"),
        (F.col("id") % 2 + 1).cast("int").alias("month"),
    )
    w = Window.partitionBy("month", "uid").orderBy("stop_event")
    plain = df.select(
        "*",
        F.lead("cluster_label").over(w).alias("next_label"),
        F.lead("start_timestamp").over(w).alias("next_start"),
        F.lead("location_type").over(w).alias("next_type"),
        F.lead("weekend").over(w).alias("next_weekend"),
    )
    want = sorted(map(str, plain.collect()))
    for got in (trips.with_next_stop(df, trips.run_marks(df, width)), trips.with_next_stop(df)):
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp"])
def test_runs_follow_counts_not_key_values(spark, kind):
    key = {"bigint": "id * 1000000", "string": "lpad(id, 9, '0')", "timestamp": "timestamp_seconds(id * 86400)"}[kind]
    df = spark.range(4_000).selectExpr(
        "if(id % 40 = 0, 2, 1) as uid", f"{key} as stop_event", "id as start_timestamp", "id + 1 as end_timestamp",
        "concat('c', id % 5) as cluster_label", "'H' as location_type", "false as weekend", "1 as month",
    )
    marks = trips.run_marks(df, 200)
    assert 8 <= marks.rows.filter("uid = 1").count() <= 40
    want = sorted(map(str, trips.with_next_stop(df, trips.RunMarks(None)).collect()))
    got = trips.with_next_stop(df, marks)
    assert sorted(map(str, got.collect())) == want
    runs = trips._with_runs(df, marks.rows, F.struct(F.lit("x").alias("next_label")))
    assert runs.groupBy("uid", "run").count().agg(F.max("count")).first()[0] < 1500


def test_no_marks_no_runs(spark):
    df = stops(spark, *[stop(1, i, i / 10, "H") for i in range(5)], stop(2, 1, 1, "H"))
    assert trips.run_marks(df).rows is None
    assert trips.run_marks(df.limit(0), 1).rows is None
    assert trips.run_marks(df, 1).rows.count() == 6  # every stop a run of its own


def test_marks_survive_null_owners_ties_and_exclusion(spark):
    rows = [stop(u, e, h, k) for u in (None, 1) for e, (h, k) in enumerate(zip(range(3, 15), "HWOHWOOHWHOW"))]
    rows += [(1, None, None, 5, None, "H", None, 1), (1, 3, *rows[15][2:]), (1, 3, *rows[15][2:])]
    df = stops(spark, *rows)
    for kind in (None, "O"):
        exclude = lambda d: trips.exclude_location_type(d, kind)  # noqa: E731, B023
        want = sorted(map(str, trips.with_next_stop(exclude(df), trips.RunMarks(None)).collect()))
        for run in (1, 2, 3):
            marks = trips.run_marks(df, run).kept(exclude)
            assert sorted(map(str, trips.with_next_stop(exclude(df), marks).collect())) == want


def test_trip_over_month_edge_vanishes(spark):
    df = stops(spark, stop(1, 1, 8, "H", month=1), stop(1, 2, 9, "W", month=2))
    assert dep.departure_trips(df, commute()).count() == 0


def test_exclusion_happens_before_sequencing(spark):
    df = stops(spark, stop(1, 1, 7, "H"), stop(1, 2, 8, "O"), stop(1, 3, 9, "W"))
    assert hours(dep.departure_trips(df, commute())) == [(1, 7)]
    assert hours(dep.departure_trips(df, commute(exclude_type=None))) == []


def test_null_type_dropped_only_by_active_exclusion(spark):
    df = stops(spark, stop(1, 1, 7, None, label="x"), stop(1, 2, 8, "W"))
    assert trips.exclude_location_type(df, "O").count() == 1
    assert trips.exclude_location_type(df, None).count() == 2


def test_same_label_or_overlap_is_no_move(spark):
    same = stops(spark, stop(1, 1, 7, "H", "a"), stop(1, 2, 8, "W", "a"))
    overlap = stops(spark, stop(1, 1, 7, "H", stay=2), stop(1, 2, 8, "W"))
    touching = stops(spark, stop(1, 1, 7, "H", stay=1), stop(1, 2, 8, "W"))
    for df in (same, overlap, touching):
        assert dep.departure_trips(df, commute()).count() == 0


def test_weekend_at_either_end_or_unknown_drops(spark):
    for flags in [(True, False), (False, True), (None, False)]:
        df = stops(
            spark,
            stop(1, 1, 7, "H", weekend=flags[0]),
            stop(1, 2, 8, "W", weekend=flags[1]),
        )
        assert dep.departure_trips(df, commute()).count() == 0
        assert dep.departure_trips(df, commute(weekday_only=False)).count() == 1


def test_single_pair_is_bidirectional_but_lists_are_not(spark):
    df = stops(spark, stop(1, 1, 7, "W"), stop(1, 2, 8, "H"))
    assert dep.departure_trips(df, commute()).count() == 1
    one_way = Preset("t", TripFilter(("H", "X"), ("W",)), Sampling(RAW), "hw")
    assert dep.departure_trips(df, one_way).count() == 0


def test_origin_and_destination_only(spark):
    df = stops(spark, stop(1, 1, 7, "H"), stop(1, 2, 8, "W"), stop(1, 3, 9, "H"), stop(1, 4, 10, "H"))
    moved = trips.with_next_stop(df)
    assert moved.filter(trips.origin_type_only(("H",))).count() == 1
    assert moved.filter(trips.dest_type_only(("H",))).count() == 2


DAY = [("H", 6), ("W", 7), ("H", 12), ("W", 13), ("H", 18)]


def test_first_counts_only_if_outbound(spark):
    df = stops(spark, *[stop(1, i, h, k) for i, (k, h) in enumerate(DAY)])
    both = commute(first_outbound=True, last_return=True)
    assert hours(dep.departure_trips(df, both)) == [(1, 6), (1, 13)]
    # Starting the day with a return: no outbound trip survives.
    late = stops(spark, *[stop(1, i, h, k) for i, (k, h) in enumerate(DAY[1:])])
    assert hours(dep.departure_trips(late, both)) == [(1, 13)]
    per_direction = commute(first_outbound=True, last_return=True, per_direction=True)
    assert hours(dep.departure_trips(late, per_direction)) == [(1, 12), (1, 13)]


def test_one_flag_alone_filters_nothing(spark):
    df = stops(spark, *[stop(1, i, h, k) for i, (k, h) in enumerate(DAY)])
    assert dep.departure_trips(df, commute(first_outbound=True)).count() == 4
    assert dep.departure_trips(df, commute(last_return=True)).count() == 4


def test_other_types_count_as_return(spark):
    df = stops(spark, stop(1, 1, 7, "O"), stop(1, 2, 8, "H"))
    p = Preset("t", preset("legacy_ho").trips, Sampling(RAW), "ho")
    assert hours(dep.departure_trips(df, p)) == [(1, 7)]


def test_month_slice_is_positional(spark):
    df = stops(spark, *[stop(1, m, 8, "H", month=m) for m in (3, 5, 9)])
    months = lambda r: sorted(x["month"] for x in trips.month_slice(df, r).collect())
    assert months((1, 3)) == [5, 9]
    assert months((0, 1)) == [3]
    assert months((1, 99)) == [5, 9]
    every = [3, 5, 9]
    for start in (None, 0, 1, 3, 7, -1, -2, -9):
        for stop_at in (None, 0, 2, 3, 7, -1, -3, -9):
            assert months((start, stop_at)) == every[start:stop_at]
    assert months(None) == [3, 5, 9]


def test_same_day_depends_on_zone_not_session(spark):
    df = stops(spark, stop(1, 1, 23, "H"), stop(1, 2, 25, "W"))
    assert dep.departure_trips(df, commute()).count() == 0
    west = Preset("t", commute().trips, Sampling(RAW), "hw", zone="America/Phoenix")
    assert hours(dep.departure_trips(df, west)) == [(1, 16)]


def test_profile_of_nothing_is_24_zero_rows(spark):
    rows = dep.departure_profile(stops(spark, stop(1, 1, 8, "H")), commute()).collect()
    assert [r["trip_count"] for r in rows] == [0] * 24
    assert {r["percentage_of_trips"] for r in rows} == {None}


def test_shared_pass_equals_single_runs(spark):
    df = stops(
        spark,
        *[stop(u, i, 6 + 2 * i + u / 10, "HWOHW"[(i + u) % 5]) for u in range(6) for i in range(7)],
    )
    several = [
        commute(first_outbound=True, last_return=True),
        Preset("all", TripFilter(exclude_type=None), Sampling(RAW), "all"),
        Preset("uniform", TripFilter(), Sampling(UNIFORM), "all"),
        Preset("none", TripFilter(("Q",)), Sampling(RAW), "all"),
    ]
    shared = dep.preset_profiles(df, several)
    for p in several:
        one = [tuple(r) for r in dep.departure_profile(df, p).collect()]
        got = [tuple(r)[1:] for r in shared.filter(F.col("series") == p.name).collect()]
        assert sorted(got) == sorted(one)


def test_result_does_not_depend_on_partitioning(spark):
    df = stops(
        spark,
        *[stop(u, i, 6 + i, "HW"[i % 2]) for u in range(20) for i in range(8)],
    )
    p = Preset("t", commute().trips, Sampling(UNIFORM), "hw")
    want = sorted(map(str, dep.departure_trips(df.coalesce(1), p).collect()))
    assert sorted(map(str, dep.departure_trips(df.repartition(13, "stop_event"), p).collect())) == want


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_whole_users_reach_the_daily_ends_in_one_shuffle(spark):
    df = stops(spark, *[stop(u, i, 6 + i, "HW"[i % 2]) for u in range(20) for i in range(8)])
    plan = executed(dep.departure_trips(df, commute(first_outbound=True, last_return=True), trips.RunMarks(None)))
    assert plan.count("Exchange hashpartitioning") == 1  # (user, month) also serves (user, month, day)
