import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripweave.operators import compare, profile
from tripweave.sources.distributions import HourlyDistribution


def series(spark, points, name="s"):
    return spark.createDataFrame(
        [(name, h, float(v)) for h, v in points.items()], "series string, hour int, percentage double"
    )


def plain_dtw(x, y):
    cost = [[math.inf] * (len(y) + 1) for _ in range(len(x) + 1)]
    cost[0][0] = 0.0
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            cost[i][j] = abs(a - b) + min(cost[i - 1][j], cost[i][j - 1], cost[i - 1][j - 1])
    return cost[-1][-1]


values = st.lists(st.floats(0, 20), min_size=24, max_size=24)


@settings(max_examples=8, deadline=None)
@given(x=values, y=values)
def test_dtw_equals_plain_loop_and_is_symmetric(spark, x, y):
    rows = [(x, y), (y, x), (x, x)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    got = [r[0] for r in df.select(compare.dtw("x", "y")).collect()]
    assert got == pytest.approx([plain_dtw(x, y), plain_dtw(x, y), 0.0], abs=1e-9)


@settings(max_examples=10, deadline=None)
@given(points=st.dictionaries(st.integers(-2, 26), st.floats(0, 30), min_size=1, max_size=12))
def test_interpolation_equals_numpy(spark, points):
    got = profile.interp_hours(series(spark, points), ("series",)).orderBy("hour").collect()
    xs = sorted(points)
    want = np.interp(range(24), xs, [points[x] for x in xs])
    assert [r["percentage"] for r in got] == pytest.approx(list(want), abs=1e-9)


def test_statistics_and_ties(spark):
    pct = [0.0] * 24
    pct[8], pct[17], pct[9] = 40.0, 40.0, 20.0
    df = spark.createDataFrame(
        [("s", h, p) for h, p in enumerate(pct)],
        "series string, trip_start_hour int, percentage_of_trips double",
    )
    row = compare.profile_statistics(df).first()
    mean = np.average(range(24), weights=pct)
    std = math.sqrt(np.average((np.arange(24) - mean) ** 2, weights=pct))
    assert (row["mean_hour"], row["std_hour"]) == (pytest.approx(mean), pytest.approx(std))
    assert (row["peak_hour"], row["peak_share"]) == (8, 40.0)


def test_statistics_of_nothing_are_null(spark):
    df = spark.createDataFrame(
        [("s", h, 0.0) for h in range(24)],
        "series string, trip_start_hour int, percentage_of_trips double",
    )
    assert compare.profile_statistics(df).first()["mean_hour"] is None


def test_spine_and_rounding(spark):
    trips = spark.createDataFrame([(8,), (8,), (9,), (None,)], "trip_start_hour int")
    rows = profile.hourly_profile(trips).orderBy("trip_start_hour").collect()
    assert len(rows) == 24
    assert rows[8]["percentage_of_trips"] == pytest.approx(200 / 3)
    assert rows[8]["rounded_share"] == 50.0
    assert sum(r["percentage_of_trips"] for r in rows) == pytest.approx(100)


def test_overlay_matrix_and_pairs(spark):
    df = spark.createDataFrame(
        [(s, h, v) for s in ("a", "b") for h, v in ((h, float(h)) for h in range(24))],
        "series string, trip_start_hour int, percentage_of_trips double",
    )
    survey = series(spark, {0: 0.0, 23: 23.0}, "ramp")
    matrix = compare.profile_matrix(df)
    assert matrix.columns == ["series", *[f"h{h}" for h in range(24)]]
    assert compare.series_overlay(df, survey).count() == 50
    pairing = spark.createDataFrame([("a", "ramp")], "series string, survey string")
    (row,) = compare.dtw_pairs(df, survey, pairing).collect()
    assert (row["series"], row["dtw"]) == ("a", pytest.approx(0.0))
    stacked = compare.stack_series({"x": df.drop("series"), "y": df.drop("series")})
    assert stacked.count() == 96


def test_distribution_normalises_over_all_rows(spark):
    df = series(spark, {7: 30.0, 8: 60.0, 30: 10.0})
    dist = HourlyDistribution.from_frame(df)
    assert dist.shares[7:9] == (pytest.approx(0.3), pytest.approx(0.6))
    assert dist.shares[0] is None and dist.weights()[0] == 0.01
    both = HourlyDistribution.by_series(df.union(series(spark, {1: 5.0}, "t")))
    assert both["s"] == dist and both["t"].shares[1] == 1.0
