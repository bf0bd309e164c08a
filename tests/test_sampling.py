import hashlib
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripweave.operators.sampling import with_informed_departure, with_uniform_departure
from tripweave.sources.distributions import HourlyDistribution

EPOCH = datetime(1970, 1, 1)


def uniforms(uid, event):
    digest = hashlib.md5(f"{uid}:{event}:1:departure".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) / 2**32 for i in (0, 8, 16)]


def plain_departure(weights, uid, event, end, start):
    """Walk over the whole hours of the gap, one by one."""
    u_hour, u_minute, u_gap = uniforms(uid, event)
    marks = [m for m in range(end // 3600 * 3600, start + 1, 3600) if end <= m <= start]
    if not marks:
        return end + (start - end) * u_gap
    by_hour = sorted((m // 3600 % 24, weights[m // 3600 % 24]) for m in marks)
    total = sum(w for _, w in by_hour)
    running, hour = 0.0, None
    for h, w in by_hour:
        running += w
        if running > u_hour * total + 1e-12:
            hour = h
            break
    day = EPOCH + timedelta(seconds=end - end % 86400)
    drawn = day + timedelta(hours=hour, minutes=int(u_minute * 60))
    return min(max((drawn - EPOCH).total_seconds(), end), start)


def run(spark, dist, rows, zone="UTC"):
    df = spark.createDataFrame(
        rows, "uid bigint, stop_event bigint, end_timestamp bigint, next_start bigint"
    ).withColumn("month", F.lit(1))
    got = with_informed_departure(df, dist, zone)
    assert got.columns == [*df.columns, "departure"]
    return {(r["uid"], r["stop_event"]): r["departure"] for r in got.collect()}


gaps = st.lists(
    st.tuples(st.integers(0, 5 * 86400), st.integers(1, 4 * 86400)), min_size=20, max_size=20
)


@settings(max_examples=8, deadline=None)
@given(gaps=gaps, percentages=st.lists(st.integers(1, 40), min_size=24, max_size=24))
def test_informed_equals_walk_over_hours(spark, gaps, percentages):
    dist = HourlyDistribution.of(dict(enumerate(map(float, percentages))))
    rows = [(i, i * 3, end, end + gap) for i, (end, gap) in enumerate(gaps)]
    got = run(spark, dist, rows)
    for uid, event, end, start in rows:
        want = plain_departure(dist.weights(), uid, event, end, start)
        assert got[uid, event] == pytest.approx(want, abs=1e-6)
        assert end <= got[uid, event] <= start


def test_hour_without_share_is_rarely_drawn_and_zero_share_never(spark):
    dist = HourlyDistribution.of({7: 50.0, 8: 0.0, 9: 50.0})
    assert dist.weights()[8] == 0 and dist.weights()[10] == 0.01
    rows = [(i, 0, 7 * 3600 - 60, 9 * 3600 + 3599) for i in range(500)]
    hours = {int(d // 3600) for d in run(spark, dist, rows).values()}
    assert hours == {7, 9}


def test_only_zero_shares_in_gap_means_equal_weights(spark):
    dist = HourlyDistribution.of({h: 0.0 if h < 12 else 1.0 for h in range(24)})
    rows = [(i, 0, 6 * 3600, 8 * 3600 + 3599) for i in range(600)]
    drawn = [int(d // 3600) for d in run(spark, dist, rows).values()]
    assert set(drawn) == {6, 7, 8}
    assert min(drawn.count(h) for h in (6, 7, 8)) > 120


def test_no_whole_hour_falls_back_to_uniform(spark):
    dist = HourlyDistribution.of({h: 1.0 for h in range(24)})
    rows = [(i, 0, 3660, 7000) for i in range(50)]
    for (uid, event), d in run(spark, dist, rows).items():
        assert d == pytest.approx(3660 + (7000 - 3660) * uniforms(uid, event)[2])


def test_zone_moves_the_marks(spark):
    dist = HourlyDistribution.of({8: 1.0, **{h: 0.0 for h in range(24) if h != 8}})
    noon = int(datetime(2024, 5, 6, 12, tzinfo=timezone.utc).timestamp())
    (d,) = run(spark, dist, [(1, 1, noon, noon + 8 * 3600)], "America/Phoenix").values()
    assert 15 <= d % 86400 / 3600 < 16  # 08:xx on a clock seven hours behind UTC


def test_uniform_stays_in_gap_and_repeats(spark):
    df = spark.range(1000).select(
        F.col("id").alias("uid"),
        F.col("id").alias("stop_event"),
        F.lit(1).alias("month"),
        F.lit(1000).alias("end_timestamp"),
        F.lit(5000).alias("next_start"),
    )
    once, again = (
        [r["departure"] for r in with_uniform_departure(d).orderBy("uid").collect()]
        for d in (df, df.repartition(5))
    )
    assert once == again
    assert all(1000 <= d < 5000 for d in once)
    assert abs(sum(once) / 1000 - 3000) < 150


def test_months_draw_differently(spark):
    df = spark.createDataFrame([(1, 5, m, 0, 1000) for m in (1, 2)], "uid long, stop_event long, month int, end_timestamp long, next_start long")
    assert len({r["departure"] for r in with_uniform_departure(df).collect()}) == 2
