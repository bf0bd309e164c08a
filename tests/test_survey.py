from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripweave.operators import survey
from tripweave.plans.departure import preset_trips
from tripweave.plans.presets import MODULAR, preset
from tripweave.plans.surveys import all_hour_shares, hour_shares, survey_clean, survey_flows
from tripweave.sources import HourlyDistribution
from tripweave.sources.tables import SURVEY_TRIP_SCHEMA

COLUMNS = ["id_soc", "dto_origen", "dto_dest", "p5_3", "p5_13", "p5_6", "p5_11a", "p5_9_1", "factor"]


def trip(person=1, origin="001", dest="002", day=1, purpose=2, kind=1, dest_kind=2, hour=8, factor=1.0):
    return (person, origin, dest, day, purpose, kind, dest_kind, hour, factor)


def table(spark, rows):
    return spark.createDataFrame(list(rows), SURVEY_TRIP_SCHEMA)


def shares(df):
    return {r["hour"]: r["percentage"] for r in df.collect()}


def pandas_tours(rows, kind):
    """Every pair of legs, then distinct, then repeated by weight."""
    frame = pd.DataFrame(rows, columns=COLUMNS).drop(columns=["dto_origen", "dto_dest"])
    frame = frame[(frame.p5_9_1 != 99) & (frame.p5_3 == 1)]
    if kind == "hw":
        out = frame[(frame.p5_6 == 1) & (frame.p5_13 == 2)]
        back = frame[(frame.p5_11a == 1) & (frame.p5_13 == 1)]
    else:
        out = frame[(frame.p5_6 == 1) & (frame.p5_13 != 2)]
        back = frame[frame.p5_11a == 1]
    both = out.merge(
        back, left_on=["id_soc", "p5_11a"], right_on=["id_soc", "p5_6"], suffixes=("_o", "_r")
    ).drop_duplicates()
    weight = Counter()
    for _, r in both.iterrows():
        for hour in (r.p5_9_1_o, r.p5_9_1_r):
            if pd.notna(hour):
                weight[int(hour)] += int(r.factor_o)
    total = 2 * sum(int(f) for f in both.factor_o)
    return {h: 100 * w / total for h, w in weight.items() if w}


codes = st.sampled_from([1, 2, 3, None])
survey_rows = st.lists(
    st.tuples(
        st.integers(1, 3), st.just("001"), st.just("002"), st.sampled_from([1, 1, 2]), codes, codes,
        codes, st.sampled_from([6, 7, 8, 99, None]), st.sampled_from([0.5, 1.0, 2.9]),
    ),
    min_size=12, max_size=40,
)


@settings(max_examples=12, deadline=None)
@given(rows=survey_rows)
def test_tour_shares_equal_forming_all_pairs(spark, rows):
    got = all_hour_shares(table(spark, rows), series=("hw", "ho")).collect()
    for kind in ("hw", "ho"):
        mine = {r["hour"]: r["percentage"] for r in got if r["series"] == kind}
        assert mine == pytest.approx(pandas_tours(rows, kind))


def test_null_keys_match_unless_strict(spark):
    rows = [trip(None), trip(None, purpose=1, kind=2, dest_kind=1, hour=17)]
    trips = survey.valid_trips(table(spark, rows))
    tour = {"hw": survey.work_tour()}
    assert survey.tour_legs(trips, tour).count() == 2
    assert survey.tour_legs(trips, tour, strict_null=True).count() == 0


def test_leg_without_partner_is_no_tour(spark):
    rows = [trip(1), trip(2), trip(2, purpose=1, kind=2, dest_kind=1, hour=17, factor=9.0)]
    legs = survey.tour_legs(survey.valid_trips(table(spark, rows)), {"hw": survey.work_tour()})
    assert {(r["id_soc"], r["leg"], r["tours"], r["tour_people"]) for r in legs.collect()} == {
        (2, "outbound", 1, 1),
        (2, "return", 1, 1),
    }


def test_null_hour_counts_in_total_only(spark):
    got = shares(hour_shares(table(spark, [trip(hour=7, factor=3.0), trip(hour=None, factor=1.0)]), "all"))
    assert got == {7: 75.0}


def test_unknown_hour_and_weekend_are_left_out(spark):
    rows = [trip(hour=7), trip(hour=99), trip(hour=9, day=2)]
    assert shares(hour_shares(table(spark, rows), "all")) == {7: 100.0}
    assert shares(hour_shares(table(spark, rows), "all", weekday=False)) == {7: 50.0, 9: 50.0}


def test_not_home_based_keeps_unknown_places(spark):
    rows = [trip(kind=None, dest_kind=2, hour=5), trip(kind=1, dest_kind=2, hour=6)]
    assert shares(hour_shares(table(spark, rows), "nhb")) == {5: 100.0}


def test_weighted_sums_equal_repeated_rows(spark):
    rows = [trip(i, dest=f"00{i % 3}", factor=f) for i, f in enumerate([0.0, 0.9, 1.0, 2.9, 4.2])]
    df = survey.work_rows(table(spark, rows))
    repeated = survey.replicate_by_weight(df)
    assert repeated.count() == 7
    counted = {(r[0], r[1]): r["n"] for r in repeated.groupBy("home_geomid", "work_geomid").agg(F.count("*").alias("n")).collect()}
    known = spark.createDataFrame([("001",), ("000",), ("002",)], "geomid string")
    flows = survey.work_flows(table(spark, rows), known)
    summed = {(r[0], r[1]): r["counts"] for r in survey.survey_od(flows).collect()}
    assert summed == counted


def homes(spark, *ids):
    return spark.createDataFrame(
        [(i, "09", i, 2, 10.0) for i in ids], "distrito string, ent string, mun string, p1_1 int, factor double"
    )


def test_flows_between_known_zones_and_purpose(spark):
    rows = [
        trip(1, "001", "002", factor=2.0),
        trip(2, "001", "404"),
        trip(3, "002", "001", purpose=3, factor=5.0),
        trip(4, "002", "002", day=2, factor=7.0),
        trip(5, "001", "001", factor=0.4),
    ]
    known = homes(spark, "001", "002")
    as_set = lambda df: {tuple(r) for r in survey.survey_od(df).collect()}
    flows = survey_flows(table(spark, rows), known)
    assert as_set(flows) == {("001", "002", 2), ("002", "001", 5)}
    assert flows.count() == 3
    second_city = survey_flows(table(spark, rows), known, weekday=False, purpose=2)
    assert as_set(second_city) == {("001", "002", 2), ("002", "002", 7)}
    assert {tuple(r) for r in survey.zone_workers(flows).collect()} == {("002", 2), ("001", 5)}


def test_survey_clean_names_all_products(spark):
    products = survey_clean(table(spark, [trip()]), homes(spark, "001", "002"))
    assert set(products) == {
        "population", "workers", "od_matrix",
        "hw_trips_by_hour", "ho_trips_by_hour", "nhb_trips_by_hour", "all_trips_by_hour",
    }
    assert {tuple(r) for r in products["population"].collect()} == {("001", 20.0), ("002", 20.0)}


def test_unknown_series_is_refused(spark):
    with pytest.raises(ValueError, match="unknown survey series"):
        hour_shares(table(spark, [trip()]), "zz")


def test_large_weights_are_counted_without_copies_and_copied_in_blocks(spark):
    rows = spark.createDataFrame([("a", 1e8), ("a", 2.9), ("b", 0.5)], "kind string, factor double")
    assert [tuple(r) for r in survey.replicated_counts(rows, "kind").collect()] == [("a", 100_000_002)]
    some = spark.createDataFrame([("a", 65_536.0), ("b", 131_073.2), ("c", 1.0)], "kind string, factor double")
    copies = survey.replicate_by_weight(some)
    assert copies.columns == ["kind", "factor"]
    assert {r["kind"]: r["count"] for r in copies.groupBy("kind").count().collect()} == {"a": 65_536, "b": 131_073, "c": 1}


def test_hour_shares_and_profiles_run_as_compiled_code(spark):
    """Series are columns of the sums, and no row passes an interpreted lambda."""
    trips = survey.valid_trips(table(spark, [trip(), trip(purpose=1, kind=2, dest_kind=1, hour=18)]))
    conditions = {"nhb": survey.not_home_based(), "all": F.lit(True)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    below = plan(survey.trip_hour_share(trips, conditions)).rpartition("Aggregate [start_hour")
    assert below[1] and "Generate" not in below[2]
    assert "lambda" not in plan(survey.tour_hour_share(trips, {"hw": survey.work_tour(), "ho": survey.other_tour()}))
    stops = spark.createDataFrame([], "uid long, stop_event long, start_timestamp long, end_timestamp long, cluster_label string, location_type string, weekend boolean, month int")
    presets = [preset(n).informed_by(HourlyDistribution.of({8: 60.0, 18: 40.0})) for n in MODULAR]
    assert "lambda" not in plan(preset_trips(stops, presets))
