"""One Spark query per operator, over the derived tables.

Doubles are rounded and dates turned to text so that another engine's result
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import HOME_WORK_HOURS, Tables
from tripweave import functions as fn
from tripweave.operators import compare, od, profile, survey, trips, zones
from tripweave.operators.spatial import assign_zone, valid_zones, zone_validity
from tripweave.plans import departure as dep
from tripweave.plans import od as od_plan
from tripweave.plans import surveys as survey_plan
from tripweave.plans.presets import INFORMED, MODULAR, PRESETS, RAW, Preset, Sampling, TripFilter, preset
from tripweave.sources import (
    HourlyDistribution,
    manifest,
    origin,
    read_anchors,
    read_hourly_distribution,
    read_stops,
    read_survey_csv,
    read_trips,
    read_zones,
    reuse_or_build,
    scratch_path,
    write_anchors,
    write_collection,
    write_csv,
    write_trips,
    write_zones,
)
from tripweave.sources.tables import HOUSEHOLD_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register ``f(tables)`` under ``name``."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- sources and sinks --------------------------------------------------------


@query("csv_roundtrip_ids")
def csv_roundtrip_ids(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "households")
    write_csv(t.households, path)
    return read_survey_csv(t.spark, path, HOUSEHOLD_SCHEMA)


@query("hourly_distribution_load")
def hourly_distribution_load(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "hours")
    shares = survey_plan.hour_shares(t.survey, "all")
    write_csv(shares.withColumnRenamed("hour", "start_hour"), path)
    loaded = read_hourly_distribution(t.spark, path)
    total = loaded.agg(F.sum("percentage")).scalar()
    return rounded(loaded.withColumn("share", F.col("percentage") / total), "percentage", "share")


@query("zones_from_geojson")
def zones_from_geojson(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "zones")
    write_zones(t.fine_zones, path)
    loaded = read_zones(t.spark, path, layout="lines")
    vertices = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    return rounded(
        loaded.select(
            "geomid", "population", "zone_ord", vertices.alias("vertices"), "minx", "miny", "maxx", "maxy"
        ),
        "minx", "miny", "maxx", "maxy",
    )


@query("zones_from_collection")
def zones_from_collection(t: Tables) -> DataFrame:
    """Fine zones with holes and second parts, out to one collection under other names and in again."""
    path = scratch_path(t.spark, "collection")
    named = t.shaped_zones.withColumnsRenamed({"geomid": "CVE", "population": "POB"})
    write_collection(named, path)
    loaded = read_zones(t.spark, path, {"CVE": "geomid", "POB": "population"})
    return rounded(
        loaded.select(
            "geomid", "population", "zone_ord", F.size("rings").alias("rings"),
            (F.array_max("parts") + 1).alias("polygons"), "minx", "miny", "maxx", "maxy",
        ),
        "minx", "miny", "maxx", "maxy",
    )


@query("zones_valid")
def zones_valid(t: Tables) -> DataFrame:
    return zone_validity(t.flawed_zones)


@query("assign_valid_zone")
def assign_valid_zone(t: Tables) -> DataFrame:
    return assign_zone(t.anchors, valid_zones(t.flawed_zones), *od_plan.HOME)


def _count_by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy("month", "trip_start_hour").agg(F.count("*").alias("trips"))


@query("trips_table_roundtrip")
def trips_table_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trips")
    write_trips(dep.departure_trips(t.stops, preset("HW_raw")), path)
    return _count_by_hour(read_trips(t.spark, path))


@query("trips_reuse")
def trips_reuse(t: Tables) -> DataFrame:
    """One path asked for raw trips, again, and for uniform ones: only the second is not built."""
    path, asked = scratch_path(t.spark, "trips"), ("HW_raw", "HW_raw", "HW_random_uniform")
    parts, before = [], None
    for request, name in enumerate(asked):
        build = lambda: dep.departure_trips(t.stops, preset(name))  # noqa: E731, B023
        table = reuse_or_build(t.spark, path, build, made_from=origin(preset(name), t.stops))
        now = manifest(t.spark, path)["version"]
        parts.append(_count_by_hour(table).select(F.lit(request).alias("request"), F.lit(now != before).alias("built"), "*"))
        before = now
    return reduce(DataFrame.unionByName, parts)


# -- anchors, zones, OD pairs -------------------------------------------------


@query("anchors_filtered")
def anchors_filtered(t: Tables) -> DataFrame:
    return od.drop_missing_anchor(t.anchors)


@query("anchors_in_extent")
def anchors_in_extent(t: Tables) -> DataFrame:
    return od.filter_extent(t.anchors, zones.extent_of(t.zones))


@query("anchors_along_curve")
def anchors_along_curve(t: Tables) -> DataFrame:
    """The extent filter over anchors that were written along a curve."""
    path = scratch_path(t.spark, "anchors")
    write_anchors(t.anchors, path)
    return od.filter_extent(od.drop_missing_anchor(read_anchors(t.spark, path)), zones.extent_of(t.zones))


@query("anchors_dedup")
def anchors_dedup(t: Tables) -> DataFrame:
    return od.dedupe_users(t.anchors)


@query("zones_extent")
def zones_extent(t: Tables) -> DataFrame:
    return rounded(zones.total_bounds(t.fine_zones), "minx", "miny", "maxx", "maxy")


@query("zones_population")
def zones_population(t: Tables) -> DataFrame:
    return od_plan.zones_with_population(t.zones, t.households).select("geomid", "population")


@query("assign_home_zone")
def assign_home_zone(t: Tables) -> DataFrame:
    return assign_zone(t.anchors, t.zones, *od_plan.HOME)


@query("assign_work_zone")
def assign_work_zone(t: Tables) -> DataFrame:
    return assign_zone(t.anchors, t.zones, *od_plan.WORK)


@query("assign_fine_zone")
def assign_fine_zone(t: Tables) -> DataFrame:
    return assign_zone(t.anchors, t.fine_zones, *od_plan.HOME)


@query("assign_fine_zone_shuffled")
def assign_fine_zone_shuffled(t: Tables) -> DataFrame:
    return assign_zone(t.anchors, t.fine_zones, *od_plan.HOME, broadcast_bytes=0)


@query("od_pairs")
def od_pairs(t: Tables) -> DataFrame:
    return od_plan.od_pairs(t.anchors, t.zones)


def _od(t: Tables) -> DataFrame:
    """The pairs as the analyses get them: from the store."""
    return od_plan.stored_od_pairs(t.anchors, t.zones)


def _factors(t: Tables) -> DataFrame:
    return od.expansion_factors(t.zones, _od(t))


def _expand(t: Tables, pairs: DataFrame) -> DataFrame:
    return od.expanded_od(pairs, od.expansion_factors(t.zones, pairs))


def _expanded(t: Tables) -> DataFrame:
    return _expand(t, _od(t))


def _matrix(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Expanded pairs and the zones of the matrix they fill."""
    pairs = _od(t)
    return _expand(t, pairs), od.zone_universe(pairs)


# -- OD analysis --------------------------------------------------------------


@query("expansion_factors")
def expansion_factors(t: Tables) -> DataFrame:
    return rounded(_factors(t), "expansion", "scaled_users")


@query("scaling_table")
def scaling_table(t: Tables) -> DataFrame:
    return rounded(compare.scaling_table(_factors(t)), "scaled_users")


@query("zone_map_table")
def zone_map_table(t: Tables) -> DataFrame:
    return rounded(compare.zone_map_table(_factors(t)), "expansion")


@query("zones_filtered")
def zones_filtered(t: Tables) -> DataFrame:
    keep = (F.col("expansion") < 100) & (F.col("count_uid") > 5)
    return rounded(od.zone_outlier_filter(_factors(t), keep), "expansion", "scaled_users")


@query("expansion_hist")
def expansion_hist(t: Tables) -> DataFrame:
    return rounded(od.expansion_histogram(_factors(t), 5), "probability")


@query("od_expanded")
def od_expanded(t: Tables) -> DataFrame:
    return rounded(_expanded(t), "counts")


@query("zone_universe")
def zone_universe(t: Tables) -> DataFrame:
    return od.zone_universe(_od(t))


@query("od_wide")
def od_wide(t: Tables) -> DataFrame:
    total = F.aggregate(F.map_values("cells"), F.lit(0.0), lambda a, x: a + x)
    return od.pivot_od(_expanded(t)).select(
        "home_geomid",
        F.size("cells").alias("filled"),
        F.array_join(F.map_keys("cells"), ",").alias("work_geomids"),
        F.round(total, 3).alias("total"),
    )


@query("od_unpivot")
def od_unpivot(t: Tables) -> DataFrame:
    return rounded(od.unpivot_od(od.pivot_od(_expanded(t))), "counts")


@query("od_dense")
def od_dense(t: Tables) -> DataFrame:
    return rounded(od.matrix_totals(*_matrix(t)), "total", digits=3)


@query("od_aligned")
def od_aligned(t: Tables) -> DataFrame:
    return rounded(od.align_matrix(*_matrix(t)), "counts")


@query("survey_od_aligned")
def survey_od_aligned(t: Tables) -> DataFrame:
    """The survey's pairs on the zones of the measured matrix."""
    return od.align_matrix(_survey_od(t), _matrix(t)[1])


@query("od_expansion_both_ends")
def od_expansion_both_ends(t: Tables) -> DataFrame:
    pairs = _od(t)
    both = od.attach_expansion(pairs, od.expansion_factors(t.zones, pairs), ("home", "work"))
    return rounded(both, "home_expansion", "work_expansion")


@query("od_pairs_from_files")
def od_pairs_from_files(t: Tables) -> DataFrame:
    anchors, places = scratch_path(t.spark, "anchors"), scratch_path(t.spark, "places")
    t.anchors.write.parquet(anchors)
    write_zones(t.zones, places)
    return od_plan.od_pairs(read_anchors(t.spark, anchors), read_zones(t.spark, places, layout="lines"))


@query("profile_from_files")
def profile_from_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stops")
    t.stops.write.parquet(path)
    return _profile(dep.departure_profile(read_stops(t.spark, path), preset("HW_raw")))


def _survey_od(t: Tables) -> DataFrame:
    return survey.survey_od(survey_plan.survey_flows(t.survey, t.known_households))


@query("od_compare_rows")
def od_compare_rows(t: Tables) -> DataFrame:
    return rounded(compare.join_od_sources(_expanded(t), _survey_od(t)), "counts_lbs")


@query("od_corr")
def od_corr(t: Tables) -> DataFrame:
    return rounded(od_plan.od_comparison(_od(t), t.zones, _survey_od(t)), "r")


@query("od_range")
def od_range(t: Tables) -> DataFrame:
    pairs = compare.join_od_sources(_expanded(t), _survey_od(t))
    return rounded(compare.value_range(pairs), "min_value", "max_value")


# -- surveys ------------------------------------------------------------------


@query("survey_population")
def survey_population(t: Tables) -> DataFrame:
    return survey.zone_population(t.households)


@query("survey_known_zones")
def survey_known_zones(t: Tables) -> DataFrame:
    rows = survey.work_rows(survey.select_trips(t.survey))
    return survey.keep_known_zones(rows, survey.zone_population(t.known_households))


@query("survey_workers")
def survey_workers(t: Tables) -> DataFrame:
    return survey.zone_workers(survey_plan.survey_flows(t.survey, t.known_households))


@query("survey_workers_by_purpose")
def survey_workers_by_purpose(t: Tables) -> DataFrame:
    return survey.zone_workers(
        survey_plan.survey_flows(t.survey, t.known_households, weekday=False, purpose=2)
    )


query("survey_od")(_survey_od)


@query("survey_od_dense")
def survey_od_dense(t: Tables) -> DataFrame:
    flows = survey_plan.survey_flows(t.survey, t.known_households)
    return rounded(od.matrix_totals(flows, od.zone_universe(flows)), "total", digits=3)


@query("survey_valid_trips")
def survey_valid_trips(t: Tables) -> DataFrame:
    return survey.valid_trips(t.survey)


@query("survey_hw_tours")
def survey_hw_tours(t: Tables) -> DataFrame:
    legs = survey.tour_legs(survey.valid_trips(t.survey), {"hw": survey.work_tour()})
    return legs.drop("series")


@query("survey_ho_tours")
def survey_ho_tours(t: Tables) -> DataFrame:
    legs = survey.tour_legs(survey.valid_trips(t.survey), {"ho": survey.other_tour()})
    return legs.drop("series")


def _register_survey_hours(series: str) -> None:
    @query(f"survey_{series}_hours")
    def hours(t: Tables) -> DataFrame:
        return rounded(survey_plan.hour_shares(t.survey, series), "percentage")


for _series in survey_plan.SERIES:
    _register_survey_hours(_series)


@query("survey_hours_any_day")
def survey_hours_any_day(t: Tables) -> DataFrame:
    """All hour shares of the second city: no test of the weekday."""
    return rounded(survey_plan.all_hour_shares(t.survey, weekday=False), "percentage")


@query("survey_od_by_purpose")
def survey_od_by_purpose(t: Tables) -> DataFrame:
    """The second city's OD table: trips to work on any day."""
    return survey.survey_od(survey_plan.survey_flows(t.survey, t.known_households, weekday=False, purpose=2))


@query("replicate_rows")
def replicate_rows(t: Tables) -> DataFrame:
    rows = survey.replicate_by_weight(survey.valid_trips(t.survey))
    return rows.groupBy("purpose", "start_hour").agg(F.count("*").alias("people"))


@query("desire_lines_counts")
def desire_lines_counts(t: Tables) -> DataFrame:
    return survey.category_counts(survey.desire_lines(t.desire_lines), "tipo_de_vi")


@query("desire_lines_total")
def desire_lines_total(t: Tables) -> DataFrame:
    return survey.desire_lines(t.desire_lines).agg(F.sum("count").alias("trips"))


# -- stops to trips -----------------------------------------------------------


def _following(t: Tables) -> DataFrame:
    return trips.with_next_stop(trips.exclude_location_type(t.stops, "O"))


def _moves(t: Tables, condition) -> DataFrame:
    return _following(t).filter(condition).select(
        "uid", "stop_event", "month", "location_type", "next_type", "end_timestamp", "next_start"
    )


@query("stops_excl_other")
def stops_excl_other(t: Tables) -> DataFrame:
    return trips.exclude_location_type(t.stops, "O")


@query("month_slice")
def month_slice(t: Tables) -> DataFrame:
    return trips.month_slice(t.stops, (1, 3))


@query("month_slice_open")
def month_slice_open(t: Tables) -> DataFrame:
    """All months but the first, and the last but one, by open and negative places."""
    later = trips.month_slice(t.stops, (1, None)).withColumn("part", F.lit("later"))
    return later.unionByName(trips.month_slice(t.stops, (-2, -1)).withColumn("part", F.lit("last_but_one")))


@query("next_stop")
def next_stop(t: Tables) -> DataFrame:
    return _following(t)


@query("next_stop_in_runs")
def next_stop_in_runs(t: Tables) -> DataFrame:
    kept = trips.exclude_location_type(t.stops, "O")
    return trips.with_next_stop(kept, trips.run_marks(kept, 2))


@query("real_moves")
def real_moves(t: Tables) -> DataFrame:
    return _moves(t, trips.is_real_move())


@query("weekday_moves")
def weekday_moves(t: Tables) -> DataFrame:
    return _moves(t, trips.is_real_move() & trips.is_weekday_move())


@query("trips_hw_bidir")
def trips_hw_bidir(t: Tables) -> DataFrame:
    return _moves(t, trips.trip_condition(("H",), ("W",), same_day_only=False))


@query("trips_from_home")
def trips_from_home(t: Tables) -> DataFrame:
    return _moves(t, trips.trip_condition(origins=("H",), same_day_only=False))


@query("trips_to_work")
def trips_to_work(t: Tables) -> DataFrame:
    return _moves(t, trips.trip_condition(dests=("W",), same_day_only=False))


@query("same_day_trips")
def same_day_trips(t: Tables) -> DataFrame:
    return _following(t).filter(trips.trip_condition()).select(
        "uid", "stop_event", trips.origin_date().cast("string").alias("origin_end_date")
    )


@query("month_audit")
def month_audit(t: Tables) -> DataFrame:
    kept = trips.exclude_location_type(t.stops, "O")
    return trips.month_audit(kept, dep.departure_trips(t.stops, preset("HW_raw")))


@query("first_last_raw")
def first_last_raw(t: Tables) -> DataFrame:
    return dep.departure_trips(t.stops, preset("HW_raw")).select(
        "uid",
        "stop_event",
        "month",
        trips.direction().alias("direction"),
        F.unix_seconds("rand_start_ts").alias("departure"),
        "trip_start_hour",
    )


@query("first_last_per_direction")
def first_last_per_direction(t: Tables) -> DataFrame:
    """The day's first trip out and last trip back, ranked apart."""
    commute = replace(preset("HW_raw").trips, per_direction=True)
    p = Preset("HW_raw_by_direction", commute, Sampling(RAW), "hw")
    return dep.departure_trips(t.stops, p).select(
        "uid", "stop_event", "month", trips.direction().alias("direction"), "trip_start_hour"
    )


@query("one_flag_keeps_all")
def one_flag_keeps_all(t: Tables) -> DataFrame:
    """With one of the two flags alone no trip of the day is dropped."""
    commute = replace(preset("HW_raw").trips, last_return=False)
    p = Preset("HW_raw_first_only", commute, Sampling(RAW), "hw")
    return dep.departure_trips(t.stops, p).select("uid", "stop_event", "month", "trip_start_hour")


# -- profiles -----------------------------------------------------------------


def _profile(df: DataFrame) -> DataFrame:
    return rounded(df, "percentage_of_trips").drop("rounded_share")


def _named(t: Tables, names) -> list[Preset]:
    """Presets informed, where they need it, by the hours of the survey tables."""
    presets = [preset(n) for n in names]
    informed = {p.survey for p in presets if p.sampling.strategy == INFORMED}
    if not informed:
        return presets
    hours = HourlyDistribution.by_series(survey_plan.stored_hour_shares(t.survey))
    return [p.informed_by(hours[p.survey]) if p.survey in hours else p for p in presets]


@query("hourly_profile_raw")
def hourly_profile_raw(t: Tables) -> DataFrame:
    return _profile(dep.departure_profile(t.stops, preset("HW_raw")))


@query("hourly_profile_uniform")
def hourly_profile_uniform(t: Tables) -> DataFrame:
    return _profile(dep.departure_profile(t.stops, preset("HW_random_uniform")))


@query("hourly_profile_informed")
def hourly_profile_informed(t: Tables) -> DataFrame:
    hours = HourlyDistribution.of(HOME_WORK_HOURS)
    return _profile(dep.departure_profile(t.stops, preset("HW_informed").informed_by(hours)))


@query("informed_departures")
def informed_departures(t: Tables) -> DataFrame:
    hours = HourlyDistribution.of(HOME_WORK_HOURS)
    return dep.departure_trips(t.stops, preset("all_informed").informed_by(hours)).select(
        "uid", "stop_event", F.round("departure", 3).alias("departure"), "trip_start_hour"
    )


@query("hourly_profile_rounded")
def hourly_profile_rounded(t: Tables) -> DataFrame:
    return dep.departure_profile(t.stops, preset("HW_raw")).drop("percentage_of_trips")


@query("sorted_profile")
def sorted_profile(t: Tables) -> DataFrame:
    return _profile(dep.departure_profile(t.stops, preset("HW_raw"))).orderBy("trip_start_hour")


@query("zoned_profile")
def zoned_profile(t: Tables) -> DataFrame:
    """Hours on the wall clock of a zone seven hours behind UTC."""
    commute = preset("HW_raw").trips
    p = Preset("HW_raw_local", commute, Sampling(RAW), "hw", zone="America/Phoenix")
    return _profile(dep.departure_profile(t.stops, p))


@query("middle_months_profile")
def middle_months_profile(t: Tables) -> DataFrame:
    p = Preset("later_months", TripFilter(), Sampling(RAW), "all", month_positions=(1, 3))
    return _profile(dep.departure_profile(t.stops, p))


def _register_profile(name: str) -> None:
    @query(f"profile_{name}")
    def one(t: Tables) -> DataFrame:
        (p,) = _named(t, [name])
        return _profile(dep.departure_profile(t.stops, p))


for _name in PRESETS:
    _register_profile(_name)


def _all_profiles(t: Tables) -> DataFrame:
    return dep.stored_profiles(t.stops, _named(t, MODULAR))


@query("compare_profiles")
def compare_profiles(t: Tables) -> DataFrame:
    return _profile(_all_profiles(t)).drop("rounded_share")


@query("profile_matrix")
def profile_matrix(t: Tables) -> DataFrame:
    return rounded(compare.profile_matrix(_all_profiles(t)), *[f"h{h}" for h in range(24)])


@query("profile_stats")
def profile_stats(t: Tables) -> DataFrame:
    return rounded(compare.profile_statistics(_all_profiles(t)), "mean_hour", "std_hour", "peak_share")


@query("hour_spine")
def hour_spine(t: Tables) -> DataFrame:
    shares = survey_plan.all_hour_shares(t.survey).withColumnRenamed("hour", "trip_start_hour")
    return rounded(profile.hour_spine(shares, ("series",), "percentage"), "percentage")


@query("interp_hours")
def interp_hours(t: Tables) -> DataFrame:
    shares = survey_plan.all_hour_shares(t.survey)
    return rounded(profile.interp_hours(shares, ("series",)), "percentage")


@query("series_overlay")
def series_overlay(t: Tables) -> DataFrame:
    overlay = compare.series_overlay(_all_profiles(t), survey_plan.stored_hour_shares(t.survey))
    return rounded(overlay, "percentage")


@query("dtw_pairs")
def dtw_pairs(t: Tables) -> DataFrame:
    pairing = t.spark.createDataFrame(
        [(n, PRESETS[n].survey) for n in MODULAR], "series string, survey string"
    )
    shares = survey_plan.stored_hour_shares(t.survey)
    return rounded(compare.dtw_pairs(_all_profiles(t), shares, pairing), "dtw", "dtw_normalised")


# -- scalar functions ---------------------------------------------------------


@query("scalar_kit")
def scalar_kit(t: Tables) -> DataFrame:
    customer = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    text = key.cast("string")
    return customer.select(
        "c_custkey",
        fn.zero_pad(text).alias("padded"),
        fn.concat_ids(fn.zero_pad(text), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))).alias("joined"),
        fn.round_to_multiple(key * 2.5, 5).alias("nearest"),
        F.round(fn.expansion_factor(balance, key), 6).alias("expansion"),
        F.round(fn.log10_positive(balance), 6).alias("log_balance"),
        fn.fill_int(F.when(balance > 0, balance)).alias("filled"),
        F.round(balance / 7, 2).alias("two_decimals"),
        F.expr(fn.hour_of(fn.local_seconds("c_custkey * 4567"))).alias("hour_of_day"),
        F.expr(fn.date_of(fn.local_seconds("c_custkey * 45678"))).cast("string").alias("day"),
    )
