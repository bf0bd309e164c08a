"""Anchors and zones to OD pairs, and OD pairs to survey comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripweave.operators.compare import join_od_sources, log_correlation
from tripweave.operators.od import (
    attach_zone_population,
    count_od_users,
    dedupe_users,
    drop_missing_anchor,
    expanded_od,
    expansion_factors,
    filter_extent,
)
from tripweave.operators.spatial import assign_zones, valid_zones, zone_frame
from tripweave.operators.zones import attach_population, survey_zone_population
from tripweave.sources.store import stored

HOME = ("home_longitude", "home_latitude", "home_geomid")
WORK = ("work_longitude", "work_latitude", "work_geomid")


def located_users(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per user whose home and work lie in the box around all zones,
    with the zones that contain them."""
    frame = zone_frame(zones)
    users = dedupe_users(filter_extent(drop_missing_anchor(anchors), frame.extent))
    return assign_zones(users, zones, [HOME, WORK], frame).select(
        "uid", "home_geomid", "work_geomid"
    )


def od_pairs(anchors: DataFrame, zones: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """``home_geomid, work_geomid, count_uid, home_population, work_population``.

    With ``skip_invalid`` no point lies in a zone of invalid shape; otherwise
    such zones hold what an odd number of their rings go around.
    """
    if skip_invalid:
        zones = valid_zones(zones)
    return attach_zone_population(count_od_users(located_users(anchors, zones)), zones)


def stored_od_pairs(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """``od_pairs``, made once for the same anchors and zones.

    Analyses use the pairs several times; each use is a small scan, and the
    anchors are located once.
    """
    build = lambda: od_pairs(anchors, zones)
    return stored(anchors.sparkSession, "od-pairs", None, [anchors, zones], build)


def zones_with_population(zones: DataFrame, households: DataFrame) -> DataFrame:
    return attach_population(zones, survey_zone_population(households))


def od_comparison(od: DataFrame, zones: DataFrame, survey_od: DataFrame) -> DataFrame:
    """Log correlation of the expanded OD table with the survey's."""
    expanded = expanded_od(od, expansion_factors(zones, od))
    return log_correlation(join_od_sources(expanded, survey_od))
