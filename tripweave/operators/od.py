"""Origin-destination tables from user anchors, and their expansion to people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import expansion_factor, fill_int, round_to_multiple
from tripweave.operators.zones import Extent

UNKNOWN_ZONE = "0"
PAIR = ("home_geomid", "work_geomid")


# -- anchors ------------------------------------------------------------------


def drop_missing_anchor(anchors: DataFrame) -> DataFrame:
    return anchors.filter(F.col("home_latitude").isNotNull() & F.col("work_latitude").isNotNull())


def filter_extent(anchors: DataFrame, extent: Extent) -> DataFrame:
    """Home and work both inside the box, edges included."""
    inside = F.lit(True)
    for place in ("home", "work"):
        inside &= F.col(f"{place}_longitude").between(extent.minx, extent.maxx)
        inside &= F.col(f"{place}_latitude").between(extent.miny, extent.maxy)
    return anchors.filter(inside)


def dedupe_users(anchors: DataFrame) -> DataFrame:
    """One row per user: the one with the smallest coordinates.

    An aggregate, so repeated rows of one user shrink before the shuffle.
    """
    row = F.struct("home_longitude", "home_latitude", "work_longitude", "work_latitude")
    return anchors.groupBy("uid").agg(F.min(row).alias("row")).select("uid", "row.*")


# -- pairs --------------------------------------------------------------------


def count_od_users(located: DataFrame) -> DataFrame:
    """Users per home and work zone; users outside all zones keep a null zone."""
    return located.groupBy(*PAIR).agg(F.count("uid").alias("count_uid"))


def attach_zone_population(od: DataFrame, zones: DataFrame) -> DataFrame:
    """Population of both ends, 0 when unknown; a null zone becomes ``'0'``."""
    people = zones.select("geomid", "population")
    for end in ("home", "work"):
        side = people.select(
            F.col("geomid").alias(f"{end}_geomid"),
            F.col("population").alias(f"{end}_population"),
        )
        od = od.join(side, f"{end}_geomid", "left")
    return od.select(
        *[F.coalesce(F.col(c), F.lit(UNKNOWN_ZONE)).alias(c) for c in PAIR],
        "count_uid",
        fill_int(F.col("home_population")).alias("home_population"),
        fill_int(F.col("work_population")).alias("work_population"),
    )


def drop_missing_od(od: DataFrame) -> DataFrame:
    return od.na.drop(subset=list(PAIR))


def exclude_unknown_zone(od: DataFrame) -> DataFrame:
    return od.filter((F.col("home_geomid") != UNKNOWN_ZONE) & (F.col("work_geomid") != UNKNOWN_ZONE))


# -- expansion ----------------------------------------------------------------


def users_per_home(od: DataFrame) -> DataFrame:
    return od.groupBy(F.col("home_geomid").alias("geomid")).agg(F.sum("count_uid").alias("count_uid"))


def expansion_factors(zones: DataFrame, od: DataFrame) -> DataFrame:
    """Zones with users, expansion (population / users) and scaled users.

    Zones without users stay, with nulls.
    """
    return (
        zones.select("geomid", "population")
        .join(users_per_home(od), "geomid", "left")
        .withColumn("expansion", expansion_factor(F.col("population"), F.col("count_uid")))
        .withColumn("scaled_users", F.col("count_uid") * F.col("expansion"))
    )


def attach_expansion(od: DataFrame, factors: DataFrame, ends: tuple[str, ...] = ("home",)) -> DataFrame:
    """Expansion of the home zone (and, on request, of the work zone)."""
    for end in ends:
        side = factors.select(
            F.col("geomid").alias(f"{end}_geomid"), F.col("expansion").alias(f"{end}_expansion")
        )
        od = od.join(side, f"{end}_geomid", "left")
    return od.select("count_uid", *PAIR, *[f"{end}_expansion" for end in ends])


def expanded_od(od: DataFrame, factors: DataFrame, exclude_unknown: bool = True) -> DataFrame:
    """People per pair: users times the expansion of their home zone."""
    rows = attach_expansion(drop_missing_od(od), factors)
    if exclude_unknown:
        rows = exclude_unknown_zone(rows)
    people = F.sum(F.col("count_uid") * F.col("home_expansion"))
    return rows.groupBy(*PAIR).agg(F.coalesce(people, F.lit(0.0)).alias("counts"))


def expansion_histogram(factors: DataFrame, factor: float = 5.0) -> DataFrame:
    """Share of zones per rounded expansion factor; zones without one are left out."""
    binned = (
        factors.select(round_to_multiple(F.col("expansion"), factor).alias("expansion_rounded"))
        .filter(F.col("expansion_rounded").isNotNull())
        .groupBy("expansion_rounded")
        .agg(F.count("*").alias("zones"))
    )
    total = binned.agg(F.sum("zones")).scalar()
    return binned.select("expansion_rounded", "zones", (F.col("zones") / total).alias("probability"))


def zone_outlier_filter(factors: DataFrame, condition: Column) -> DataFrame:
    """Zones that meet a condition such as ``F.col("expansion") < 200``."""
    return factors.filter(condition)


# -- matrices -----------------------------------------------------------------


def zone_universe(od: DataFrame) -> DataFrame:
    """Every zone seen at either end."""
    return (
        od.select(F.explode(F.array(*PAIR)).alias("geomid"))
        .filter(F.col("geomid").isNotNull())
        .distinct()
    )


def align_matrix(
    od: DataFrame, universe: DataFrame, value: str = "counts", unknown: bool = False
) -> DataFrame:
    """The matrix on the zones of ``universe``: its pairs with trips.

    All other pairs of those zones are zeros and are not written, so the table
    grows with the trips and not with the square of the zones.
    """
    ids = _matrix_zones(universe, unknown)
    for end in PAIR:
        od = od.join(ids.select(F.col("geomid").alias(end)), end, "left_semi")
    return od.select(*PAIR, value)


def _matrix_zones(universe: DataFrame, unknown: bool) -> DataFrame:
    return universe if unknown else universe.filter(F.col("geomid") != UNKNOWN_ZONE)


def matrix_totals(
    od: DataFrame, universe: DataFrame, value: str = "counts", unknown: bool = False
) -> DataFrame:
    """One row on the aligned matrix: ``zones``, ``filled`` pairs and their ``total``."""
    zones = _matrix_zones(universe, unknown).agg(F.count("*")).scalar()
    return align_matrix(od, universe, value, unknown).agg(
        zones.alias("zones"),
        F.count("*").alias("filled"),
        F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("total"),
    )


def pivot_od(od: DataFrame, value: str = "counts") -> DataFrame:
    """A sparse row per home zone: ``cells`` maps work zones to values, in their order.

    A pair given twice is an error, as two values claim one cell.
    """
    cells = F.sort_array(F.collect_list(F.struct("work_geomid", value)))
    return od.groupBy("home_geomid").agg(F.map_from_entries(cells).alias("cells"))


def unpivot_od(rows: DataFrame, value: str = "counts") -> DataFrame:
    """Sparse rows back to one row per pair."""
    return rows.select("home_geomid", F.explode("cells").alias("work_geomid", value))
