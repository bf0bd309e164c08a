"""Weighted household and trip surveys.

A survey row stands for ``int(factor)`` people. Where the result is a count of
people, weights are summed; rows are never repeated to be counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions import truncated_weight
from tripweave.operators.profile import weighted_hour_share

# Fixed values of the survey coding.
HOME_PLACE = 1
RETURN_HOME, GO_TO_WORK = 1, 2
WEEKDAY = 1
UNKNOWN_HOUR = 99

_TRIP_NAMES = {
    "p5_13": "purpose",
    "p5_6": "type_origin",
    "p5_11a": "type_dest",
    "p5_9_1": "start_hour",
    "p5_3": "day_type",
}

COPIES_A_BLOCK = 65_536


# -- zones and flows ----------------------------------------------------------


def zone_population(households: DataFrame) -> DataFrame:
    """People per zone: persons times weight."""
    return households.groupBy(F.col("distrito").alias("geomid")).agg(
        F.sum(F.col("p1_1") * F.col("factor")).alias("population")
    )


def select_trips(survey: DataFrame, weekday: bool = True, purpose: int | None = None) -> DataFrame:
    """Optional weekday and purpose tests on the raw trip survey."""
    if weekday:
        survey = survey.filter(F.col("p5_3") == WEEKDAY)
    if purpose is not None:
        survey = survey.filter(F.col("p5_13") == purpose)
    return survey


def keep_known_zones(survey: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows whose home and work zone are both known."""
    known = zones.select("geomid").distinct()
    for end in ("home_geomid", "work_geomid"):
        survey = survey.join(known, survey[end] == known["geomid"], "left_semi")
    return survey


def work_rows(survey: DataFrame) -> DataFrame:
    return survey.select(
        F.col("dto_origen").alias("home_geomid"), F.col("dto_dest").alias("work_geomid"), "factor"
    )


def work_flows(
    survey: DataFrame, zones: DataFrame, weekday: bool = True, purpose: int | None = None
) -> DataFrame:
    """People per zone pair between known zones, pairs of weight 0 included.

    Rows are summed per pair first; the zone tests then see only the pairs.
    """
    pairs = (
        work_rows(select_trips(survey, weekday, purpose))
        .groupBy("home_geomid", "work_geomid")
        .agg(F.sum(truncated_weight(F.col("factor"))).alias("counts"))
    )
    return keep_known_zones(pairs, zones)


def survey_od(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("counts") > 0)


def zone_workers(flows: DataFrame) -> DataFrame:
    """People per work zone; zones without any are absent."""
    return (
        flows.groupBy("work_geomid")
        .agg(F.sum("counts").alias("workers"))
        .filter(F.col("workers") > 0)
    )


def replicate_by_weight(rows: DataFrame, weight: str = "factor") -> DataFrame:
    """Each row ``int(weight)`` times; rows of weight 0 vanish.

    Copies come in blocks, so that no row carries an array of ``weight`` elements.
    Where only numbers of copies are wanted, ``replicated_counts`` makes none.
    """
    times = truncated_weight(F.col(weight)).cast("bigint")
    return (
        rows.withColumn("times", times)
        .filter(F.col("times") > 0)
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES_A_BLOCK})")))
        .withColumn(
            "copy",
            F.explode(F.expr(f"sequence(1L, least({COPIES_A_BLOCK}L, times - block * {COPIES_A_BLOCK}))")),
        )
        .drop("times", "block", "copy")
    )


def replicated_counts(rows: DataFrame, *by: str, weight: str = "factor", out: str = "people") -> DataFrame:
    """How many copies ``replicate_by_weight`` makes of the rows of each group."""
    times = truncated_weight(F.col(weight)).cast("bigint")
    return rows.filter(times > 0).groupBy(*by).agg(F.sum(times).alias(out))


def category_counts(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("rows"))


def desire_lines(lines: DataFrame) -> DataFrame:
    """Trips per zone pair of a line-of-desire survey, whole numbers."""
    return lines.select(
        F.col("zona_de_or").alias("home_geomid"),
        F.col("zona_de_de").alias("work_geomid"),
        F.col("total_de_v").cast("bigint").alias("count"),
        "tipo_de_vi",
    )


# -- trips by hour ------------------------------------------------------------


def valid_trips(survey: DataFrame, weekday: bool = True) -> DataFrame:
    """Trips with a usable start hour (null is kept, 99 is not), renamed."""
    rows = survey.filter(~F.col("p5_9_1").eqNullSafe(UNKNOWN_HOUR))
    return select_trips(rows, weekday).select(
        "id_soc", *[F.col(c).alias(n) for c, n in _TRIP_NAMES.items()], "factor"
    )


@dataclass(frozen=True)
class Tour:
    """Two legs of one person that share a place: out from home, and back.

    The outbound leg ends at the kind of place where the return leg starts.
    """

    outbound: Column
    inbound: Column


def work_tour() -> Tour:
    return Tour(
        outbound=(F.col("type_origin") == HOME_PLACE) & (F.col("purpose") == GO_TO_WORK),
        inbound=(F.col("type_dest") == HOME_PLACE) & (F.col("purpose") == RETURN_HOME),
    )


def other_tour() -> Tour:
    return Tour(
        outbound=(F.col("type_origin") == HOME_PLACE) & ~F.col("purpose").eqNullSafe(GO_TO_WORK),
        inbound=F.col("type_dest") == HOME_PLACE,
    )


def _legs(trips: DataFrame, tours: dict[str, Tour], strict_null: bool) -> DataFrame:
    """One row per distinct leg and role, with ``link``: the kind of place shared.

    Distinct tours are all pairs of distinct legs of one (series, person, link),
    so legs are made distinct here and the pairs need not be formed.
    """

    def role(series: str, leg: str, link: str) -> Column:
        return F.struct(
            F.lit(series).alias("series"), F.lit(leg).alias("leg"), F.col(link).alias("link")
        )

    roles, used = [], F.lit(False)
    for series, tour in tours.items():
        outbound = F.coalesce(tour.outbound, F.lit(False))
        inbound = F.coalesce(tour.inbound, F.lit(False))
        used |= outbound | inbound
        roles.append(F.when(outbound, role(series, "outbound", "type_dest")))
        roles.append(F.when(inbound, role(series, "return", "type_origin")))
    legs = (
        trips.filter(used)
        .distinct()
        .withColumn("role", F.explode(F.array(*roles)))
        .filter("role is not null")
        .select("*", "role.*")
        .drop("role")
        .withColumn("people", truncated_weight(F.col("factor")))
    )
    if strict_null:
        legs = legs.filter(F.col("id_soc").isNotNull() & F.col("link").isNotNull())
    return legs


_TOUR_KEY = ("series", "id_soc", "link")


def _leg_sums() -> list[Column]:
    is_out = F.col("leg") == "outbound"
    return [
        F.count_if(is_out).alias("outbounds"),
        F.count_if(~is_out).alias("returns"),
        F.sum(F.when(is_out, F.col("people")).otherwise(0)).alias("outbound_people"),
    ]


def tour_legs(trips: DataFrame, tours: dict[str, Tour], strict_null: bool = False) -> DataFrame:
    """Legs that take part in a tour, with the tours they are in.

    ``tours`` counts the pairs a leg belongs to and ``tour_people`` sums the
    outbound weight over them. This is the whole pair table in factored form:
    its size grows with the legs, not with their products.
    """
    legs = _legs(trips, tours, strict_null)
    totals = (
        legs.groupBy(*[F.col(k).alias(f"total_{k}") for k in _TOUR_KEY])
        .agg(*_leg_sums())
        .filter((F.col("outbounds") > 0) & (F.col("returns") > 0))
    )
    same = [F.col(k).eqNullSafe(F.col(f"total_{k}")) for k in _TOUR_KEY]
    is_out = F.col("leg") == "outbound"
    return legs.join(totals, same).select(
        *legs.columns,
        F.when(is_out, F.col("returns")).otherwise(F.col("outbounds")).alias("tours"),
        F.when(is_out, F.col("people") * F.col("returns"))
        .otherwise(F.col("outbound_people"))
        .alias("tour_people"),
    )


def tour_hour_share(
    trips: DataFrame, tours: dict[str, Tour], strict_null: bool = False
) -> DataFrame:
    """Share of tour legs per series and start hour; both legs weigh as the outbound.

    Legs are summed per (person, link, hour) before a person's totals are
    formed, so no group holds more rows than there are hours. The series are
    columns of these sums, so a leg is no row for each of them.
    """
    outs = [F.coalesce(t.outbound, F.lit(False)) for t in tours.values()]
    ins = [F.coalesce(t.inbound, F.lit(False)) for t in tours.values()]
    any_out, any_in = reduce(or_, outs), reduce(or_, ins)
    end = lambda link, out: F.struct(F.col(link).alias("link"), F.lit(out).alias("is_out"))
    ends = F.array(F.when(any_out, end("type_dest", True)), F.when(any_in, end("type_origin", False)))
    flags = [F.when(F.col("is_out"), o).otherwise(i).alias(f"in_{n}") for n, (o, i) in enumerate(zip(outs, ins))]
    legs = (
        trips.filter(any_out | any_in)
        .distinct()
        .withColumn("end", F.explode(ends))
        .filter("end is not null")
        .select("*", "end.*")
        .select("id_soc", "link", "start_hour", "is_out", truncated_weight(F.col("factor")).alias("people"), *flags)
    )
    if strict_null:
        legs = legs.filter(F.col("id_soc").isNotNull() & F.col("link").isNotNull())
    person = Window.partitionBy("id_soc", "link")
    sums, masses = [], []
    for n in range(len(tours)):
        member = F.col(f"in_{n}")
        sums.append(F.sum(F.when(F.col("is_out") & member, F.col("people")).otherwise(0)).alias(f"people_{n}"))
        sums.append(F.count_if(~F.col("is_out") & member).alias(f"returns_{n}"))
        people, returns = F.col(f"people_{n}"), F.col(f"returns_{n}")
        masses.append((people * F.sum(returns).over(person) + returns * F.sum(people).over(person)).alias(f"weight_{n}"))
    per_hour = legs.groupBy("id_soc", "link", "start_hour").agg(*sums)
    return _series_shares(per_hour.select("start_hour", *masses), tuple(tours))


def _series_shares(rows: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """Hour shares of rows with ``start_hour`` and one ``weight_n`` for each of ``series``, null where they are no members."""
    per_hour = rows.groupBy("start_hour").agg(*[F.sum(f"weight_{n}").alias(f"weight_{n}") for n in range(len(series))])
    long = F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"weight_{n}").alias("weight")) for n, s in enumerate(series)])
    return weighted_hour_share(per_hour.select("start_hour", F.inline(long)), "start_hour", "weight", by=("series",))


def not_home_based() -> Column:
    """Neither end is home; unknown place types count as not home."""
    return ~F.col("type_origin").eqNullSafe(HOME_PLACE) & ~F.col("type_dest").eqNullSafe(
        HOME_PLACE
    )


def trip_hour_share(trips: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Share of people per series and start hour, one leg per row."""
    people = truncated_weight(F.col("factor"))
    weights = [F.when(c, people).alias(f"weight_{n}") for n, c in enumerate(conditions.values())]
    return _series_shares(trips.select("start_hour", *weights), tuple(conditions))
