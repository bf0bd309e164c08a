"""The same results as plain SQL for DuckDB, written independently of Spark.

``CTES`` names reusable pieces; ``sql`` prepends those that a query mentions.
"""

from __future__ import annotations

import re

from checks.views import EV_DUCKDB, HOME_WORK_HOURS, TABLES

# The named analyses as sampling, survey hours, type of stops left
# out before sequencing, types at the two ends, first and last trip of the day only.
ANALYSES = {
    "HW_informed": ("informed", "hw", "O", ("H", "W"), True),
    "HW_random_uniform": ("uniform", "hw", "O", ("H", "W"), True),
    "HW_raw": ("raw", "hw", "O", ("H", "W"), True),
    "HO_informed": ("informed", "ho", None, ("H", "O"), False),
    "nonH_informed": ("informed", "nhb", "O", None, False),
    "all_informed": ("informed", "all", "O", None, False),
    "legacy_ho": ("informed", "ho", "W", ("H", "O"), True),
    "legacy_nonh": ("informed", "nhb", "H", None, False),
    "legacy_all": ("informed", "all", None, None, False),
}
COMPARED = ("HW_informed", "HW_random_uniform", "HW_raw", "HO_informed", "nonH_informed", "all_informed")
ABSENT_HOUR_WEIGHT = 0.01

CTES: dict[str, str] = {"ev": EV_DUCKDB, **TABLES}


def sql(body: str) -> str:
    """``with`` the pieces that ``body`` needs, in order of dependence."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    heads = ",\n".join(f"{n} as (\n{CTES[n].strip()}\n)" for n in needed)
    return f"with {heads}\n{body.strip()}"


# -- anchors and zones --------------------------------------------------------

CTES["box"] = """
select min(x0) as minx, min(y0) as miny, max(x0 + 1) as maxx, max(y0 + 1) as maxy from zones"""

_IN_BOX = """
select a.* from anchors a, box b
where a.home_latitude is not null and a.work_latitude is not null
  and a.home_longitude between b.minx and b.maxx and a.work_longitude between b.minx and b.maxx
  and a.home_latitude between b.miny and b.maxy and a.work_latitude between b.miny and b.maxy"""
CTES["anchors_boxed"] = _IN_BOX


def _first_per_user(source: str) -> str:
    return f"""
select uid, home_longitude, home_latitude, work_longitude, work_latitude from (
  select *, row_number() over (partition by uid order by home_longitude nulls first,
    home_latitude nulls first, work_longitude nulls first, work_latitude nulls first) as rn
  from {source}) where rn = 1"""


CTES["users_boxed"] = _first_per_user("anchors_boxed")


def _in_square(end: str, zone: str) -> str:
    return (
        f"a.{end}_longitude > {zone}.x0 and a.{end}_longitude < {zone}.x0 + 1 and "
        f"a.{end}_latitude > {zone}.y0 and a.{end}_latitude < {zone}.y0 + 1"
    )


CTES["od_counts"] = f"""
select h.geomid as home_geomid, w.geomid as work_geomid, count(a.uid) as count_uid
from users_boxed a
left join zones h on {_in_square("home", "h")}
left join zones w on {_in_square("work", "w")}
group by 1, 2"""

CTES["od"] = """
select coalesce(c.home_geomid, '0') as home_geomid, coalesce(c.work_geomid, '0') as work_geomid,
  c.count_uid, coalesce(h.population, 0) as home_population, coalesce(w.population, 0) as work_population
from od_counts c left join zones h on c.home_geomid = h.geomid left join zones w on c.work_geomid = w.geomid"""

CTES["factors"] = """
select z.geomid, z.population, u.count_uid, z.population::double / u.count_uid as expansion,
  u.count_uid * (z.population::double / u.count_uid) as scaled_users
from zones z left join (
  select home_geomid, sum(count_uid)::bigint as count_uid from od group by 1) u on u.home_geomid = z.geomid"""

CTES["expanded"] = """
select o.home_geomid, o.work_geomid, coalesce(sum(o.count_uid * f.expansion), 0) as counts
from od o left join factors f on f.geomid = o.home_geomid
where o.home_geomid <> '0' and o.work_geomid <> '0' group by 1, 2"""

CTES["od_ids"] = "select home_geomid as geomid from od union select work_geomid from od"

# -- surveys ------------------------------------------------------------------

CTES["known"] = "select distinct distrito as geomid from known_households"

CTES["flows"] = """
select dto_origen as home_geomid, dto_dest as work_geomid,
  sum(cast(trunc(factor) as bigint))::bigint as counts
from survey_trips where p5_3 = 1 and dto_origen in (select geomid from known)
  and dto_dest in (select geomid from known) group by 1, 2"""

CTES["survey_pairs"] = "select * from flows where counts > 0"

CTES["flow_ids"] = "select home_geomid as geomid from flows union select work_geomid from flows"

CTES["job"] = """
select id_soc, p5_13 as purpose, p5_6 as type_origin, p5_11a as type_dest, p5_9_1 as start_hour,
  p5_3 as day_type, factor from survey_trips where p5_9_1 is distinct from 99 and p5_3 = 1"""

_JOB = ("purpose", "type_origin", "type_dest", "start_hour", "day_type", "factor")
_SIDES = ", ".join([*(f"o.{c} as o_{c}" for c in _JOB), *(f"r.{c} as r_{c}" for c in _JOB)])
_OUTBOUND = {
    "hw": "type_origin = 1 and purpose = 2",
    "ho": "type_origin = 1 and purpose is distinct from 2",
}
_RETURN = {"hw": "type_dest = 1 and purpose = 1", "ho": "type_dest = 1"}

for _kind in ("hw", "ho"):
    CTES[f"{_kind}_pairs"] = f"""
select distinct o.id_soc, {_SIDES}, cast(trunc(o.factor) as bigint) as people
from (select * from job where {_OUTBOUND[_kind]}) o join (select * from job where {_RETURN[_kind]}) r
  on o.id_soc = r.id_soc and o.type_dest = r.type_origin"""
    CTES[f"{_kind}_hours"] = f"""
select h as hour, 100e0 * sum(people) / (2 * (select sum(people) from {_kind}_pairs)) as percentage
from (select o_start_hour as h, people from {_kind}_pairs
      union all select r_start_hour, people from {_kind}_pairs)
where h is not null group by h having sum(people) > 0"""

for _kind, _where in (("nhb", "type_origin is distinct from 1 and type_dest is distinct from 1"), ("all", "true")):
    CTES[f"{_kind}_hours"] = f"""
select start_hour as hour, 100e0 * sum(people) / (
    select sum(cast(trunc(factor) as bigint)) from job where {_where}) as percentage
from (select start_hour, cast(trunc(factor) as bigint) as people from job where {_where})
where start_hour is not null group by 1 having sum(people) > 0"""

CTES["survey_hours"] = " union all ".join(
    f"select '{k}' as series, hour, percentage from {k}_hours" for k in ("hw", "ho", "nhb", "all")
)

# The same on any day of the week.
CTES["job_any"] = CTES["job"].replace(" and p5_3 = 1", "")
for _kind in ("hw_pairs", "ho_pairs", "hw_hours", "ho_hours", "nhb_hours", "all_hours"):
    CTES[f"{_kind}_any"] = re.sub(r"\b(job|hw_pairs|ho_pairs)\b", r"\1_any", CTES[_kind])


def _tour_legs(kind: str) -> str:
    parts = []
    for leg, side, link in (("outbound", "o", "type_dest"), ("return", "r", "type_origin")):
        columns = ", ".join(f"{side}_{c} as {c}" for c in _JOB)
        parts.append(f"""
select id_soc, {columns}, '{leg}' as leg, {side}_{link} as link,
  cast(trunc({side}_factor) as bigint) as people, count(*) as tours, sum(people)::bigint as tour_people
from {kind}_pairs group by all""")
    return sql("\nunion all\n".join(parts))


# -- stops --------------------------------------------------------------------

_EXCLUDED = {"o": "location_type <> 'O'", "w": "location_type <> 'W'", "h": "location_type <> 'H'", "n": "true"}
for _key, _where in _EXCLUDED.items():
    CTES[f"next_{_key}"] = f"""
select *, lead(cluster_label) over w as next_label, lead(start_timestamp) over w as next_start,
  lead(location_type) over w as next_type, lead(weekend) over w as next_weekend
from stops where {_where} window w as (partition by month, uid order by stop_event)"""

_REAL = (
    "next_label is not null and cluster_label <> next_label and end_timestamp is not null "
    "and next_start is not null and next_start > end_timestamp"
)
_WEEKDAY = "weekend = false and next_weekend = false"
_SAME_DAY = "floor(end_timestamp / 86400e0) = floor(next_start / 86400e0)"


def _both_ways(a: str, b: str) -> str:
    return (
        f"((location_type = '{a}' and next_type = '{b}') or (location_type = '{b}' and next_type = '{a}'))"
    )


def _uniform(word: int) -> str:
    digest = "md5(concat_ws(':', uid, stop_event, month, 'departure'))"
    return f"(('0x' || substring({digest}, {1 + 8 * word}, 8))::bigint / 4294967296e0)"


def _departures(moves: str, how: str, weights: str) -> str:
    """Departure epoch per move; ``weights`` names an (hour, w) relation."""
    if how == "raw":
        return f"select *, end_timestamp::double as departure from ({moves})"
    if how == "uniform":
        return (
            f"select *, end_timestamp + (next_start - end_timestamp) * {_uniform(0)} as departure "
            f"from ({moves})"
        )
    return f"""
select * exclude (hour, day), case
    when hour is null then end_timestamp + (next_start - end_timestamp) * {_uniform(2)}
    else greatest(end_timestamp, least(next_start,
      day + hour * 3600 + cast(floor({_uniform(1)} * 60) as bigint) * 60))::double end as departure
from (
  select m.*, cast(floor(m.end_timestamp / 86400e0) as bigint) * 86400 as day, p.hour
  from ({moves}) m left join (
    select uid, stop_event, month, min(hour) as hour from (
      select uid, stop_event, month, hour,
        sum(w) over (partition by uid, stop_event, month order by hour) as running,
        sum(w) over (partition by uid, stop_event, month) as total,
        count(*) over (partition by uid, stop_event, month order by hour) as marks,
        count(*) over (partition by uid, stop_event, month) as all_marks
      from ({moves}) c join {weights} on
        cast(floor(c.end_timestamp / 86400e0) as bigint) * 86400 + hour * 3600
          between c.end_timestamp and c.next_start)
    where case when total > 0 then running > {_uniform(0)} * total else marks > {_uniform(0)} * all_marks end
    group by 1, 2, 3) p on p.uid = m.uid and p.stop_event = m.stop_event and p.month = m.month)"""


def _first_last(departures: str) -> str:
    return f"""
select * exclude (rn_first, rn_last) from (
  select *, row_number() over (partition by month, uid, floor(end_timestamp / 86400e0)
      order by departure, stop_event) as rn_first,
    row_number() over (partition by month, uid, floor(end_timestamp / 86400e0)
      order by departure desc, stop_event desc) as rn_last
  from ({departures}))
where (location_type = 'H' and rn_first = 1) or (location_type <> 'H' and rn_last = 1)"""


def _weights(hours: str) -> str:
    """24 sampling weights from an (hour, percentage) relation."""
    return f"""(select s.hour, coalesce(d.percentage / (select sum(percentage) from {hours}), {ABSENT_HOUR_WEIGHT}e0) as w
  from (select range as hour from range(24)) s left join {hours} d on d.hour = s.hour)"""


CTES["inline_hours"] = "select * from (values " + ", ".join(
    f"({h}, {v}e0)" for h, v in HOME_WORK_HOURS.items()
) + ") as v(hour, percentage)"
CTES["inline_weights"] = f"select * from {_weights('inline_hours')}"
for _kind in ("hw", "ho", "nhb", "all"):
    CTES[f"{_kind}_weights"] = f"select * from {_weights(f'{_kind}_hours')}"


def _preset_trips(name: str, weights: str | None = None) -> str:
    sampling, survey, left_out, ends, daily_ends = ANALYSES[name]
    source = f"next_{(left_out or 'n').lower()}"
    tests = [_REAL, _WEEKDAY, _SAME_DAY]
    if ends:
        tests.append(_both_ways(*ends))
    moves = f"select * from {source} where {' and '.join(tests)}"
    rows = _departures(moves, sampling, weights or f"{survey}_weights")
    if daily_ends:
        rows = _first_last(rows)
    return f"select *, cast(floor(departure / 3600) % 24 as int) as trip_start_hour from ({rows})"


for _name in ANALYSES:
    CTES[f"trips_{_name.lower()}"] = _preset_trips(_name)
CTES["trips_inline"] = _preset_trips("HW_informed", "inline_weights")
CTES["trips_inline_all"] = _preset_trips("all_informed", "inline_weights")


def _profile(trips: str, share: str = "exact") -> str:
    shares = {
        "exact": "100e0 * trip_count / sum(trip_count) over () as percentage_of_trips",
        "rounded": "round(round(100e0 * trip_count / all_trips, 9), 2) as rounded_share",
    }
    return f"""
select s.hour as trip_start_hour, trip_count, {shares[share]}
from (select cast(range as int) as hour, (select count(*) from {trips} x where x.trip_start_hour = range) as trip_count,
  (select count(*) from {trips}) as all_trips from range(24)) s"""


CTES["profiles"] = " union all ".join(
    f"select '{n}' as series, * from ({_profile(f'trips_{n.lower()}')})" for n in COMPARED
)


def _profile_query(trips: str) -> str:
    return sql(
        "select trip_start_hour, trip_count, round(percentage_of_trips, 6) as percentage_of_trips "
        f"from ({_profile(trips)})"
    )


# -- profiles on 0..23 --------------------------------------------------------


def _interpolated(source: str, hour: str, value: str) -> str:
    """Linear interpolation per series on 0..23, flat outside."""
    return f"""
select series, cast(h as int) as hour, case
    when lo is null then v_hi when hi is null then v_lo when hi = lo then v_lo
    else v_lo + (v_hi - v_lo) * (h - lo) / (hi - lo) end as percentage
from (
  select k.series, k.h,
    max(s.{hour}) filter (s.{hour} <= k.h) as lo, min(s.{hour}) filter (s.{hour} >= k.h) as hi,
    arg_max(s.{value}, s.{hour}) filter (s.{hour} <= k.h) as v_lo,
    arg_min(s.{value}, s.{hour}) filter (s.{hour} >= k.h) as v_hi
  from (select distinct series, range as h from {source}, range(24)) k join {source} s on s.series = k.series
  group by 1, 2)"""


CTES["survey_interp"] = _interpolated("survey_hours", "hour", "percentage")
CTES["pairing"] = "select * from (values " + ", ".join(
    f"('{n}', '{ANALYSES[n][1]}')" for n in COMPARED
) + ") as v(series, survey)"

CTES["curves"] = """
select p.series, p.survey, x.v as x, y.v as y from pairing p
join (select series, list(percentage_of_trips order by trip_start_hour) as v from profiles group by 1) x
  on x.series = p.series
join (select series, list(percentage order by hour) as v from survey_interp group by 1) y
  on y.series = p.survey"""

# Cell (i, j) = step div 24, step mod 24; ``d`` keeps all cells filled so far.
_WARP = """
warp(series, survey, x, y, step, d) as (
  select series, survey, x, y, 0, []::double[] from curves
  union all
  select series, survey, x, y, step + 1, list_append(d, abs(x[step // 24 + 1] - y[step % 24 + 1]) + case
    when step = 0 then 0
    else least(
      case when step >= 24 then d[step - 24 + 1] else 'infinity'::double end,
      case when step % 24 > 0 then d[step] else 'infinity'::double end,
      case when step >= 24 and step % 24 > 0 then d[step - 25 + 1] else 'infinity'::double end) end)
  from warp where step < 576)"""


def _dtw() -> str:
    base = sql("select * from curves")
    heads = base[len("with ") : base.rindex("\nselect * from curves")]
    return f"""with recursive {heads},{_WARP}
select series, survey, round(d[576], 6) as dtw, round(d[576] / 48, 6) as dtw_normalised
from warp where step = 576"""


# -- queries ------------------------------------------------------------------

_MOVE = "uid, stop_event, month, location_type, next_type, end_timestamp, next_start"


def _moves(condition: str) -> str:
    return sql(f"select {_MOVE} from next_o where {condition}")


def _aligned(ids: str, source: str) -> str:
    ends = " and ".join(f"{e}_geomid in (select geomid from {ids} where geomid <> '0')" for e in ("home", "work"))
    return f"select home_geomid, work_geomid, counts from {source} where {ends}"


def _totals(ids: str, source: str) -> str:
    return sql(
        f"select (select count(*) from {ids} where geomid <> '0') as zones, count(*) as filled, "
        f"round(coalesce(sum(counts::double), 0), 3) as total from ({_aligned(ids, source)})"
    )


CTES["od_both"] = """
select e.home_geomid, e.work_geomid, e.counts as counts_lbs, s.counts as counts_eod,
  case when e.home_geomid = e.work_geomid then 'intra' else 'inter' end as kind
from expanded e join survey_pairs s on s.home_geomid = e.home_geomid and s.work_geomid = e.work_geomid"""


def _correlations() -> str:
    parts = []
    for kind, where in (("overall", "true"), ("intra", "kind = 'intra'"), ("inter", "kind = 'inter'")):
        parts.append(f"""
select '{kind}' as kind, count(*) as n_pairs, round(corr(log10(counts_lbs), log10(counts_eod)), 6) as r
from od_both where {where} and counts_lbs > 0 and counts_eod > 0""")
    return sql("\nunion all\n".join(parts))


_FINE_HIT = "abs(a.home_longitude - z.cx) + abs(a.home_latitude - z.cy) < z.radius"
_FINE = f"""
select a.*, h.geomid as home_geomid from anchors a left join (
  select a.home_longitude, a.home_latitude, arg_min(z.geomid, z.zone_ord) as geomid
  from (select distinct home_longitude, home_latitude from anchors) a join fine_zones z on {_FINE_HIT}
  group by 1, 2) h on h.home_longitude = a.home_longitude and h.home_latitude = a.home_latitude"""

_STATS = """
select series, round(mean_hour, 6) as mean_hour, round(sqrt(var), 6) as std_hour, peak_hour,
  round(peak_share, 6) as peak_share
from (
  select p.series, m.mean_hour,
    sum(p.percentage_of_trips * (p.trip_start_hour - m.mean_hour) ** 2) / sum(p.percentage_of_trips) as var,
    max(p.percentage_of_trips) as peak_share,
    min(p.trip_start_hour) filter (p.percentage_of_trips = m.top) as peak_hour
  from profiles p join (
    select series, sum(trip_start_hour * percentage_of_trips) / sum(percentage_of_trips) as mean_hour,
      max(percentage_of_trips) as top from profiles group by 1) m on m.series = p.series
  group by 1, 2)"""

_TRIPS_BY_HOUR = (
    "select month, trip_start_hour, count(*) as trips from trips_hw_raw group by 1, 2"
)
_RAW_PROFILE = _profile_query("trips_hw_raw")

ORACLES: dict[str, str] = {
    "csv_roundtrip_ids": sql("select distrito, ent, mun, p1_1, factor::double as factor from survey_households"),
    "hourly_distribution_load": sql(
        "select hour, round(percentage, 6) as percentage, "
        "round(percentage / (select sum(percentage) from all_hours), 6) as share from all_hours"
    ),
    "zones_from_geojson": sql(
        "select geomid, population, zone_ord, cast(5 as int) as vertices, round(cx - radius, 6) as minx, "
        "round(cy - radius, 6) as miny, round(cx + radius, 6) as maxx, round(cy + radius, 6) as maxy from fine_zones"
    ),
    "zones_from_collection": sql(
        "select geomid, population, zone_ord, case zone_ord % 3 when 0 then 1 else 2 end::int as rings, "
        "case zone_ord % 3 when 2 then 2 else 1 end::int as polygons, round(cx - radius, 6) as minx, "
        "round(cy - radius, 6) as miny, round(cx + radius + case zone_ord % 3 when 2 then 1 else 0 end, 6) as maxx, "
        "round(cy + radius, 6) as maxy from fine_zones"
    ),
    "zones_valid": sql("select geomid, zone_ord % 4 = 3 as valid from fine_zones"),
    "assign_valid_zone": sql(
        "select any_value(a.uid) as uid, any_value(a.home_longitude) as home_longitude, "
        "any_value(a.home_latitude) as home_latitude, any_value(a.work_longitude) as work_longitude, "
        "any_value(a.work_latitude) as work_latitude, arg_min(z.geomid, z.zone_ord) as home_geomid "
        "from (select *, row_number() over () as rn from anchors) a left join fine_zones z on z.zone_ord % 4 = 3 "
        "and abs(a.home_longitude - z.cx) + abs(a.home_latitude - z.cy) < z.radius "
        "and abs(a.home_longitude - z.cx) + abs(a.home_latitude - z.cy) > z.radius / 2 group by a.rn"
    ),
    "trips_table_roundtrip": sql(_TRIPS_BY_HOUR),
    "trips_reuse": sql(
        "select request, built, month, trip_start_hour, count(*) as trips from ("
        "select 0 as request, true as built, month, trip_start_hour from trips_hw_raw "
        "union all select 1, false, month, trip_start_hour from trips_hw_raw "
        "union all select 2, true, month, trip_start_hour from trips_hw_random_uniform) group by 1, 2, 3, 4"
    ),
    "anchors_filtered": sql(
        "select * from anchors where home_latitude is not null and work_latitude is not null"
    ),
    "anchors_in_extent": sql("select * from anchors_boxed"),
    "anchors_along_curve": sql("select * from anchors_boxed"),
    "anchors_dedup": sql(_first_per_user("anchors")),
    "zones_extent": sql(
        "select round(min(cx - radius), 6) as minx, round(min(cy - radius), 6) as miny, "
        "round(max(cx + radius), 6) as maxx, round(max(cy + radius), 6) as maxy from fine_zones"
    ),
    "zones_population": sql(
        "select z.geomid, coalesce(sum(h.p1_1 * h.factor), 0)::bigint as population "
        "from zones z left join survey_households h on h.distrito = z.geomid group by 1"
    ),
    "assign_home_zone": sql(
        f"select a.*, h.geomid as home_geomid from anchors a left join zones h on {_in_square('home', 'h')}"
    ),
    "assign_work_zone": sql(
        f"select a.*, w.geomid as work_geomid from anchors a left join zones w on {_in_square('work', 'w')}"
    ),
    "assign_fine_zone": sql(_FINE),
    "assign_fine_zone_shuffled": sql(_FINE),
    "od_pairs": sql("select * from od"),
    "od_pairs_from_files": sql("select * from od"),
    "profile_from_files": _RAW_PROFILE,
    "od_expansion_both_ends": sql(
        "select o.count_uid, o.home_geomid, o.work_geomid, round(h.expansion, 6) as home_expansion, "
        "round(w.expansion, 6) as work_expansion from od o left join factors h on h.geomid = o.home_geomid "
        "left join factors w on w.geomid = o.work_geomid"
    ),
    "expansion_factors": sql(
        "select geomid, population, count_uid, round(expansion, 6) as expansion, "
        "round(scaled_users, 6) as scaled_users from factors"
    ),
    "scaling_table": sql(
        "select geomid, population, count_uid, round(scaled_users, 6) as scaled_users from factors"
    ),
    "zone_map_table": sql(
        "select geomid, round(expansion, 6) as expansion, population, count_uid from factors"
    ),
    "zones_filtered": sql(
        "select geomid, population, count_uid, round(expansion, 6) as expansion, "
        "round(scaled_users, 6) as scaled_users from factors where expansion < 100 and count_uid > 5"
    ),
    "expansion_hist": sql(
        "select expansion_rounded, count(*) as zones, round(count(*) / sum(count(*)) over (), 6) as probability "
        "from (select round_even(expansion / 5, 0) * 5 as expansion_rounded from factors where expansion is not null) group by 1"
    ),
    "od_expanded": sql("select home_geomid, work_geomid, round(counts, 6) as counts from expanded"),
    "zone_universe": sql("select geomid from od_ids"),
    "od_wide": sql(
        "select home_geomid, count(*)::int as filled, string_agg(work_geomid, ',' order by work_geomid) as work_geomids, "
        "round(sum(counts), 3) as total from expanded group by 1"
    ),
    "od_unpivot": sql("select home_geomid, work_geomid, round(counts, 6) as counts from expanded"),
    "od_dense": _totals("od_ids", "expanded"),
    "od_aligned": sql(
        f"select home_geomid, work_geomid, round(counts, 6) as counts from ({_aligned('od_ids', 'expanded')})"
    ),
    "survey_od_aligned": sql(_aligned("od_ids", "survey_pairs")),
    "od_compare_rows": sql(
        "select home_geomid, work_geomid, round(counts_lbs, 6) as counts_lbs, counts_eod, kind from od_both"
    ),
    "od_corr": _correlations(),
    "od_range": sql(
        "select round(least(min(counts_lbs), min(counts_eod)) - 1, 6) as min_value, "
        "round(greatest(max(counts_lbs), max(counts_eod)), 6) as max_value from od_both"
    ),
    "survey_population": sql(
        "select distrito as geomid, sum(p1_1 * factor)::bigint as population from survey_households group by 1"
    ),
    "survey_known_zones": sql(
        "select dto_origen as home_geomid, dto_dest as work_geomid, factor from survey_trips where p5_3 = 1 "
        "and dto_origen in (select geomid from known) and dto_dest in (select geomid from known)"
    ),
    "survey_workers": sql(
        "select work_geomid, sum(counts)::bigint as workers from flows group by 1 having sum(counts) > 0"
    ),
    "survey_hours_any_day": sql(
        " union all ".join(
            f"select '{k}' as series, hour, round(percentage, 6) as percentage from {k}_hours_any" for k in ("hw", "ho", "nhb", "all")
        )
    ),
    "survey_od_by_purpose": sql(
        "select dto_origen as home_geomid, dto_dest as work_geomid, sum(cast(trunc(factor) as bigint))::bigint as counts "
        "from survey_trips where p5_13 = 2 and dto_origen in (select geomid from known) and dto_dest in (select geomid from known) "
        "group by 1, 2 having sum(cast(trunc(factor) as bigint)) > 0"
    ),
    "survey_workers_by_purpose": sql(
        "select dto_dest as work_geomid, sum(cast(trunc(factor) as bigint))::bigint as workers from survey_trips "
        "where p5_13 = 2 and dto_origen in (select geomid from known) and dto_dest in (select geomid from known) "
        "group by 1 having sum(cast(trunc(factor) as bigint)) > 0"
    ),
    "survey_od": sql("select * from survey_pairs"),
    "survey_od_dense": _totals("flow_ids", "flows"),
    "survey_valid_trips": sql("select * from job"),
    "survey_hw_tours": _tour_legs("hw"),
    "survey_ho_tours": _tour_legs("ho"),
    **{
        f"survey_{k}_hours": sql(f"select hour, round(percentage, 6) as percentage from {k}_hours")
        for k in ("hw", "ho", "nhb", "all")
    },
    "replicate_rows": sql(
        "select purpose, start_hour, count(*) as people from (select purpose, start_hour, "
        "unnest(range(cast(trunc(factor) as bigint))) as copy from job) group by 1, 2"
    ),
    "desire_lines_counts": sql(
        'select tipo_de_vi, count(*) as "rows" from desire_lines group by 1'
    ),
    "desire_lines_total": sql(
        "select sum(cast(trunc(total_de_v) as bigint))::bigint as trips from desire_lines"
    ),
    "stops_excl_other": sql("select * from stops where location_type <> 'O'"),
    "month_slice": sql(
        "select s.* from stops s join (select month, dense_rank() over (order by month) as place "
        "from (select distinct month from stops)) m on m.month = s.month where m.place in (2, 3)"
    ),
    "month_slice_open": sql(
        "with m as (select month, row_number() over (order by month) as place, count(*) over () as n "
        "from (select distinct month from stops)) "
        "select s.*, 'later' as part from stops s join m using (month) where place > 1 "
        "union all select s.*, 'last_but_one' from stops s join m using (month) where place = n - 1"
    ).replace(")\nwith m as", "),\nm as"),
    "next_stop": sql("select * from next_o"),
    "next_stop_in_runs": sql("select * from next_o"),
    "real_moves": _moves(_REAL),
    "weekday_moves": _moves(f"{_REAL} and {_WEEKDAY}"),
    "trips_hw_bidir": _moves(f"{_REAL} and {_WEEKDAY} and {_both_ways('H', 'W')}"),
    "trips_from_home": _moves(f"{_REAL} and {_WEEKDAY} and location_type = 'H' and next_type <> 'H'"),
    "trips_to_work": _moves(f"{_REAL} and {_WEEKDAY} and next_type = 'W'"),
    "same_day_trips": sql(
        "select uid, stop_event, strftime(to_timestamp(end_timestamp) at time zone 'UTC', '%Y-%m-%d') as origin_end_date "
        f"from next_o where {_REAL} and {_WEEKDAY} and {_SAME_DAY}"
    ),
    "month_audit": sql(
        "select s.month, s.stops, coalesce(t.trips, 0) as trips from "
        "(select month, count(*) as stops from stops where location_type <> 'O' group by 1) s "
        "left join (select month, count(*) as trips from trips_hw_raw group by 1) t on t.month = s.month"
    ),
    "first_last_raw": sql(
        "select uid, stop_event, month, case when location_type = 'H' then 'H_to_W' else 'W_to_H' end as direction, "
        "cast(floor(departure) as bigint) as departure, trip_start_hour from trips_hw_raw"
    ),
    "first_last_per_direction": sql(
        "select uid, stop_event, month, direction, cast(floor(end_timestamp / 3600e0) % 24 as int) as trip_start_hour from ("
        "select *, row_number() over (partition by month, uid, day, direction order by end_timestamp, stop_event) as first, "
        "row_number() over (partition by month, uid, day, direction order by end_timestamp desc, stop_event desc) as last from ("
        "select *, case when location_type = 'H' then 'H_to_W' else 'W_to_H' end as direction, floor(end_timestamp / 86400e0) as day "
        f"from next_o where {_REAL} and {_WEEKDAY} and {_SAME_DAY} and {_both_ways('H', 'W')})) "
        "where (direction = 'H_to_W' and first = 1) or (direction = 'W_to_H' and last = 1)"
    ),
    "one_flag_keeps_all": sql(
        "select uid, stop_event, month, cast(floor(end_timestamp / 3600e0) % 24 as int) as trip_start_hour "
        f"from next_o where {_REAL} and {_WEEKDAY} and {_SAME_DAY} and {_both_ways('H', 'W')}"
    ),
    "hourly_profile_raw": _RAW_PROFILE,
    "sorted_profile": _RAW_PROFILE + " order by 1",
    "hourly_profile_uniform": _profile_query("trips_hw_random_uniform"),
    "hourly_profile_informed": _profile_query("trips_inline"),
    "informed_departures": sql(
        "select uid, stop_event, round(departure, 3) as departure, trip_start_hour from trips_inline_all"
    ),
    "hourly_profile_rounded": sql(_profile("trips_hw_raw", "rounded")),
    **{f"profile_{n}": _profile_query(f"trips_{n.lower()}") for n in ANALYSES},
    "compare_profiles": sql(
        "select series, trip_start_hour, trip_count, round(percentage_of_trips, 6) as percentage_of_trips from profiles"
    ),
    "profile_matrix": sql(
        "select series, "
        + ", ".join(
            f"round(max(case when trip_start_hour = {h} then percentage_of_trips end), 6) as h{h}"
            for h in range(24)
        )
        + " from profiles group by 1"
    ),
    "profile_stats": sql(_STATS),
    "hour_spine": sql(
        "select k.series, cast(k.h as int) as trip_start_hour, round(coalesce(s.percentage, 0), 6) as percentage "
        "from (select distinct series, range as h from survey_hours, range(24)) k "
        "left join survey_hours s on s.series = k.series and s.hour = k.h"
    ),
    "interp_hours": sql("select series, hour, round(percentage, 6) as percentage from survey_interp"),
    "series_overlay": sql(
        "select series, 'lbs' as origin, trip_start_hour as hour, round(percentage_of_trips, 6) as percentage "
        "from profiles union all select series, 'survey', hour, round(percentage, 6) from survey_hours"
    ),
    "dtw_pairs": _dtw(),
    "scalar_kit": """
select c_custkey, case when length(c_custkey::varchar) < 3 then lpad(c_custkey::varchar, 3, '0') else c_custkey::varchar end as padded,
  case when c_mktsegment = 'MACHINERY' then null else
    (case when length(c_custkey::varchar) < 3 then lpad(c_custkey::varchar, 3, '0') else c_custkey::varchar end) || c_mktsegment end as joined,
  round_even(c_custkey * 2.5e0 / 5, 0) * 5 as nearest,
  round(case when c_custkey = 0 then null else c_acctbal / c_custkey end, 6) as expansion,
  round(case when c_acctbal > 0 then log10(c_acctbal) end, 6) as log_balance,
  cast(trunc(case when c_acctbal > 0 then c_acctbal else 0 end) as bigint) as filled,
  round(c_acctbal / 7, 2) as two_decimals,
  cast((c_custkey * 4567 // 3600) % 24 as int) as hour_of_day,
  strftime(make_date(1970, 1, 1) + cast(c_custkey * 45678 // 86400 as int), '%Y-%m-%d') as day
from customer""",
}

# Wall clock of a zone without daylight saving: a fixed seven hours behind UTC.
_LOCAL = "(end_timestamp - 25200)"
_LOCAL_NEXT = "(next_start - 25200)"
_LOCAL_TRIPS = f"""
select *, cast(floor((departure - 25200) / 3600) % 24 as int) as trip_start_hour from (
  select * exclude (rn_first, rn_last) from (
    select *, end_timestamp::double as departure,
      row_number() over (partition by month, uid, floor({_LOCAL} / 86400e0) order by end_timestamp, stop_event) as rn_first,
      row_number() over (partition by month, uid, floor({_LOCAL} / 86400e0) order by end_timestamp desc, stop_event desc) as rn_last
    from next_o where {_REAL} and {_WEEKDAY} and {_both_ways("H", "W")}
      and floor({_LOCAL} / 86400e0) = floor({_LOCAL_NEXT} / 86400e0))
  where (location_type = 'H' and rn_first = 1) or (location_type <> 'H' and rn_last = 1))"""
CTES["trips_local"] = _LOCAL_TRIPS
ORACLES["zoned_profile"] = _profile_query("trips_local")

CTES["next_later"] = CTES["next_o"].replace(
    "where location_type <> 'O'",
    "where location_type <> 'O' and month in (select month from (select month, dense_rank() over (order by month) as place "
    "from (select distinct month from stops)) where place in (2, 3))",
)
CTES["trips_later"] = f"""
select *, cast(floor(end_timestamp / 3600e0) % 24 as int) as trip_start_hour
from next_later where {_REAL} and {_WEEKDAY} and {_SAME_DAY}"""
ORACLES["middle_months_profile"] = _profile_query("trips_later")
