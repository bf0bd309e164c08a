"""Mobility tables derived from the given test tables.

One SQL text per table serves Spark and DuckDB; only ``ev`` (events with an
epoch second) differs between the engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.geometry import bounds

# Percentage of home-work departures per hour 0..23.
HOME_WORK_HOURS = {
    0: 0.04, 1: 0.04, 2: 0.08, 3: 0.25, 4: 1.3, 5: 4.7,
    6: 8.8, 7: 11.3, 8: 9.8, 9: 5.2, 10: 3.2, 11: 1.9,
    12: 2.2, 13: 2.9, 14: 4.7, 15: 4.8, 16: 5.0, 17: 5.9,
    18: 10.4, 19: 6.4, 20: 5.0, 21: 3.3, 22: 2.3, 23: 0.9,
}

EV_SPARK = (
    "select *, timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as e from events"
)
EV_DUCKDB = "select *, cast(floor(epoch(ts)) as bigint) as e from events"

TABLES = {
    "stops": """
select user_id as uid, event_id as stop_event, e as start_timestamp,
  e + cast(floor(value * 10) as bigint) as end_timestamp,
  case when event_type in ('click','view') then 'H'
       when event_type in ('purchase','signup') then 'W' else 'O' end as location_type,
  concat(event_type, '-', cast(event_id % 3 as string)) as cluster_label,
  (cast(floor(e / 86400e0) as bigint) + 4) % 7 in (0, 6) as weekend,
  cast(1 + floor((floor(e / 86400e0) - 19723) / 10) as int) as month
from ev""",
    "zones": """
select lpad(cast(n_nationkey as string), 3, '0') as geomid, n_nationkey as zone_ord,
  cast(n_nationkey % 5 as double) as x0, cast(floor(n_nationkey / 5e0) as double) as y0,
  cast(1000 + 137 * n_nationkey as bigint) as population
from nation""",
    "fine_zones": """
select lpad(cast(c_custkey as string), 8, '0') as geomid, c_custkey as zone_ord,
  (c_custkey % 50) * 0.11e0 + 0.0003e0 as cx, floor(c_custkey / 50e0) * 0.11e0 + 0.0001e0 as cy,
  0.06e0 + (c_custkey % 7) * 0.01e0 as radius,
  cast(1000 + 137 * (c_custkey % 25) as bigint) as population
from customer""",
    "anchors": """
select c_custkey as uid,
  ((c_custkey * 7919) % 5500) / 1000e0 - 0.25e0 as home_longitude,
  ((c_custkey * 104729) % 5500) / 1000e0 - 0.25e0 as home_latitude,
  ((c_custkey * 1299709) % 5500) / 1000e0 - 0.25e0 as work_longitude,
  case when c_custkey % 97 = 5 then null
       else ((c_custkey * 15485863) % 5500) / 1000e0 - 0.25e0 end as work_latitude
from customer
union all
select c_custkey, 2.5e0, 0.5e0, 3.5e0, 0.5e0 from customer where c_custkey % 50 = 0""",
    "survey_households": """
select lpad(cast(c_nationkey as string), 3, '0') as distrito, '09' as ent,
  lpad(cast(c_nationkey as string), 3, '0') as mun,
  cast(1 + c_custkey % 6 as int) as p1_1, 10 + c_custkey % 90 as factor
from customer""",
    "known_households": """
select * from survey_households where distrito < '023'""",
    "survey_trips": """
select l_orderkey as id_soc, lpad(cast(l_suppkey % 25 as string), 3, '0') as dto_origen,
  lpad(cast(l_partkey % 25 as string), 3, '0') as dto_dest,
  cast(case when l_orderkey % 4 = 0 then 2 else 1 end as int) as p5_3,
  cast(1 + l_partkey % 3 as int) as p5_13, cast(1 + l_suppkey % 3 as int) as p5_6,
  cast(1 + l_linenumber % 3 as int) as p5_11a,
  cast(case when l_partkey % 50 = 0 then 99 else l_partkey % 24 end as int) as p5_9_1,
  l_quantity as factor
from lineitem""",
    "desire_lines": """
select lpad(cast(o_custkey % 25 as string), 3, '0') as zona_de_or,
  lpad(cast(o_orderkey % 25 as string), 3, '0') as zona_de_de,
  o_totalprice / 1000 as total_de_v, o_orderpriority as tipo_de_vi
from orders""",
}

_SOURCE = {
    "stops": "events",
    "zones": "nation",
    "fine_zones": "customer",
    "anchors": "customer",
    "survey_households": "customer",
    "survey_trips": "lineitem",
    "desire_lines": "orders",
}

# Square k spans (x0, y0) to (x0 + 1, y0 + 1).
_SQUARE = """
array(array(
  named_struct('x', x0, 'y', y0), named_struct('x', x0 + 1, 'y', y0),
  named_struct('x', x0 + 1, 'y', y0 + 1), named_struct('x', x0, 'y', y0 + 1),
  named_struct('x', x0, 'y', y0)))"""

# Overlapping diamonds, one per customer: |x - cx| + |y - cy| < radius.
_DIAMOND = """
array(array(
  named_struct('x', cx - radius, 'y', cy), named_struct('x', cx, 'y', cy - radius),
  named_struct('x', cx + radius, 'y', cy), named_struct('x', cx, 'y', cy + radius),
  named_struct('x', cx - radius, 'y', cy)))"""


# The diamond around another centre or of another size, as one ring.
def _diamond(cx: str, radius: str) -> str:
    return _DIAMOND.strip().removeprefix("array(").removesuffix(")").replace("radius", radius).replace("'x', cx", f"'x', {cx}")


# Of three zones the second has a hole, the third a part to the right.
_SHAPES = f"""
case zone_ord % 3
  when 0 then array({_diamond("cx", "radius")})
  when 1 then array({_diamond("cx", "radius")}, {_diamond("cx", "(radius / 2)")})
  else array({_diamond("cx", "radius")}, {_diamond("cx + 1", "radius")}) end"""

# Of four zones one is a bow-tie, one is open and one has a ring across its border.
_FLAWED = f"""
case zone_ord % 4
  when 0 then array(array(
    named_struct('x', cx - radius, 'y', cy), named_struct('x', cx, 'y', cy - radius),
    named_struct('x', cx, 'y', cy + radius), named_struct('x', cx + radius, 'y', cy),
    named_struct('x', cx - radius, 'y', cy)))
  when 1 then array(slice({_diamond("cx", "radius")}, 1, 4))
  when 2 then array({_diamond("cx", "radius")}, {_diamond("cx + radius", "radius")})
  else array({_diamond("cx", "radius")}, {_diamond("cx", "(radius / 2)")}) end"""


@dataclass(frozen=True)
class Tables:
    """The derived tables of one scale, as Spark DataFrames."""

    spark: SparkSession
    sf_dir: str

    def _derive(self, name: str) -> DataFrame:
        source = _SOURCE[name]
        df = self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet")
        df.createOrReplaceTempView(source)
        text = TABLES[name]
        if source == "events":
            text = text.replace("from ev", f"from ({EV_SPARK})")
        return self.spark.sql(text)

    @property
    def stops(self) -> DataFrame:
        return self._derive("stops")

    @property
    def zones(self) -> DataFrame:
        return self._derive("zones").select(
            "geomid",
            "population",
            F.col("zone_ord").cast("bigint").alias("zone_ord"),
            F.expr(_SQUARE).alias("rings"),
        ).withColumns(bounds())

    @property
    def fine_zones(self) -> DataFrame:
        """Many overlapping zones; their number grows with the customers."""
        return self._derive("fine_zones").select(
            "geomid", "population", "zone_ord", F.expr(_DIAMOND).alias("rings")
        ).withColumns(bounds())

    @property
    def shaped_zones(self) -> DataFrame:
        """``fine_zones``, some with holes or of two polygons."""
        return self._derive("fine_zones").select(
            "geomid", "population", "zone_ord", F.expr(_SHAPES).alias("rings"),
            F.expr("case zone_ord % 3 when 0 then array(0) when 1 then array(0, 0) else array(0, 1) end").alias("parts"),
        ).withColumns(bounds())

    @property
    def flawed_zones(self) -> DataFrame:
        """``fine_zones``, three of four with invalid shapes."""
        return self._derive("fine_zones").select(
            "geomid", "population", "zone_ord", F.expr(_FLAWED).alias("rings")
        ).withColumns(bounds())

    @property
    def anchors(self) -> DataFrame:
        return self._derive("anchors")

    @property
    def households(self) -> DataFrame:
        return self._derive("survey_households")

    @property
    def known_households(self) -> DataFrame:
        """Households of the zones that the survey knows."""
        return self.households.filter("distrito < '023'")

    @property
    def survey(self) -> DataFrame:
        return self._derive("survey_trips")

    @property
    def desire_lines(self) -> DataFrame:
        return self._derive("desire_lines")
