"""Point-in-zone assignment as an equi-join on grid cells.

Each zone is cut into the cells of a grid that suits its own size: cells are
powers of two wide, and the power is the zone's level. Cells that still hold
many edges are cut further, so a zone of many vertices has small cells along
its border and large ones inside. A cell keeps the edges that meet it and one
bit for all others; a cell without edges lies wholly inside its zone. So a
point looks up one cell on each level in use and is tested against a few edges,
however many vertices a zone has, and many points are settled by the join alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.geometry import (
    bounds,
    edges_clash,
    edges_meeting_box,
    inside,
    numbered_edges,
    odd_crossings,
    ring_edges,
    rings_closed,
    strictly_inside,
)
from tripweave.operators.sizing import BROADCAST_BYTES
from tripweave.operators.zones import Extent, latest_shapes
from tripweave.sources.scratch import scratch_path

# The finer the grid, the more points fall into cells that lie wholly inside a
# zone and need no look at its edges. A zone has at most (this + 1) ** 2 cells
# before those of many edges are cut further.
CELLS_PER_ZONE_SIDE = 4
#: Cells of more edges are cut further, by a power of two to this power at a time.
CELL_EDGES = 16
CUT = 2
#: Points look cells up by chained joins on up to this many levels, else by one shuffled join.
CHAINED_LEVELS = 12
# Cell numbers stay below 2 ** 41, also for tiny zones far from the origin.
_LARGEST_POWER = 40
# Beyond this power rounding would blur which edges meet a cell.
_FINEST_POWER = 24
_CELL = ("cell_level", "cell_x", "cell_y")
# Boxes are a little wider than half a cell on each side.
_HALF = "0.500001D"
_EDGE_BYTES = 40
_ROW_BYTES = 96
_TASK_VERTICES = 10_000


class ZoneFrame(NamedTuple):
    """The box around all zones, the levels of their grids, and how large they are."""

    extent: Extent
    levels: list[int]
    zones: int = 0
    vertices: int = 0
    most_vertices: int = 0


class ZoneIndex(NamedTuple):
    """Cells of all zones, the levels they are on, and whether they may be broadcast."""

    cells: DataFrame
    levels: list[int]
    small: bool


def _level() -> Column:
    """Power of two that is the cell width of a zone; null for a zone without extent."""
    side = "greatest(maxx - minx, maxy - miny)"
    own, least = f"ceil(log2({side} / {CELLS_PER_ZONE_SIDE}))", f"ceil(log2({_far()})) - {_LARGEST_POWER}"
    return F.expr(f"if({side} > 0 and {_far()} < 1e300D, cast(greatest({own}, {least}) as int), null)")


def _far() -> str:
    return "greatest(abs(minx), abs(maxx), abs(miny), abs(maxy))"


def zone_frame(zones: DataFrame) -> ZoneFrame:
    """One pass over the zones. Levels are few: doubles have some two thousand powers of two."""
    vertices = F.expr("aggregate(rings, 0L, (n, r) -> n + size(r))")
    row = zones.agg(
        *[getattr(F, end[:3])(end).alias(end) for end in Extent._fields],
        F.collect_set(_level()).alias("levels"),
        F.count("*").alias("zones"),
        F.sum(vertices).alias("vertices"),
        F.max(vertices).alias("most"),
    ).first()
    extent = Extent(*[row[end] for end in Extent._fields])
    return ZoneFrame(extent, sorted(row["levels"]), row["zones"], row["vertices"] or 0, row["most"] or 0)


def _cell_index(coordinate: str, size: str) -> str:
    """Null for coordinates that no cell number reaches, infinite and not-a-number ones too."""
    at = f"{coordinate} / {size}"
    return f"if(abs({at}) < 4503599627370496D, cast(floor({at}) as bigint), null)"


def _cells_at(places: str, level: str, edges: str, within: str) -> str:
    """Cells ``width`` wide at ``places``, without those outside of their zone.

    ``within`` says whether the middle ``b.cx, b.cy`` of a cell lies in the
    zone. One expression, so that no optimizer rule copies parts of it.
    """
    boxes = f"transform({places}, p -> named_struct('x', p.x, 'y', p.y, 'cx', (p.x + 0.5D) * width, 'cy', (p.y + 0.5D) * width))"
    near = edges_meeting_box(edges, "b.cx", "b.cy", "half")
    filled = f"transform({boxes}, b -> named_struct('x', b.x, 'y', b.y, 'cx', b.cx, 'cy', b.cy, 'edges', {near}))"
    others = f"{within} <> {odd_crossings('b.edges', 'b.cx', 'b.cy', 'b.cx')}"
    cells = (
        f"transform({filled}, b -> named_struct('cell_level', {level}, 'cell_x', b.x, 'cell_y', b.y, "
        f"'edges', b.edges, 'others', {others}))"
    )
    return f"filter({cells}, c -> size(c.edges) > 0 or c.others)"


def _cuts(most_vertices: int) -> int:
    """Rounds of cutting that zones of so many vertices may need; a round divides a cell's edges by some 4.

    Two more rounds than for a border of even density, for vertices that crowd.
    """
    if most_vertices <= CELL_EDGES:
        return 0
    return 2 + math.ceil(math.log2(most_vertices / CELL_EDGES) / CUT)


def _cut(cells: DataFrame) -> DataFrame:
    """Cells of many edges in smaller ones, others as they are."""
    side = 1 << CUT
    places = (
        f"transform(sequence(0, {side * side - 1}), q -> named_struct("
        f"'x', cell_x * {side} + q % {side}, 'y', cell_y * {side} + q div {side}))"
    )
    within = f"({odd_crossings('edges', 'b.cx', 'b.cy', 'middle')} <> others)"
    parts = _cells_at(places, f"cell_level - {CUT}", "edges", within)
    whole = "array(named_struct('cell_level', cell_level, 'cell_x', cell_x, 'cell_y', cell_y, 'edges', edges, 'others', others))"
    return (
        cells.withColumns(
            {
                "width": F.expr(f"pow(2D, cell_level - {CUT})"),
                "half": F.expr(f"pow(2D, cell_level - {CUT}) * {_HALF}"),
                "middle": F.expr("(cell_x + 0.5D) * pow(2D, cell_level)"),
            }
        )
        .withColumn("cell", F.explode(F.expr(f"if(size(edges) > {CELL_EDGES} and cell_level - {CUT} >= finest, {parts}, {whole})")))
        .select("cell.*", "zone_ord", "geomid", "finest")
    )


def zone_cells(zones: DataFrame, cuts: int | None = None, edges: str = ring_edges("rings")) -> DataFrame:
    """``cell_level, cell_x, cell_y, zone_ord, geomid, solid, edges, others`` per zone and cell.

    ``solid`` cells lie wholly inside the zone and carry no edges. ``others``
    is what edges that do not meet the cell contribute to ``odd_crossings``
    around its middle. Cells of more than ``CELL_EDGES`` edges are cut in
    ``cuts`` rounds, as many as the largest zone may need by default; what is
    below the precision of the coordinates, such as many edges at one vertex,
    stays together.
    """
    if cuts is None:
        cuts = _cuts(zone_frame(zones).most_vertices)
    range_of = lambda low, high: f"sequence({_cell_index(low, 'width')}, {_cell_index(high, 'width')})"
    places = (
        f"flatten(transform({range_of('minx', 'maxx')}, x -> "
        f"transform({range_of('miny', 'maxy')}, y -> named_struct('x', x, 'y', y))))"
    )
    cells = (
        latest_shapes(zones)
        .withColumns({**bounds(), "all_edges": F.expr(edges)})
        .withColumn("level", _level())
        .filter("level is not null")
        .withColumns(
            {
                "finest": F.expr(f"cast(ceil(log2({_far()})) as int) - {_FINEST_POWER}"),
                "width": F.expr("pow(2D, level)"),
                "half": F.expr(f"pow(2D, level) * {_HALF}"),
            }
        )
        .withColumn("cell", F.explode(F.expr(_cells_at(places, "level", "all_edges", inside("all_edges", "b.cx", "b.cy")))))
        .select("cell.*", "zone_ord", "geomid", "finest")
    )
    for _ in range(cuts):
        cells = _cut(cells)
    return cells.select(*_CELL, "zone_ord", "geomid", F.expr("size(edges) = 0").alias("solid"), "edges", "others")


def zone_index(zones: DataFrame, frame: ZoneFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> ZoneIndex:
    """The cells to look points up in. ``frame`` is ``zone_frame(zones)``, where it is known already.

    A ceiling from the frame alone (every cell with every edge) settles small
    tables of simple zones. Otherwise the cells are written once and measured.
    """
    frame = frame or zone_frame(zones)
    cuts = _cuts(frame.most_vertices)
    # zones are small against the work of cutting them, so tasks are dealt out by that
    tasks = 1 + frame.vertices // _TASK_VERTICES
    cells = zone_cells(zones.repartition(tasks, "geomid") if tasks > 1 else zones, cuts)
    ceiling = (CELLS_PER_ZONE_SIDE + 1) ** 2 * (_ROW_BYTES * frame.zones + _EDGE_BYTES * frame.vertices)
    if cuts == 0 and ceiling <= broadcast_bytes:
        return ZoneIndex(cells, frame.levels, len(frame.levels) <= CHAINED_LEVELS)
    path = scratch_path(zones.sparkSession, "zone-cells")
    cells.write.parquet(path)
    written = zones.sparkSession.read.parquet(path)
    row = written.agg(
        F.collect_set("cell_level").alias("levels"),
        F.sum(F.size("edges") * _EDGE_BYTES + _ROW_BYTES).alias("bytes"),
    ).first()
    levels = sorted(row["levels"])
    return ZoneIndex(written, levels, len(levels) <= CHAINED_LEVELS and (row["bytes"] or 0) <= broadcast_bytes)


def zone_validity(zones: DataFrame) -> DataFrame:
    """``geomid, valid``: whether a zone's last shape is made of proper rings.

    Rings must be closed, of at least four vertices and not flat; no two edges
    may cross or run along each other, and edges of one ring may touch as
    neighbours only. Rings may touch each other. Edges meet each other in the
    cells of the zone, a few at a time. Whether holes lie inside of their shell
    is not asked.
    """
    shapes = latest_shapes(zones).withColumns(bounds())
    closed = shapes.select("geomid", F.expr(rings_closed("rings")).alias("closed"))
    cells = zone_cells(zones.filter(rings_closed("rings")), _cuts(zone_frame(zones).most_vertices), numbered_edges("rings"))
    clash = cells.groupBy("geomid").agg(F.max(F.expr(edges_clash("edges"))).alias("clash"))
    return closed.join(clash, "geomid", "left").select(
        "geomid", F.expr("coalesce(closed, false) and not coalesce(clash, false)").alias("valid")
    )


def valid_zones(zones: DataFrame) -> DataFrame:
    """The zones whose shapes are valid; points lie in no other."""
    return zones.join(zone_validity(zones).filter("valid"), "geomid", "left_semi")


def assign_zone(
    points: DataFrame,
    zones: DataFrame,
    lon: str,
    lat: str,
    out: str = "geomid",
    frame: ZoneFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out``: the first zone that strictly contains the point, else null."""
    return assign_zones(points, zones, [(lon, lat, out)], frame, broadcast_bytes)


def assign_zones(
    points: DataFrame,
    zones: DataFrame,
    targets: list[tuple[str, str, str]],
    frame: ZoneFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``assign_zone`` for several ``(lon, lat, out)`` against the same cells."""
    index = zone_index(zones, frame, broadcast_bytes)
    lookup = F.broadcast(_cell_lists(index.cells)) if index.small else None
    for lon, lat, out in targets:
        if index.small:
            points = _assign_by_lookup(points, lookup, lon, lat, out, index.levels)
        else:
            points = _assign_by_shuffle(points, index.cells, lon, lat, out, index.levels)
    return points


def _cell_lists(cells: DataFrame) -> DataFrame:
    """One row per cell; used only for measured sizes.

    ``sure`` is the zone of every point in the cell when its first zone covers
    the cell wholly; otherwise ``unsure`` lists the zones to test, in order.
    """
    zone = F.struct("zone_ord", "geomid", "solid", "edges", "others")
    lists = cells.groupBy(*_CELL).agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    return lists.selectExpr(
        *_CELL,
        "if(zones[0].solid, named_struct('zone_ord', zones[0].zone_ord, 'geomid', zones[0].geomid), null) as sure",
        "if(zones[0].solid, null, zones) as unsure",
    )


def _cell_of(lon: str, lat: str) -> dict[str, Column]:
    size = "pow(2D, cell_level)"
    return {"cell_x": F.expr(_cell_index(lon, size)), "cell_y": F.expr(_cell_index(lat, size))}


_MIDDLE = "((cell_x + 0.5D) * pow(2D, cell_level))"


def _assign_by_lookup(
    points: DataFrame, lookup: DataFrame, lon: str, lat: str, out: str, levels: list[int]
) -> DataFrame:
    """Each point meets at most one lookup row a level, so no shuffle and no regrouping."""
    containing = f"filter(unsure, z -> z.solid or {strictly_inside('z.edges', 'z.others', lon, lat, _MIDDLE)})"
    named = f"transform({containing}, z -> named_struct('zone_ord', z.zone_ord, 'geomid', z.geomid))"
    columns, found = points.columns, []
    for n, level in enumerate(levels):
        found.append(f"found_on_{n}")
        points = (
            points.withColumn("cell_level", F.lit(level))
            .withColumns(_cell_of(lon, lat))
            .join(lookup, list(_CELL), "left")
            .withColumn(found[-1], F.expr(f"coalesce(sure, get({named}, 0))"))
            .drop(*_CELL, "sure", "unsure")
        )
    if not found:
        return points.withColumn(out, F.lit(None).cast("string"))
    first = F.expr(f"array_min(array({', '.join(found)})).geomid")
    return points.select(*columns, first.alias(out))


def _assign_by_shuffle(
    points: DataFrame, cells: DataFrame, lon: str, lat: str, out: str, levels: list[int]
) -> DataFrame:
    """For zone tables of any size: settle distinct coordinates, then join back.

    Copies of one coordinate collapse before they meet the zones, and the two
    shuffled joins can be split by the adaptive skew handling.
    """
    at = points.select(lon, lat).na.drop().distinct()
    every = F.array(*[F.lit(level) for level in levels]).cast("array<int>")
    found = (
        at.withColumn("cell_level", F.explode(every))
        .withColumns(_cell_of(lon, lat))
        .join(cells, list(_CELL))
        .filter(f"solid or {strictly_inside('edges', 'others', lon, lat, _MIDDLE)}")
        .groupBy(lon, lat)
        .agg(F.expr("min(named_struct('zone_ord', zone_ord, 'geomid', geomid)).geomid").alias(out))
    )
    return points.join(found, [lon, lat], "left").select(*points.columns, out)
