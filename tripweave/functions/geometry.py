"""Polygon expressions over ``rings array<array<struct<x,y>>>``, as SQL text.

Rings are closed (first vertex repeated last). Holes and the parts of a
multipolygon are further rings of the same zone under the even-odd rule.
Edges are ``array<struct<x1,y1,x2,y2>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(rings: str) -> str:
    return f"""
flatten(transform(filter({rings}, r -> size(r) > 1), r ->
  transform(sequence(1, size(r) - 1), i -> named_struct(
    'x1', r[i - 1].x, 'y1', r[i - 1].y, 'x2', r[i].x, 'y2', r[i].y))))"""


def numbered_edges(rings: str) -> str:
    """Edges with the ring ``r`` and place ``k`` of each and the number ``n`` of edges of the ring; repeated vertices count once."""
    single = f"transform({rings}, r -> filter(r, (p, i) -> i = 0 or p <> r[i - 1]))"
    return f"""
flatten(transform({single}, (r, c) -> if(size(r) < 2, array(),
  transform(sequence(1, greatest(size(r) - 1, 1)), i -> named_struct(
    'x1', r[i - 1].x, 'y1', r[i - 1].y, 'x2', r[i].x, 'y2', r[i].y, 'r', c, 'k', i, 'n', size(r) - 1)))))"""


def _side(a: str, x: str, y: str) -> str:
    return f"signum(({a}.x2 - {a}.x1) * ({y} - {a}.y1) - ({a}.y2 - {a}.y1) * ({x} - {a}.x1))"


def edges_clash(edges: str) -> str:
    """Whether two of ``numbered_edges`` cross, run along each other, or touch although they are of one ring and no neighbours."""
    shared = lambda c: f"(least(greatest(e.{c}1, e.{c}2), greatest(f.{c}1, f.{c}2)) - greatest(least(e.{c}1, e.{c}2), least(f.{c}1, f.{c}2)))"
    sides = f"array({_side('e', 'f.x1', 'f.y1')}, {_side('e', 'f.x2', 'f.y2')}, {_side('f', 'e.x1', 'e.y1')}, {_side('f', 'e.x2', 'e.y2')})"
    neighbours = "(e.r = f.r and (f.k = e.k + 1 or (e.k = 1 and f.k = f.n)))"
    return f"""
exists({edges}, e -> exists({edges}, f -> (e.r < f.r or (e.r = f.r and e.k < f.k))
  and {shared('x')} >= 0 and {shared('y')} >= 0
  and exists(array({sides}), s -> case
    when s[0] = 0 and s[1] = 0 and s[2] = 0 and s[3] = 0
      then {shared('x')} > 0 or {shared('y')} > 0 or (e.r = f.r and not {neighbours})
    when s[0] * s[1] < 0 and s[2] * s[3] < 0 then true
    else s[0] * s[1] <= 0 and s[2] * s[3] <= 0 and e.r = f.r and not {neighbours} end)))"""


def rings_closed(rings: str) -> str:
    """Whether all rings are closed, of at least four finite vertices and not flat."""
    twice_area = """
abs(aggregate(sequence(1, size(r) - 1), 0D, (a, i) -> a + (r[i - 1].x - r[0].x) * (r[i].y - r[0].y) - (r[i].x - r[0].x) * (r[i - 1].y - r[0].y)))"""
    return f"""
(size({rings}) > 0 and forall({rings}, r -> if(size(r) < 4, false, r[0] = r[size(r) - 1]
  and forall(r, p -> coalesce(abs(p.x) < 1e300D and abs(p.y) < 1e300D, false)) and {twice_area} > 0)))"""


def bounds(rings: str = "rings") -> dict[str, Column]:
    """Bounding box columns ``minx, miny, maxx, maxy``."""
    return {
        f"{end}{axis}": F.expr(
            f"array_{end}(transform({rings}, r -> array_{end}(transform(r, p -> p.{axis}))))"
        )
        for axis in "xy"
        for end in ("min", "max")
    }


def inside(edges: str, x: str, y: str) -> str:
    """Even-odd containment; points on an edge may fall either way."""
    return f"""
(size(filter({edges}, e -> if((e.y1 > {y}) <> (e.y2 > {y}),
   {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1, false))) % 2 = 1)"""


def on_edge(edges: str, x: str, y: str) -> str:
    return f"""
exists({edges}, e ->
  {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2)
  and {y} between least(e.y1, e.y2) and greatest(e.y1, e.y2)
  and (e.x2 - e.x1) * ({y} - e.y1) = (e.y2 - e.y1) * ({x} - e.x1))"""


def strictly_inside(edges: str, others: str, x: str, y: str, middle: str) -> str:
    """Containment that excludes the boundary, from a box's edges and the bit of all ``others``."""
    return f"({odd_crossings(edges, x, y, middle)} <> {others} and not {on_edge(edges, x, y)})"


def edges_meeting_box(edges: str, cx: str, cy: str, half: str) -> str:
    """Edges that meet the box around ``cx, cy`` of half the width ``half``, as far as rounding can tell."""
    return f"""
filter({edges}, e -> greatest(e.x1, e.x2) >= {cx} - {half} and least(e.x1, e.x2) <= {cx} + {half}
  and greatest(e.y1, e.y2) >= {cy} - {half} and least(e.y1, e.y2) <= {cy} + {half}
  and abs((e.x2 - e.x1) * ({cy} - e.y1) - (e.y2 - e.y1) * ({cx} - e.x1))
    <= (abs(e.x2 - e.x1) + abs(e.y2 - e.y1)) * {half})"""


def odd_crossings(edges: str, x: str, y: str, middle: str) -> str:
    """Parity of what ``edges`` contribute to the containment of a point.

    An edge contributes its crossing of the ray to the right and, of each of
    its ends, whether it lies right of ``middle`` and not above the point. Each
    end counts twice around a ring, so over all edges the parity is that of the
    crossings. An edge contributes the same to all points of a box that it does
    not meet, if ``middle`` runs through the box: a box needs its own edges and
    one bit for all others. This holds for rounded numbers too.
    """
    return f"""
(size(filter({edges}, e ->
  if((e.y1 > {y}) <> (e.y2 > {y}), {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1, false)
  <> ((e.x1 > {middle} and e.y1 <= {y}) <> (e.x2 > {middle} and e.y2 <= {y})))) % 2 = 1)"""
