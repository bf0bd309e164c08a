import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions.geometry import bounds
from tripweave.operators.spatial import CELL_EDGES, assign_zone, valid_zones, zone_cells, zone_frame, zone_index, zone_validity
from tripweave.sources import read_zones, write_zones

ZONE_SCHEMA = "geomid string, zone_ord bigint, rings array<array<struct<x:double,y:double>>>"


def zones(spark, *rows):
    floats = [
        (g, k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for g, k, rings in rows
    ]
    return spark.createDataFrame(floats, ZONE_SCHEMA).withColumns(bounds())


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def locate(spark, zone_table, points, **options):
    df = spark.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(points)], "id int, lon double, lat double"
    )
    rows = assign_zone(df, zone_table, "lon", "lat", **options).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(points)))
    return [r["geomid"] for r in rows]


WAYS = [{}, {"broadcast_bytes": 0}]


@pytest.mark.parametrize("options", WAYS)
def test_boundary_hole_and_null(spark, options):
    ring_with_hole = zones(spark, ("a", 0, [box(0, 0, 4, 4), box(1, 1, 3, 3)]))
    points = [(0.5, 0.5), (0.0, 2.0), (4.0, 4.0), (2.0, 2.0), (1.0, 2.0), (3.5, 3.5), (9.0, 9.0), (None, 1.0)]
    assert locate(spark, ring_with_hole, points, **options) == [
        "a", None, None, None, None, "a", None, None,
    ]


@pytest.mark.parametrize("options", WAYS)
def test_first_zone_wins_and_last_shape_of_an_id_counts(spark, options):
    table = zones(
        spark,
        ("late", 2, [box(0, 0, 2, 2)]),
        ("early", 1, [box(1, 1, 3, 3)]),
        ("twice", 0, [box(0, 0, 2, 2)]),
        ("twice", 3, [box(5, 5, 6, 6)]),
    )
    points = [(0.5, 0.5), (1.5, 1.5), (2.5, 2.5), (5.5, 5.5)]
    assert locate(spark, table, points, **options) == ["late", "early", "early", "twice"]


@pytest.mark.parametrize("options", WAYS)
def test_two_part_zone(spark, options):
    table = zones(spark, ("a", 0, [box(0, 0, 1, 1), box(4, 4, 5, 5)]))
    points = [(0.5, 0.5), (2.0, 2.0), (4.5, 4.5)]
    assert locate(spark, table, points, **options) == ["a", None, "a"]


def contains(rings, x, y):
    """Crossing count over all edges, boundary excluded."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            on_line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
            if on_line and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("options", WAYS)
def test_random_polygons_equal_brute_force(spark, options):
    rng = random.Random(3)
    shapes = []
    for k in range(25):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        corners = [
            (round(cx + rng.uniform(-1.5, 1.5), 2), round(cy + rng.uniform(-1.5, 1.5), 2))
            for _ in range(rng.randint(3, 9))
        ]
        shapes.append((f"z{k:02d}", k, [corners + corners[:1]]))
    points = [(round(rng.uniform(-5, 5), 2), round(rng.uniform(-5, 5), 2)) for _ in range(800)]
    points += [p for _, _, (ring,) in shapes for p in ring[:2]]
    want = [
        next((g for g, _, rings in shapes if contains(rings, x, y)), None) for x, y in points
    ]
    assert len(set(want)) > 15
    assert locate(spark, zones(spark, *shapes), points, **options) == want


def test_inner_cells_carry_no_edges(spark):
    cells = zone_cells(zones(spark, ("a", 0, [box(0.1, 0.1, 15.9, 15.9)])))
    inner, rim = (cells.filter(F.col("solid") == s).collect() for s in (True, False))
    assert len(inner) == 4 and len(rim) == 12
    assert all(len(c["edges"]) == 0 for c in inner)
    assert all(1 <= len(c["edges"]) <= 3 for c in rim)


def many_zones(spark, n, mixed):
    """Tiles of a strip, a tenth of them a hundred times larger where sizes are mixed."""
    side = F.when((F.col("id") % 10 == 0) & F.lit(mixed), 100.0).otherwise(1.0)
    at = [F.floor(F.col("id") / 300) * side, F.col("id") % 300 * side]
    (x0, y0), (x1, y1) = at, [a + side for a in at]
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    table = spark.range(n).select(F.col("id").cast("string").alias("geomid"), F.col("id").alias("zone_ord"), F.array(ring).alias("rings"))
    return table.withColumns(bounds())


@pytest.mark.parametrize("mixed", [False, True])
def test_zones_per_cell_and_cells_per_zone_stay_flat(spark, mixed):
    for n in (1_000, 30_000):
        cells = zone_cells(many_zones(spark, n, mixed))
        assert cells.groupBy("cell_level", "cell_x", "cell_y").count().agg(F.max("count")).first()[0] <= 4
        assert cells.groupBy("geomid").count().agg(F.max("count")).first()[0] <= 25


def coast(vertices, seed=1, cx=0.0, cy=0.0):
    """A jagged closed border around ``cx, cy``."""
    rng = random.Random(seed)
    out, rough = [], [rng.uniform(-1, 1) for _ in range(12)]
    for i in range(vertices):
        a = 2 * math.pi * i / vertices
        r = 3 + sum(w / (k + 1) * math.sin((k + 1) * 2 * a + k) for k, w in enumerate(rough)) / 3 + 4 / vertices * (i % 2)
        out.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return out + out[:1]


@pytest.mark.parametrize("vertices", [100, 10_000, 100_000])
def test_edges_of_a_cell_stay_few_for_any_number_of_vertices(spark, vertices):
    cells = zone_cells(zones(spark, ("a", 0, [coast(vertices)])))
    row = cells.agg(F.max(F.size("edges")).alias("most"), F.count("*").alias("cells"), F.sum(F.size("edges")).alias("all")).first()
    assert row["most"] <= CELL_EDGES
    assert row["cells"] < 25 + 2 * vertices and vertices <= row["all"] < 4 * vertices


@pytest.mark.parametrize("options", WAYS)
def test_jagged_borders_equal_brute_force(spark, options):
    rng = random.Random(4)
    fan = [(5.0, 5.0)] + [p for k in range(60) for p in ((6 + k / 60, 5 + k / 50), (6 + k / 60, 5 + k / 50 + 0.005), (5.0, 5.0))]
    shapes = [
        ("coast", 2, [coast(700), coast(90, 2)[::-1]]),  # a hole or an overlap, whichever even-odd says
        ("grid", 1, [[(x / 8, (x * 7 % 5) / 8) for x in range(40)] + [(5.0, -2.0), (0.0, -2.0), (0.0, 0.0)]]),
        ("fan", 0, [fan]),  # sixty edges at one corner
    ]
    points = [(rng.uniform(-5, 8), rng.uniform(-5, 8)) for _ in range(1500)]
    points += [(rng.randrange(-20, 60) / 8, rng.randrange(-20, 60) / 8) for _ in range(700)]
    points += [p for _, _, rings in shapes for ring in rings for p in ring[::9]]
    points += [((x1 + x2) / 2, (y1 + y2) / 2) for (x1, y1), (x2, y2) in zip(shapes[0][2][0], shapes[0][2][0][1:])][::9]
    first = sorted(shapes, key=lambda s: s[1])
    want = [next((g for g, _, rings in first if contains(rings, x, y)), None) for x, y in points]
    assert len(set(want)) == 4
    assert locate(spark, zones(spark, *shapes), points, **options) == want


def test_cells_of_simple_zones_need_no_job_of_their_own(spark):
    index = zone_index(zones(spark, ("a", 0, [box(0, 0, 1, 1)])))
    assert index.small and "Scan parquet" not in index.cells._jdf.queryExecution().executedPlan().toString()
    large = zone_index(zones(spark, ("a", 0, [coast(500)]), ("b", 1, [box(9, 9, 10, 10)])))
    assert large.small and len(large.levels) > 2
    assert "parquet" in large.cells._jdf.queryExecution().executedPlan().toString()


def test_levels_follow_zone_sizes(spark):
    shapes = [("big", 0, [box(0, 0, 1024, 1024)]), ("flat", 9, [box(0, 5, 1024, 5.0001)]), ("none", 3, [box(1, 1, 1, 1)])]
    shapes += [(f"s{k}", k, [box(k, 0, k + 0.125, 0.125)]) for k in range(1, 8)]
    frame = zone_frame(zones(spark, *shapes))
    assert frame.extent == (0, 0, 1024, 1024)
    assert frame.levels == [-5, 8]
    assert locate(spark, zones(spark, *shapes[3:], *shapes[:1]), [(1.06, 0.06), (1.5, 0.5)]) == ["big", "big"]


@pytest.mark.parametrize("options", WAYS)
def test_many_levels_and_tiny_zones_far_out(spark, options):
    shapes = [(f"z{k}", k, [box(-(2.0**k), -(2.0**k), 2.0**k, 2.0**k)]) for k in range(12)]
    shapes.append(("tiny", 50, [box(1e9, 1e9, 1e9 + 1e-6, 1e9 + 1e-6)]))
    points = [(0.0, 0.5), (1.5, 0.0), (2000.0, 0.0), (3000.0, 0.0), (1e9 + 4e-7, 1e9 + 4e-7)]
    assert locate(spark, zones(spark, *shapes), points, **options) == ["z0", "z1", "z11", None, "tiny"]


def test_no_zones(spark):
    none = zones(spark, ("a", 0, [box(0, 0, 1, 1)])).limit(0)
    for options in WAYS:
        assert locate(spark, none, [(0.5, 0.5)], **options) == [None]


def test_plan_has_no_shuffle_of_points(spark):
    table = zones(spark, ("a", 0, [box(0, 0, 1, 1)]))
    points = spark.range(10).select(F.col("id").cast("double").alias("lon"), F.lit(0.5).alias("lat"))
    plan = assign_zone(points, table, "lon", "lat")._jdf.queryExecution().executedPlan().toString()
    join = plan.split("BroadcastHashJoin", 1)
    assert len(join) == 2
    points_side = join[1].split("BroadcastExchange")[0]
    assert "Exchange" not in points_side


def collection(*features):
    return {"type": "FeatureCollection", "features": list(features)}


def feature(geomid, population, kind, coordinates):
    return {
        "type": "Feature",
        "properties": {"CVE": geomid, "POB": population, "other": 1},
        "geometry": {"type": kind, "coordinates": coordinates},
    }


def test_geojson_collection_and_lines(spark, tmp_path):
    source = tmp_path / "zones.geojson"
    hole = [box(0, 0, 4, 4), box(1, 1, 2, 2)]
    source.write_text(
        json.dumps(
            collection(
                feature("007", 12, "Polygon", hole),
                feature("010", 3.0, "MultiPolygon", [[box(5, 5, 6, 6)], [box(8, 8, 9, 9), box(8.2, 8.2, 8.4, 8.4)]]),
                feature("011", None, "Polygon", [box(0, 5, 1, 6)]),
            ),
            indent=1,
        )
    )
    names = {"CVE": "geomid", "POB": "population"}
    first = read_zones(spark, str(source), names)
    write_zones(first, str(tmp_path / "out"))
    again = read_zones(spark, str(tmp_path / "out"), layout="lines")
    for table in (first, again):
        rows = {r["geomid"]: r for r in table.collect()}
        assert set(rows) == {"007", "010", "011"}
        assert [rows[g]["zone_ord"] for g in ("007", "010", "011")] == [0, 1, 2]
        assert (rows["007"]["population"], rows["010"]["population"]) == (12, 3)
        assert rows["011"]["population"] is None
        assert rows["007"]["parts"] == [0, 0] and rows["010"]["parts"] == [0, 1, 1]
        assert (rows["010"]["minx"], rows["010"]["maxy"]) == (5.0, 9.0)
    assert sorted(map(str, first.collect())) == sorted(
        str(r) for r in again.select(first.columns).collect()
    )
    kinds = [
        json.loads(r["value"])["geometry"]["type"]
        for r in spark.read.text(str(tmp_path / "out")).collect()
    ]
    assert sorted(kinds) == ["MultiPolygon", "Polygon", "Polygon"]



@pytest.mark.parametrize("options", WAYS)
def test_coordinates_out_of_reach_lie_in_no_zone(spark, options):
    points = [(float("inf"), 1.0), (1e300, 1.0), (1.0, float("-inf")), (float("nan"), 1.0), (1.0, 1.0)]
    assert locate(spark, zones(spark, ("a", 0, [box(0, 0, 2, 2)])), points, **options) == [None] * 4 + ["a"]


@pytest.mark.parametrize("options", WAYS)
def test_columns_keep_their_order(spark, options):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double")
    found = assign_zone(df, zones(spark, ("a", 0, [box(0, 0, 2, 2)])), "lon", "lat", **options)
    assert found.columns == ["id", "lon", "lat", "geomid"]


SHAPES = {
    "square": (True, [box(0, 0, 1, 1)]),
    "bow-tie": (False, [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]),
    "open": (False, [box(0, 0, 1, 1)[:-1]]),
    "flat": (False, [[(0, 0), (1, 1), (2, 2), (0, 0)]]),
    "two points": (False, [[(0, 0), (1, 1), (0, 0)]]),
    "hole": (True, [box(0, 0, 9, 9), box(1, 1, 2, 2)]),
    "hole across": (False, [box(0, 0, 9, 9), box(8, 8, 10, 10)]),
    "parts touch in a point": (True, [box(0, 0, 1, 1), box(1, 1, 2, 2)]),
    "parts share a side": (False, [box(0, 0, 1, 1), box(1, 0, 2, 1)]),
    "ring touches itself": (False, [[(0, 0), (2, 0), (2, 2), (1, 0), (0, 2), (0, 0)]]),
    "ring meets a vertex twice": (False, [[(0, 0), (1, 1), (0, 2), (2, 2), (1, 1), (2, 0), (0, 0)]]),
    "spike": (False, [[(0, 0), (2, 0), (2, 2), (2, 3), (2, 2), (0, 2), (0, 0)]]),
    "vertex twice in a row": (True, [[(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 1), (0, 0)]]),
    "infinite": (False, [[(0, 0), (float("inf"), 0), (1, 1), (0, 0)]]),
    "none": (False, []),
    "triangle": (True, [[(0, 0), (1, 0), (0, 1), (0, 0)]]),
}


def test_which_shapes_are_valid(spark):
    shapes = [(name, k, rings) for k, (name, (_, rings)) in enumerate(SHAPES.items())]
    jagged = coast(3000)
    crossed = list(jagged)
    crossed[1200], crossed[1203] = crossed[1203], crossed[1200]
    shapes += [("coast", 90, [jagged]), ("crossed coast", 91, [crossed])]
    shapes += [("mended", 92, SHAPES["bow-tie"][1]), ("mended", 93, SHAPES["square"][1])]
    got = {r["geomid"]: r["valid"] for r in zone_validity(zones(spark, *shapes)).collect()}
    want = {name: valid for name, (valid, _) in SHAPES.items()}
    assert got == want | {"coast": True, "crossed coast": False, "mended": True}


@pytest.mark.parametrize("options", WAYS)
def test_invalid_zones_take_no_point(spark, options):
    table = zones(spark, ("bow", 0, SHAPES["bow-tie"][1]), ("square", 1, [box(0, 0, 4, 4)]))
    assert locate(spark, table, [(0.9, 0.5)], **options) == ["bow"]
    assert locate(spark, valid_zones(table), [(0.9, 0.5)], **options) == ["square"]
