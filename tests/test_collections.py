import json
import random

import pytest

from tripweave.sources import read_zones, write_collection
from tripweave.sources.zonefiles import collection_objects


def odd_collection(n, seed=3):
    rng = random.Random(seed)
    names = ['plain', 'brace } in {', 'quote \\" and \\\\', 'list ] [', '"features": [{', "ünïcode 的", "", "a\nb", "back\\"]
    features = []
    for i in range(n):
        ring = [[rng.uniform(0, 9), rng.uniform(0, 9)] for _ in range(rng.randrange(3, 30))]
        kind = rng.choice(["Polygon", "MultiPolygon"])
        rings = [ring + ring[:1]] * rng.randrange(1, 4)
        features.append(
            {
                "type": "Feature",
                "properties": {"geomid": f"{i:05d}", "population": i, "name": rng.choice(names), "more": {"deep": {"er": [{}]}}},
                "geometry": {"type": kind, "coordinates": rings if kind == "Polygon" else [rings, rings[:1]]},
            }
        )
    head = {"type": "FeatureCollection", "name": "x } y", "crs": {"type": "name", "properties": {"name": "urn{"}}}
    more = {"list": [[1, [2]], {"a": [{}]}]}
    return head | {"before": more, "features": features} | {"bbox": [0, 0, 9, 9], "after": {"a": "]}"} | more}


@pytest.mark.parametrize("block", ["128m", "3k", "701b"])
@pytest.mark.parametrize("indent", [None, 1])
def test_a_collection_is_cut_out_of_many_blocks(spark, tmp_path, block, indent):
    collection = odd_collection(80)
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps(collection, indent=indent, ensure_ascii=False))
    settings = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "128m" if block == "128m" else "0"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = collection_objects(spark, str(path))
        got = [json.loads(r["text"]) for r in found.orderBy("pos").collect()]
        tasks = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
        zones = read_zones(spark, str(path)).orderBy("zone_ord").collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert got == collection["features"]
    assert tasks == 1 if block == "128m" else tasks > 20
    assert [z["geomid"] for z in zones] == [f"{i:05d}" for i in range(80)]
    for zone, feature in zip(zones, collection["features"]):
        shapes = feature["geometry"]["coordinates"]
        rings = shapes if feature["geometry"]["type"] == "Polygon" else [r for polygon in shapes for r in polygon]
        assert [[[p["x"], p["y"]] for p in ring] for ring in zone["rings"]] == rings


def test_collection_out_and_in(spark, tmp_path):
    source, copy = tmp_path / "zones.geojson", str(tmp_path / "copy")
    source.write_text(json.dumps(odd_collection(30)))
    zones = read_zones(spark, str(source))
    write_collection(zones, copy)
    assert sorted(map(str, read_zones(spark, copy).collect())) == sorted(map(str, zones.collect()))


def test_collections_without_features(spark, tmp_path):
    for i, text in enumerate(['{"type": "FeatureCollection", "features": []}', "{}"]):
        path = tmp_path / f"{i}.geojson"
        path.write_text(text)
        assert read_zones(spark, str(path)).count() == 0
