import os

import pytest

from tripweave.plans import departure as dep
from tripweave.plans.presets import preset
from tripweave.sources import manifest, origin, read_stops, reuse_or_build, stored
from tripweave.sources.store import current


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def trips(spark, n):
    return spark.sql(f"select id as uid, timestamp'2024-01-01' as rand_start_ts, 8 as trip_start_hour, 1 as month from range({n})")


def test_a_failed_build_leaves_the_table_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    reuse_or_build(spark, path, lambda: trips(spark, 3), made_from="a")
    broken = lambda: trips(spark, 5).selectExpr("uid", "rand_start_ts", "raise_error('lost') as trip_start_hour", "month")
    with pytest.raises(Exception, match="lost"):
        reuse_or_build(spark, path, broken, made_from="b")
    assert current(spark, path).count() == 3 and manifest(spark, path)["origin"] == "a"
    reader = current(spark, path)
    assert reuse_or_build(spark, path, lambda: trips(spark, 4), made_from="b").count() == 4
    assert reader.count() == 3  # the version before stays for those who read it
    for n in (5, 6, 7):
        reuse_or_build(spark, path, lambda: trips(spark, n), recompute=True, made_from="b")  # noqa: B023
    assert len([p for p in os.listdir(path) if p.startswith("v-")]) == 2


def test_no_table_no_read(spark, tmp_path):
    assert manifest(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        current(spark, str(tmp_path / "none"))


def test_rebuilt_when_preset_or_input_changes_only(spark, tmp_path):
    stops, path = str(tmp_path / "stops"), str(tmp_path / "trips")
    rows = "select {n} as uid, id as stop_event, id * 3600 as start_timestamp, id * 3600 + 60 as end_timestamp, " \
        "'c' || id as cluster_label, if(id % 2 = 0, 'H', 'W') as location_type, false as weekend, 1 as month from range(6)"
    spark.sql(rows.format(n=1)).write.parquet(stops)
    versions = []

    def ask(name):
        dep.saved_departure_profile(spark, read_stops(spark, stops), preset(name), path).collect()
        versions.append(manifest(spark, path)["version"])

    for name in ("HW_raw", "HW_raw", "HW_random_uniform", "HW_random_uniform"):
        ask(name)
    spark.sql(rows.format(n=2)).write.mode("append").parquet(stops)
    ask("HW_random_uniform")
    a, b, c = versions[0], versions[2], versions[4]
    assert versions == [a, a, b, b, c] and len({a, b, c}) == 3
    assert current(spark, path).select("uid").distinct().count() == 2


def test_origin_tells_parameters_files_and_plans(spark, tmp_path):
    path = str(tmp_path / "a table of 100 %")
    write = lambda mode, *values: table(spark, *values).selectExpr("v", "'p %' as p").write.mode(mode).partitionBy("p").parquet(path)
    write("error", 1, 2)
    read = lambda: spark.read.parquet(path)
    assert origin(1, read()) == origin(1, read()) != origin(2, read())
    assert origin(1, read(), plans=True) == origin(1, read(), plans=True) != origin(1, read().limit(1), plans=True)
    assert origin(1, read().filter("v > 1"), plans=True) != origin(1, read().filter("v > 2"), plans=True)
    before = origin(1, read())
    write("append", 3)
    assert origin(1, read()) != before


def test_stored_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    table(spark, 1, 2, 3).write.parquet(path)
    source = spark.read.parquet(path)

    def ask(limit):
        def build():
            calls.append(limit)
            return source.filter(f"v <= {limit}")

        return stored(spark, "test", [limit, str(tmp_path)], [source], build).count()

    assert [ask(2), ask(2), ask(1), ask(2)] == [2, 2, 1, 2]
    assert calls == [2, 1]
