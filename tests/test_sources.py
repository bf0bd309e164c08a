from types import SimpleNamespace

import pytest

from tripweave.operators.od import drop_missing_anchor, filter_extent
from tripweave.operators.trips import with_next_stop
from tripweave.operators.zones import Extent
from tripweave.plans import departure as dep
from tripweave.plans.presets import MODULAR, PRESETS, Sampling, preset
from tripweave.sources import (
    read_anchors,
    read_hourly_distribution,
    read_stops,
    read_survey_csv,
    read_trips,
    reuse_or_build,
    scratch_path,
    table_ready,
    write_anchors,
    write_csv,
    write_trips,
)
from tripweave.sources.tables import OD_PAIRS_SCHEMA

TRIPS = "uid bigint, rand_start_ts timestamp, trip_start_hour int, month int"


def trips(spark, *months):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1), 8, m) for i, m in enumerate(months)]
    return spark.createDataFrame(rows, TRIPS)


def test_ids_keep_zeros_and_columns_match_by_name(spark, tmp_path):
    path = tmp_path / "od.csv"
    path.write_text(
        "work_geomid,extra,home_geomid,count_uid,home_population,work_population\n007,x,0,3,10,\n"
    )
    row = read_survey_csv(spark, str(path), OD_PAIRS_SCHEMA).first()
    assert tuple(row) == ("0", "007", 3, 10, None)


@pytest.mark.parametrize("header", ["hour", "start_hour"])
def test_distribution_headers(spark, tmp_path, header):
    path = tmp_path / "h.csv"
    path.write_text(f"{header},percentage\n7.0,60.5\n8,39.5\n")
    rows = {r["hour"]: r["percentage"] for r in read_hourly_distribution(spark, str(path)).collect()}
    assert rows == {7: 60.5, 8: 39.5}


def test_rerun_replaces_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "trips")
    write_trips(trips(spark, 1, 1, 2), path)
    assert table_ready(spark, path)
    write_trips(trips(spark, 2, 2, 2), path)
    months = sorted(r["month"] for r in read_trips(spark, path).collect())
    assert months == [2, 2, 2]


def test_reuse_builds_once_and_recomputes_on_request(spark, tmp_path):
    path = str(tmp_path / "trips")
    calls = []

    def build():
        calls.append(1)
        return trips(spark, 1, 2)

    for recompute in (False, False, True):
        assert reuse_or_build(spark, path, build, recompute).count() == 2
    assert len(calls) == 2


def test_unfinished_table_is_rebuilt(spark, tmp_path):
    path = tmp_path / "trips"
    (path / "month=7").mkdir(parents=True)
    trips(spark, 7).drop("month").write.parquet(str(path / "month=7" / "part"))
    assert not table_ready(spark, str(path))
    assert reuse_or_build(spark, str(path), lambda: trips(spark, 1)).count() == 1


def test_records_per_file_limit(spark, tmp_path):
    path = tmp_path / "trips"
    write_trips(trips(spark, *[3] * 10).coalesce(1), str(path), records_per_file=4)
    assert len(list((path / "month=3").glob("*.parquet"))) >= 3


def test_parquet_inputs_read_only_their_columns(spark, tmp_path):
    spark.sql(
        "select 1 as uid, 2e0 as home_latitude, 3e0 as home_longitude, 4e0 as work_latitude, "
        "5e0 as work_longitude, 'x' as junk"
    ).write.parquet(str(tmp_path / "anchors"))
    assert "junk" not in read_anchors(spark, str(tmp_path / "anchors" / "*.parquet")).columns
    boxed = filter_extent(
        drop_missing_anchor(read_anchors(spark, str(tmp_path / "anchors"))), Extent(0.0, 0.0, 9.0, 9.0)
    )
    scan = boxed._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(home_latitude,0.0)", "LessThanOrEqual(work_longitude,9.0)"):
        assert pushed in scan
    spark.sql(
        "select 1 as uid, 2 as stop_event, 3L as start_timestamp, 4L as end_timestamp, 'a' as cluster_label, "
        "'H' as location_type, false as weekend, 1 as month, 'x' as junk"
    ).write.parquet(str(tmp_path / "stops"))
    stops = read_stops(spark, str(tmp_path / "stops"))
    assert "junk" not in stops.columns and with_next_stop(stops).count() == 1


def scanned(df):
    """Rows that came out of the file scan of a finished query."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves() if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString() else df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_box_reads_few_rows_of_anchors_along_the_curve(spark, tmp_path):
    place = lambda seed, span: f"(abs(hash(id, {seed})) % 1000000) / 1000000e0 * {span} - {span} / 2"
    anchors = spark.range(200_000).selectExpr(
        "id as uid", f"{place(1, 20)} as home_latitude", f"{place(2, 20)} as home_longitude",
        f"{place(1, 20)} + {place(3, 1)} as work_latitude", f"{place(2, 20)} + {place(4, 1)} as work_longitude",
    )
    anchors.write.parquet(str(tmp_path / "any"))
    write_anchors(anchors.unionByName(anchors.limit(1).selectExpr("null as uid", "null as home_latitude", "1e300 as home_longitude", "double('nan') as work_latitude", "0e0 as work_longitude")), str(tmp_path / "curve"), row_group_bytes=64 << 10)
    box = Extent(-1.0, -1.0, 1.0, 1.0)
    boxed = lambda name: filter_extent(read_anchors(spark, str(tmp_path / name)), box)
    want = sorted(map(tuple, boxed("any").collect()))
    assert sorted(map(tuple, boxed("curve").collect())) == want and len(want) > 500
    assert scanned(boxed("any")) > 150_000
    assert scanned(boxed("curve")) < 40_000


def session_stub(master, shared=None):
    settings = {"spark.checkpoint.dir": shared}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key) or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_scratch_prefers_the_shared_folder():
    cluster = session_stub("yarn", "hdfs://shared/tmp/")
    one, two = scratch_path(cluster, "x"), scratch_path(cluster, "x")
    assert one.startswith("hdfs://shared/tmp/tripweave/x-") and one != two
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session_stub("yarn"), "x")


def test_saved_profile_reads_its_table(spark, tmp_path):
    from checks.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "trips")
    first = dep.saved_departure_profile(spark, t.stops, preset("HW_raw"), path).collect()
    again = dep.saved_departure_profile(spark, t.stops.limit(0), preset("HW_raw"), path).collect()
    direct = dep.departure_profile(t.stops, preset("HW_raw")).collect()
    assert first == again == direct


def test_csv_out_and_in(spark, tmp_path):
    path = str(tmp_path / "od")
    rows = spark.sql("select '007' as home_geomid, '0' as work_geomid, 3L as count_uid, 1L as home_population, 0L as work_population")
    write_csv(rows, path)
    assert read_survey_csv(spark, path, OD_PAIRS_SCHEMA).collect() == rows.collect()


def test_presets():
    assert len(PRESETS) == 9 and set(MODULAR) < set(PRESETS)
    with pytest.raises(ValueError, match="unknown preset"):
        preset("nope")
    with pytest.raises(ValueError, match="strategy"):
        Sampling("guess")


def test_informed_preset_needs_hours(spark):
    from checks.views import Tables

    with pytest.raises(ValueError, match="needs a distribution"):
        dep.departure_trips(Tables(spark, "/root/testdata/sf0.001").stops, preset("HW_informed"))
