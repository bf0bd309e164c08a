import pytest
from pyspark.sql import functions as F

from tripweave.operators import compare, od
from tripweave.operators.zones import Extent, attach_population, survey_zone_population

OD_SCHEMA = (
    "home_geomid string, work_geomid string, count_uid bigint, "
    "home_population bigint, work_population bigint"
)


def pairs(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], OD_SCHEMA)


def counted(spark, *rows):
    return spark.createDataFrame(list(rows), "home_geomid string, work_geomid string, counts double")


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "geomid string, population bigint")


def as_dict(df, value="counts"):
    return {(r["home_geomid"], r["work_geomid"]): r[value] for r in df.collect()}


def test_extent_includes_its_edges(spark):
    names = "home_longitude double, home_latitude double, work_longitude double, work_latitude double"
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 1.1, 0.5), (None, 0.5, 0.5, 0.5)], names
    )
    assert od.filter_extent(df, Extent(0, 0, 1, 1)).count() == 1


def test_one_row_per_user_is_a_whole_row(spark):
    names = "uid int, home_longitude double, home_latitude double, work_longitude double, work_latitude double"
    df = spark.createDataFrame(
        [(1, 2.0, 0.0, 0.0, 0.0), (1, 1.0, 9.0, 9.0, 9.0), (2, 3.0, 3.0, 3.0, 3.0)], names
    )
    assert sorted(map(tuple, od.dedupe_users(df).collect())) == [
        (1, 1.0, 9.0, 9.0, 9.0),
        (2, 3.0, 3.0, 3.0, 3.0),
    ]


def test_users_outside_all_zones_become_zone_0(spark):
    located = spark.createDataFrame(
        [(1, "a", None), (2, None, None), (3, "a", None), (None, "a", "b")],
        "uid int, home_geomid string, work_geomid string",
    )
    got = od.attach_zone_population(od.count_od_users(located), people(spark, ("a", 7)))
    assert sorted(map(tuple, got.collect())) == [
        ("0", "0", 1, 0, 0),
        ("a", "0", 2, 7, 0),
        ("a", "b", 0, 7, 0),
    ]


def test_expansion_without_users_is_null(spark):
    rows = od.expansion_factors(people(spark, ("a", 10), ("b", 5)), pairs(spark, ("a", "b", 4))).collect()
    got = {r["geomid"]: (r["count_uid"], r["expansion"], r["scaled_users"]) for r in rows}
    assert got == {"a": (4, 2.5, 10.0), "b": (None, None, None)}


def test_expanded_od_of_unknown_population_is_zero(spark):
    table = pairs(spark, ("a", "b", 4), ("x", "a", 3), ("0", "a", 9), ("a", "0", 9), (None, "a", 1))
    factors = od.expansion_factors(people(spark, ("a", 26)), table)
    assert as_dict(od.expanded_od(table, factors)) == {("a", "b"): 8.0, ("x", "a"): 0.0}
    kept = as_dict(od.expanded_od(table, factors, exclude_unknown=False))
    assert set(kept) == {("a", "b"), ("x", "a"), ("0", "a"), ("a", "0")}


def test_both_ends_expansion(spark):
    table = pairs(spark, ("a", "b", 4))
    factors = od.expansion_factors(people(spark, ("a", 8), ("b", 5)), table)
    row = od.attach_expansion(table, factors, ("home", "work")).first()
    assert (row["home_expansion"], row["work_expansion"]) == (2.0, None)


def test_histogram_rounds_half_to_even_and_skips_null(spark):
    factors = spark.createDataFrame([(2.5,), (7.5,), (12.6,), (None,)], "expansion double")
    got = {r["expansion_rounded"]: r["probability"] for r in od.expansion_histogram(factors).collect()}
    assert got == pytest.approx({0.0: 1 / 3, 10.0: 1 / 3, 15.0: 1 / 3})


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "geomid string")


def test_matrix_there_and_back(spark):
    table = counted(spark, ("a", "b", 2.0), ("a", "a", 4.0), ("b", "b", 1.0))
    rows = od.pivot_od(table)
    assert {r["home_geomid"]: r["cells"] for r in rows.collect()} == {"a": {"a": 4.0, "b": 2.0}, "b": {"b": 1.0}}
    assert as_dict(od.unpivot_od(rows)) == as_dict(table)


def test_a_cell_given_twice_is_an_error(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        od.pivot_od(counted(spark, ("a", "b", 2.0), ("a", "b", 1.0))).collect()


def test_aligned_matrix_is_sparse(spark):
    table = counted(spark, ("a", "b", 2.0), ("b", "b", 1.0), ("z", "a", 5.0), ("a", "0", 7.0))
    universe = ids(spark, "0", "a", "b", "c")
    assert as_dict(od.align_matrix(table, universe)) == {("a", "b"): 2.0, ("b", "b"): 1.0}
    assert len(as_dict(od.align_matrix(table, universe, unknown=True))) == 3
    assert tuple(od.matrix_totals(table, universe).first()) == (3, 2, 3.0)
    assert tuple(od.matrix_totals(table.limit(0), universe).first()) == (3, 0, 0.0)


def test_zone_universe_keeps_unknown(spark):
    universe = od.zone_universe(counted(spark, ("a", "0", 1.0), ("c", None, 1.0), ("a", "b", 1.0)))
    assert sorted(r["geomid"] for r in universe.collect()) == ["0", "a", "b", "c"]


def test_zone_population_pads_ids(spark):
    homes = spark.createDataFrame(
        [("7", 2, 10.0), ("007", 1, 5.0), ("1234", 1, 1.0)], "distrito string, p1_1 int, factor double"
    )
    got = survey_zone_population(homes)
    assert {r["geomid"]: r["population"] for r in got.collect()} == {"007": 25.0, "1234": 1.0}
    zones = people(spark, ("007", 0), ("008", 99))
    filled = attach_population(zones, got).collect()
    assert {r["geomid"]: r["population"] for r in filled} == {"007": 25, "008": 0}


def test_correlation_guards(spark):
    def r(lbs, eod):
        rows = [("a", str(i), x) for i, x in enumerate(lbs)]
        other = [("a", str(i), x) for i, x in enumerate(eod)]
        both = compare.join_od_sources(counted(spark, *rows), counted(spark, *other))
        return {x["kind"]: (x["n_pairs"], x["r"]) for x in compare.log_correlation(both).collect()}

    assert r([1.0, 10.0, 100.0], [2.0, 20.0, 200.0])["overall"] == (3, pytest.approx(1.0))
    assert r([1.0, 10.0], [5.0, 5.0])["overall"] == (2, None)
    assert r([1.0], [5.0])["overall"] == (1, None)
    assert r([0.0, 10.0, 100.0], [1.0, 1.0, 2.0])["overall"] == (2, pytest.approx(1.0))
    assert r([1.0, 10.0], [5.0, 6.0])["intra"] == (0, None)


def test_value_range_and_tables(spark):
    both = compare.join_od_sources(
        counted(spark, ("a", "a", 3.0), ("a", "b", 9.0)), counted(spark, ("a", "a", 20.0), ("a", "b", 2.0))
    )
    assert tuple(compare.value_range(both).first()) == (1.0, 20.0)
    kinds = {r["work_geomid"]: r["kind"] for r in both.collect()}
    assert kinds == {"a": "intra", "b": "inter"}
    factors = od.expansion_factors(people(spark, ("a", 10)), pairs(spark, ("a", "b", 4)))
    assert compare.scaling_table(factors).columns == ["geomid", "population", "count_uid", "scaled_users"]
    assert od.zone_outlier_filter(factors, F.col("expansion") < 2).count() == 0
