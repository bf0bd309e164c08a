"""Columnar and CSV tables in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.sources.store import current, manifest, replace

ANCHOR_COORDINATES = ("home_latitude", "home_longitude", "work_latitude", "work_longitude")

STOP_COLUMNS = (
    "uid",
    "stop_event",
    "start_timestamp",
    "end_timestamp",
    "cluster_label",
    "location_type",
    "weekend",
    "month",
)

OD_PAIRS_SCHEMA = (
    "home_geomid string, work_geomid string, count_uid bigint, "
    "home_population bigint, work_population bigint"
)
SURVEY_OD_SCHEMA = "home_geomid string, work_geomid string, counts double"
HOUSEHOLD_SCHEMA = "distrito string, ent string, mun string, p1_1 int, factor double"
SURVEY_TRIP_SCHEMA = (
    "id_soc bigint, dto_origen string, dto_dest string, p5_3 int, p5_13 int, "
    "p5_6 int, p5_11a int, p5_9_1 int, factor double"
)

TRIP_COLUMNS = ("uid", "rand_start_ts", "trip_start_hour", "month")

RECORDS_PER_FILE = 5_000_000
ROW_GROUP_BYTES = 16 << 20


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Home and work coordinates per user; ``path`` may be a glob."""
    return spark.read.parquet(path).select(
        "uid", *[F.col(c).cast("double").alias(c) for c in ANCHOR_COORDINATES]
    )


def curve_place(columns: tuple[str, ...] = ANCHOR_COORDINATES, bits: int = 15) -> Column:
    """Place on a curve that fills the space of the coordinates, so that what is near in all is near on it.

    Bits of the coordinates, in equal steps over all latitudes and longitudes,
    take turns. A null or odd coordinate counts as the least.
    """
    steps = []
    for c in columns:
        half = 90 if "latitude" in c else 180
        step = F.floor((F.col(c) + half) / (2 * half) * (1 << bits)).cast("long")
        steps.append(F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0)))
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for i, step in enumerate(steps):
            taken = F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(taken, bit * len(steps) + i))
    return place


def write_anchors(
    anchors: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Anchors along a space-filling curve, so that a filter by a box reads few row groups.

    Ranges of the curve are balanced by a sample of the rows; users of one
    place are cut by their id. Row groups are kept small, as their least and
    largest coordinates are what a reader can skip by.
    """
    (
        anchors.select("uid", *ANCHOR_COORDINATES)
        .withColumn("_place", curve_place())
        .repartitionByRange("_place", "uid")
        .sortWithinPartitions("_place", "uid")
        .drop("_place")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", records_per_file)
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*STOP_COLUMNS)


def read_survey_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema, so ids keep leading zeros.

    Columns are matched by name: the file may hold more of them than the
    schema, in any order.
    """
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trips(trips: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Trip table partitioned by month; a rerun replaces the whole table.

    Months that the new trips lack are gone afterwards, so two analyses never
    mix. Rows are rebalanced by month, so small months share few files and a
    month that holds most rows is split over many tasks.
    """
    (
        trips.select(*TRIP_COLUMNS)
        .hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", records_per_file)
        .partitionBy("month")
        .parquet(path)
    )


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_ready(spark: SparkSession, path: str) -> bool:
    """A finished write left its success marker; a broken one did not."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def reuse_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    recompute: bool = False,
    made_from: str | None = None,
) -> DataFrame:
    """The trip table at ``path``, written first when missing, on request, or made from something else.

    ``made_from`` is the ``origin`` of what ``build`` gives; without it any
    finished table is reused. A rebuild shows only when it is whole.
    """
    known = manifest(spark, path)
    if recompute or known is None or made_from not in (None, known["origin"]):
        replace(spark, path, build().select(*TRIP_COLUMNS), made_from or "", write_trips)
    return current(spark, path)
