"""Zone polygons as GeoJSON.

``collection`` is one FeatureCollection document, ``lines`` one Feature per
line. Both are read in as many tasks as a file has blocks; lines are the layout
that is written in many tasks too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.functions.geometry import bounds

# Fixed values of the GeoJSON format.
POLYGON = "Polygon"
MULTIPOLYGON = "MultiPolygon"

_RING = "array<array<double>>"
_ORDER = "zone_ord"


_BLOCK = ("file", "block")
# Depth counts an object once and an array so often, so it tells both apart.
_ARRAY = 1 << 20
_LIST = 1 + _ARRAY  # depth within an array of the outermost object
_OPEN, _CLOSE = r"\\[", r"\\]"


def _outside(start: int) -> str:
    """What of a piece stands outside of strings, if it starts outside (0) or inside (1) of one."""
    return f"array_join(filter(parts, (_, i) -> i % 2 = {start}), '')"


def _count(text: str, chars: str) -> str:
    return f"char_length(regexp_replace({text}, '[^{chars}]+', ''))"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with what it changes and what is known from its block alone.

    The reader splits a file at closing braces and so into blocks, however few
    lines it has. ``deeper_0`` and ``deeper_1`` are how much deeper the text is
    nested after a piece and its brace, if its block starts outside or inside of
    a string; ``before_0`` and ``before_1`` are those sums over the pieces
    before it in the block.
    """
    pieces = (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
        .withColumn("parts", F.split(F.regexp_replace("value", r"\\.", ""), '"'))
    )
    in_order = Window.partitionBy(*_BLOCK).orderBy("id")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    deeper = [
        f"{_count(_outside(s), '{')} - if((size(parts) - 1 + {s}) % 2 = 0, 1, 0) "
        f"+ {_ARRAY} * ({_count(_outside(s), _OPEN)} - {_count(_outside(s), _CLOSE)})"
        for s in (0, 1)
    ]
    own = pieces.selectExpr("*", "size(parts) - 1 as quotes", f"{deeper[0]} as outside", f"{deeper[1]} as inside").drop("parts")
    odd = own.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    known = odd.selectExpr("*", "if(odd = 0, outside, inside) as deeper_0", "if(odd = 0, inside, outside) as deeper_1")
    return known.withColumns({f"before_{s}": F.coalesce(F.sum(f"deeper_{s}").over(earlier), F.lit(0)) for s in (0, 1)})


def _block_starts(pieces: DataFrame) -> DataFrame:
    """``file, block, in_string, depth`` at the start of each block; one row a block."""
    blocks = pieces.groupBy(*_BLOCK).agg(
        (F.sum("quotes") % 2).alias("odd"), F.sum("deeper_0").alias("deeper_0"), F.sum("deeper_1").alias("deeper_1")
    )
    one = F.struct("block", "odd", "deeper_0", "deeper_1")
    folded = F.expr(
        "aggregate(all_blocks, struct(0L as in_string, 0L as depth, cast(array() as array<struct<block: bigint, in_string: bigint, depth: bigint>>) as starts), "
        "(a, b) -> struct((a.in_string + b.odd) % 2 as in_string, a.depth + if(a.in_string = 0, b.deeper_0, b.deeper_1) as depth, "
        "array_append(a.starts, struct(b.block as block, a.in_string as in_string, a.depth as depth)) as starts), a -> a.starts)"
    )
    files = blocks.groupBy("file").agg(F.sort_array(F.collect_list(one)).alias("all_blocks"))
    return files.select("file", F.explode(folded).alias("start")).select("file", "start.*")


def collection_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, text`` of the objects in the ``features`` of a JSON document.

    What is inside of a string and how deep the text is nested follow from the
    text before, so they are summed within the blocks of the file first, then
    over the few rows of the blocks, and then tell where every object begins.
    """
    pieces = _pieces(spark, path)
    starts = F.broadcast(_block_starts(pieces))  # a row for each block of the files
    depth = "depth + if(in_string = 0, before_0, before_1)"
    after = f"{depth} + if(in_string = 0, deeper_0, deeper_1)"
    closed = "(in_string + odd + quotes) % 2 = 0"
    earlier = Window.partitionBy(*_BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    nested = (
        pieces.join(starts, list(_BLOCK))
        .selectExpr(*_BLOCK, "id", "value", f"{depth} as from_depth", f"{after} as to_depth", f"int({closed} and {after} = {_LIST}) as ends")
        .withColumn("ended", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    )
    per_block = nested.groupBy(*_BLOCK).agg(F.sum("ends").alias("ends"))
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(per_block.select(*_BLOCK, F.coalesce(F.sum("ends").over(so_far), F.lit(0)).alias("offset")))
    head = r'(?s)^.*?"features"\s*:\s*\[\s*(?=\{)'
    begun = F.when(
        (F.col("from_depth") < _LIST) & F.col("value").rlike(head), F.regexp_replace("value", head, "")
    ).when(F.col("from_depth") == _LIST, F.regexp_replace("value", r"(?s)^[^{]*", ""))
    piece = F.struct("block", "id", begun.isNotNull().alias("begins"), F.coalesce(begun, "value").alias("value"))
    # what stands before an object begins belongs to none
    own = "slice(pieces, array_max(transform(pieces, (p, i) -> if(p.begins, i + 1, 0))), size(pieces))"
    return (
        nested.join(offsets, list(_BLOCK))
        .filter(f"to_depth > {_LIST} or ends = 1")
        .groupBy("file", (F.col("offset") + F.col("ended")).alias("pos"))
        .agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("ends").alias("ends"))
        .filter("ends = 1 and exists(pieces, p -> p.begins)")
        .select("file", "pos", F.concat(F.array_join(F.expr(f"{own}.value"), "}"), F.lit("}")).alias("text"))
    )


def read_zones(
    spark: SparkSession,
    path: str,
    columns: dict[str, str] | None = None,
    layout: str = "collection",
) -> DataFrame:
    """``geomid, population, zone_ord, rings, parts, minx, miny, maxx, maxy``.

    ``columns`` maps property names to ``geomid`` and ``population`` (and any
    further column to keep). ``parts`` names the polygon each ring belongs to.
    Order is the place in a collection; lines carry it in ``zone_ord``.
    """
    names = columns or {"geomid": "geomid", "population": "population"}
    wanted = [*names, _ORDER] if _ORDER not in names else list(names)
    properties = ", ".join(f"`{n}`: string" for n in wanted)
    feature = (
        f"struct<type: string, properties: struct<{properties}>, "
        "geometry: struct<type: string, coordinates: string>>"
    )
    if layout == "collection":
        found = collection_objects(spark, path).select("pos", F.from_json("text", feature).alias("feature"))
        features = found.filter("feature.type = 'Feature'")
    elif layout == "lines":
        features = spark.read.text(path).select(
            F.lit(0).alias("pos"), F.from_json("value", feature).alias("feature")
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")

    text = F.col("feature.geometry.coordinates")
    kind = F.col("feature.geometry.type")
    polygons = (
        F.when(kind == POLYGON, F.array(F.from_json(text, f"array<{_RING}>")))
        .when(kind == MULTIPOLYGON, F.from_json(text, f"array<array<{_RING}>>"))
        .alias("polygons")
    )
    kept = [F.col(f"feature.properties.`{src}`").alias(dst) for src, dst in names.items()]
    order = F.coalesce(F.col(f"feature.properties.{_ORDER}").cast("bigint"), F.col("pos"))
    rows = features.select(*kept, order.alias(_ORDER), polygons)
    rings = F.transform(
        F.flatten("polygons"),
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )
    parts = F.flatten(
        F.transform("polygons", lambda polygon, i: F.array_repeat(i, F.size(polygon)))
    )
    zones = rows.withColumn("rings", rings).withColumn("parts", parts).drop("polygons")
    if "population" in names.values():
        zones = zones.withColumn("population", F.col("population").cast("double").cast("bigint"))
    return zones.withColumns(bounds())


def write_zones(zones: DataFrame, path: str) -> None:
    """One GeoJSON Feature per line, keeping ids, population and zone order.

    Without a ``parts`` column all rings of a zone form one polygon.
    """
    _features(zones).write.mode("overwrite").text(path)


def write_collection(zones: DataFrame, path: str) -> None:
    """One FeatureCollection in zone order, in the one file that such a document is."""
    rows = _features(zones.withColumn("_place", F.col(_ORDER)), "_place")
    ends = zones.sparkSession.createDataFrame(
        [(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "part int, value string"
    )
    place = F.row_number().over(Window.orderBy("_place"))
    comma = F.when(place == 1, F.lit("")).otherwise(F.lit(","))
    listed = rows.select(F.lit(1).alias("part"), "_place", F.concat(comma, F.col("value")).alias("value"))
    whole = listed.unionByName(ends, allowMissingColumns=True)
    whole.repartition(1).sortWithinPartitions("part", "_place").select("value").write.mode("overwrite").text(path)


def _features(zones: DataFrame, *kept: str) -> DataFrame:
    """A column ``value`` with the GeoJSON of each zone, after the columns ``kept``."""
    skip = {"rings", "parts", "minx", "miny", "maxx", "maxy"}
    properties = F.struct(*[c for c in zones.columns if c not in skip | set(kept)])
    points = F.transform(
        "rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    )
    part_of = (
        F.col("parts")
        if "parts" in zones.columns
        else F.array_repeat(F.lit(0), F.size("rings"))
    )
    prepared = zones.select(
        *kept, properties.alias("properties"), points.alias("points"), part_of.alias("part_of")
    )
    polygons = F.transform(
        F.sequence(F.lit(0), F.array_max("part_of")),
        lambda part: F.filter("points", lambda _, i: F.get("part_of", i) == part),
    )
    one = F.array_max("part_of") == 0
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json("properties"),
        F.lit(',"geometry":{"type":"'),
        F.when(one, POLYGON).otherwise(MULTIPOLYGON),
        F.lit('","coordinates":'),
        F.when(one, F.to_json(F.get("polygons", F.lit(0)))).otherwise(F.to_json("polygons")),
        F.lit("}}"),
    )
    return prepared.withColumn("polygons", polygons).select(*kept, feature.alias("value"))
