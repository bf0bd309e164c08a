"""Shards of near equal bytes by a k-d tree over the documents' metadata.

A node of the tree is cut along its widest dimension at the weighted median
(weights are bytes), until there are as many leaves as shards. Medians are
found by histograms: every pass sums the bytes per node and bin on the
executors, and the driver sees at most ``BINS`` sums a pass (or 16 a node, if
there are more nodes than that). Rows of equal coordinates are ordered by a
hash of the row and at last by the row's place, so a value that a third of
all rows share is cut like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.sources import scratch_path

BINS = 16_384
_TOP = (1 << 63) - 1
_SIZE, _HASH, _ROW = "_kd_size", "_kd_hash", "_kd_row"


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (0 for null) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def number_axis(column: str) -> Column:
    """A whole number as a coordinate whose differences fit into a long; null first."""
    return F.coalesce(F.shiftright(F.col(column).cast("long"), 1), F.lit(-(1 << 62)))


def text_axis(column: str) -> Column:
    """The first seven bytes of a string as a number, in the order of the strings; null first."""
    head = F.hex(F.substring(F.col(column).cast("binary"), 1, 7))
    return F.coalesce(F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long"), F.lit(-1))


def scale_axis(size: Column) -> Column:
    """A size by its logarithm, so that a few giants do not make the axis wide."""
    return F.floor(F.log2(size + 1) * 1_000_000).cast("long")


@dataclass
class _Node:
    """Part of the tree that becomes ``leaves`` shards from number ``first`` on.

    The cut is a triple (axis value, hash, row): rows up to it go left.
    """

    first: int
    leaves: int
    axis: int = 0
    phase: int = 0  # searched part of the cut: 0 axis value, 1 hash, 2 row, 3 none
    low: int = 0
    high: int = 0
    need: float = 0.0
    cut: list[int] = field(default_factory=lambda: [_TOP, _TOP, _TOP])
    children: tuple[_Node, _Node] | None = None

    def settle(self, bins: list) -> None:
        """Narrow the search to the bin in which the wanted weight is reached."""
        below = 0
        for b in bins:
            if below + b["weight"] >= self.need:
                break
            below += b["weight"]
        self.need -= below
        self.low, self.high = b["low"], b["high"]
        if b["rows"] == 1 or (self.low == self.high and self.phase == 2):
            takes = b["weight"] - self.need <= self.need
            self.cut[self.phase] = self.low if takes else self.low - 1
            self.phase = 3
        elif self.low == self.high:
            self.cut[self.phase] = self.low
            self.phase += 1
            self.low, self.high = 0, _TOP

    def split(self) -> tuple[_Node, _Node]:
        half = self.leaves // 2
        self.children = (_Node(self.first, half), _Node(self.first + half, self.leaves - half))
        return self.children

    def key(self, axes: list[str]) -> Column:
        return F.col([axes[self.axis], _HASH, _ROW][self.phase])

    def sought(self, axes: list[str]) -> Column:
        """Rows that can still hold the cut."""
        inside = self.key(axes).between(self.low, self.high)
        if self.phase > 0:
            inside &= F.col(axes[self.axis]) == self.cut[0]
        if self.phase > 1:
            inside &= F.col(_HASH) == self.cut[1]
        return inside


def _by_node(root: _Node, axes: list[str], at_node: Callable[[_Node], Column]) -> Column:
    """The value of ``at_node`` for the undivided node in which a row lies."""
    if root.children is None:
        return at_node(root)
    value, (v, h, r) = F.col(axes[root.axis]), root.cut
    right = (value > v) | ((value == v) & ((F.col(_HASH) > h) | ((F.col(_HASH) == h) & (F.col(_ROW) > r))))
    left_part, right_part = (_by_node(c, axes, at_node) for c in root.children)
    return F.when(right, right_part).otherwise(left_part)


def _set_axes(rows: DataFrame, root: _Node, nodes: list[_Node], axes: list[str], whole: list) -> list:
    """Give each node its widest axis, measured in shares of the ranges of all rows."""
    stats = rows.groupBy(_by_node(root, axes, lambda n: F.lit(n.first)).alias("node")).agg(
        F.sum(_SIZE).alias("weight"),
        *[f(a).alias(f"{p}{i}") for i, a in enumerate(axes) for f, p in ((F.min, "l"), (F.max, "h"))],
    )
    found = {s["node"]: s for s in stats.collect()}
    for n in nodes:
        s = found.get(n.first)
        if s is None:  # no rows, so any cut will do
            n.phase = 3
            continue
        ranges = [(s[f"l{i}"], s[f"h{i}"]) for i in range(len(axes))]
        whole = whole or ranges
        wide = [(h - l) / max(1, rh - rl) for (l, h), (rl, rh) in zip(ranges, whole)]
        n.axis = max(range(len(axes)), key=lambda i: (wide[i], -i))
        n.low, n.high = ranges[n.axis]
        n.need = s["weight"] * (n.leaves // 2) / n.leaves
    return whole


def _find_cuts(rows: DataFrame, root: _Node, nodes: list[_Node], axes: list[str]) -> None:
    """Search the weighted medians of all nodes at once, a histogram each pass."""
    bins = max(16, BINS // len(nodes))
    places = {n.first: i for i, n in enumerate(nodes)}

    def cell(n: _Node) -> Column:
        if n.first not in places or n.phase > 2 or n.leaves < 2:
            return F.lit(None).cast("long")
        width = (n.high - n.low) // bins + 1
        number = F.call_function("div", n.key(axes) - F.lit(n.low), F.lit(width).cast("long"))
        return F.when(n.sought(axes), number + F.lit(places[n.first] * bins).cast("long"))

    while any(n.phase < 3 for n in nodes):
        found = (
            rows.select(
                _by_node(root, axes, cell).alias("cell"),
                _by_node(root, axes, lambda n: n.key(axes) if n.phase < 3 else F.lit(0).cast("long")).alias("key"),
                _SIZE,
            )
            .where("cell is not null")
            .groupBy("cell")
            .agg(F.sum(_SIZE).alias("weight"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for b in sorted(found, key=lambda b: b["cell"]):
            by_node.setdefault(b["cell"] // bins, []).append(b)
        for i, n in enumerate(nodes):
            if n.phase < 3:
                n.settle(by_node[i])


def kd_shards(
    docs: DataFrame,
    axes: dict[str, Column],
    size: Column,
    identity: Column,
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """``docs`` with ``shard`` (int from 0), ``slot`` (long, gapless from 0) and ``size``.

    Give the number of shards, or the target bytes of one. ``axes`` are whole
    numbers whose differences fit into a long, ``size`` is positive, and
    ``identity`` is a 63-bit hash that orders rows of equal coordinates.
    The rows are written once to the shared folder; each pass reads only the
    narrow columns of that table. Columns called shard, slot or size are
    replaced. An empty input gives no rows. Repeated rows are interchangeable
    and may lie on both sides of a cut; null coordinates come first.
    """
    spark = docs.sparkSession
    names = [f"_kd_axis{i}" for i in range(len(axes))]
    path = scratch_path(spark, "kd")
    docs.select(
        *[c for c in docs.columns if c.lower() not in ("shard", "slot", "size")],
        size.alias(_SIZE),
        identity.alias(_HASH),
        *[a.alias(n) for a, n in zip(axes.values(), names)],
    ).withColumn(_ROW, F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path)
    if shards is None:
        total = table.agg(F.sum(_SIZE)).first()[0] or 0
        shards = max(1, -(-total // target_bytes))

    narrow = table.select(_SIZE, _HASH, _ROW, *names)
    root = _Node(0, shards)
    nodes, whole = [root] if shards > 1 else [], []
    while nodes:
        whole = _set_axes(narrow, root, nodes, names, whole)
        _find_cuts(narrow, root, nodes, names)
        nodes = [c for n in nodes for c in n.split() if c.leaves > 1]
    placed = table.withColumn("shard", _by_node(root, names, lambda n: F.lit(n.first)))
    return _with_slots(placed).withColumnRenamed(_SIZE, "size").drop(_HASH, _ROW, *names)


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0.

    Rows are counted per shard and written part, so no task orders a whole
    shard; the counts of the parts before a row's own are added to its rank.
    """
    parts = placed.withColumn("_kd_part", F.shiftright(_ROW, 33))
    before = Window.partitionBy("shard").orderBy("_kd_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        parts.groupBy("shard", "_kd_part")
        .agg(F.count("*").alias("_kd_n"))
        .select("shard", "_kd_part", F.coalesce(F.sum("_kd_n").over(before), F.lit(0)).alias("_kd_before"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "_kd_part").orderBy(_ROW))
    ranked = parts.withColumn("_kd_rank", rank)
    return (
        ranked.join(counts, ["shard", "_kd_part"])
        .withColumn("slot", F.col("_kd_before") + F.col("_kd_rank") - 1)
        .drop("_kd_part", "_kd_before", "_kd_rank")
    )


def document_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard documents along source, language, size and id."""
    size = text_bytes()
    axes = {
        "source": text_axis("source"),
        "lang": text_axis("lang"),
        "size": scale_axis(size),
        "doc_id": number_axis("doc_id"),
    }
    identity = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    return kd_shards(docs, axes, size, identity, shards, target_bytes)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    size = text_bytes()
    slim = docs.select(
        "doc_id",
        size.alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_axis("source").alias("source_axis"),
        text_axis("lang").alias("lang_axis"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("identity"),
    )
    axes = {
        "source": F.col("source_axis"),
        "lang": F.col("lang_axis"),
        "size": scale_axis(F.col("n_bytes")),
        "doc_id": number_axis("doc_id"),
    }
    sharded = kd_shards(slim, axes, F.col("n_bytes"), F.col("identity"), shards=24)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
