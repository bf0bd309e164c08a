"""Benchmark passages in documents: a prefix-filtered join of shingles.

A window is ``WINDOW`` words of an item. Its tokens are shingles of a few
words, ordered by how rare they are in the documents; an occurrence of the
window holds all of them, so the rarest alone is the prefix on which documents
and windows are joined. A match of the token fixes where the window would lie;
it must lie inside the document (the length and position bounds), and then
all its words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.operators.sizing import fits_broadcast
from tripweave.sources import scratch_path

WINDOW = 10
TOKEN_WORDS = 3
#: Broadcast tables of windows only up to this many bytes; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.filter(F.split(lowered, _NO_WORD), lambda w: w != "")


def _token(size: int) -> Column:
    """Hash of ``size`` words from place ``p`` on."""
    return F.xxhash64(*[F.expr(f"w[p + {i}]") for i in range(size)])


def _tokens(rows: DataFrame, size: int) -> DataFrame:
    """One row for each place of ``w`` where ``size`` words begin, with its ``token``."""
    long_enough = rows.where(F.size("w") >= size)
    placed = long_enough.select("*", F.explode(F.expr(f"sequence(0, size(w) - {size})")).alias("p"))
    return placed.withColumn("token", _token(size))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, w (words), size``: all windows of each item; a shorter item is one window."""
    items = benchmark.select("item_id", words().alias("all")).where("size(all) > 0")
    starts = F.expr(f"sequence(0, greatest(0, size(all) - {window}))")
    cut = items.select("item_id", "all", F.explode(starts).alias("s"))
    return cut.select("item_id", F.expr(f"slice(all, s + 1, {window})").alias("w")).withColumn("size", F.size("w"))


def _sent(df: DataFrame, row_bytes: Column) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, row_bytes, BROADCAST_BYTES) else df


def _prefixes(spark: SparkSession, docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """``token, windows``: each window under its rarest token, with the place of the token in it."""
    tokens = _tokens(windows, size)
    path = scratch_path(spark, "window-tokens")
    tokens.write.parquet(path)
    tokens = spark.read.parquet(path)
    asked = _sent(tokens.select("token").distinct(), F.lit(16))
    found = _tokens(docs.select("w"), size).select("token").join(asked, "token")
    counts = found.groupBy("token").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("w").orderBy(F.coalesce("times", F.lit(0)), "token", "p")
    first = tokens.select("w", "token", "p").distinct().join(counts, "token", "left")
    chosen = first.withColumn("n", F.row_number().over(rarest)).where("n = 1 and times > 0")
    path = scratch_path(spark, "prefixes")
    chosen.select("token", F.col("p").alias("at"), F.col("w").alias("window")).write.parquet(path)
    return spark.read.parquet(path)


def hits(docs: DataFrame, windows: DataFrame, token_words: int = TOKEN_WORDS) -> DataFrame:
    """``doc_id, text_hash, window, start`` of every occurrence of a window in ``docs`` (doc_id, text_hash, w)."""
    spark = docs.sparkSession
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(token_words))).distinct().collect()]
    found = None
    for size in sorted(sizes):  # items of one or two words have tokens of their own size
        own = windows.where(F.least("size", F.lit(token_words)) == size).select("w").distinct()
        prefixes = _prefixes(spark, docs, own, size)
        sent = _sent(prefixes, F.lit(64) + F.expr("aggregate(window, 0, (a, x) -> a + octet_length(x) + 16)"))
        met = _tokens(docs, size).join(sent, "token").withColumn("start", F.col("p") - F.col("at"))
        inside = met.where("start >= 0 and start + size(window) <= size(w)")
        same = inside.where("slice(w, start + 1, size(window)) = window")
        part = same.select("doc_id", "text_hash", "window", "start")
        found = part if found is None else found.unionByName(part)
    return found


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """``doc_id, text_hash, n_hit, items`` of documents that hold a window; None without any window."""
    spark = docs.sparkSession
    path = scratch_path(spark, "windows")
    item_windows(benchmark).write.parquet(path)
    windows = spark.read.parquet(path)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words().alias("w"))
    found = hits(rows, windows)
    if found is None:
        return None
    path = scratch_path(spark, "hits")
    found.distinct().write.parquet(path)
    found = spark.read.parquet(path)
    # a document's hits are bounded by its words; lengths differ only for items shorter than a window
    spans = found.select("doc_id", "text_hash", "start", (F.col("start") + F.size("window")).alias("end")).distinct()
    covered = F.expr(
        "aggregate(sort_array(collect_list(struct(start, end))), struct(0L as n, 0 as upto), "
        "(a, s) -> struct(a.n + greatest(0, s.end - greatest(s.start, a.upto)) as n, greatest(a.upto, s.end) as upto), a -> a.n)"
    )
    n_hit = spans.groupBy("doc_id", "text_hash").agg(covered.alias("n_hit"))
    owners = windows.select(F.col("w").alias("window"), "item_id").distinct()
    named = found.select("doc_id", "text_hash", "window").distinct().join(owners, "window")
    items = named.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    same = [n_hit[c].eqNullSafe(items[c]) for c in ("doc_id", "text_hash")]
    return n_hit.join(items, same).select(n_hit["doc_id"], n_hit["text_hash"], "n_hit", F.sort_array("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every row of ``docs``; ``items`` are ids as sorted strings.

    Null and empty texts have no words. Rows that repeat id and text have the
    same result; items without words have no window, and a null item_id names
    no item. Without any window nothing is hit.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words()).cast("long").alias("n_words"))
    found = _found(docs, benchmark)
    none = F.array().cast("array<string>")
    if found is None:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    f = found.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    joined = rows.join(f, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a word of an occurring window; columns are those of ``docs``."""
    found = _found(docs, benchmark)
    if found is None:
        return docs
    marked = docs.withColumn("_hit_hash", F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(found["doc_id"]) & (marked["_hit_hash"] == found["text_hash"])
    if fits_broadcast(found, F.lit(32), BROADCAST_BYTES):
        found = F.broadcast(found.select("doc_id", "text_hash"))
    return marked.join(found, same, "left_anti").select(docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
