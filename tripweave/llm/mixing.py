"""Mix sources to target shares by repeating documents a Poisson number of times.

A source's mean repetition is its target share over its present share of the
bytes. Each document has a uniform number from a seeded hash of its id; its
copies are the smallest count whose cumulative Poisson probability exceeds the
number, so a document's copies depend on its source's rate and its own id only.
Copies are then shuffled over all partitions by a hash of id and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.sizing import fits_broadcast
from tripweave.sources import scratch_path

SEED = "mix-1"
#: Documents of more copies are dealt out in blocks of so many.
COPIES = 4096


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def uniform(seed: str = SEED, doc_id: str = "doc_id") -> Column:
    """52 bits of a hash of the id, in [0, 1)."""
    digits = F.substring(_hash(seed, F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``source, rate``: mean copies of a document of each source.

    ``weights`` are target shares of the bytes, scaled to sum to one; sources
    without a weight get none. Without weights all sources get equal shares.
    The mixture has as many bytes as the input. A source of no bytes keeps one
    copy of each document on average.
    """
    sums = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    path = scratch_path(docs.sparkSession, "source-bytes")
    sums.select("source", "bytes", share.alias("weight")).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    total = found.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).first()
    if not total["b"] or not total["w"]:
        return found.select("source", F.lit(1.0 if weights is None else 0.0).alias("rate"))
    rate = F.col("weight") / F.lit(float(total["w"])) * F.lit(float(total["b"])) / F.col("bytes")
    return found.select("source", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def _first_step() -> Column:
    """The least number of copies that can be drawn: twelve deviations below the rate, 0 for small rates."""
    low = F.floor(F.col("rate") - 12 * F.sqrt("rate") - 30)
    return F.when(low < 100, F.lit(0)).otherwise(low).cast("long")


def _log_probability(k: Column) -> Column:
    """Logarithm of the Poisson probability of ``k``, 0 or at least 100, by Stirling's series."""
    rate = F.col("rate")
    series = 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5)
    large = (k - rate) - k * F.log(k / rate) - 0.5 * F.log(2 * math.pi * k) - series
    return F.when(k == 0, -rate).otherwise(large)


def copies() -> Column:
    """Copies at ``_mix_u`` by ``rate, _mix_first, _mix_log``: how many cumulative probabilities do not exceed it.

    Steps run from twelve deviations below the rate to twelve above it, so they
    grow with the root of the rate; nothing but their sum is kept.
    """
    return F.expr(
        "_mix_first + aggregate(sequence(0, cast(ceil(least(rate, 12 * sqrt(rate) + 130) + 12 * sqrt(rate) + 30) as int)), "
        "named_struct('l', _mix_log, 's', 0D, 'n', 0L), "
        "(a, k) -> named_struct('l', a.l + ln(rate) - ln(_mix_first + k + 1D), 's', a.s + exp(a.l), "
        "'n', a.n + if(a.s + exp(a.l) <= _mix_u, 1L, 0L)), a -> a.n)"
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` repeated, with ``copy`` (int from 1) and ``shuffle_key``, ordered by the key in each partition.

    Rows of the same id have the same number of copies, null ids too; null
    sources are one source. Columns called copy or shuffle_key are replaced.
    Rates are broadcast only if their measured size allows it, else joined by
    a shuffle that may split a large source. Documents of very many copies are
    first dealt out in blocks of them, so no task makes all copies of one; rows
    of one id, and equal rows, go to many partitions.
    """
    rates = source_rates(docs, weights).withColumnRenamed("source", "_mix_source")
    first = _first_step()
    # a rate of 0 has no logarithm and gives no copies
    table = rates.where("rate > 0").select("_mix_source", "rate", first.alias("_mix_first"), _log_probability(first).alias("_mix_log"))
    largest = table.agg(F.max("rate")).first()[0] or 0.0
    if fits_broadcast(table, F.coalesce(F.octet_length("_mix_source"), F.lit(0)) + 64, 16 << 20):
        table = F.broadcast(table)
    base = docs.select(*[c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")])
    joined = base.join(table, base["source"].eqNullSafe(table["_mix_source"])).withColumn("_mix_u", uniform(seed))
    counted = joined.withColumn("_mix_n", copies()).where("_mix_n > 0").withColumn("_mix_row", F.monotonically_increasing_id())
    each, last = F.lit(COPIES), F.col("_mix_n")
    if largest + 12 * math.sqrt(largest) + 30 > COPIES:
        many = counted.where(last > each).withColumn("_mix_block", F.explode(F.sequence(F.lit(0).cast('long'), F.floor((last - 1) / each))))
        many = many.repartition(F.xxhash64("doc_id", "_mix_row", "_mix_block"))
        counted = counted.where(last <= each).withColumn("_mix_block", F.lit(0).cast("long")).unionByName(many)
        numbers = F.sequence(F.col("_mix_block") * each + 1, F.least(last, (F.col("_mix_block") + 1) * each))
    else:
        numbers = F.sequence(F.lit(1).cast("long"), last)
    key = F.substring(_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")), 1, 16)
    return (
        counted.withColumn("copy", F.explode(numbers))
        .withColumn("copy", F.col("copy").cast("int"))
        .withColumn("shuffle_key", key)
        .repartition(F.col("shuffle_key"), F.xxhash64("text"), F.pmod("_mix_row", F.lit(64)))
        .select(*base.columns, "copy", "shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal shares of the bytes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
