"""Draw documents that look like a target: importance resampling on hashed n-grams.

Features are runs of words, hashed by CRC-32 into buckets. A bucket's gain is
the logarithm of how much likelier it is in the target than in the corpus, a
document's weight the mean gain of its features. Weights and seeded Gumbel
noise make a score; the highest scores are the sample, without replacement.

The checksums of a batch are taken all at once: distinct features of equal
length form a matrix of bytes, one column at a time updates the checksums of
all rows, and the buckets are scattered back to the features' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.sources import scratch_path

BUCKETS = 10_000
#: A feature is a run of up to this many words.
LONGEST = 1
SEED = "2024"
#: Percentage of the eligible documents that is drawn, and the words that make one eligible.
PERCENT = 10
LEAST_WORDS = 20

#: Longer features are cut into pieces of this many bytes, whose checksums are combined.
_PIECE = 64
_TEXTS = 512  # texts whose features are held at a time
_LOWER = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 or 48 <= b < 58 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """Effect of one byte on a checksum of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_START = np.uint32(0xFFFFFFFF)


def _past_piece() -> list[np.ndarray]:
    """What ``_PIECE`` zero bytes make of each byte of a checksum: the update is linear over bits."""
    state = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(_PIECE):
        state = _CRC[state & 255] ^ (state >> 8)
    return list(state)


_SHIFT = _past_piece()


def _updated(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for column in rows.T:
        state = _CRC[(state ^ column) & 255] ^ (state >> 8)
    return state


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte strings ``data[start : start + length]``."""
    heads = np.where(lengths > _PIECE, (lengths - 1) % _PIECE + 1, lengths)
    state = np.full(len(starts), _START, np.uint32)
    by_length = np.argsort(heads, kind="stable")
    for group in np.split(by_length, np.flatnonzero(np.diff(heads[by_length])) + 1):
        if len(group):
            rows = data[starts[group][:, None] + np.arange(heads[group[0]])]
            state[group] = _updated(state[group], rows)
    for i in np.flatnonzero(lengths > _PIECE):
        pieces = data[starts[i] + heads[i] : starts[i] + lengths[i]].reshape(-1, _PIECE)
        s = int(state[i])
        for own in _updated(np.zeros(len(pieces), np.uint32), pieces).tolist():
            s = own ^ int(_SHIFT[0][s & 255] ^ _SHIFT[1][s >> 8 & 255] ^ _SHIFT[2][s >> 16 & 255] ^ _SHIFT[3][s >> 24])
        state[i] = s
    return state ^ _START


def _features(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """Number of words of a whole text and all its runs of up to ``longest`` of them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def buckets_of(features: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each feature; distinct ones are hashed once."""
    coded = pa.array(features, pa.large_binary()).dictionary_encode()
    known = coded.dictionary
    if not len(known):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
    data = np.frombuffer(known.buffers()[2] or b"", np.uint8)
    hashed = crc32_of(data, offsets[:-1], np.diff(offsets)).astype(np.int64) % buckets
    return hashed[coded.indices.to_numpy()]


def _hashed(batches: Iterator[pa.RecordBatch], longest: int, buckets: int):
    """Slices of the batches with words and features a text and the buckets of all its features in a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            found = [_features(t.as_py(), longest) for t in part.column(part.num_columns - 1)]
            sizes = np.array([len(runs) for _, runs in found], np.int64)
            yield part, np.array([n for n, _ in found], np.int64), sizes, buckets_of([x for _, runs in found for x in runs], buckets)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket; a task sums up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, own in _hashed(batches, longest, buckets):
            total += np.bincount(own, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bucket", "n"])

    sums = texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of each of the B buckets."""
    s, t, b = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``docs`` (with ``text``) with ``imp_words``, ``imp_features`` and ``imp_weight`` in place of the text."""
    kept = docs.select(*[c for c in docs.columns if c != "text"], "text")
    names = [*kept.columns[:-1], "imp_words", "imp_features", "imp_weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, sizes, own in _hashed(batches, longest, len(gain)):
            ends = np.concatenate(([0], np.cumsum(gain[own])))
            last = np.cumsum(sizes)
            mean = np.where(sizes, (ends[last] - ends[last - sizes]) // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(words), pa.array(sizes), pa.array(mean)], names)

    schema = kept.drop("text").schema
    for name in names[-3:]:
        schema = schema.add(name, "long")
    return kept.mapInArrow(weigh, schema)


def noise(seed: str = SEED, doc_id: str = "doc_id") -> Column:
    """Thousandths of a Gumbel variate from 32 bits of a hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_ranks(scored: DataFrame, draw: int) -> DataFrame:
    """``scored`` with ``rank`` 1 to ``draw`` by falling score, ties to smaller ids, then null.

    Rows are range partitioned and sorted, equal ones by their number, and
    written; a row's rank is its place in its partition and the sizes of the
    partitions before, so no task sees more than its range.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_imp_row")]
    path = scratch_path(spark, "score-order")
    place = F.monotonically_increasing_id()
    (
        scored.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_imp_part": F.shiftright(place, 33), "_imp_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    parts = placed.groupBy("_imp_part").agg((F.max("_imp_place") + 1).alias("_imp_n"))
    before = F.sum("_imp_n").over(Window.orderBy("_imp_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row a shuffle partition
    starts = parts.select("_imp_part", F.coalesce(before, F.lit(0)).alias("_imp_before"))
    rank = F.col("_imp_before") + F.col("_imp_place") + 1
    return placed.join(F.broadcast(starts), "_imp_part").select(
        *scored.columns, F.when(rank <= draw, rank).alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (doc_id, text).

    ``target`` has a ``text`` column. Drawn rows have a rank from 1; of the
    rows of at least ``least_words`` words ``percent`` in a hundred are drawn,
    rounded down. A text without features, null or empty, weighs 0. A null id
    is hashed as the word null and goes before others of its score; rows of one
    id have one noise, and equal rows are ranked in any order. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    gain = gains(bucket_counts(rows, "text", longest, buckets), bucket_counts(target, "text", longest, buckets))
    path = scratch_path(spark, "scores")
    weighted(rows, gain, longest).select(
        "doc_id",
        "imp_words",
        F.col("imp_features").alias("n_features"),
        F.col("imp_weight").alias("weight"),
        (F.col("imp_weight") + noise(seed)).alias("score"),
        F.monotonically_increasing_id().alias("_imp_row"),
    ).write.parquet(path)
    scored = spark.read.parquet(path)
    eligible = F.col("imp_words") >= least_words
    draw = percent * scored.where(eligible).count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return with_ranks(scored.where(eligible), draw).select(out).unionByName(rest.select(out))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
