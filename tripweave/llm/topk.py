"""Exact top-k inner products: tiles of queries by candidates, then merged lists.

Queries and candidates are cut into blocks by a hash. A tile is one block of
each: one matrix product and a partial selection, in one task of bounded size.
The lists of a query's tiles are merged in two rounds, so no task sees more
than the lists of ``FAN`` tiles or of ``FAN`` merged lists a query at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a block at most, and bytes of their components on average.
QUERY_BLOCK = 16_384
SHARD_BLOCK = 8192
BLOCK_BYTES = 32 << 20
_LARGEST = float(np.finfo(float).max)
FAN = 32
_STEP = 128


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components in one array, and the length of each vector."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False), np.diff(flat.offsets.to_numpy())


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact within a long; beyond it they saturate."""
    top = max((float(np.abs(x).max(initial=0)) for x in (q, c)), default=0.0)
    bound = q.shape[1] * top * top
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """Best ``k`` candidates of each query within one tile; ties to smaller ids.

    Only vectors of the query's own length are candidates, and a row with the
    query's id is not.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    if not queries.num_rows or not shard.num_rows:
        empty = pa.array([], pa.int64())
        return pa.table({"s": empty.cast(pa.int32()), "query_id": empty, "vec_id": empty, "score": empty})
    (qv, qn), (cv, cn) = _flat(queries.column("vector")), _flat(shard.column("row"))
    q_ids, c_ids = queries.column("vec_id").to_numpy(), shard.column("row_id").to_numpy()
    q_at, c_at = (np.concatenate(([0], np.cumsum(n)[:-1])).astype(int) for n in (qn, cn))
    for length in np.intersect1d(qn, cn):
        qs, cs = np.flatnonzero(qn == length), np.flatnonzero(cn == length)
        cs = cs[np.argsort(c_ids[cs], kind="stable")]
        spread = np.arange(length)
        c = cv[c_at[cs][:, None] + spread]
        for part in (qs[i : i + _STEP] for i in range(0, len(qs), _STEP)):
            scores = _scores(qv[q_at[part][:, None] + spread], c)
            allowed = q_ids[part][:, None] != c_ids[cs][None, :]
            for row, (s, ok) in enumerate(zip(scores, allowed)):
                at = np.flatnonzero(ok)
                s = s[at]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
                    pick = np.concatenate((above, equal[: k - len(above)]))
                    at, s = at[pick], s[pick]
                out[0].append(np.full(len(at), q_ids[part[row]]))
                out[1].append(c_ids[cs[at]])
                out[2].append(s)
    joined = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out]
    tile = pa.array(np.full(len(joined[0]), queries.column("s")[0].as_py()), pa.int32())
    return pa.table([tile, *map(pa.array, joined)], names=["s", "query_id", "vec_id", "score"])


def _best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(vectors: DataFrame, most: int) -> int:
    row = vectors.agg(F.count("*").alias("n"), F.sum(F.size("vector").cast("long")).alias("components")).first()
    return max(1, -(-row["n"] // most), -(-8 * (row["components"] or 0) // BLOCK_BYTES))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows of ``vectors`` (vec_id, vector array<double>).

    ``vector`` must hold whole numbers. Rows with a null id or vector take no
    part; an id that repeats among the queries asks once, with its smallest
    vector, while every repeated candidate row counts. An empty table gives no
    rows, and a vector of no components scores 0 against others of none.
    """
    usable = vectors.where("vec_id is not null and vector is not null")
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = [_blocks(queries, QUERY_BLOCK), _blocks(usable, SHARD_BLOCK)]
    # candidates go by row, so that an id that repeats is dealt out as well
    keys = [F.xxhash64("vec_id"), F.xxhash64("vec_id", F.monotonically_increasing_id())]
    block = [F.pmod(key, F.lit(n)).cast("int") for key, n in zip(keys, blocks)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    q = queries.select(block[0].alias("q"), every[1].alias("s"), "vec_id", "vector")
    c = usable.select(every[0].alias("of"), block[1].alias("shard"), F.col("vec_id").alias("row_id"), F.col("vector").alias("row"))
    tiles = (
        q.groupBy("q", "s")
        .cogroup(c.groupBy("of", "shard"))
        .applyInArrow(lambda a, b: tile_top(a, b, k), "s int, query_id long, vec_id long, score long")
    )
    groups = _best(tiles.withColumn("g", F.floor(F.col("s") / FAN)), k, "query_id", "g").drop("rank", "g")
    return _best(groups, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled_vectors(embeddings: DataFrame) -> DataFrame:
    """Each component x as floor(1024 x); vectors with a null or non-finite component become null.

    What is beyond the largest double counts as the largest double.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    largest = lambda v: F.greatest(F.least(v, F.lit(_LARGEST)), F.lit(-_LARGEST))
    # adding 0.0 turns -0.0 into 0.0; floor on doubles goes through a decimal so that no size overflows
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**50, F.floor(v * 1024).cast("double")).otherwise(largest(v * 1024)))
    return embeddings.select("vec_id", F.when(~bad, whole).alias("vector"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, k=10)
