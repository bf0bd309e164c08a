"""Document quality by a sparse ensemble of rules over text statistics.

Small boosted trees are grown on the statistics of labelled rows; every path
from a root is a rule, a conjunction of bounds. A logistic regression with a
lasso penalty weighs the rules and keeps few of them, which are compiled into
one Spark column over the columns of statistics.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the training sample: labelled documents of each class.
TRAIN_DOCS = 4000
THRESHOLD = 0.5
TREES = 40
DEPTH = 3
#: A side of a cut holds at least this many training rows.
LEAST_ROWS = 20
#: A statistic is cut at one of so many quantiles.
CUTS = 48
RATE = 0.3
#: Penalties that are tried on a fifth of the training rows.
PENALTIES = (0.03, 0.01, 0.003, 0.001)

# -- statistics --------------------------------------------------------------------

_KINDS = ("letters", "upper", "digits", "shouts", "stops", "signs", "symbols", "rest")
_ENDS = (".", "!", "?")
_ROWS = 256  # texts whose statistics are held at a time

STATISTICS = (
    "log_chars",
    "letters",
    "upper",
    "digits",
    "shouts",
    "stops",
    "symbols",
    "word_chars",
    "distinct_words",
    "repeats",
    "ended_words",
    "short_words",
    "longest_word",
    "distinct_lines",
    "line_words",
)


def _kind(c: str) -> str:
    kind = unicodedata.category(c)
    if c in "!?":
        return "shouts"
    if c in ".,;:":
        return "stops"
    if c in "\"'()-":
        return "signs"
    if kind == "Lu":
        return "upper"
    if kind[0] in "LM":
        return "letters"
    return "digits" if kind[0] == "N" else "symbols" if kind[0] in "PS" else "rest"


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the first two planes; those beyond are ideographs."""
    return np.array([_KINDS.index(_kind(chr(c))) for c in range(0x20000)] + [0], np.uint8)


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; shares of characters, words and lines, 0 where there are none."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    among = dict(zip(_KINDS, np.bincount(_kinds()[np.minimum(points, 0x20000)], minlength=len(_KINDS)).tolist()))
    words, lines = text.split(), text.split("\n")
    chars, n = max(1, len(text)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        math.log1p(len(text)),
        (among["letters"] + among["upper"]) / chars,
        among["upper"] / chars,
        among["digits"] / chars,
        among["shouts"] / chars,
        among["stops"] / chars,
        among["symbols"] / chars,
        float(lengths.sum()) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(w.endswith(_ENDS) for w in words) / n,
        float((lengths < 3).sum()) / n,
        math.log1p(int(lengths.max(initial=0))),
        len(set(lines)) / len(lines),
        len(words) / len(lines),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_<name>`` of each of ``STATISTICS``, doubles that are never null, in place of the text."""
    kept = docs.select(*[c for c in docs.columns if c != "text"], "text")
    names = [f"_q_{n}" for n in STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            found = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)])
            arrays = [*batch.columns[:-1], *map(pa.array, found.T.copy())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *names])

    schema = kept.drop("text").schema
    for name in names:
        schema = schema.add(name, "double")
    return kept.mapInArrow(measure, schema)


# -- rules -------------------------------------------------------------------------

#: One bound of a rule: statistic, whether it must exceed the limit, limit.
Bound = tuple[str, bool, float]


@dataclass
class RuleEnsemble:
    """Rules with their weights, and the weight of no rule."""

    rules: list[tuple[tuple[Bound, ...], float]] = field(default_factory=list)
    bias: float = 0.0

    def column(self) -> Column:
        """The score, from 0 to 1, over the columns of ``with_statistics``."""
        margin = F.lit(self.bias)
        for bounds, weight in self.rules:
            tests = [F.col(f"_q_{s}") > limit if above else F.col(f"_q_{s}") <= limit for s, above, limit in bounds]
            margin = margin + F.when(reduce(and_, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _limits(x: np.ndarray) -> list[np.ndarray]:
    """Cuts of each statistic: midpoints of neighbours among its quantiles."""
    out = []
    for values in x.T:
        marks = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="nearest"))
        out.append((marks[1:] + marks[:-1]) / 2)
    return out


def _grow(codes: np.ndarray, sizes: list[int], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list) -> None:
    """Nodes of one tree into ``found`` as (path, rows, leaf value), by the largest gain of a Newton step."""
    g, h = slope[rows].sum(), curve[rows].sum()
    best = None
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for s, size in enumerate(sizes):
            own = codes[rows, s]
            n = np.cumsum(np.bincount(own, minlength=size + 1))[:-1]
            gs = np.cumsum(np.bincount(own, slope[rows], size + 1))[:-1]
            hs = np.cumsum(np.bincount(own, curve[rows], size + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(n < LEAST_ROWS) | (n > len(rows) - LEAST_ROWS)] = -1
            if size and gain.max() > (best[0] if best else 1e-6):
                best = (gain.max(), s, int(gain.argmax()))
    found.append((path, rows, RATE * g / (h + 1), best is None))
    if best:
        _, s, at = best
        below = codes[rows, s] <= at
        for above, part in ((False, rows[below]), (True, rows[~below])):
            _grow(codes, sizes, slope, curve, part, depth - 1, (*path, (s, above, at)), found)


def _paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, limits: list[np.ndarray]) -> list[tuple]:
    """Distinct paths of boosted trees; each tree sees half of the rows."""
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(limits, x.T)])
    sizes, margin, paths = [len(c) for c in limits], np.zeros(len(x)), {}
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(x))[: max(2 * LEAST_ROWS, len(x) // 2)])
        found: list = []
        _grow(codes, sizes, weight * (y - p), weight * p * (1 - p), rows, DEPTH, (), found)
        for path, _, value, leaf in found:
            held = _holds(codes, path)
            if path:
                paths.setdefault(np.packbits(held).tobytes(), path)  # of rules alike on all rows the first
            if leaf:
                margin[held] += value
    return list(paths.values())


def _holds(codes: np.ndarray, path: tuple) -> np.ndarray:
    held = np.ones(len(codes), bool)
    for s, above, at in path:
        held &= (codes[:, s] > at) == above
    return held


def _lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, the weights under a lasso penalty, by accelerated proximal steps."""
    held = np.packbits(np.column_stack((y > 0, r > 0)), axis=1)
    _, first, same = np.unique(held, axis=0, return_index=True, return_inverse=True)
    r, y, weight = r[first], y[first], np.bincount(same.ravel(), weight)  # rows alike count together
    design = np.hstack((r, np.ones((len(r), 1))))
    share = weight / weight.sum()
    norm = np.linalg.eigvalsh((design * share[:, None]).T @ design)[-1]
    step = 4 / norm
    now = np.zeros(design.shape[1])
    ahead, pace = now, 1.0
    for _ in range(rounds):
        slope = design.T @ (share * (1 / (1 + np.exp(-np.clip(design @ ahead, -40, 40))) - y))
        new = ahead - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = new + (pace - 1) / faster * (new - now), new, faster
    return now[:-1], float(now[-1])


def _loss(r: np.ndarray, y: np.ndarray, weight: np.ndarray, found: tuple[np.ndarray, float]) -> float:
    margin = r @ found[0] + found[1]
    return float((weight * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum())


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Fit on statistics ``x`` (rows by ``names``), labels 0 or 1 and row weights, in any fixed order of rows."""
    if len(set(y.tolist())) < 2:
        share = ((weight * y).sum() + 1) / (weight.sum() + 2)
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    limits = _limits(x)
    paths = _paths(x, y, weight, limits)
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(limits, x.T)])
    r = np.column_stack([_holds(codes, p) for p in paths]).astype(float) if paths else np.zeros((len(x), 0))
    apart = np.arange(len(x)) % 5 == 0
    tried = [
        _loss(r[apart], y[apart], weight[apart], _lasso(r[~apart], y[~apart], weight[~apart], p)) for p in PENALTIES
    ]
    weights, bias = _lasso(r, y, weight, PENALTIES[int(np.argmin(tried))])
    rules = [
        (tuple((names[s], above, float(limits[s][at])) for s, above, at in path), float(w))
        for path, w in zip(paths, weights)
        if w
    ]
    return RuleEnsemble(rules, bias)


# -- the query ---------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, usable: Column | None = None, each: int = TRAIN_DOCS) -> RuleEnsemble:
    """The ensemble of at most ``each`` labelled documents of either class, those of smallest id hash.

    Classes weigh as many rows as are labelled so, sampled or not. An id with
    several labels is of low quality if one says so; of an id with several texts the
    one of least statistics is taken. Null ids, labels and texts are not trained on.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out() if usable is None else usable)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("quality") == v).orderBy(order, "doc_id").limit(each) for v in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x each ids
    texts = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id")
    names = list(STATISTICS)
    own = F.struct(*[f"_q_{n}" for n in names])
    rows = with_statistics(texts).groupBy("doc_id", "quality").agg(F.min(own).alias("x"))
    found = rows.orderBy(order, "doc_id").collect()
    y = np.array([float(r["quality"]) for r in found])
    weight = np.array([sizes[int(v)] / min(sizes[int(v)], each) for v in y])
    return train(np.array([list(r["x"]) for r in found]).reshape(-1, len(names)), y, weight, names)


def with_quality(docs: DataFrame, model: RuleEnsemble, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and a double called ``name`` for every row; null and empty texts are texts without words.

    A text that is among ``columns`` passes through the statistics beside its copy.
    """
    kept = docs.select(*[F.col(c).alias(f"_kept_{c}") for c in columns], "text")
    scored = with_statistics(kept).withColumn("_q_score", model.column())
    return scored.select(*[F.col(f"_kept_{c}").alias(c) for c in columns], F.col("_q_score").alias(name))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
