"""Importance resampling and the quality rules."""

import hashlib
import math
import random
import zlib
from collections import Counter
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import importance, quality

SF = "/root/testdata/sf0.001"


# -- importance resampling --------------------------------------------------------------


def test_checksums_of_all_lengths():
    rng = random.Random(1)
    lengths = [0, 1, 2, 7, 63, 64, 65, 128, 129, 1000, 70_001]
    words = [bytes(rng.randrange(256) for _ in range(rng.choice(lengths[:-1]))) for _ in range(2000)]
    words += [b"x" * n for n in lengths]
    assert importance.buckets_of(words, 1 << 32).tolist() == [zlib.crc32(w) for w in words]
    assert importance.buckets_of([]).tolist() == []


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in lower).split(" ")


def brute_scores(docs, target, longest, buckets):
    def features(text):
        words = [w for w in words_of(text) if w]
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total = [sum(c.values()) + buckets for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    out = []
    for i, text in docs:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_scores_and_ranks_on_odd_rows(spark, odd_docs, longest):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rng = random.Random(3)
    rows += [(100 + i, " ".join(rng.choice(["alpha", "béta", "g4mma", "的", "x" * 300]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(7, "same words again " * 9)] * 30  # one id holds many rows
    docs = spark.createDataFrame([(*r, "s", "r") for r in rows], "doc_id long, text string, score string, rank string")
    target = spark.createDataFrame([("béta GAMMA alpha",), (None,), ("",)], "text string")
    got = [tuple(r) for r in importance.resample(docs, target, 30, 20, longest, 50).collect()]
    want = brute_scores(rows, ["béta GAMMA alpha"], longest, 50)
    full = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((r[:4] for r in got), key=full) == sorted((r[:4] for r in want), key=full)
    eligible = [r for r in want if r[4] >= 20]
    order = sorted(eligible, key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in drawn] == list(range(1, len(eligible) * 30 // 100 + 1))
    assert [r[:4] for r in drawn] == [r[:4] for r in order[: len(drawn)]]


def test_resampling_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, spark.createDataFrame([], "text string")).collect() == []
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [(r.n_features, r.rank) for r in importance.resample(one, docs.select("text"), 100).collect()] == [(30, 1)]


# -- quality ----------------------------------------------------------------------------


def test_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics("Hi hi hi. A1 | ok!\n的 ok!")))
    assert got["distinct_words"] == 7 / 8 and got["repeats"] == 0
    assert got["ended_words"] == 3 / 8 and got["short_words"] == 5 / 8
    assert (got["upper"], got["digits"], got["shouts"], got["stops"], got["symbols"]) == tuple(n / 24 for n in (2, 1, 2, 1, 1))
    assert got["line_words"] == 4 and got["distinct_lines"] == 1
    assert set(quality.statistics(None)) == set(quality.statistics("")) == {0.0, 1.0}
    assert all(np.isfinite(quality.statistics("\ud800 \U0001f600 x")))


def test_rules_are_what_their_column_computes(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = quality.train(x, y, np.ones(len(x)), ["a", "b", "c"])
    assert 0 < len(model.rules) < 120 and any(len(bounds) > 1 for bounds, _ in model.rules)
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], "_q_a double, _q_b double, _q_c double")
    got = [r.s for r in table.select("_q_a", model.column().alias("s")).collect()]
    want = []
    for row in x:
        at = dict(zip("abc", row))
        margin = model.bias + sum(w for bounds, w in model.rules if all((at[s] > v) == above for s, above, v in bounds))
        want.append(1 / (1 + math.exp(-margin)))
    assert got == pytest.approx(want)
    assert mean(int((s > 0.5) == (v > 0)) for s, v in zip(want, y)) > 0.97


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    rows = quality.op12(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert mean(int(r.predicted == r.quality) for r in rows) > 0.95


def test_quality_of_odd_rows_and_repeated_ids(spark, odd_docs):
    words = "some plain words of a text that is long enough. "
    rows = [(1000 + i, words * (1 + i % 5) if i % 2 else "@@ ## | " * 9) for i in range(300)] + [(1001, "another text"), (1003, None)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    labels = spark.createDataFrame([(i, int(i % 2), None, "x") for i, _ in rows] + [(None, 1, 0, "x"), (1001, 0, 0, "y"), (5, None, 0, "z")], "doc_id long, quality int, toxic int, score string")
    model = quality.fitted(docs, labels)
    again = quality.fitted(docs.orderBy(F.desc("doc_id")).repartition(3), labels)
    assert (model.rules, model.bias) == (again.rules, again.bias)
    scored = quality.with_quality(docs, model, ["doc_id", "text", "score"], "quality")
    got = [(r.doc_id, r.text, r.score, r.quality) for r in scored.collect()]
    plain = [(r.doc_id, r.text, r.score) for r in docs.collect()]
    full = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((g[:3] for g in got), key=full) == sorted(plain, key=full)
    assert all((q > 0.5) == bool(i % 2) for i, t, _, q in got if i and i > 1003)
    none = quality.fitted(docs.limit(0), labels)
    assert none.rules == [] and quality.with_quality(docs.limit(0), none, ["doc_id"]).count() == 0
