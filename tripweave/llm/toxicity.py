"""Toxic documents by a support vector machine on a gappy subsequence kernel.

Two strings are alike by the letter triples they share in order, gaps allowed:
a triple that spans ``g`` places counts ``DECAY ** g``, so "idxiot" and
"i-d-i-o-t" stay close to "idiot" while other words do not. Landmark words of
the training rows turn the kernel into a feature map (Nyström); a sentence has
for each landmark its best word, the machine is trained on sentences, and a
document scores by its worst sentence. In scripts without spaces between words
two neighbouring characters are a word, of three symbols each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECAY = 0.7
#: Triples that span more places than this count as nothing.
SPAN = 8
#: Words less alike than this to every landmark have no feature.
LEAST_LIKE = 0.55
LANDMARKS = 96
#: A landmark is less alike than this to those chosen before it.
ALIKE = 0.75
#: Bounds of the training sample: documents of each label, and characters of one.
TRAIN_DOCS = 1500
TRAIN_CHARS = 20_000
THRESHOLD = 0.7
#: A clean sentence called toxic costs as much as this many missed toxic ones.
CLEAN_COST = 4.0

_WINDOW = 24
_GAP = 31  # symbol of everything that is no letter
_CELLS = 500_000
_ROWS = 256  # texts whose words are held at a time
_LIKELY = 256  # words compared with all landmarks at a time
_EDGES = ".,;:!?\"'()#$%&*"
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_MAYBE_SPELLED = re.compile(r" \S \S ")
_MARKS = re.compile(r"([\W_])[\W_]+")

# Ideographs, kana and Hangul syllables, which stand without spaces between words or are many.
_WIDE_CHARS = "\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3040-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff"
_WIDE = re.compile(f"[{_WIDE_CHARS}]+")
_WITHIN_WIDE = re.compile(f"(?<=[{_WIDE_CHARS}])[^\\w\\s.!?]+(?=[{_WIDE_CHARS}])")
_MAYBE_WIDE = re.compile("[\u2e80-\U0003ffff]")
# Full-width forms of ASCII, and sentence ends.
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3002: ". ", 0xFF01: "! ", 0xFF1F: "? ", 0xFF61: ". ", 0x3000: " "}
_DIGITS = 0x1401  # syllabic letters from here on are symbols 0 to 30


def _alphabet() -> np.ndarray:
    """Symbols of code points: the letters a to z, five for other Latin letters, and any for those of other scripts."""
    codes = np.full(0x20001, _GAP, np.int32)
    for c in range(0x20000):
        if chr(c).isalpha():
            codes[c] = c - 97 if 97 <= c < 123 else 26 + c % 5 if c < 0x250 else c % _GAP
    codes[_DIGITS : _DIGITS + _GAP] = np.arange(_GAP)
    return codes


@cache
def _as_digits(c: str) -> str:
    """Three symbols for a character of a large script; they tell 29,791 in a row apart."""
    n = ord(c)
    return "".join(chr(_DIGITS + n // base % _GAP) for base in (1, _GAP, _GAP**2))


def _in_pairs(match: re.Match) -> str:
    run = [_as_digits(c) for c in match[0]]
    return " " + " ".join([a + b for a, b in zip(run, run[1:])] or run) + " "


def _widened(text: str) -> str:
    """Runs of ideographs and the like as words of two characters each, and marks between them left out."""
    return _WIDE.sub(_in_pairs, _WITHIN_WIDE.sub("", text.translate(_NARROW)))


_CODES = _alphabet()
_STEPS = [(i, j, DECAY ** (j + 1)) for i, j in combinations(range(1, SPAN), 2)]


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols below 32."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
    return _CODES[np.minimum(points, len(_CODES) - 1)]


def _triples(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all triples of each row; a triple with a gap symbol has code 0 and weight 0."""
    width = symbols.shape[1]
    firsts, seconds, thirds, weights = [], [], [], []
    for i, j, w in _STEPS:
        n = width - j
        if n > 0:
            at = np.arange(n)
            firsts.append(at), seconds.append(at + i), thirds.append(at + j), weights.append(np.full(n, w, np.float32))
    if not firsts:
        return np.zeros((len(symbols), 0), np.int32), np.zeros((len(symbols), 0), np.float32)
    a, b, c = (symbols[:, np.concatenate(x)] for x in (firsts, seconds, thirds))
    letters = (a != _GAP) & (b != _GAP) & (c != _GAP)
    return np.where(letters, a * 1024 + b * 32 + c, 0), np.where(letters, np.concatenate(weights), 0)


def _profile(word: str) -> np.ndarray:
    codes, weights = _triples(_letters([word]))
    return np.bincount(codes[0], weights[0], 32 * 1024)


def _self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """K(s, s) of each row: weights summed per triple, squared and summed."""
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1).astype(float)
    group = np.cumsum(np.diff(c, axis=1, prepend=-1) != 0, axis=1) - 1 + np.arange(len(c))[:, None] * c.shape[1]
    return (np.bincount(group.ravel(), w.ravel(), c.size).reshape(c.shape) ** 2).sum(axis=1)


@dataclass
class SubsequenceSvm:
    """Landmarks, the machine's weights on whitened kernel values, and a calibration."""

    landmarks: list[str]
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        profiles = np.array([_profile(w) for w in self.landmarks]).reshape(len(self.landmarks), 32 * 1024)
        self.norms = np.sqrt((profiles**2).sum(axis=1))
        scaled = profiles / self.norms[:, None] if len(profiles) else profiles
        self.table = np.ascontiguousarray(scaled.T, np.float32)
        self.best = self.table.max(axis=1) if len(profiles) else np.zeros(32 * 1024, np.float32)
        if not len(profiles):
            self.whiten = np.zeros((0, 0))
            return
        values, vectors = np.linalg.eigh(scaled @ scaled.T + 1e-3 * np.eye(len(scaled)))
        self.whiten = vectors / np.sqrt(values) @ vectors.T

    def alike(self, words: list[str]) -> dict[str, np.ndarray]:
        """Kernel values to the landmarks of each word that is alike enough to one."""
        by_length: dict[int, list[str]] = {}
        found: dict[str, np.ndarray] = {}
        windows: dict[str, list[str]] = {}
        for w in words:
            if 3 <= len(w) <= _WINDOW:
                by_length.setdefault(len(w), []).append(w)
            elif len(w) > _WINDOW:
                for at in range(0, len(w) - _WINDOW // 2, _WINDOW // 2):
                    windows.setdefault(w[at : at + _WINDOW], []).append(w)
        for part in windows:
            by_length.setdefault(len(part), []).append(part)
        for length, group in by_length.items():
            step = max(1, _CELLS // (len(_STEPS) * length))
            for at in range(0, len(group), step):
                self._alike(group[at : at + step], found)
        for part, owners in windows.items():
            if part in found:
                for w in owners:
                    found[w] = np.maximum(found[w], found[part]) if w in found else found[part]
        return found

    def _alike(self, words: list[str], found: dict[str, np.ndarray]) -> None:
        codes, weights = _triples(_letters(words))
        # no kernel value exceeds this sum; a third of the weights' norm bounds the divisor from below
        bound = (weights * self.best[codes]).sum(axis=1)
        likely = np.flatnonzero(bound > LEAST_LIKE * np.sqrt((weights**2).sum(axis=1)))
        for i in range(0, len(likely), _LIKELY):
            part = likely[i : i + _LIKELY]
            c, w = codes[part], weights[part]
            values = np.zeros((len(part), self.table.shape[1]), np.float32)
            row, col = np.nonzero(self.best[c] * w)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            values[row[first]] = np.add.reduceat(self.table[c[row, col]] * w[row, col][:, None], first, axis=0)
            values /= np.sqrt(np.maximum(_self_kernel(c, w), 1e-12))[:, None]
            for k in np.flatnonzero(values.max(axis=1) >= LEAST_LIKE):
                found[words[part[k]]] = np.where(values[k] >= LEAST_LIKE, values[k], 0)

    def sentences(self, text: str, alike: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Features of the sentences that hold a word alike to a landmark."""
        out = []
        for sentence in _SENTENCE.split(prepared(text)):
            hits = [alike[w] for w in words_of(sentence) if w in alike]
            if hits:
                out.append(np.max(hits, axis=0))
        return out

    def margin(self, sentences: list[np.ndarray]) -> float:
        """The largest decision value of a document's sentences; the bias if none has features."""
        if self.weights is None or not sentences:
            return self.bias
        return max(self.bias, float((np.array(sentences) @ self.whiten @ self.weights).max()) + self.bias)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def prepared(text: str) -> str:
    """Lower case, words spelled letter by letter written together, and ideographs in pairs."""
    text = text.lower()
    if _MAYBE_WIDE.search(text):
        text = _widened(text).lower()
    if _MAYBE_SPELLED.search(text):
        text = _SPELLED.sub(lambda m: m[0].replace(" ", ""), text)
    return text


def bare(word: str) -> str:
    """A word without marks around it and with one mark for several in a row."""
    word = word.strip(_EDGES)
    return word if word.isalnum() else _MARKS.sub(r"\1", word)


def words_of(sentence: str) -> list[str]:
    return [bare(w) for w in sentence.split()]


def _primal_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Squared hinge loss by Newton steps over the rows inside the margin; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(50):
        a = x[active] * cost[active][:, None]
        w = np.linalg.solve(penalty + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps."""
    x, theta = np.column_stack((margins, np.ones(len(margins)))), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _choose_landmarks(texts: list[str], labels: np.ndarray, wanted: int) -> list[str]:
    """Words that mark toxic rows most, by the z-score of their shares of rows, each unlike those before."""
    n = [max(1, int((labels == v).sum())) for v in (0, 1)]
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels):
        counts[label].update({w for w in words_of(prepared(text)) if 3 <= len(w) <= _WINDOW})
    rated = []
    for w, c in counts[1].items():
        if c >= 3:
            p = (c + counts[0][w] + 1) / (sum(n) + 2)
            rated.append(((c / n[1] - counts[0][w] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])), w))
    chosen: list[str] = []
    profiles: list[np.ndarray] = []
    for z, w in sorted(rated, key=lambda r: (-r[0], r[1])):
        if z < 4 or len(chosen) == wanted:
            break
        p = _profile(w)
        norm = np.sqrt(p @ p)
        if norm > 0 and all(p @ q < ALIKE * norm for q in profiles):
            chosen.append(w)
            profiles.append(p / norm)
    return chosen


def _toxic_ones(values: np.ndarray) -> np.ndarray:
    above = np.flatnonzero(values > 0)
    return above if len(above) else np.array([values.argmax()])


def disguises(word: str) -> list[str]:
    """The word with a separator at each inner place, and with one at all of them."""
    return [*(word[:i] + "*" + word[i:] for i in range(1, len(word))), "*".join(word)]


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> SubsequenceSvm:
    """Fit on whole labelled texts.

    Sentences of clean rows are examples of the clean class. Of each toxic row
    the sentences with a positive decision value are toxic examples, or else
    the one of largest value; the choice, at first all sentences, and the fit
    alternate until they settle. Landmarks that the fit
    calls toxic are then shown with inserted characters as well, as one more
    toxic sentence each, and it is repeated.
    """
    y = np.array(labels, int)
    model = SubsequenceSvm(_choose_landmarks(texts, y, landmarks))
    if not model.landmarks or len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model.bias, model.shift = 0.0, float(np.log(share / (1 - share)))
        return model
    alike = model.alike(list({w for t in texts for w in words_of(prepared(t))}))
    bags = [np.array(model.sentences(t, alike)).reshape(-1, len(model.landmarks)) @ model.whiten for t in texts]
    clean = [b for b, v in zip(bags, y) if v == 0 and len(b)]
    empty = np.zeros((1, len(model.landmarks)))
    negatives = np.vstack([*clean, empty])
    cost0 = np.full(len(negatives), CLEAN_COST)
    cost0[-1] = max(1, sum(v == 0 and not len(b) for b, v in zip(bags, y)))
    toxic = [b for b, v in zip(bags, y) if v == 1 and len(b)]
    picks = [np.arange(len(b)) for b in toxic]
    disguised = np.empty((0, len(model.landmarks)))
    for turn in range(10):
        positives = np.vstack([*(b[i] for b, i in zip(toxic, picks)), disguised]) if toxic else empty
        x = np.vstack((positives, negatives))
        target = np.concatenate((np.ones(len(positives)), -np.ones(len(negatives))))
        w = _primal_svm(x, target, np.concatenate((np.ones(len(positives)), cost0)))
        model.weights, model.bias = w[:-1], float(w[-1])
        again = [_toxic_ones(b @ model.weights + model.bias) for b in toxic]
        if turn and all(map(np.array_equal, again, picks)):
            break
        picks = again
        shown = [w for w in model.landmarks if model.margin([model.alike([w])[w]]) > 0.5]
        variants = [v for w in shown for v in disguises(w)]
        seen = model.alike(variants)
        disguised = np.array([seen[v] for v in variants if v in seen]).reshape(-1, len(model.landmarks)) @ model.whiten
    margins = np.array([max(model.bias, float((b @ model.weights).max()) + model.bias) if len(b) else model.bias for b in bags])
    model.slope, model.shift = _calibrate(margins, y)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, each: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """At most ``each`` labelled texts of either class, those of smallest id hash.

    An id with several labels is toxic if one says so, and has the least of its
    texts. Null texts and texts of
    more than ``TRAIN_CHARS`` characters are not trained on.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(each) for v in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x each ids
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= TRAIN_CHARS)
    rows = texts.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    found = sorted(rows.collect())
    return [r["text"] for r in found], [r["toxic"] for r in found]


class _Judged:
    """What a worker knows of words, kept from task to task and bounded in size."""

    MOST = 200_000
    _current: _Judged | None = None

    def __init__(self, model: SubsequenceSvm) -> None:
        self.model, self.landmarks = model, tuple(model.landmarks)
        self.plain: set[str] = set()
        self.hits: set[str] = set()
        self.alike: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, model: SubsequenceSvm) -> _Judged:
        if cls._current is None or cls._current.landmarks != tuple(model.landmarks):
            cls._current = cls(model)
        return cls._current

    def alike_among(self, words: list[set[str]]) -> set[str]:
        """Words, as they stand between white space, that are alike to a landmark."""
        if len(self.plain) > self.MOST:
            self.plain, self.hits, self.alike = set(), set(), {}
        new = set().union(*words) - self.plain - self.hits
        stripped = {w: bare(w) for w in new}
        self.alike.update(self.model.alike(list(set(stripped.values()) - self.alike.keys())))
        found = {w for w, b in stripped.items() if b in self.alike}
        self.hits |= found
        self.plain |= new - found
        return self.hits


def with_scores(docs: DataFrame, model: SubsequenceSvm, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and a double called ``name`` for every row; null and empty texts get the score of no words.

    Texts go to the workers once and nothing but scores comes back, whatever the columns hold.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = _Judged.of(model)
        for batch in batches:
            scores: list[float] = []
            for at in range(0, len(batch), _ROWS):
                texts = batch.slice(at, _ROWS).to_pylist()
                words = [set(prepared(t).split()) if t else set() for t in texts]
                hits = judged.alike_among(words)
                scores += [model.score(model.margin(model.sentences(t, judged.alike) if w & hits else [])) for t, w in zip(texts, words)]
            yield pa.array(scores, pa.float64())

    return docs.select(*columns, score("text").alias(name))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame) -> SubsequenceSvm:
    return train(*training_sample(docs, labels, ~held_out()))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose text scores below the threshold; columns are those of ``docs``."""
    scored = with_scores(docs, fitted(docs, labels), docs.columns, "_tox_score")
    return scored.where(F.col("_tox_score") < THRESHOLD).select(docs.columns)
