"""Secrets in texts: known forms, and strings that a tokenizer cannot shorten.

Common words take few tokens of a byte-pair vocabulary, random strings take
nearly one for each character or two. A string of letters, digits or both with few
characters a token is a secret, unless it has the form of a digest, a UUID or a
plain number. What is glued to words by separators is tested apart from them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Candidates have at least so many characters, and at most so many a token.
LEAST_CHARS = 20
MOST_CHARS_A_TOKEN = 2.0

KINDS = ("assign", "access", "hex", "dense")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:sha\d+[-:=]?)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_NUMBER = re.compile(r"[0-9+/_=-]+")
#: Digests and UUIDs between separators; they are no secrets, and what is beside them is tested without them.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|" + _DIGEST.pattern + r")(?![A-Za-z0-9])"
)
_PART = re.compile(r"[A-Za-z0-9]+")
#: A run of parts that is not the whole candidate has a part of so many characters.
LEAST_PART = 8


@cache
def tokenizer(path: str):
    """The vocabulary of a tiktoken rank file, once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the known forms, leftmost and not overlapping within a kind."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of hex digits is matched whole, so asking for 24 at once drops the short ones
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _is_dense(s: str, encoding) -> bool:
    return len(s) <= MOST_CHARS_A_TOKEN * len(encoding.encode_ordinary(s))


def _dense_runs(s: str, encoding) -> Iterator[tuple[int, int]]:
    """Dense strings of ``s``: the whole, or else its longest runs of dense parts between separators."""
    if len(s) < LEAST_CHARS or _NUMBER.fullmatch(s):
        return
    if _is_dense(s, encoding):
        yield 0, len(s)
        return
    run: list[tuple[int, int]] = []
    parts = [m.span() for m in _PART.finditer(s)]
    for at in [*parts, None]:
        if at is not None and (_is_dense(s[slice(*at)], encoding) and not s[slice(*at)].isdigit() or (run and s[slice(*at)].isdigit())):
            run.append(at)
            continue
        while run and s[slice(*run[-1])].isdigit():
            run.pop()
        if run:
            joined = s[run[0][0] : run[-1][1]]
            if len(joined) >= LEAST_CHARS and max(b - a for a, b in run) >= LEAST_PART and _is_dense(joined, encoding):
                yield run[0][0], run[-1][1]
            else:
                yield from ((a, b) for a, b in run if b - a >= LEAST_CHARS)
        run = []


def dense_spans(text: str, encoding, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of few characters a token that meet no known form, digest, identifier or number.

    Known forms, digests, UUIDs and numbers inside a candidate are cut out, and
    what is left is tested piece by piece.
    """
    found = []
    for m in _CANDIDATE.finditer(text):
        s, start, end = m[0], m.start(), m.end()
        met = [(a - start, b - start) for a, _, b in base if start < b and a < end]
        if not met and not _KNOWN.search(s) and not _NUMBER.fullmatch(s) and _is_dense(s, encoding):
            found.append((start, 3, end))
            continue
        at = 0
        for a, b in [*sorted(met + [k.span() for k in _KNOWN.finditer(s)]), (len(s), len(s))]:
            found += [(start + at + x, 3, start + at + y) for x, y in _dense_runs(s[at : max(at, a)], encoding)]
            at = max(at, b)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base (spans), spans`` for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind. A null text is empty. ``vocabulary`` is the path of a rank file
    that all executors can open.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = dense_spans(text, tokenizer(path), base)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), _joined(base), _joined(base + more)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
