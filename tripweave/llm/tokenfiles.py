"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 has the lowest chunk of every
id, level 1 the next chunk of those ids that need one, and so on; a bitmap of
each level says whose code goes on, and a rank directory counts its ones up to
each block. Token ``i`` is read by its chunk on level 0 and, while the bit is
set, by the rank of the bit on the next level, without decoding any other.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.sources import scratch_path

MAGIC = b"DAC1"
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: A file is closed when it holds this many tokens.
FILE_TOKENS = 4_000_000
_BLOCK = 512  # bits between two entries of the rank directory
_MOST_CACHED = 1_000_000
_FINAL = "!#$%&*,.;:?)"
_MARK, _LINE = "\0", 64  # new pieces are encoded in lines of so many, with marks between


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Bytes of one file: ids of the documents, where each begins, and the levels."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, np.uint8)
        padded[: len(more)] = more
        ones = np.concatenate(([0], np.cumsum(padded.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint32)))).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ones.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    head = MAGIC + struct.pack("<QB", len(doc_ids), len(levels))
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.tobytes(), *levels])


class TokenFile:
    """One file's bytes, read at random or as a whole."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.docs, count = struct.unpack_from("<QB", data, 4)
        at = 13
        known = np.frombuffer(data, np.uint8, self.docs, at)
        numbers = np.frombuffer(data, "<i8", self.docs, at + self.docs)
        self.doc_ids = [int(n) if k else None for n, k in zip(numbers, known)]
        at += 9 * self.docs
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(data, "<u4", -(-n // _BLOCK) + 1, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * len(ranks)

    def token(self, i: int) -> int:
        """The ``i``-th id of the file."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            before = bits[block * _BLOCK >> 3 : i >> 3]
            part = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + part.bit_count()
            shift += 8
        return value

    def all_tokens(self) -> np.ndarray:
        below = None
        for chunks, bits, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            if below is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
                values[more] |= below << np.uint32(8)
            below = values
        return below


class _Known(dict):
    """Ids of parts as bytes; an unknown part is noted and stands for itself."""

    def __init__(self) -> None:
        super().__init__({"": b""})
        self.missed: list[str] = []

    def __missing__(self, part: str) -> str:
        self.missed.append(part)
        return part


class _Encoder:
    """Ids of whole texts; what stands between spaces and line ends is encoded once and kept.

    The tokenizer joins nothing across white space, nor most letters with the
    ASCII punctuation that ends a part (the tokenizer is asked about each
    letter beyond ASCII), so the ids of a text are those of its pieces. The
    memory of pieces is bounded.
    """

    _current: dict[str, _Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.known = _Known()
        self.apart: dict[str, bool] = {}

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls._current:
            cls._current[path] = cls(path)
        return cls._current[path]

    def _stands_apart(self, letter: str) -> bool:
        """No punctuation mark after ``letter`` is joined with it or with a mark that it leaves when normalised."""
        if letter not in self.apart:
            shape, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            ends = [f"{letter}{mark}" for mark in _FINAL]
            whole = [cut.pre_tokenize_str(shape.normalize_str(end) if shape else end) for end in ends]
            self.apart[letter] = all(len(found) == 2 and found[1][1][1] - found[1][1][0] == 1 for found in whole)
        return self.apart[letter]

    def _pieces(self, part: str) -> tuple[str, ...]:
        """A part without its final ASCII punctuation, and that, where a letter that stands apart comes before it."""
        if "<|" in part:  # may hold control strings, which are matched as they stand
            return (part,)
        body = part.rstrip(_FINAL)
        if part.isascii():
            part, body = part.lower(), body.lower()
        if not body or len(body) == len(part) or not body[-1].isalpha():
            return (part,)
        return (body, part[len(body) :]) if body[-1].isascii() or self._stands_apart(body[-1]) else (part,)

    def _learn(self, missed: set[str]) -> None:
        split = {part: self._pieces(part) for part in missed}
        new = list({piece for pieces in split.values() for piece in pieces if piece not in self.known})
        odd = [piece for piece in new if _MARK in piece]
        plain = [piece for piece in new if _MARK not in piece] if odd else new
        lines = [plain[at : at + _LINE] for at in range(0, len(plain), _LINE)]
        encode = self.tokenizer.encode_batch_fast
        for at in range(0, len(lines), 256):
            some = lines[at : at + 256]
            for line, code in zip(some, encode([f" {_MARK} ".join(x) for x in some], add_special_tokens=False)):
                ids = np.array(code.ids, "<u4")
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
                data, start = ids.tobytes(), 0
                for piece, end in zip(line, ends.tolist()):
                    self.known[piece] = data[start:end]
                    start = end + 4
        for piece, code in zip(odd, encode(odd, add_special_tokens=False) if odd else ()):
            self.known[piece] = np.array(code.ids, "<u4").tobytes()
        for part, pieces in split.items():
            if len(pieces) > 1 or pieces[0] != part:
                self.known[part] = b"".join(map(self.known.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > _MOST_CACHED:
            self.known = _Known()
        known = self.known
        found = [list(map(known.__getitem__, _parts(t))) for t in texts]
        if known.missed:
            self._learn(set(known.missed))
            known.missed = []
            found = [[v if v.__class__ is bytes else known[v] for v in values] for values in found]
        end = struct.pack("<I", END_ID)
        return [np.frombuffer(b"".join([*values, end]), "<u4") for values in found]


def _parts(text: str | None) -> list[str]:
    text = text or ""
    if text.isascii() and "<|" not in text:  # the vocabulary is of lower case; its control strings are not
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write ids of all texts in the order of doc_id; returns the files (``part, n, file, n_docs, n_tokens``).

    Rows of one id go by a hash of their text, null ids come first, and a null
    text has the end id alone. A task writes files under new names and only
    the files named in the result count, so a repeated task leaves no trace in it.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _Encoder.of(tokenizer), TaskContext.get().partitionId()
        store, folder = _filesystem(path)
        store.create_dir(folder, recursive=True)
        kept: tuple[list, list] = ([], [])
        number = tokens = 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(name) as out:
                out.write(encode_file(kept[0], [len(x) for x in kept[1]], np.concatenate(kept[1])))
            row = [[part], [number], [name], [len(kept[0])], [tokens]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "n", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    kept[0].append(doc_id)
                    kept[1].append(ids)
                    tokens += len(ids)
                    if tokens >= FILE_TOKENS:
                        yield close()
                        kept, number, tokens = ([], []), number + 1, 0
        if kept[0]:
            yield close()

    return rows.mapInArrow(write, "part long, n long, file string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``files`` (from :func:`write_token_files`)."""
    before = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, so ordering them all is bounded by the number of files
    placed = files.select("part", "n", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, files.count()), "file").select("file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(name) as source:
                    data = TokenFile(source.read())
                ids, at = data.all_tokens().astype("<u4"), data.starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
                columns = [pa.array(data.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = scratch_path(spark, "tokens"), scratch_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, folder, public_tokenizers.path(VOCABULARY)).write.parquet(manifest)
    return read_token_files(spark.read.parquet(manifest), folder)
