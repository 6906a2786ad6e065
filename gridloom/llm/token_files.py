"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is a row of blocks, each of some documents whole, in ascending order of key over all files. A block has
- a header: magic, number of documents, number of ids, width of an id in bytes, first key, number of null keys, sizes;
- the keys, less the first one, as an Elias-Fano sequence;
- the documents' ends in the id array as an Elias-Fano sequence: low bits packed, high bits unary, and the place of every
  SELECT-th high bit, so that an offset is found without decoding those before it and without a table of 64-bit numbers;
- the ids, as 2-byte little-endian numbers where the vocabulary allows, else 4;
- a line feed, the last byte of each block.

Files are written by Spark's text writer (a block is a line, whatever bytes it has, and sizes in the header say where it ends)
and read as binary files, so they can be in any store that Spark reaches.

Defined results: null and empty texts have the end id alone. Rows with equal keys stay separate rows, ordered by a hash of the text;
rows with a null key come first. Extra columns are ignored; an empty table writes no block and reads as no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import chunked, gathered
from .common import fresh_path, slices, written
from .merging import Kept
from .token_counts import default_tokenizer

END_ID = 2
#: Ids or documents after which a block is closed (a document is never split), and blocks in a file at most.
BLOCK_IDS, BLOCK_DOCS, FILE_BLOCKS = 1 << 20, 1 << 16, 8
SELECT = 256
_MAGIC = b"GLTOK1\r\n"
_HEAD = struct.Struct("<8sQQBqQII")


class EliasFano:
    """A non-decreasing sequence of non-negative integers; [i] selects one of them."""

    _SIZES = struct.Struct("<QQB")

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.top, self.width, self._low, self._high, self._places = n, top, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.empty((n, width), np.uint8)
        for k in range(width):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> width) + n + 1 if n else 0, np.uint8)
        high[place] = 1
        return cls(n, top, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), place[::SELECT].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self._SIZES.pack(self.n, self.top, self.width) + self._places.tobytes() + self._low.tobytes() + self._high.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> EliasFano:
        n, top, width = cls._SIZES.unpack_from(data)
        at = cls._SIZES.size
        n_places, n_low, n_high = -(-n // SELECT), -(-n * width // 8), -(-((top >> width) + n + 1) // 8) if n else 0
        places = np.frombuffer(data, "<u4", n_places, at)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * n_places)
        high = np.frombuffer(data, np.uint8, n_high, at + 4 * n_places + n_low)
        return cls(n, top, width, low, high, places)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._places[i // SELECT]), i % SELECT
        byte, skip = at >> 3, at & 7
        while True:
            some = np.unpackbits(self._high[byte : byte + 64], bitorder="little")[skip:]
            ones = np.flatnonzero(some)
            if left < len(ones):
                place = byte * 8 + skip + int(ones[left])
                break
            left, byte, skip = left - len(ones), byte + 64, 0
        bit = i * self.width
        span = np.unpackbits(self._low[bit >> 3 : (bit + self.width + 7) >> 3], bitorder="little")[bit & 7 :][: self.width]
        return (place - i << self.width) | sum(int(b) << k for k, b in enumerate(span))

    def some(self, begin: int, stop: int) -> np.ndarray:
        """The numbers begin..stop-1. Select finds the first one's high bit, and no more is decoded than lies between it and the last one's."""
        begin, stop = max(0, begin), min(stop, self.n)
        if begin >= stop:
            return np.zeros(0, np.int64)
        at = int(self._places[begin // SELECT])
        after = -(-stop // SELECT)
        until = int(self._places[after]) if after < len(self._places) else 8 * len(self._high)
        bits = np.unpackbits(self._high[at >> 3 : (until + 7) >> 3], bitorder="little")
        skip = begin // SELECT * SELECT
        place = np.flatnonzero(bits[at & 7 :])[begin - skip : stop - skip] + at
        out = (place - np.arange(begin, stop)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            first = begin * self.width
            low = np.unpackbits(self._low[first >> 3 : (stop * self.width + 7) >> 3], bitorder="little")[first & 7 :][: (stop - begin) * self.width].reshape(-1, self.width)
            for k in range(self.width):
                out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out.astype(np.int64)


class Encoder:
    """Texts to ids by the tokenizers library; equal pieces, cut where no token crosses, are encoded once."""

    #: New words that are encoded in one string.
    JOINED = 100

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Words come here once, so the library's own cache of them only costs.
        if hasattr(self._tokenizer.model, "_resize_cache"):
            self._tokenizer.model._resize_cache(0)
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", s) for s in self.special):
            raise ValueError("a special string with white space would be cut")
        # Tokens that begin with a space: in byte-level vocabularies it stands as U+0120.
        self._spaced = np.array([(self._tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(size)])
        self.kept = Kept(self._encode, 120_000)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Words with a space before them go in strings of many, which is far cheaper: their tokens part at the spaces."""
        out = [b""] * len(pieces)
        words = [k for k, p in enumerate(pieces) if _WORD.fullmatch(p)]
        apart = set(words)
        rest = [k for k, p in enumerate(pieces) if p and k not in apart]
        for k, ids in zip(rest, self._ids([pieces[k] for k in rest]), strict=True):
            out[k] = ids.tobytes()
        if words:
            ids = np.concatenate(self._ids(["".join([pieces[k] for k in words[a : a + self.JOINED]]) for a in range(0, len(words), self.JOINED)]))
            begins = np.flatnonzero(self._spaced[ids])
            if len(begins) != len(words):
                raise ValueError("this tokenizer doesn't end its tokens before spaces")
            data, w = ids.tobytes(), self.width
            for k, a, b in zip(words, (begins * w).tolist(), (np.append(begins[1:], len(ids)) * w).tolist(), strict=True):
                out[k] = data[a:b]
        return out

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and where each text ends among them."""
        distinct, codes, bounds = chunked(texts, self.special)
        known = self.kept.of(distinct)
        known.append(np.array([end], self.kind).tobytes())
        sizes = np.array([len(x) for x in known], np.int64) // self.width
        codes = np.insert(codes, bounds[1:], len(known) - 1)
        ids = np.frombuffer(b"".join(known), self.kind)[gathered(codes, np.cumsum(sizes) - sizes, sizes)]
        return ids, np.cumsum(sizes[codes])[bounds[1:] + np.arange(len(texts))]


#: A word with a space before it and no other white space.
_WORD = re.compile(r" \S+")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_block(keys: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One block. keys ascend, nulls first."""
    known = np.array([k for k in keys if k is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    key_part = EliasFano.of(known.astype(np.uint64) - np.uint64(first % (1 << 64))).to_bytes()
    end_part = EliasFano.of(ends).to_bytes()
    head = _HEAD.pack(_MAGIC, len(ends), len(ids), ids.itemsize, first, len(keys) - len(known), len(key_part), len(end_part))
    return head + key_part + end_part + ids.tobytes()


class Block:
    """A block that was read; offsets come from select, ids are a view."""

    def __init__(self, data: memoryview):
        magic, self.n_docs, self.n_ids, self.width, self._first, self._nulls, n_keys, n_ends = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("no token block begins here")
        at = _HEAD.size
        self._keys, self.ends = EliasFano.read(data[at : at + n_keys]), EliasFano.read(data[at + n_keys : at + n_keys + n_ends])
        at += n_keys + n_ends
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)
        self.size = at + self.n_ids * self.width + 1

    def key(self, i: int) -> int | None:
        return None if i < self._nulls else self._first + self._keys[i - self._nulls]

    def keys(self, begin: int, stop: int) -> list[int | None]:
        """Of the documents begin..stop-1."""
        nulls = max(0, min(stop, self._nulls) - begin)
        return [None] * nulls + (self._keys.some(max(0, begin - self._nulls), max(0, stop - self._nulls)) + self._first).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def blocks(content: bytes) -> Iterator[Block]:
    at, view = 0, memoryview(content)
    while at < len(content):
        block = Block(view[at:])
        yield block
        at += block.size


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END_ID, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, block_docs: int = BLOCK_DOCS) -> None:
    """Encodes docs and writes token files, ascending in key over file numbers. The texts are moved once, by ranges of the key and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(os.fspath(tokenizer) if tokenizer else default_tokenizer())
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            packed = pack_block(keys, np.concatenate(held), np.cumsum(np.concatenate(sizes)))
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

        for batch in slices(batches, 1):
            ids, ends = encode(batch.column(1), end)
            names, row = batch.column(0).to_pylist(), 0
            while row < len(names):
                # Up to the document with which the block is full.
                done = int(ends[row - 1]) if row else 0
                stop = min(int(np.searchsorted(ends, done + block_ids - n)) + 1, row + block_docs - len(keys), len(names))
                keys += names[row:stop]
                held.append(ids[done : int(ends[stop - 1])])
                sizes.append(np.diff(ends[row:stop], prepend=done))
                n, row = n + len(held[-1]), stop
                if n >= block_ids or len(keys) >= block_docs:
                    yield block()
                    keys, held, sizes, n = [], [], [], 0
        if keys:
            yield block()

    # By a hash of the text as well, so that the rows of one key, or without a key, are dealt to many tasks.
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    made = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids before the document over all files), n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers).

    The files are read once; offsets inside a block come from select, SELECT documents at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    number = [F.regexp_extract("path", r"part-(\d+)-.*?-c(\d+)", k).cast("long").alias(n) for k, n in ((1, "part"), (2, "file"))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                before = 0
                for block in blocks(content.as_py()):
                    last = 0
                    for k in range(0, block.n_docs, SELECT):
                        ends = block.ends.some(k, k + SELECT)
                        ids = block.ids[last : int(ends[-1])].astype("<u4")
                        sizes = np.diff(ends, prepend=last)
                        at = (ends - sizes - last).tolist()
                        crc = [zlib.crc32(ids[a : a + n].data) for a, n in zip(at, sizes.tolist(), strict=True)]
                        held = len(sizes)
                        yield pa.RecordBatch.from_arrays([pa.array([part] * held), pa.array([file] * held), pa.array(block.keys(k, k + held), pa.int64()), pa.array(ends - sizes + before), pa.array(sizes), pa.array(crc, pa.int64())], names=["part", "file", key, "at", "n_tokens", "ids_crc32"])
                        last = int(ends[-1])
                    before += block.n_ids

    made = written(files.select(*number, "content").mapInArrow(rows, f"part long, file long, {key} long, at long, n_tokens long, ids_crc32 long"), "offsets")
    # Two small prefix sums: over the files of a part, and over the parts of the written job.
    per_file = made.groupBy("part", "file").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    per_part = per_file.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = per_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("p"))
    in_part = per_file.select("part", "file", (F.sum("n").over(W.partitionBy("part").orderBy("file")) - F.col("n")).alias("f"))
    base = in_part.join(before_part, "part").select("part", "file", (F.col("p") + F.col("f")).alias("base"))
    return made.join(base, ["part", "file"]).select(key, (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what read_tokens() finds in them."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
