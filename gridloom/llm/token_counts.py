"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are cut at special strings and into pre-tokens; the distinct pre-tokens of a batch are one ragged numpy array of
byte symbols. In each round every pre-token applies its lowest-rank pair at all its places, leftmost first; the symbols
that survive are the tokens. (Where a merge makes a pair that ranks as early as itself or earlier, the word waits for the next round.)

Defined results: a null text counts as empty (0 bytes, 0 tokens). Special strings inside texts are one token each, as
the tokenizer file's library takes them by default. Rows with equal keys each get a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunked
from .common import slices
from .merging import Kept, MergeTable, merge

LIMIT = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE tokenizer file (without normalizer, prefix space, dropout or unknown token; others are refused)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        added = spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not plain:
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = [t["content"] for t in added]
        if any(re.search(r"\s", t) for t in self.special):
            raise ValueError("special strings with white space aren't supported")
        self._words = regex.compile(public_tokenizers.PATTERN)
        vocab = model["vocab"]
        stand_in = byte_symbols()
        self.of_byte = np.array([vocab[stand_in[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, into = (np.array([vocab[x] for x in col], np.int64) for col in ((a for a, _ in merges), (b for _, b in merges), (a + b for a, b in merges)))
        rank = np.arange(len(merges))
        self.table = MergeTable(left, right, rank, into, max(vocab.values()) + 1)
        self.kept = Kept(self._count_pieces, 250_000)

    def pre_tokens(self, piece: str) -> list[str]:
        return self._words.findall(piece)

    def _count_pieces(self, pieces: list[str]) -> list[int]:
        rows = [[] if p in self.special else self.pre_tokens(p) for p in pieces]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(w for row in rows for w in row))}
        raw = [w.encode("utf-8", "replace") for w in distinct]
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        counts = merge(self.table, symbols, np.array([len(r) for r in raw], np.int64))[1].tolist()
        return [int(p in self.special) if not row else sum(counts[distinct[w]] for w in row) for p, row in zip(pieces, rows, strict=True)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        distinct, codes, bounds = chunked(texts, self.special)
        ends = np.append(0, np.cumsum(np.array(self.kept.of(distinct), np.int64)[codes] if len(codes) else []))
        return np.diff(ends[bounds]).astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(os.fspath(tokenizer) if tokenizer else default_tokenizer())
        for batch in slices(batches, 1):
            n_bytes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(bpe.counts(batch.column(1)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
