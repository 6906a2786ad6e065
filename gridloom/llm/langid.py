"""Language identification by multilingual mixtures.

A document is a mixture of languages: each of its character n-grams was drawn from one language's n-gram distribution,
languages being drawn by the document's proportions. Expectation-maximisation estimates the proportions; the language
set is chosen by penalised likelihood (each further language costs half the logarithm of the number of n-grams): the
likeliest single language, or a set on the way from the proportions over all languages to their best one, best two and so on.
The logarithm of a mixture's likelihood is concave, so its slope at a single language bounds what any mixture can gain on it;
where that is less than a second language costs, the single one is the answer without any rounds.

The n-gram distributions are learnt from a bounded sample of labelled documents: for each language at most TRAIN_ROWS distinct texts,
those that come first by a hash. Their whole texts count. A model has NUMBERS numbers at most: up to 128 languages
have a column of 65,536 cells each, and with every doubling of the languages beyond that cells are joined two and two, so their number is
bounded only by the smallest useful column (LEAST_CELLS: 32,768 languages; more labels aren't languages and are an error).

Defined results: a null text, or one without a letter, is `und` with score 0 (no languages). A row whose n-grams say
nothing (all unseen) takes the language that is likeliest beforehand. Without any labelled row identify() says `und` of everything, and
in_a_language() keeps every text with a letter: where no language is known, none can be missed.
Ties go to the language that comes first in order. Extra columns of the input are ignored; rows with equal keys each get a row.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

#: Labelled texts of each language that are learnt from, at most.
TRAIN_ROWS = 1500
#: n-grams are hashed to so many cells, fewer where a model would have more than so many numbers, and so many at least.
CELLS, NUMBERS, LEAST_CELLS = 1 << 16, 1 << 23, 1 << 8
#: The share of a document that its main language has at least, for the document to be in a language.
LEAST_SHARE = 1 / 3
ORDERS = (1, 2, 3)
EM_ROUNDS = 25
_LETTER = regex.compile(r"\p{L}")
_DROP = regex.compile(r"[^\p{L}\p{M}]+")


def grams(text: str) -> np.ndarray:
    """Cells of all n-grams of the words of a text, lower-cased, a space on either side of a word."""
    words = _DROP.sub(" ", unicodedata.normalize("NFC", text).lower())
    codes = np.frombuffer(f" {words.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(out)


def cells_for(languages: int) -> int:
    """Cells of a column: a power of two."""
    if languages * LEAST_CELLS > NUMBERS:
        raise ValueError(f"more than {NUMBERS // LEAST_CELLS} languages")
    return min(CELLS, 1 << ((NUMBERS // max(1, languages)).bit_length() - 1))


def counted(text: str, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text) // (CELLS // cells), minlength=cells)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # cells x languages
    prior: np.ndarray

    def mixture(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document's proportions over its chosen languages (0 elsewhere), and the number of them by penalised likelihood."""
        p = self.likelihood[at]
        informed = p.max(axis=1) > 1.001 * p.min(axis=1)
        p, n = p[informed], n[informed]
        total = n.sum()
        if not total:
            return self.prior, np.array([int(self.prior.argmax())])
        cost = 0.5 * np.log(total)
        single = n @ np.log(p)
        best = int(single.argmax())
        chosen, share, fit = np.array([best]), np.ones(1), single[best]
        if (n @ (p / p[:, [best]])).max() - total > cost:
            start = _em(p, n, np.full(len(self.languages), 1 / len(self.languages)))
            order = np.argsort(-start, kind="stable")
            before = single[order[0]]
            for k in range(2, len(order) + 1):
                sub = p[:, order[:k]]
                w = _em(sub, n, start[order[:k]] + 1e-9)
                now = float(n @ np.log(sub @ w)) - cost * (k - 1)
                if now <= before:
                    break
                before = now
                if now > fit:
                    fit, chosen, share = now, order[:k], w
        out = np.zeros(len(self.languages))
        out[chosen] = share
        return out, chosen

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, []
        share, chosen = self.mixture(*counted(text, len(self.likelihood)))
        best = int(share.argmax())
        return self.languages[best], float(min(1.0, share[best])), sorted(self.languages[k] for k in chosen)

    def accepts(self, text: str | None, wanted: frozenset[str] | None = None, least: float = LEAST_SHARE) -> bool:
        """Whether the text's main language is one of the wanted (of all learnt, if None) and has the least share of it."""
        if not self.languages:
            return bool(text and _LETTER.search(text))
        name, score, _ = self.predict(text)
        return name != "und" and score >= least and (wanted is None or name in wanted)


def _em(p: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    w = w / w.sum()
    for _ in range(EM_ROUNDS):
        part = p * w
        new = (n / part.sum(axis=1)) @ part
        new /= new.sum()
        if np.abs(new - w).max() < 1e-4:
            return new
        w = new
    return w


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most `rows` texts of each non-null language. What reaches the driver is a count for each language and cell."""
    labelled = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(NUMBERS // LEAST_CELLS + 1).collect()
    languages = sorted(r["lang"] for r in sizes)
    cells, number = cells_for(len(languages)), {name: k for k, name in enumerate(languages)}
    # A part of each language by hash that has the wanted number of texts and some more; the rest is cut from that.
    parts = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (rows + 8 * rows**0.5 + 10) / r["n"])) for r in sizes], "lang string, part double")
    near = labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(parts), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30))
    near = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _LETTER.search(t):
                    at, n = counted(t, cells)
                    held.setdefault(number[name], np.zeros(cells))[at] += n
        for k, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int64()), pa.array(at), pa.array(own[at].astype(np.int64))], names=["lang", "cell", "n"])

    counts = np.zeros((cells, len(languages)))
    found = sample.select("lang", "text").mapInArrow(count, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # At most NUMBERS rows of three numbers, as columns.
    table = found.toArrow()
    counts[table.column(1).to_numpy(), table.column(0).to_numpy()] = table.column(2).to_numpy()
    known = counts.sum(axis=0) > 0
    languages, counts = [name for name, k in zip(languages, known.tolist(), strict=True) if k], counts[:, known]
    total = counts.sum(axis=0) if languages else np.ones(0)
    used = max(1, int((counts.sum(axis=1) > 0).sum())) if languages else 1
    return Model(languages, (counts + 0.5) / (total + 0.5 * used), total / total.sum() if languages else total)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's estimated share of the document) and the chosen languages, a row for each row."""
    # The model has a bounded size: NUMBERS at most.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 1):
            rows = [m.predict(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _OUT.types[1:], strict=True))], schema=_OUT)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def held_out(key: str = "doc_id"):
    """The contract's rule: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def is_held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 4 == 2


def learnt(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()))


def in_a_language(docs: DataFrame, model: Model, text: str = "text", wanted: frozenset[str] | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs in whose text a (wanted) language is found that has the least share of it, with all their columns and no others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.accepts(t, wanted, least) for t in texts], dtype="boolean")

    return docs.where(found(F.col(text).cast("string")))
