"""FeatureCollections of any size, read by many tasks.

A collection is one JSON value, which a JSON reader gives to one task. Here the file is read as text that is cut at every closing
brace, which Spark splits by byte ranges like any text. What a split holds depends on what lies before it: whether it
begins inside a string, and how deep in brackets. So each split is summed up first, for both cases (is it in a string at its end, how
much deeper, how shallow in between); a row for each split is put in order, and then every split knows how it begins. A second pass
takes the objects of depth three out, which are the features; what one split begins and another ends is put together by the split it began in.

Defined results: objects in other arrays of the collection, and anything in a feature that looks like one, are no features. A file that ends in
the middle of a feature gives all features before it. Braces in strings, escaped quotes, line feeds and spaces anywhere are fine. Files
without a feature, and empty ones, give no rows. A null or missing geometry is a null one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a split that are looked at together.
_CHUNK = 1 << 20
_ESCAPE = re.compile(rb"\\.", re.S)
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
#: Depth of a feature's own braces: in the array of the collection.
_OUTER = 2


def _depths(data: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside of strings, the change of depth at each, and whether the end is in a string."""
    raw = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
    quotes = np.cumsum(raw == 34)
    inside = (quotes + in_string) % 2 == 1
    at = np.flatnonzero((_STEP[raw] != 0) & ~inside)
    return at, _STEP[raw[at]].astype(np.int64), bool((int(quotes[-1]) + in_string) % 2) if len(raw) else in_string


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, begin of the split), bytes) in order, about _CHUNK bytes at once. Each row ends in the brace that it was cut at."""
    key, held, size = None, [], 0
    for batch in batches:
        for value, file, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, begin) != key or size > _CHUNK:
                if held:
                    yield key, b"".join(held)
                key, held, size = (file, begin), [], 0
            held.append(value.encode("utf-8", "surrogatepass") + b"}")
            size += len(held[-1])
    if held:
        yield key, b"".join(held)


_SUMS = "file string, begin long, odd boolean, up0 long, low0 long, up1 long, low1 long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether it has an odd number of quotes, and for a begin outside (0) and inside (1) of a string how much deeper it ends and the least depth in it."""
    rows: dict[tuple[str, int], list] = {}
    for key, data in _chunks(batches):
        now = rows.setdefault(key, [[False, 0, 0], [True, 0, 0]])
        for state in now:
            at, step, state[0] = _depths(data, state[0])
            if len(at):
                depth = state[1] + np.cumsum(step)
                state[1], state[2] = int(depth[-1]), min(state[2], int(depth.min()))
    out = [(*k, a[0], a[1], a[2], b[1], b[2]) for k, (a, b) in rows.items()]
    columns = list(zip(*out, strict=True)) if out else [()] * 7
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the splits of all files in order: how each begins, and in which split the feature began that is open there."""
    file, inside, depth, owner = None, False, 0, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["file"] != file:
                file, inside, depth, owner = r["file"], False, 0, None
            out.append((file, r["begin"], inside, depth, owner))
            up, low = (r["up1"], r["low1"]) if inside else (r["up0"], r["low0"])
            if depth + low <= _OUTER or owner is None:
                owner = r["begin"]
            depth, inside = depth + up, inside != r["odd"]
            if depth <= _OUTER:
                owner = None
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "begin", "inside", "depth", "owner"])


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(feature): the JSON text of each feature of the collections at the path, on one line."""
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    # A row for each split: their number follows the files' sizes divided by a partition's.
    order = text.mapInArrow(_sums, _SUMS).repartition(1).sortWithinPartitions("file", "begin")
    begins = order.mapInArrow(_begins, "file string, begin long, inside boolean, depth long, owner long").collect()
    known = {(r.file, r.begin): (r.inside, r.depth, r.owner) for r in begins}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, inside, depth, owner, part = None, False, 0, None, []
        begin_of = None

        def row(owner_: int | None, file: str, begin: int, pieces: list[bytes], closes: bool, whole: bool) -> tuple:
            return file, owner_, begin, b"".join(pieces).replace(b"\n", b" ").replace(b"\r", b" ").decode("utf-8", "replace"), closes, whole

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "owner", "begin", "text", "closes", "whole"])

        for key, data in _chunks(batches):
            rows: list[tuple] = []
            if key != last:
                if part:
                    rows.append(row(begin_of, *last, part, False, False))
                last, part = key, []
                inside, depth, owner = known[key]
                begin_of = owner if depth > _OUTER else None
            at, step, end_inside = _depths(data, inside)
            after = depth + np.cumsum(step)
            # Objects and arrays of depth three; only objects can be features.
            opens, closes = at[(step > 0) & (after == _OUTER + 1)].tolist(), (at[(step < 0) & (after == _OUTER)] + 1).tolist()
            place = 0
            if depth > _OUTER:  # something that began before this chunk
                part.append(data[: closes[0]] if closes else data)
                if closes:
                    if data[closes[0] - 1] == 125:
                        rows.append(row(begin_of, *key, part, True, begin_of == key[1]))
                    part, place, begin_of = [], 1, None
            ends = closes[place:]
            for k, start in enumerate(opens):
                if data[start] == 123 and k < len(ends):
                    rows.append(row(key[1], *key, [data[start : ends[k]]], True, True))
                elif k >= len(ends):
                    part, begin_of = [data[start:]], key[1]
            depth, inside = depth + int(step.sum()), end_inside
            yield batch_of(rows)
        if part:
            yield batch_of([row(begin_of, *last, part, False, False)])

    pieces = text.mapInArrow(cut, "file string, owner long, begin long, text string, closes boolean, whole boolean")
    features = pieces.where("whole").select(F.col("text").alias("feature"))
    if all(owner is None for _, _, owner in known.values()):
        return features  # no split begins inside a feature, so none was cut
    # Of a feature that was cut there are as many rows as splits that it lies in. They alone are moved: whole ones are taken from a look of their own at the text.
    cut_ones = pieces.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("p"), F.bool_or("closes").alias("closed")).where("closed")
    return features.unionByName(cut_ones.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("feature")))


def write_collections(features: DataFrame, path: str, feature: str = "feature", most: int | None = None) -> None:
    """A FeatureCollection for each partition of a table of feature texts. most: features of a collection at most, each then a compressed file of its own, as small ones needn't be split."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            lines = []
            for f in batch.column(0).to_pylist():
                if n == most:
                    lines.append("]}")
                    n = 0
                lines.append(("," if n else '{"type": "FeatureCollection", "features": [') + f)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"], pa.string())], names=["value"])

    # All lines of a full collection, the last of which closes it, are one file.
    options = {"maxRecordsPerFile": most + 1, "compression": "gzip"} if most else {}
    features.select(feature).mapInArrow(framed, "value string").write.options(**options).text(path)
