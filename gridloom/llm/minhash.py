"""Near-duplicate documents by MinHash, banding, and connected components.

1. sketch(): a pass over the texts gives every document the size of its shingle set, a digest of the set, band keys and a
   byte of each minimum (one universal hash function each).
2. Documents with equal sets become one class (an aggregation); only class representatives go on.
3. A band key shared by several representatives makes a bucket. No bucket is expanded into pairs: first every member is
   held only against the first member of each of its buckets (that of the least doc_id, likely what the others were made from), the likeliest one by signature is confirmed on the full
   sets, and the links give components.
4. Members of buckets that hold several components are banded once more, by FINE bands of FINE_ROWS minima, so that only likely
   texts meet. In a fine bucket, members outside its most frequent component meet the others: signatures first, then the full sets of those that
   have a like one. A bucket of up to BLOCK is one block, a row a member; a larger one is dealt to SIDES blocks a side at most, so its rows grow with its
   members, not with their pairs. Of a block only the members that ask are held. No link between components is lost, whatever the bucket's size.
5. Components come from alternating large-star and small-star steps. Classes that share a doc_id are linked as well.

Misses are those of the method alone: with 32 bands of 4 rows, a pair at similarity 0.8 shares no band with probability
5e-8; the signature check (80 of 128 for 0.8) and the fine bands each turn away a pair at 0.8 with probability 1e-6. Tables that grow
with the input are joined by sorting and merging only, so none goes through the driver.

Defined results: null or empty texts, and texts without words, have the size 0 and are linked with nothing; a text of
fewer words than a shingle has its whole sequence as its one shingle. Rows with equal doc_id count as one document, which
has the links of each of its texts, and each row gets its result. A null doc_id is its own class: component_id null, kept false. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import merged, numbered, slices, written

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Members of a bucket that are compared in one group before it is dealt to several, and groups that a side is dealt to at most.
BLOCK, SIDES = 1024, 8
#: Fine bands, and the minima of each: a pair at 0.8 shares none of them with probability 1e-6.
FINE, FINE_ROWS = 124, 10
#: Edges of a partition while components are found.
EDGES = 100_000
#: Rows, and bytes of texts or sets, that a stored file has at least where a table is in several.
FILE_ROWS, FILE_BYTES = 4000, 8 << 20
#: Words whose hash a worker keeps.
_KEPT_WORDS = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FINE_PLACES = _rng.permuted(np.tile(np.arange(HASHES), (FINE, 1)), axis=1)[:, :FINE_ROWS]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size, self._hashes = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
        if len(self._hashes) > _KEPT_WORDS:
            self._hashes = {}
        kept, digest = self._hashes, xxhash.xxh3_64_intdigest
        h = np.fromiter((kept[w] if w in kept else kept.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 32 high bits of the least value of each hash function."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(low, (_MUL[:, None] * shingles[None, k : k + 512] + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


_SKETCH = "doc_id long, place long, n_shingles long, digest binary, bands array<long>, sig binary"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def sketch(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """doc_id, place (order, or the key), n_shingles, digest of the set (null when empty), band keys, and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        band = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in slices(batches, 1):
            out: list = [batch.column(0), batch.column(2), [], [], [], []]
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                out[2].append(len(s))
                if len(s):
                    low = minima(s)
                    keys = band.copy()
                    for row in low.reshape(BANDS, ROWS).T:
                        keys = _mix(keys + row.astype(np.uint64))
                    out[3].append(xxhash.xxh3_128_digest(s.tobytes()))
                    out[4].append(keys.view(np.int64))
                    out[5].append((low & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    for column in out[3:]:
                        column.append(None)
            yield pa.RecordBatch.from_arrays([*out[:2], *(pa.array(c, t) for c, t in zip(out[2:], _SKETCH_ARROW.types[2:], strict=True))], schema=_SKETCH_ARROW)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.col(order or key).cast("long").alias("o")).mapInArrow(run, _SKETCH)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Of (id, digest, text): id and the full set, sorted 64-bit shingle hashes as bytes, of each text whose set has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in slices(batches, 2):
            sets = [shingles(t).tobytes() for t in batch.column(2).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"]).filter(own)

    return texts.select("id", "digest", F.col("text").cast("string")).mapInArrow(run, "id long, shingles binary")


def similar(n_common: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * n_common >= percent * (n_a + n_b - n_common)


def least_agreement(percent: int) -> int:
    """Equal minima that a pair at the similarity falls short of with probability 1e-6 only."""
    p = percent / 100
    return max(1, math.floor(HASHES * p - 4.75 * math.sqrt(HASHES * p * (1 - p))))


def _sets_similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    return similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a row each, no grouping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = [_sets_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return merged(merged(pairs.select("a", "b"), left, "a"), right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _files(rows: int, size: int = 0) -> int:
    """Files that a table with as many rows and bytes is stored in at most. Its partitions may be hundreds, and then it would be mostly files, whose making costs
    more than the rows: on a local disk Hadoop starts several processes for each, and while one starts it shares all of the executor's memory."""
    return max(1, -(-rows // FILE_ROWS), -(-size // FILE_BYTES))


def _edges(df: DataFrame, parts: int) -> tuple[DataFrame, int, int]:
    """Edges (u, v) stored, with their number and the sum of their hashes, counted as they are written."""
    seen = Observation()
    counts = [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")]
    made = written(df.select("u", "v").observe(seen, *counts).coalesce(parts), "edges")
    return made, seen.get["n"], int(seen.get["h"])


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, component) of every linked id, component being the least id reachable: alternating large-star and small-star. parts: files of the links at most.

    A step groups to a minimum with partial sums and joins it back, so a node with very many neighbours is never
    gathered; the edges of each round are written. Rounds end when the edge set stays the same.
    """
    parts = parts or int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges, *before = _edges(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), parts)
    while before[0]:
        # Files follow the number of edges: a small graph in hundreds of partitions would be mostly files.
        parts = max(1, -(-before[0] // EDGES))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large has u > v throughout, so the smaller neighbours of u are its v
        met = merged(large, large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, *after = _edges(small.select("e.u", "e.v").where("u <> v").distinct(), parts)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """pairs (a, b) with the number of equal signature bytes, where that is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, HASHES) for c in ("x", "y"))
            same = (x == y).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64())], names=["a", "b", "same"])
            yield out.filter(pa.array(same >= least))

    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    return merged(merged(pairs, left, "a"), right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same long")


def _streamed(rows: DataFrame, keys: list[str], columns: list[str], group, schema: str) -> DataFrame:
    """What group() makes of each group of equal keys, those that ask first; groups are cut from sorted partitions, which is far cheaper than a call of
    its own for each of very many small groups. Its add() takes a piece of the group, its end() is called after the last; both give lists of rows of longs."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out: list[tuple] = []
            at = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            data = [batch.column(c).to_pylist() for c in columns]
            begin = 0
            for k in range(1, len(at) + 1):
                if k == len(at) or at[k] != at[begin]:
                    if at[begin] != last:
                        out += held.end() if held else []
                        last, held = at[begin], group(at[begin])
                    out += held.add(*(d[begin:k] for d in data))
                    begin = k
            yield _longs(out, names)
        if held:
            yield _longs(held.end(), names)

    return rows.select(*dict.fromkeys([*keys, *columns])).repartition(*keys).sortWithinPartitions(*keys, F.desc("asks")).mapInArrow(run, schema)


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    data = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in data], names=names)


def _count_to(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _blocks(key: str, of: str, salt: int) -> tuple[Column, Column]:
    """The number of blocks for a count, and the block of a key."""
    n = F.least(F.ceil(F.col(of) / BLOCK), F.lit(SIDES)).cast("int")
    return n, F.pmod(F.xxhash64(key, F.lit(salt)), n).cast("int")


def _meetings(near: DataFrame) -> DataFrame:
    """(band, p, q, asks, id, component): near's members (band, id, component) in the blocks of their band in which they meet.

    Members outside a band's most frequent component ask all others. asks: 2 asks and is asked (in a band that is one block), 1 asks, 0 is asked.
    """
    parts = near.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"))
    main = main.select("band", F.col("m.component").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("n_odd"))
    sized, odd = merged(near, main, "band"), F.col("component") != F.col("main")
    (blocks, own), (odd_blocks, own_odd) = _blocks("id", "n", 0), _blocks("id", "n_odd", 1)
    as_other = F.transform(_count_to(odd_blocks), lambda k: F.struct(k.alias("p"), own.alias("q"), F.lit(0).alias("asks")))
    as_odd = F.transform(_count_to(blocks), lambda k: F.struct(own_odd.alias("p"), k.alias("q"), F.lit(1).alias("asks")))
    dealt = sized.where(F.col("n") > BLOCK).select("band", "id", "component", F.explode(F.when(odd, F.concat(as_other, as_odd)).otherwise(as_other)).alias("g"))
    whole = sized.where(F.col("n") <= BLOCK).select("band", F.lit(0).alias("p"), F.lit(0).alias("q"), F.when(odd, 2).otherwise(0).alias("asks"), "id", "component")
    return whole.unionByName(dealt.select("band", "g.p", "g.q", "g.asks", "id", "component"))


def fine_keys(sigs: np.ndarray) -> np.ndarray:
    """FINE band keys of each signature (rows of bytes), each of other FINE_ROWS of its bytes."""
    keys = np.broadcast_to(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(sigs), FINE))
    for k in range(FINE_ROWS):
        keys = _mix(keys + sigs[:, _FINE_PLACES[:, k]].astype(np.uint64))
    return keys.view(np.int64)


def _fine_rows(members: DataFrame) -> DataFrame:
    """(band, id, component): FINE rows for each member (id, component, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                keys = fine_keys(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, HASHES))
                each = [pa.array(np.repeat(part.column(k).to_numpy(), FINE), pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), *each], names=["band", "id", "component"])

    return members.select("id", "component", "sig").mapInArrow(run, "band long, id long, component long")


class _Block:
    """A block's members that ask, against which the others are held piece by piece, as they come."""

    def __init__(self, here: tuple, least: int):
        self.here, self.least = here, least
        self.asks, self.ids, self.comps, self.sigs = [], [], [], []

    def take(self, asks: list, ids: list, comps: list, sigs: list) -> list[int]:
        """Holds those that ask; the places in the piece of those that are asked."""
        for k, a in enumerate(asks):
            if a:
                self.asks.append(a), self.ids.append(ids[k]), self.comps.append(comps[k]), self.sigs.append(sigs[k])
        return [k for k, a in enumerate(asks) if a != 1]

    def like(self, others: list[int], comps: list, sigs: list) -> Iterator[tuple[int, list[int]]]:
        """Each held one's place, and the places of others of the piece that are of another component and have a like signature, likest first.
        Two documents that share several fine bands are looked at in the first of them (here) alone."""
        if not others or not self.ids:
            return
        table = np.frombuffer(b"".join([sigs[k] for k in others]), np.uint8).reshape(-1, HASHES)
        keys, of = None, np.array([comps[k] for k in others])
        for k, sig in enumerate(self.sigs):
            own = np.frombuffer(sig, np.uint8)
            same = (table == own).sum(axis=1)
            at = np.flatnonzero((same >= self.least) & (of != self.comps[k]))
            if len(at):
                keys = fine_keys(table) if keys is None else keys
                mine = fine_keys(own[None, :])
                at = at[mine[0, (keys[at] == mine).argmax(axis=1)] == self.here[0]]
            if len(at):
                yield k, [others[m] for m in at[np.argsort(-same[at], kind="stable")].tolist()]


class _LikeBlock(_Block):
    """(band, p, q, asks, id, component) of the members with a like one in the block."""

    def __init__(self, here: tuple, least: int):
        super().__init__(here, least)
        self.kept: set[int] = set()

    def add(self, asks: list, ids: list, comps: list, sigs: list) -> list[tuple]:
        found: set[int] = set()
        for k, at in self.like(self.take(asks, ids, comps, sigs), comps, sigs):
            self.kept.add(self.ids[k])
            found.update(at)
        # One that asks as well is told at the end.
        self.kept.update(ids[k] for k in found if asks[k])
        return [(*self.here, 0, ids[k], comps[k]) for k in sorted(found) if not asks[k]]

    def end(self) -> list[tuple]:
        return [(*self.here, a, i, c) for a, i, c in zip(self.asks, self.ids, self.comps, strict=True) if i in self.kept]


class _LinkBlock(_Block):
    """(a, b): each that asks with one member of each other component whose full set is similar enough."""

    def __init__(self, here: tuple, least: int, percent: int):
        super().__init__(here, least)
        self.percent, self.sets, self.done = percent, [], set()

    def add(self, asks: list, ids: list, comps: list, sigs: list, sets: list) -> list[tuple]:
        self.sets += [np.frombuffer(x, np.uint64) for x, a in zip(sets, asks, strict=True) if a]
        out = []
        for k, found in self.like(self.take(asks, ids, comps, sigs), comps, sigs):
            for j in found:
                if (k, comps[j]) not in self.done and _sets_similar(self.sets[k], np.frombuffer(sets[j], np.uint64), self.percent):
                    self.done.add((k, comps[j]))
                    out.append((min(self.ids[k], ids[j]), max(self.ids[k], ids[j])))
        return out

    def end(self) -> list[tuple]:
        return []


def _links_between(members: DataFrame, sigs: DataFrame, sets: DataFrame, labels: DataFrame, least: int, percent: int, parts: int) -> DataFrame:
    """(a, b): links between components. members: (band, id). A document is linked with one member of each component that is similar enough in a block.

    No pair is a row, and full sets go only to the blocks in which a signature is like theirs.
    """
    named = merged(members, labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    inner = merged(named, mixed, "band", "left_semi").select("id", "component").distinct()
    spots = written(_fine_rows(merged(inner, sigs.select("id", "sig"), "id")).coalesce(parts), "spots")
    spread = spots.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    near = written(merged(spots, spread, "band", "left_semi").coalesce(parts), "near")
    place = ["band", "p", "q"]
    rows = merged(_meetings(near), sigs.select("id", "sig"), "id")
    kept = _streamed(rows, place, ["asks", "id", "component", "sig"], lambda here: _LikeBlock(here, least), "band long, p long, q long, asks long, id long, component long")
    kept = written(kept.coalesce(parts), "like")
    full = merged(kept, sets.join(kept.select("id").distinct().hint("merge"), "id", "left_semi"), "id")
    return _streamed(merged(full, sigs.select("id", "sig"), "id"), place, ["asks", "id", "component", "sig", "shingles"], lambda here: _LinkBlock(here, least, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs. `order` says which texts are looked at first (else the key); results don't depend on it."""
    seen = Observation()
    counts = [F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")]
    sketches = written(sketch(docs, shingle, key, text, order).observe(seen, *counts), "sketches")
    parts = _files(seen.get["n"])
    sound = sketches.where("digest is not null and doc_id is not null")
    # A class of equal sets, whose bands and signatures are equal: partial minima, whatever its size. Its number is stored, so it stays the same.
    classes = sound.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("place").alias("place"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()).coalesce(parts), "classes")
    rows = classes.select(F.explode(F.array_distinct("bands")).alias("band"), "id", "place")
    # Null places, if any, come last.
    lead = F.min(F.struct(F.col("place").isNull(), "place", "id"))["id"].alias("lead")
    buckets = rows.groupBy("band").agg(lead, F.count("*").alias("n")).where("n > 1").select("band", "lead")
    members = written(merged(rows.drop("place"), buckets, "band").select("band", "id", "lead").coalesce(parts), "buckets")
    within = written(members.select("id").distinct().coalesce(parts), "within")
    shared = merged(classes.select("id", "rep", "digest", "sig"), within, "id", "left_semi")
    sigs = written(shared.select("id", "sig").coalesce(parts), "signatures")
    reps = shared.select("id", F.col("rep").alias("doc_id"), "digest")
    texts = merged(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), reps, "doc_id")
    texts = texts.groupBy("doc_id", "id", "digest", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sets = written(shingle_sets(texts, shingle).coalesce(_files(seen.get["n"], 8 * seen.get["shingles"])), "sets")
    least = least_agreement(percent)

    pairs = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    likely = _agreeing(pairs, sigs, least).groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    named = written(merged(sound.select("doc_id", "digest"), classes.select("digest", "id"), "digest").select("doc_id", "id").distinct().coalesce(parts), "named")
    several = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    of_one = merged(named, several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    labels = components(confirmed(likely, sets, percent).unionByName(of_one), parts)
    more = written(_links_between(members.select("band", "id"), sigs, sets, labels, least, percent, parts).coalesce(parts), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), parts)
    # The least doc_id of each component, given to its classes by a join that Spark splits where a component holds very many.
    own = merged(classes.select("id", "rep"), labels, "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    lowest = own.groupBy("component").agg(F.min("rep").alias("_c"), F.count("*").alias("n")).where("n > 1").select("component", "_c")
    found = merged(own, lowest, "component", "left").select("id", F.coalesce("_c", "rep").alias("_c"))
    component = merged(named, found, "id").groupBy("doc_id").agg(F.min("_c").alias("_c"))
    out = merged(sketches.select("doc_id", "n_shingles"), component, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"), F.coalesce(F.coalesce("_c", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least key, null keys last.

    Rows count one by one, whatever their keys: of repeated rows one stays. Rows without words are linked with nothing and stay.
    """
    seen = Observation()
    sizes = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c, kind in docs.dtypes if kind in ("string", "binary")]
    rows, row = numbered(docs.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0)).alias("size")), "rows")
    parts = _files(seen.get["n"])
    found = written(near_duplicates(rows, shingle, percent, row, text, key).select(F.col("doc_id").alias("row"), "component_id").coalesce(parts), "found")
    named = merged(found, rows.select(F.col(row).alias("row"), F.col(key).alias("k")), "row")
    groups = written(named.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("k").isNull(), "k", "row")).alias("m")).where("n > 1").coalesce(parts), "groups")
    out = merged(found.where("row <> component_id").select("row").unionByName(groups.select(F.col("component_id").alias("row"))), groups.select(F.col("m.row").alias("row")), "row", "left_anti")
    return merged(rows, out.withColumnRenamed("row", row), row, "left_anti").select(docs.columns).coalesce(_files(seen.get["n"], seen.get["size"]))


#: DuckDB SQL for the rows of op6, from the contract's own words: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w)=1 THEN w[1] ELSE w[k]||' '||w[k+1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-1,1)+1)) AS k FROM d WHERE len(w)>0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT x,y FROM p JOIN n na ON na.doc_id=x JOIN n nb ON nb.doc_id=y WHERE 100*i>=80*(na.n+nb.n-i)),
e AS (SELECT x,y FROM l UNION SELECT y,x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x=r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n,0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c=d.doc_id AS kept FROM d LEFT JOIN n USING(doc_id) JOIN m USING(doc_id)
"""
