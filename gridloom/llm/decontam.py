"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search clusters do it: a segment holds some documents whole and, for every
term in them, the sorted list of the term's positions. Every training token has its posting. A query visits each segment
once; in it, a phrase starts from the postings of its rarest term, shifts each list by the term's offset in the phrase
and intersects list after list, from rare to frequent. A term that stands in a third of all documents therefore costs
no more in one segment than in another, no list is ever gathered over segments, and no postings are shuffled. Proximity
matches come from the same postings: stretches of at most NEAR times an item's number of words that hold all its words in any order.
Test texts go to the segments in blocks of QUERY_BYTES at most, one at a time; a single longer text is a block of its own.

Defined results: a null or empty text has no words; its row has counts 0, no items, and isn't contaminated. Rows with
equal doc_id each get a row, and so do rows with a null doc_id. Null item_id or items without words have no windows. Empty tables give empty results. Extra
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, written

#: Words: digits, a-z and everything beyond ASCII; A-Z count as a-z. In UTF-8 that is a table over bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX_SCHEMA = "doc_ids binary, no_ids binary, digests binary, doc_starts binary, terms binary, term_starts binary, gaps binary"
#: Tokens after which a segment is closed. A document is never split, so a longer one makes a longer segment.
SEGMENT_TOKENS = 1_000_000
#: Bytes of test texts that go to the executors at once; more are taken in blocks of about this size.
QUERY_BYTES = 4 << 20
WINDOW = 13
#: Words of a stretch that counts as a proximity match, for each word of the item.
NEAR = 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _segment(doc_ids: list[int | None], digests: list[bytes], docs: list[list[bytes]]) -> dict[str, bytes]:
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in docs for w in words), np.int32)
    post = np.argsort(flat, kind="stable").astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(ids)))]).astype(np.int32)
    gaps = np.diff(post, prepend=np.int32(0))
    first = starts[:-1]
    gaps[first] = post[first]
    return {
        "doc_ids": np.array([k or 0 for k in doc_ids], np.int64).tobytes(),
        "no_ids": bytes(k is None for k in doc_ids),
        "digests": b"".join(digests),
        "doc_starts": np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int32).tobytes(),
        "terms": b" ".join(ids),
        "term_starts": starts.tobytes(),
        "gaps": gaps.astype(np.int32).tobytes(),
    }


_INDEX_ARROW = pa.schema([(n.split()[0], pa.binary()) for n in INDEX_SCHEMA.split(", ")])


def digest_of(text: str) -> Column:
    """16 bytes by which a row's text is known beside its doc_id."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The index segments of docs, not yet stored. A null key is kept as such."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        digests: list[bytes] = []
        held: list[list[bytes]] = []
        n = 0
        for batch in slices(batches, 1):
            for key_, text_, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text_)
                ids.append(key_)
                digests.append(digest)
                held.append(words)
                n += len(words)
                if n >= segment_tokens:
                    yield pa.RecordBatch.from_pylist([_segment(ids, digests, held)], _INDEX_ARROW)
                    ids, digests, held, n = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, digests, held)], _INDEX_ARROW)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string"), digest_of(text).alias("digest")).mapInArrow(build, INDEX_SCHEMA)


def store_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The index of docs, written to the shared folder, each segment with a number by which it and its documents are known from then on."""
    return written(build_index(docs, key, text, segment_tokens).withColumn("segment", F.monotonically_increasing_id()), "postings")


class _Segment:
    """A stored segment, opened for the terms of a query."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.number = row["segment"]
        self.doc_ids = [None if no else k for k, no in zip(np.frombuffer(row["doc_ids"], np.int64).tolist(), row["no_ids"], strict=True)]
        self.digests = [row["digests"][k : k + 16] for k in range(0, len(row["digests"]), 16)]
        self.doc_starts = np.frombuffer(row["doc_starts"], np.int32)
        starts, self._gaps = np.frombuffer(row["term_starts"], np.int32), np.frombuffer(row["gaps"], np.int32)
        self._at = np.full(len(vocabulary) + 1, -1, np.int64)
        self.count = np.zeros(len(vocabulary) + 1, np.int64)
        for at, term in enumerate(row["terms"].split(b" ")):
            if (k := vocabulary.get(term)) is not None and term:
                self._at[k], self.count[k] = starts[at], starts[at + 1] - starts[at]
        self._lists: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        if term not in self._lists:
            at = self._at[term]
            self._lists[term] = np.cumsum(self._gaps[at : at + self.count[term]])
        return self._lists[term]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the phrase starts, by intersecting shifted lists from the rarest term on."""
        order = np.argsort(self.count[terms], kind="stable")
        at = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                return at
            other, want = self.postings(terms[k]), at + k
            near = np.searchsorted(other, want)
            at = at[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] == want)]
        at = at[at >= 0]
        doc = self.documents(at)
        return at[at + len(terms) <= self.doc_starts[doc + 1]]

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Smallest stretches (start, end) of at most `span` words of one document that hold all the terms."""
        terms = np.unique(terms)
        order = terms[np.argsort(self.count[terms], kind="stable")]
        anchor = self.postings(order[0])
        for k in order[1:]:
            other = self.postings(k)
            low, high = np.searchsorted(other, anchor - span + 1), np.searchsorted(other, anchor + span)
            anchor = anchor[high > low]
        if not len(anchor):
            return []
        # Every stretch ends at an occurrence of some term: the latest occurrence of each other term before it starts it.
        ends = np.unique(np.concatenate([self.postings(k) for k in order]))
        close = np.searchsorted(anchor, ends - span + 1) < np.searchsorted(anchor, ends + 1)
        ends = ends[close]
        begin = np.full(len(ends), np.iinfo(np.int64).max)
        for k in order:
            other = self.postings(k)
            last = np.searchsorted(other, ends, "right") - 1
            begin = np.minimum(begin, np.where(last >= 0, other[np.maximum(last, 0)], -1))
        ok = (begin >= 0) & (ends - begin < span) & (self.documents(np.maximum(begin, 0)) == self.documents(ends))
        begin, ends = begin[ok], ends[ok]
        keep = np.ones(len(ends), bool)  # of stretches with one start only the shortest
        keep[1:] = begin[1:] != begin[:-1]
        return list(zip(begin[keep].tolist(), ends[keep].tolist(), strict=True))


class Phrases:
    """A block of phrases over one vocabulary; equal phrases are looked for once."""

    def __init__(self, phrases: Iterable[tuple[int, list[bytes]]], vocabulary: dict[bytes, int] | None = None):
        self.vocabulary: dict[bytes, int] = {} if vocabulary is None else vocabulary
        self.owners: dict[tuple[int, ...], list[int]] = {}
        for owner, words in phrases:
            if words:
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
                held = self.owners.setdefault(key, [])
                if not held or held[-1] != owner:
                    held.append(owner)
        by: dict[int, list[tuple[int, ...]]] = {}
        for key in self.owners:
            by.setdefault(len(key), []).append(key)
        self.by_length = {n: np.array(keys, np.int64) for n, keys in by.items()}

    def present(self, segment: _Segment) -> Iterator[np.ndarray]:
        for rows in self.by_length.values():
            yield from rows[(segment.count[rows] > 0).all(axis=1)]


def windows(item_words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """All runs of `size` words, or the whole item where it is shorter."""
    return [item_words[k : k + size] for k in range(max(1, len(item_words) - size + 1))] if item_words else []


def _blocks(tests: DataFrame, key: str, text: str, limit: int) -> tuple[int, Iterator[list[tuple[int, list[bytes]]]]]:
    """The number of blocks, and the test texts in blocks of about `limit` bytes, each small enough to be sent to every executor.

    With several blocks, what a block gives is to be stored before the next is taken: the driver holds one at a time.
    """
    tests = tests.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    n = max(1, -(-int(tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // limit))

    def each() -> Iterator[list[tuple[int, list[bytes]]]]:
        for block in range(n):
            part = tests.where(F.pmod(F.xxhash64("k"), F.lit(n)) == block) if n > 1 else tests
            yield [(r.k, words_of(r.t)) for r in part.orderBy("k", "t").toLocalIterator()]

    return n, each()


def phrase_matches(index: DataFrame, tests: DataFrame, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(key, doc_id, start, length): every exact occurrence of each test text as a phrase; start counts words from 0."""
    out = None
    n, blocks = _blocks(tests, key, text, query_bytes)
    for block in blocks:
        phrases = Phrases(block)

        def find(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for segment in _opened(batches, phrases.vocabulary):
                rows = []
                for terms in phrases.present(segment):
                    at = segment.phrase(terms)
                    for doc, start in zip(segment.documents(at).tolist(), at.tolist(), strict=True):
                        rows += [(owner, segment.doc_ids[doc], start - int(segment.doc_starts[doc]), len(terms)) for owner in phrases.owners[tuple(terms.tolist())]]
                yield _rows(rows, [key, "doc_id", "start", "length"])

        part = index.mapInArrow(find, f"{key} long, doc_id long, start long, length long")
        part = written(part, "hits") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def proximity_matches(index: DataFrame, tests: DataFrame, span: int, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(key, doc_id, start, length): smallest stretches of at most `span` words that hold all words of a test text, in any order."""
    out = None
    n, blocks = _blocks(tests, key, text, query_bytes)
    for block in blocks:
        phrases = Phrases(block)

        def find(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for segment in _opened(batches, phrases.vocabulary):
                rows = []
                for terms in phrases.present(segment):
                    for start, end in segment.near(terms, span):
                        doc = int(segment.documents(np.array([start]))[0])
                        rows += [(owner, segment.doc_ids[doc], start - int(segment.doc_starts[doc]), end - start + 1) for owner in phrases.owners[tuple(terms.tolist())]]
                yield _rows(rows, [key, "doc_id", "start", "length"])

        part = index.mapInArrow(find, f"{key} long, doc_id long, start long, length long")
        part = written(part, "hits") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _opened(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[_Segment]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Segment({c: batch.column(c)[row].as_py() for c in batch.schema.names}, vocabulary)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_HITS = "segment long, place long, doc_id long, digest binary, n_words long, spans array<struct<start:long,stop:long>>, items array<long>, near array<long>"
_HITS_ARROW = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])


def contamination(index: DataFrame, tests: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """A row for each indexed document: doc_id, digest of its text, n_words, hit spans (start, stop in words, merged), the test items
    found, and those with a proximity match (near).

    Everything about a document lies in its segment, so a block of tests needs no shuffle; with several blocks each block's
    hits are stored before the next block is made, and the rows of a document are put together by a grouping on the document's
    place in the index.
    """
    parts = []
    n_blocks, blocks = _blocks(tests, key, text, query_bytes)
    for block in blocks:
        phrases = Phrases((item, w) for item, words in block for w in windows(words, window))
        wholes = Phrases(block, phrases.vocabulary)

        def find(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases, wholes: Phrases = wholes) -> Iterator[pa.RecordBatch]:
            for segment in _opened(batches, phrases.vocabulary):
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                for terms in wholes.present(segment):
                    starts = [start for start, _ in segment.near(terms, NEAR * len(terms))]
                    for doc in set(segment.documents(np.array(starts, np.int64)).tolist()):
                        near.setdefault(doc, set()).update(wholes.owners[tuple(terms.tolist())])
                for terms in phrases.present(segment):
                    at = segment.phrase(terms)
                    owners = phrases.owners[tuple(terms.tolist())]
                    for doc, start in zip(segment.documents(at).tolist(), at.tolist(), strict=True):
                        spans.setdefault(doc, []).append((start, start + len(terms)))
                        items.setdefault(doc, set()).update(owners)
                rows = []
                sizes = np.diff(segment.doc_starts).tolist()
                for doc, (doc_id, digest, n) in enumerate(zip(segment.doc_ids, segment.digests, sizes, strict=True)):
                    base, merged = int(segment.doc_starts[doc]), []
                    for start, stop in sorted(spans.get(doc, ())):
                        if merged and start <= merged[-1]["stop"] + base:
                            merged[-1]["stop"] = max(merged[-1]["stop"], stop - base)
                        else:
                            merged.append({"start": start - base, "stop": stop - base})
                    found = {"spans": merged, "items": sorted(items.get(doc, ())), "near": sorted(near.get(doc, ()))}
                    rows.append({"segment": segment.number, "place": doc, "doc_id": doc_id, "digest": digest, "n_words": n, **found})
                yield pa.RecordBatch.from_pylist(rows, _HITS_ARROW)

        part = index.mapInArrow(find, _HITS)
        if n_blocks == 1:
            return part
        # Equal doc_ids in one index must not merge: a document is known by its place in its stored segment.
        # The first block has a row for each document, so of the others only hits are needed.
        parts.append(written(part.where("size(spans) > 0 or size(near) > 0") if parts else part, "hits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    grouped = out.groupBy("segment", "place", "doc_id", "digest", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), all_of("items"), all_of("near"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).stop,"
        " concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop))), concat(acc, array(x))))"
    )
    return grouped.select("segment", "place", "doc_id", "digest", "n_words", merged.alias("spans"), "items", "near")


def report(hits: DataFrame, *also: str) -> DataFrame:
    """The rule: contaminated where some word is hit and the hit words are a twentieth of all words or more. n_near: items with a proximity match."""
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)")
    named = F.array_join(F.array_sort(F.expr("transform(items, x -> cast(x as string))")), ",")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        *also,
    )


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """report() for docs against the test texts, through a stored index."""
    return report(contamination(store_index(docs), tests, window))


def without_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, each by the result of its own text: equal or null doc_ids don't touch other rows."""
    found = report(contamination(store_index(docs), tests, window), "digest").where("contaminated")
    id_, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    bad = found.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct()
    return docs.join(bad, (F.col(digest) == digest_of("text")) & F.col(id_).eqNullSafe(F.col("doc_id").cast("long")), "left_anti").select(docs.columns)


#: DuckDB SQL for the rows of op2, from the contract's own words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w),13) AS n, array_to_string(w[k:k+least(len(w),13)-1],' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w)-13,0)+2)) AS k FROM i WHERE len(w)>0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k+n-1],' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS k FROM d, (SELECT DISTINCT n FROM iw) ns WHERE len(w)>=n)),
hit AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n=iw.n AND dw.g=iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k+n)) AS p FROM hit) GROUP BY doc_id),
dp AS (SELECT doc_id, w[p] AS g, p FROM (SELECT doc_id, w, unnest(range(1, len(w)+1)) AS p FROM d)),
ig AS (SELECT item_id, len(w) AS n, unnest(list_distinct(w)) AS g, len(list_distinct(w)) AS m FROM i WHERE len(w)>0),
has AS (SELECT doc_id, ig.item_id FROM (SELECT DISTINCT doc_id, g FROM dp) t JOIN ig USING(g) GROUP BY doc_id, ig.item_id, ig.m HAVING count(*)=ig.m),
sp AS (SELECT has.doc_id, has.item_id, ig.g, dp.p, ig.m, ig.n FROM has JOIN ig USING(item_id) JOIN dp ON dp.doc_id=has.doc_id AND dp.g=ig.g),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT x.doc_id, x.item_id FROM sp x JOIN sp y ON y.doc_id=x.doc_id AND y.item_id=x.item_id AND y.p>x.p-NEAR*x.n AND y.p<=x.p
  GROUP BY x.doc_id, x.item_id, x.p, x.m HAVING count(DISTINCT y.g)=x.m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items,
 sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(d.w) AS contaminated, CAST(coalesce(n_near,0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING(doc_id) LEFT JOIN its USING(doc_id) LEFT JOIN near USING(doc_id)
""".replace("NEAR", str(NEAR))
