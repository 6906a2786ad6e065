"""Ranked lexical search that scores each bag of words once.

1. A pass over the texts turns every document into its number of terms and its bag: the numbers of the item terms in it with
   how often each occurs. Terms that no item has are counted and dropped.
2. Counts give N and L, each item term's document frequency and weight, and each document's m.
3. Documents with equal bag and m have equal scores for every item: they become one class, dealt by a hash and told apart by the bag
   itself. Of a class only the `k` least doc_ids can be in a list of k, and Spark drops the others before they are shuffled.
4. Every class is scored once against all items, term by term over the items that hold the term. A task keeps each item's k best
   classes, gives out their members by ascending doc_id, and a last ranking joins the tasks' lists.

Items come in blocks of QUERY_BYTES of text at most; each block is a search of its own over all documents, so what goes to the
executors is bounded. Weights and document frequencies are a number for each term of a block.

Defined results: a null text has no terms, and isn't among the N. Repeated rows are ranked each for itself, equal scores by ascending
doc_id, null ids (and the greatest 64-bit number, given out as null) last. Rows of equal (or null) item_id are one item with the terms of all of them; items without a term that a document
has give no rows. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, written

#: Hits of an item, the percentage of a document's m that follows its length, and the saturation of term counts.
HITS, LENGTH, SATURATION = 50, 50, 2
#: Terms: digits, letters and everything beyond ASCII; A-Z count as a-z. In UTF-8 that is a table over bytes; 0 divides.
_TABLE = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)), np.uint8)
#: Bytes of item texts that go to the executors at once.
QUERY_BYTES = 2 << 20
#: Bytes of bags that are scored at once at most, and scores of a table of classes by items.
_BAGS, _CELLS = 4 << 20, 1 << 21
#: Marks a null doc_id in order.
_LAST = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in turn, and the number of each text's."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _TABLE[np.frombuffer(memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])], np.uint8)]
    offsets = offsets - offsets[0]
    inside = data != 0
    # A term begins after a divider, or where its text does.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    kept = data[inside]
    bounds = np.append((np.cumsum(inside) - 1)[at], len(kept)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return terms, np.diff(np.searchsorted(at, offsets))


def _bag_array(codes: np.ndarray, counts: np.ndarray, owners: np.ndarray, n: int) -> pa.Array:
    """Bags of n documents: pairs of a term's number and its count, ascending, as bytes."""
    pairs = np.ascontiguousarray(np.stack([codes, counts], axis=1).astype("<i4"))
    ends = 8 * np.append(0, np.cumsum(np.bincount(owners, minlength=n))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(pairs)]).cast(pa.binary())


def bags(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), bag (of terms of the vocabulary): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in slices(batches, 1):
            terms, n = terms_of(batch.column(1))
            codes = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            owners = np.repeat(np.arange(len(n)), n)
            some = codes >= 0
            both, counts = np.unique(owners[some] * max(1, len(vocabulary)) + codes[some], return_counts=True)
            owner, code = np.divmod(both, max(1, len(vocabulary)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _bag_array(code, counts, owner, len(n))], names=["doc_id", "n", "bag"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n long, bag binary")


def _pairs(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bags: all term numbers in turn, their counts, and the number of pairs of each."""
    sizes = pc.binary_length(bag).to_numpy(zero_copy_only=False).astype(np.int64) >> 3
    flat = np.frombuffer(b"".join(bag.to_pylist()), "<i4").reshape(-1, 2)
    return flat[:, 0], flat[:, 1], sizes


def document_frequencies(made: DataFrame, n_terms: int) -> np.ndarray:
    """In how many bags each term is. A row for each term that a task has seen is shuffled, and one for each term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            seen += np.bincount(_pairs(batch.column(0))[0], minlength=n_terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in made.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, key: str, text: str, limit: int) -> tuple[int, Iterator[list[tuple[int | None, list[bytes]]]]]:
    """The number of blocks, and the items with their distinct terms in blocks of about `limit` bytes of text, one at a time."""
    items = items.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    n = max(1, -(-int(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // limit))

    def each() -> Iterator[list[tuple[int | None, list[bytes]]]]:
        for block in range(n):
            part = items.where(F.pmod(F.xxhash64("k"), F.lit(n)) == block) if n > 1 else items
            held: dict[int | None, set[bytes]] = {}
            for r in part.toLocalIterator():
                held.setdefault(r.k, set()).update(terms_of(pa.array([r.t]))[0].to_pylist())
            yield [(k, sorted(terms)) for k, terms in held.items() if terms]

    return n, each()


class _Items:
    """A block of items by term: the items that hold term t are owners[starts[t] : starts[t + 1]]."""

    def __init__(self, block: list[tuple[int | None, list[bytes]]]):
        self.ids = [k for k, _ in block]
        self.vocabulary = sorted({t for _, terms in block for t in terms})
        number = {t: k for k, t in enumerate(self.vocabulary)}
        terms = np.array([number[t] for _, ts in block for t in ts], np.int64)
        owners = np.repeat(np.arange(len(block)), [len(ts) for _, ts in block])
        self.owners = owners[np.argsort(terms, kind="stable")]
        self.starts = np.append(0, np.cumsum(np.bincount(terms, minlength=len(self.vocabulary))))
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def scores(self, codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) for items (columns)."""
        out = np.zeros((len(sizes), len(self.ids)), np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        counts = counts.astype(np.int64)
        gains = (1_000_000_000 * counts) // (1000 * counts + 10 * SATURATION * m[rows])
        order = np.argsort(codes, kind="stable")
        codes, rows, gains = codes[order], rows[order], gains[order]
        cut = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes)).tolist()
        for begin, end in zip(cut, cut[1:], strict=False):
            t = int(codes[begin])
            if self.weights[t]:
                # A class has a term once, so no cell is met twice.
                out[rows[begin:end, None], self.owners[None, self.starts[t] : self.starts[t + 1]]] += (gains[begin:end] * self.weights[t])[:, None]
        return out


class _Best:
    """The k best classes of each item so far; equal scores by the least doc_id of the class."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(n_items)]

    def add(self, scores: np.ndarray, members: list[np.ndarray]) -> None:
        floor = self.least
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        rows, items = np.nonzero(scores >= floor)
        order = np.argsort(items, kind="stable")
        rows, items = rows[order], items[order]
        cut = np.append(np.flatnonzero(np.diff(items, prepend=-1)), len(items)).tolist()
        for begin, end in zip(cut, cut[1:], strict=False):
            item = int(items[begin])
            held = self.held[item] + [(-int(scores[r, item]), int(members[r][0]), members[r]) for r in rows[begin:end].tolist()]
            held.sort(key=lambda x: x[:2])
            self.held[item] = held = held[: self.k]
            if len(held) == self.k:
                self.least[item] = -held[-1][0]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each item: its number, and the doc_ids and scores of the k best members."""
        for item, held in enumerate(self.held):
            if held:
                ids = np.concatenate([x[2] for x in held])
                scores = np.repeat([-x[0] for x in held], [len(x[2]) for x in held])
                first = np.lexsort((ids, -scores))[: self.k]
                yield item, ids[first], scores[first]


def classes(made: DataFrame, k: int = HITS) -> DataFrame:
    """m, bag, members: a row for each distinct bag and m, with its k least doc_ids (structs, null ids last). made: doc_id, m, bag."""
    same = ["h", "m", "bag"]
    hashed = made.where(F.octet_length("bag") > 0).select("doc_id", "m", "bag", F.xxhash64("m", "bag").alias("h"))
    order = W.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last())
    first = hashed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return first.groupBy(*same).agg(F.collect_list(F.struct("doc_id")).alias("members")).select("m", "bag", "members")


def ranked(docs: DataFrame, items: DataFrame, k: int = HITS, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    out = None
    n_blocks, blocks = _blocks(items, key, text, query_bytes)
    for block in blocks:
        asked = _Items(block)
        made = written(bags(docs, asked.vocabulary), "bags")
        n_docs, n_terms = made.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        asked.weights = np.array([weight(n_docs, int(df)) for df in document_frequencies(made, len(asked.vocabulary))], np.int64)
        # In decimals, as the product may be beyond 64 bits.
        share = f"(cast({LENGTH} * n as decimal(19,0)) * cast({n_docs} as decimal(18,0))) div cast({max(1, n_terms)} as decimal(18,0))"
        grouped = classes(made.withColumn("m", F.lit(100 - LENGTH) + F.expr(share)), k)

        def score(batches: Iterator[pa.RecordBatch], asked: _Items = asked) -> Iterator[pa.RecordBatch]:
            best = _Best(len(asked.ids), k)
            some = max(1, _CELLS // max(1, len(asked.ids)))
            for batch in slices(batches, 1, _BAGS):
                for begin in range(0, batch.num_rows, some):
                    part = batch.slice(begin, some)
                    codes, counts, sizes = _pairs(part.column(1))
                    lists = part.column(2)
                    ids = lists.flatten().field(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    best.add(asked.scores(codes, counts, sizes, part.column(0).to_numpy(zero_copy_only=False)), [np.sort(x) for x in np.split(ids, ends[:-1])])
            for item, ids, scores in best.rows():
                owner = pa.array([asked.ids[item]] * len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([owner, pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

        found = grouped.mapInArrow(score, "item_id long, doc_id long, score long")
        found = written(found, "found") if n_blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for the rows of op13, from the contract's own words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w)>0),
m AS (SELECT doc_id, 50+(50*CAST(len(w) AS BIGINT)*nd)//l AS m FROM d, g WHERE len(w)>0),
t AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1,2),
f AS (SELECT term, CAST(floor(1000*ln((2*nd+2)/(2*df+1))) AS BIGINT) AS w FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM t GROUP BY 1), g),
s AS (SELECT item_id, doc_id, CAST(sum(w*((1000000000*tf)//(1000*tf+20*m))) AS BIGINT) AS score FROM t JOIN f USING(term) JOIN i USING(term) JOIN m USING(doc_id) GROUP BY 1,2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score>0)
SELECT * FROM r WHERE rank<=50
"""
