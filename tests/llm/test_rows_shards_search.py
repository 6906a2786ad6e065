"""Fill-in-the-middle rows, shards and ranked search against brute force, and on awkward input."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import fim, lexical, queries, sharding

from .test_operators import AWKWARD, DIR, DOCS, clashing, docs_of, words

LINES = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n日本\n\nü", "x" * 9000 + "\n" + "y\n" * 5000 + "z" * 20_000, "a<P>b\nc", "<S>", "l\n" * 7 + "<M", "<\nP>\n<", "b\r\nc\r\n", *AWKWARD]


# 11. fill in the middle


def fim_row(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return len(units), "plain", None, None, t
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle_equals_brute_force(spark, rate):
    rng = random.Random(1)
    texts = LINES + ["".join(rng.choice(["a", "bb ", "\n", "<", "P>", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = clashing(docs_of(spark, texts)).unionByName(clashing(docs_of(spark, ["same\ntext\n"] * 3).withColumn("doc_id", F.lit(None).cast("long"))))
    made = fim.fill_in_middle(docs, rate=rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted([fim_row(k, t, rate) for k, t in enumerate(texts)] + [fim_row(None, "same\ntext\n", rate)] * 3, key=str)
    assert sorted([(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made], key=str) == want
    by_id = {r["doc_id"]: r for r in made}
    assert all(by_id[k]["back"] == (t or "") for k, t in enumerate(texts))
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [1, 50, 4095])
def test_rank_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(error)
    for values in (np.zeros(0, int), np.array([7]), np.cumsum(rng.integers(1, 200, 5000)), np.cumsum(np.where(rng.random(3000) < 0.01, 1_000_000, 3)), np.arange(10_000) * 80 + 5, np.repeat(4, 50)):
        index = fim.RankIndex.fit(values, error)
        assert np.array_equal(index[np.arange(len(values))], values) and len(index) == len(values)
        assert not len(values) or np.abs(index.residuals).max() <= error + 1
    # Regular lines need a segment, not a number each.
    assert len(fim.RankIndex.fit(np.arange(10_000) * 80 + 5, error).first) == 1


# 12. shards


def jump(key, n):
    """The published walk, on unsigned 64-bit integers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def hash_of(k):
    return 42 if k is None else xxhash.xxh64_intdigest(str(k).encode(), seed=42)


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 47, 49, 1000])
def test_shards_are_those_of_the_published_walk(spark, shards):
    keys = [None, 0, -1, 1, 2**62, -(2**63), *range(10, 1500)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for r in df.select("doc_id", sharding.placed(F.col("doc_id"), shards).alias("p")).collect():
        assert r.p["at"] == jump(hash_of(r.doc_id), shards)
        assert (jump(hash_of(r.doc_id), shards + 1) == shards) == (r.p["next"] == shards)


def check_slots(rows, docs, shards=24):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs)
    held = {}
    for r in rows:
        assert r.shard == jump(hash_of(r.doc_id), shards) and r.grown_shard == jump(hash_of(r.doc_id), shards + 1) and r.grown_shard in (r.shard, shards)
        held.setdefault(r.shard, []).append(r)
    for each in held.values():
        each.sort(key=lambda r: r.slot)
        assert [r.slot for r in each] == list(range(len(each)))
        order = [(r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in each]
        assert order == sorted(order)


def test_slots_equal_brute_force_with_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    texts = AWKWARD + [f"t{k}" for k in range(200)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(5, "copy")] * 40 + [(None, None)] * 30 + [(None, "n")] * 3 + [(6, f"v{k}") for k in range(50)]
    df = clashing(spark.createDataFrame([(k, t, None, "s", None) for k, t in docs], DOCS))
    check_slots(sharding.slots(df).collect(), docs)
    # The same rows in other partitions have the same slots.
    again = sharding.slots(df.repartition(9).orderBy(F.rand(3)))
    assert sorted(map(str, again.collect())) == sorted(map(str, sharding.slots(df).collect()))
    assert sharding.slots(df.limit(0)).count() == 0


def test_shard_query_over_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op12_shards(spark, DIR).collect()
    assert {r.law for r in rows} == {"key"}
    check_slots(rows, docs)


def test_shards_are_written_and_only_the_needed_rows_move(spark, tmp_path):
    docs = docs_of(spark, [f"t{k}" for k in range(2000)])
    gone = sharding.moved(docs, 24, 26).collect()
    assert {r["new"] for r in gone} == {24, 25} and 0.5 * 2000 * 2 / 26 < len(gone) < 1.6 * 2000 * 2 / 26
    sharding.write_shards(docs, str(tmp_path / "s"), 5, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 2000 and all(r.shard == jump(hash_of(r.doc_id), 5) for r in back.select("doc_id", "shard").collect())


# 13. ranked search


def ranking(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    N, L = len(bags), sum(len(w) for _, w in bags)
    counts = []
    df = {}
    for i, w in bags:
        c = {}
        for x in w:
            c[x] = c.get(x, 0) + 1
        counts.append((i, 50 + (50 * len(w) * N) // L, c))
        for x in c:
            df[x] = df.get(x, 0) + 1
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in by_item.items():
        scored = []
        for i, m, c in counts:
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in wanted if x in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = AWKWARD + [words(rng, rng.randrange(1, 40), 60) for _ in range(400)] + ["w1 w2 W1, w3"] * 150 + ["w3-w1 w2\nw1"] * 60
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "w5 w6"), (None, "w5 w6"), (7, "w5 w6"), (7, "w9")]
    items = [(1, "w1 w2 w5"), (2, "W3"), (3, "w1 w1 w9 nothing"), (4, ""), (5, None), (6, "é 日本 one"), (6, "two"), (None, "w5"), (8, "absent")]
    df = clashing(spark.createDataFrame([(k, t, None, "s", None) for k, t in docs], DOCS)).repartition(7)
    tests = clashing(spark.createDataFrame(items, "item_id long, text string")).withColumn("rank", F.lit(1))
    for cells, query_bytes, k in ((lexical._CELLS, lexical.QUERY_BYTES, 50), (40, 20, 50), (400, 1 << 20, 3)):
        monkeypatch.setattr(lexical, "_CELLS", cells)
        made = lexical.ranked(df, tests, k=k, query_bytes=query_bytes).collect()
        assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in made], key=str) == ranking(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    docs, items = docs_of(spark, ["a b", None]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.where("text is null"), items).count() == 0


def test_bags_of_one_class_are_scored_once(spark):
    made = spark.createDataFrame([(k, 60, struct.pack("<2i", 1, 2)) for k in range(300)] + [(9, 61, struct.pack("<2i", 1, 2)), (8, 60, b"")], "doc_id long, m long, bag binary")
    rows = lexical.classes(made, 5).collect()
    assert sorted((r.m, [x.doc_id for x in sorted(r.members)]) for r in rows) == [(60, [0, 1, 2, 3, 4]), (61, [9])]
