"""The pipeline against a brute-force version of its stages."""

import random
from pathlib import Path

import corpus_pipeline
from gridloom.llm import langid, minhash, pieces

from .test_operators import DIR, brute_components, brute_contamination


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    model = langid.learnt(docs)
    kept = {i: t for i, t in texts.items() if model.accepts(t)}
    found = brute_components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if found[i][2]}
    bad = brute_contamination(kept, items)
    kept = {i: t for i, t in kept.items() if not bad[i][4]}
    want = dict(zip(kept, pieces.brute_force(list(kept.values())), strict=True))
    made = corpus_pipeline.run(spark, DIR).collect()
    assert len(made) == len(want) and {r["doc_id"]: tuple(r)[1:] for r in made} == want
    assert minhash.least_agreement(80) == 80


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_near_duplicates_store_few_files_whatever_the_number_of_partitions(spark, tmp_path, monkeypatch):
    """Files follow the rows: hundreds of tiny ones were made, and on a local disk each starts processes that count as the executor's memory."""
    stored = []
    monkeypatch.setattr(minhash, "written", lambda df, name, f=minhash.written: stored.append(f(df, name)) or stored[-1])
    docs, (_, stage) = spark.read.parquet(f"{DIR}/documents.parquet"), corpus_pipeline.STAGES[1]
    want = sorted(map(tuple, stage(spark, docs, DIR).collect()))
    stored.clear()
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/out")
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(stored) > 10 and all(len(df.inputFiles()) <= 2 for df in stored)
    assert len(list(Path(tmp_path, "out").glob("part-*"))) <= 2


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, _language string, _id string, _digest string, _row string, id string, row string"


def made(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", None, *"abcdefgh") for k, t, lang in rows], SCHEMA)


def kept(stage, spark, docs):
    out = stage(spark, docs, DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(tuple(r)[5:] == tuple("abcdefgh") for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_on_null_empty_repeated_and_clashing_rows(spark):
    rng = random.Random(21)
    text, other, third = (" ".join(rng.choice(["the", "thing", "with", "that", "of"]) + str(rng.randrange(300)) for _ in range(80)) for _ in range(3))
    language, near, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    rows = [(1, text, "en"), (None, None, "en"), (2, "", None), (3, "12 34", "en"), (None, other, None), (3, other, "en"), (3, other, "en")]
    assert kept(language, spark, made(spark, rows)) == sorted([(1, text), (None, other), (3, other), (3, other)], key=str)
    rows = [(7, text, None), (7, text, None), (None, text, None), (None, text, None), (5, other, None), (5, third, None), (8, third + " x", None), (9, None, None), (9, None, None), (None, "", None)]
    assert kept(near, spark, made(spark, rows)) == sorted([(7, text), (5, other), (5, third), (9, None), (9, None), (None, "")], key=str)
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, item, None), (-1, text, None), (5, item, None), (5, text, None), (5, text, None), (None, None, None), (0, "", None)]
    assert kept(clean, spark, made(spark, rows)) == sorted([(-1, text), (5, text), (5, text), (None, None), (0, "")], key=str)
    out = encode(spark, made(spark, rows), DIR).collect()
    assert sorted(r["doc_id"] is None for r in out) == [False] * 5 + [True] * 2 and sorted(r["n_tokens"] for r in out)[:2] == [2, 2]
    for stage in (language, near, clean, encode):
        assert stage(spark, made(spark, rows).limit(0), DIR).count() == 0
