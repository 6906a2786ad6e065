"""A training-corpus pipeline of four stages; each is written as Parquet and read again before the next.

language ID (documents whose main language has less than a third of them, or that have none, go) -> near-duplicate removal (one document of each group stays) -> benchmark
decontamination (contaminated documents go) -> SentencePiece encoding and decoding. All but the last return the columns
of documents; each works on all rows that its predecessor kept.

Defined results of the stages: a row's own text decides about it, so null or repeated doc_ids don't touch other rows. A null
or empty text, or one without a letter, has no language and goes in the first stage (where no row is labelled, all others stay); the second and third keep it (it
is linked with nothing and has no words), the last gives it the begin and end ids alone. Of repeated rows the second
stage keeps one. Ties go to the least doc_id, null last. Empty tables give empty results with the same columns; further columns,
whatever their names, are kept by all but the last, which gives doc_id and its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, langid, minhash, pieces
from gridloom.llm.common import documents, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found that has a third of them at least."""
    return langid.in_a_language(docs, langid.learnt(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (shingles of five words, similarity 0.8), and all that is linked with nothing."""
    return minhash.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the benchmark's passages don't contaminate."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return pieces.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Language ID and merge rounds aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
