"""The subpackage's registered queries: thin uses of the operators over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, htmltext, iblt, langid, lexical, licenses, minhash, pieces, sharding, token_counts, token_files, warc
from .common import documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(documents(spark, sf_dir)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = langid.identify(docs, langid.learnt(docs))
    return made.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_rows(warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_fingerprints,
            op2_decontamination,
            op3_html_text,
            op4_token_files,
            op5_sentencepiece,
            op6_near_duplicates,
            op7_license_scan,
            op8_language_id,
            op9_token_counts,
            op10_warc_derivatives,
            op11_fill_in_middle,
            op12_shards,
            op13_ranked_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontam.ORACLE,
        "op6_near_duplicates": minhash.ORACLE,
        "op7_license_scan": licenses.ORACLE,
        "op10_warc_derivatives": warc.ORACLE,
        "op11_fill_in_middle": fim.ORACLE,
        "op13_ranked_search": lexical.ORACLE,
    }
