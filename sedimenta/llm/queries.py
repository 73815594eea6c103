"""The registered queries of the training-data operators and, where DuckDB can express
one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, minhash, mixing, secrets, suffix_dedup, token_counts, token_pack, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.token_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), path_col="doc_id", text_col="text")
    return secrets.report(found)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_suffix_dedup, op3_token_pack, op4_toxicity, op5_warc, op6_secrets, op7_token_counts, op8_near_duplicates, op9_mix, op10_embedding_links)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
