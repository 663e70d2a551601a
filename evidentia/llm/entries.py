"""Queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import stored, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import rangecoder

    return rangecoder.digest(stored(rangecoder.encode_column(table(spark, sf_dir, "documents")), "tokens", codec="none"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import pjpeg

    return pjpeg.digest(stored(pjpeg.encode_column(table(spark, sf_dir, "documents")), "media"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import toxicity

    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import lines

    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_docs=lines.EXACT_DOCS).select("doc_id", "n_lines", "n_dropped", "text")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import langid

    return langid.contract(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import pieces

    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import simhash

    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm import topk

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from evidentia.llm import sql

    return sql.statements()
