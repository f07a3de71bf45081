"""Registered queries of the training-data operators and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlink.llm import bpe, collocations, decontaminate, embedding_dedup, exact_topk, html_extract, langid, merkle, ngram_join, quality, quote_threads, sql, suffix_dedup, token_store
from strandlink.llm.common import read_table
from strandlink.plans.shipping import ship


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents"), width=50)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=80)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    shards = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(shards, shards._store)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), percent=80, k=5)


def op9_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.link_quotes(read_table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return merkle.verify(read_table(spark, sf_dir, "documents"), every=7)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_topk.search(read_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, covered=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_decontaminate": op3_decontaminate, "op4_token_store": op4_token_store, "op5_quality": op5_quality, "op7_langid": op7_langid, "op8_ngram_join": op8_ngram_join, "op9_quote_threads": op9_quote_threads, "op10_html_extract": op10_html_extract, "op6_bpe": op6_bpe, "op11_merkle_manifest": op11_merkle_manifest, "op12_exact_topk": op12_exact_topk, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": sql.OP1_NEAR, "op2_suffix_dedup": sql.OP2_REPEATS, "op8_ngram_join": sql.OP8_NEAR, "op11_merkle_manifest": sql.OP11_MERKLE, "op12_exact_topk": sql.OP12_TOPK, "op13_collocations": sql.OP13_PHRASES}
