"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import bpe, language, licenses, media, mixing, near_text, near_vectors, pages, repair, rules, sharding, statements, token_files, whitening
from driftwell.llm.registry import QUERIES, SQL, query, table

# The vocabulary that operators 4 and 10 are given.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(table(spark, sf_dir, "documents"))


@query("op2_media_columns")
def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@query("op4_token_files")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.documents_as_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op5_source_mixing", statements.SOURCE_MIXING)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


@query("op7_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages"))


@query("op8_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.embedding_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.document_duplicates(table(spark, sf_dir, "documents"))


@query("op10_bpe_coding")
def bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_texts(table(spark, sf_dir, "documents"), "text", ["doc_id"], TOKENIZER)


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query("op12_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_conversation_repair", statements.CONVERSATION_REPAIR)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


REGISTERED = QUERIES, SQL
