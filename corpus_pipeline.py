"""The corpus pipeline: documents of known language, one of each near-duplicate group, mixed to weights, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.bpe import code_texts
from driftwell.llm.language import UNKNOWN, fit, identify
from driftwell.llm.mixing import mix, word_count
from driftwell.llm.near_text import scheme, without_near_duplicates
from driftwell.llm.rows import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their language: ``lang`` becomes the recognised one. Those without text or any letter go.

    Without a label to learn from there is no network: every text with a letter stays, and ``lang`` as it is.
    """
    net = fit(docs, "text", "lang", "doc_id")
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Numbered names: a document may have columns named like the prediction's.
    numbered = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(docs.toDF(*numbered), numbered[docs.columns.index("text")], numbered, net)
    known = found.where(F.col("lang_pred") != UNKNOWN)
    return known.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for n, c in zip(numbered, docs.columns)])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return without_near_duplicates(docs, "text", "doc_id", scheme(5, 80, cells=96))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once, or up to three times."""
    # The whole row as one column: a document may have columns named like the mix's.
    sized = docs.select(
        F.struct(*docs.columns).alias("row"), "source", "doc_id", F.md5("text").alias("body"), word_count(F.col("text")).alias("size")
    )
    taken = mix(sized, "source", "size", ["doc_id", "body"])
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text that they decode to."""
    return code_texts(docs, "text", ["doc_id", "lang", "source"], TOKENIZER, keep=["ids"])


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe_coding", token_stage),
]

# Training a network and counting similarities on signatures is beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
