"""Corpus pipeline: documents in, packed training sequences out.

Toxic documents go; of equal texts one document stays, of near-duplicates (five-word shingles, similarity 0.8
or more) the least doc_id. Mixing then gives whole documents, some of them more than once, so that sources come
near their target weights, and packing gives a row a piece of a 1024-token sequence. Each stage's result
is written to the shared folder and read again, so a lost executor costs at most the stage that runs; the result of the
stage before is deleted once the next one is written.

Null texts are empty texts, rows of a null or repeated doc_id are documents by their own text, extra columns stay up to
the mixing, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, exact_dedup, mixing, packing, simhash, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", _toxicity), ("exact_dedup", _exact_dedup), ("simhash_near_dedup", _near_dedup), ("mixing", _mix), ("packing", _pack)]
#: Neither the toxicity model nor SimHash and the tokenizer are SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.save(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
