"""The subpackage's queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, exact_dedup, mixing, packing, pii, sharding, simhash, token_output, toxicity, url_filter
from .sql import SQL


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_min_cost_reshard(spark, sf_dir):
    return sharding.shard_digest(_t(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(_t(spark, sf_dir, "documents"))


def op3_robust_graph_ann(spark, sf_dir):
    return ann.neighbours(_t(spark, sf_dir, "embeddings"))


def op4_low_discrepancy_mix(spark, sf_dir):
    return mixing.mix(_t(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(_t(spark, sf_dir, "pages")).drop("lower")


def op6_repair_tokens(spark, sf_dir):
    return token_output.token_digest(_t(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_surrogates(spark, sf_dir):
    return pii.anonymise(_t(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op8_simhash(spark, sf_dir):
    return simhash.fingerprint_components(_t(spark, sf_dir, "documents"), width=3, radius=3)


def op9_sum_of_squares_pack(spark, sf_dir):
    packed = packing.pack(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_toxicity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _t(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
