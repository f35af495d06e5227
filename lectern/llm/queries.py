"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lm_score, media, mixing, packing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter
from lectern.llm.common import documents


def tokeniser() -> dict[str, object]:
    """The public tokeniser that the queries pack with."""
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "added": packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))}


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir)).withColumn("log_score", F.round("log_score", 3))


def op4_lm_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), lm_score.TRIGRAM).withColumn("log_score", F.round("log_score", 3))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(documents(spark, sf_dir), simhash.EXACT)
    return found.select("doc_id", simhash.hex_digits(found["f0"]).alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.as_media(documents(spark, sf_dir)))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), **tokeniser())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("lang", "source")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix": op1_suffix, "op2_urls": op2_urls, "op3_toxicity": op3_toxicity, "op4_lm": op4_lm, "op4_lm_trigram": op4_lm_trigram, "op5_simhash": op5_simhash, "op6_media": op6_media, "op7_pack": op7_pack, "op8_quality": op8_quality, "op9_shard": op9_shard, "op10_mix": op10_mix}


def oracle_sql() -> dict[str, str]:
    return {"op4_lm": lm_score.score_sql(), "op9_shard": sharding.place_sql(), "op10_mix": mixing.schedule_sql()}
