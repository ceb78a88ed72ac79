"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, common, decontam, linedup, oracles, pii, secrets, sharding, superminhash, toxicity, warc


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return bpe.encode_table(common.table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(common.table(spark, sf_dir, "documents"), shards=8)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return warc.archive_pages(common.table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return superminhash.near_duplicates(common.table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return linedup.repeated_lines(common.table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
