"""A corpus pipeline of five stages over ``documents``, each one operator of the llm subpackage.

``STAGES``: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read as the next one's docs. All but the last return the columns of
documents, whatever further columns there are. No stage is expressible in SQL as a whole (a trained
network, a tokenizer).

Null texts and empty texts go through all stages; rows with a null id are kept by near-dedup and lose
no lines; repeated rows share one fate, so all of them stay or go. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathtally.llm import bpe, common, decontam, linedup, superminhash, toxicity

ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below its threshold."""
    common.small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, exactly or within one word."""
    common.small_batches(spark)
    out = linedup.drop_lines(docs, linedup.repeated_lines(docs))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles overlap by 0.8 or more."""
    common.small_batches(spark)
    found = superminhash.near_duplicates(docs, size=5, percent=80)
    (name,) = common.fresh(docs.columns, "gone")
    gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    common.small_batches(spark)
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    common.small_batches(spark)
    return bpe.encode_table(docs, with_ids=True, cache=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
