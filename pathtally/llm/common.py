"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small in rows and bytes, so that a batch of very long texts fits a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, "16m"
#: Words whose hashes a Python worker keeps; beyond it the table starts anew.
CACHE_WORDS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``. Where the session does not name one, a temporary folder is
    set if all executors run in the driver's machine (a local master); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pathtally-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pathtally-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: lineage ends here."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches. Plans are run later, so the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def trimmed(batches: Iterator) -> Iterator:
    """The batches; at their end the worker gives memory that it no longer uses back to the system.

    Workers serve many tasks, and what the allocators keep would stand beside the next one's needs.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Helper column names like ``names`` that no column has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Word (bytes) to a signed 64-bit hash, filled as words appear."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) & 0x7FFFFFFFFFFFFFFF
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; fewer words make one run; none, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + words[k : len(words) - size + 1 + k])
    return out


def components(spark: SparkSession, edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components by least-label propagation with pointer jumping.

    ``edges``: columns a, b (long). Returns node, label (smallest node reachable). Every step
    is a join from many rows to one and a minimum that is taken before the shuffle, so a node
    with very many edges is neither collected nor handled by one task; each round is written
    to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), folder, f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), folder, f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = own.join(jump, own.low == jump.via, "left").select(
            "node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")
        )
        step = stage(step, folder, f"{name}-{k}")
        labels = step.select("node", "label")
        if not step.where("moved").take(1):
            return labels


def like_pattern(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)
