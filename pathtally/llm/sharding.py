"""Minimax contiguous partition of atomic groups into shards of nearly equal bytes.

Rows of equal text form a group that no shard boundary may split. Groups are ordered by the
64-bit hash of their text. The smallest capacity at which a greedy walk over that order needs no
more than the wanted number of shards is found by binary search, and the order is cut there.

The driver never sees the groups: it holds byte sums of 65,536 fixed ranges of the hash (a bound
that does not grow with the data) and, for the few ranges in which a cut may fall, their groups.
A row's shard then follows from its hash and seven constants, without a join. Slots are numbered
within (shard, salt of id and text), so one huge group is spread over many tasks.

Null text: size 1, one group with all other nulls. Empty text: size 1, its own group. Null ids and
repeated rows keep a slot each. An empty table gives an empty result. Columns besides id and text
are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: log2 of the number of hash ranges that the driver knows by their sums.
RANGE_BITS = 16
#: Salts that split each shard for numbering.
SALTS = 256
#: Ranges that are fetched at once.
AT_ONCE = 64


def smallest_capacity(sums: list[int], largest: list[int], shards: int, fetch) -> tuple[int, list[int]]:
    """Least capacity and, for each further shard, the key of its first group.

    ``sums`` and ``largest``: bytes of each range and of its largest group. ``fetch(ranges)``
    returns {range: [(key, bytes), ...] in order}.
    """
    start, total = [0], 0
    for x in sums:
        total += x
        start.append(total)
    known: dict[int, tuple[list[int], list[int]]] = {}

    def load(ranges) -> None:
        missing = [b for b in dict.fromkeys(ranges) if b not in known and 0 <= b < len(sums) and sums[b]]
        for k in range(0, len(missing), AT_ONCE):
            for b, groups in fetch(missing[k : k + AT_ONCE]).items():
                at, ends, keys = start[b], [], []
                for key, size in groups:
                    at += size
                    ends.append(at)
                    keys.append(key)
                known[b] = ends, keys

    def range_of(y: int) -> int:
        """The range that holds the group which reaches beyond y bytes."""
        return bisect_right(start, y) - 1

    def surely(capacity: int) -> list[int] | None:
        """Cuts no later than the greedy ones, from sums alone; None if these need more shards."""
        at, cuts = 0, []
        for _ in range(shards):
            if at + capacity >= total:
                return cuts
            b = range_of(at + capacity)
            at = max(start[b], at + capacity - largest[b] + 1)
            cuts.append(at)
        return None

    def greedy(capacity: int) -> list[int] | None:
        at, keys = 0, []
        for _ in range(shards):
            if at + capacity >= total:
                return keys
            b = range_of(at + capacity)
            load([b])
            ends, own = known[b]
            k = bisect_right(ends, at + capacity)  # groups of this range that still fit
            at = ends[k - 1] if k else start[b]
            keys.append(own[k])
        return None

    if not total:
        return 0, []
    low, high = max(max(largest), -(-total // shards)), total
    least = low
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if surely(mid) is not None else (mid + 1, high)
    # the answer lies between `least` and `high`; the cuts of both limits bracket the ranges needed
    near = [range_of(k * least) for k in range(1, shards)] + [range_of(min(total - 1, k * high)) for k in range(1, shards)]
    load(near)
    low = least
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(mid) is not None else (mid + 1, high)
    return low, greedy(low)


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) for every row."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("key"),
    )
    of_range = (F.shiftright("key", 64 - RANGE_BITS) + (1 << (RANGE_BITS - 1))).cast("int")
    groups = common.stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("part", of_range), folder, "groups")

    sums, largest = [0] * (1 << RANGE_BITS), [0] * (1 << RANGE_BITS)
    for part, total, most in groups.groupBy("part").agg(F.sum("bytes"), F.max("bytes")).collect():  # at most 65,536 rows
        sums[part], largest[part] = total, most

    def fetch(parts: list[int]) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for part, key, size in sorted(map(tuple, groups.where(F.col("part").isin(parts)).select("part", "key", "bytes").collect())):
            out.setdefault(part, []).append((key, size))
        return out

    _, cuts = smallest_capacity(sums, largest, shards, fetch)
    shard = F.lit(0)
    for first in cuts:
        shard = shard + (F.col("key") >= F.lit(first)).cast("int")
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))

    counted = {(s, t): n for s, t, n in rows.groupBy("shard", "salt").count().collect()}  # shards x 256 rows
    offsets = []
    for s in range(shards):
        at = 0
        for t in range(SALTS):
            offsets.append((s, t, at))
            at += counted.get((s, t), 0)
    before = spark.createDataFrame(offsets, "shard int, salt int, before long")
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "key")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(before), ["shard", "salt"])  # shards x 256 rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
