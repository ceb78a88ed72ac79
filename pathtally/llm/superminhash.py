"""Near-duplicate documents: SuperMinHash signatures, banding, exact confirmation, union-find.

A text's set is its distinct shingles of words. SuperMinHash gives every element its own
permutation of the registers; at level j the element offers j + r to the j-th register of its
permutation, and a document stops at the level at which no register can fall any more. Here a
level is one array operation over all elements of a batch, and each element's permutation grows by
one Fisher-Yates step a level. Bands of registers make buckets.

Texts of equal sets are one class. Within a bucket no pair list is made: a few pivots, the members
that share most buckets first, are compared with the members of other components that were no pivot yet, links are confirmed on
the full sets, components are joined, and only buckets that still hold several components and
members that were no pivot go on, with more pivots. A bucket ends when it is one component or
when all its members have been pivots, so no candidate pair between components is left out. Pairs
are refused within the join where sizes, or the parities of 512 bins of shingles, show that they
can't reach the bound; only the rest meets its full sets.

Null, empty or blank texts: empty set, no links, own component. Null ids: no links, component null,
kept. An id is one document: texts under one id are linked by it, so their components are one; each
row has the size of its own set. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
#: Elements that are handled at once.
AT_ONCE = 150_000
#: Pivots of a bucket in the first round; each round has 16 times as many.
PIVOTS = 8
#: 64-bit words of a set's parities.
WORDS = 8
EMPTY = np.int64(1 << 62)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int, hashes: common.WordHashes) -> np.ndarray:
    return np.unique(common.shingle_hashes(hashes.of(common.ascii_words(text)), size))


def signatures(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """(sets, m) registers: level << 32 | 32 random bits; empty sets keep EMPTY."""
    h = np.full((len(sets), m), EMPTY)
    sizes = np.array([len(s) for s in sets])
    e = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    flat = h.reshape(-1)
    for j in range(m):
        if not len(e):
            break
        x = common.mix(e + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        offer = (np.int64(j) << np.int64(32)) | (x >> np.uint64(32)).astype(np.int64)
        if perm is None:
            at = k
        else:
            row = np.arange(len(e))
            at = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = at
        np.minimum.at(flat, doc * m + at, offer)
        # a document whose registers all hold offers of this level or earlier can't change
        go = h.max(1) >= (np.int64(j + 1) << np.int64(32))
        stay = go[doc]
        if not stay.all():
            if perm is not None:
                perm = perm[stay]
            k = k[stay]
            e, doc = e[stay], doc[stay]
        if perm is None and len(e):
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            row = np.arange(len(e))
            perm[row, k] = 0
            perm[:, 0] = k
    return h


def band_keys(h: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.arange(1, h.shape[1] // rows + 1, dtype=np.uint64) * GOLDEN + np.zeros((len(h), 1), np.uint64)
    parts = h.astype(np.uint64).reshape(len(h), -1, rows)
    for k in range(rows):
        out = common.mix(out + parts[:, :, k])
    return out.astype(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 512 bins of elements, whether the set has an odd number of them."""
    bins = (common.mix(s) >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(bins, minlength=64 * WORDS).astype(np.uint8) & 1).view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), bands, parity, from doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()

        def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            keys = band_keys(signatures(sets))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            whole = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            n = np.array([len(s) for s in sets], np.int64)
            flat = pa.array(keys[n > 0].reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), flat)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(np.concatenate([parities(s) for s in sets])))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(whole[:, 0]), pa.array(whole[:, 1]), bands, parity], names=["doc_id", "n_shingles", "d1", "d2", "bands", "parity"]
            )

        for batch in common.trimmed(batches):
            ids, sets, n = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                sets.append(shingle_set(text, size, hashes))
                n += len(sets[-1])
                if n >= AT_ONCE:
                    yield out(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield out(ids, sets)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, parity array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, d1, shingles: the whole sets, for confirmation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.trimmed(batches):
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t, size, hashes) for t in part.column(1).to_pylist()]
                digests = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.int64()), lists], names=["doc_id", "d1", "shingles"])

    return docs.mapInArrow(run, "doc_id long, d1 long, shingles array<long>")


def may_link(percent: int) -> F.Column:
    """Whether a pair (n, parity; pn, pparity) can reach the bound: exact for those that it refuses.

    The intersection is at most the smaller size, and each element that only one of the sets has
    flips one bit of the parities, so these differ in no more bits than the sets in elements.
    """
    differ = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("pparity")[k])) for k in range(WORDS)), F.lit(0))
    return (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (differ * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Links: 100 * intersection >= ``percent`` * union of the shingle sets. With 24 bands of 4
    registers a pair at 0.85 shares no bucket with probability 2e-8 (at 0.8: 3e-6).
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.stage(sketch(given, size), folder, "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = common.stage(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), folder, "classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    banded = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "d1", F.col("n_shingles").alias("n"), "parity")
    crowded = banded.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = banded.join(crowded, "key")
    # whoever shares most buckets is the likeliest original of a group
    central = members.groupBy("id", "d1").agg(F.sum("crowd").alias("score"))
    members = common.stage(members.drop("crowd").join(central, ["id", "d1"]).withColumn("used", F.lit(False)), folder, "members-0")
    needed = members.select(F.col("id").alias("doc_id"), "d1").distinct()
    texts = given.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = common.stage(full_sets(texts, size).join(needed, ["doc_id", "d1"], "left_semi").dropDuplicates(["doc_id", "d1"]), folder, "sets")
    links, labels = None, None
    # an id with several texts links their classes
    twice = real.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("doc_id")
    own = real.join(twice, "doc_id", "left_semi").select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).where("doc_id <> rep")
    own = common.stage(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), folder, "own")
    if own.take(1):
        links, labels = own, common.components(spark, own, folder, "labels-0")
    turn = 0
    while True:
        turn += 1
        now = members.withColumn("label", F.col("id")) if labels is None else (
            members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        )
        open_ = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("used").alias("over")).where("low < high and not over")
        now = common.stage(now.join(open_.select("key"), "key", "left_semi"), folder, f"now-{turn}")
        place = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS * 16 ** (turn - 1)))
        picks = now.where("not used").groupBy("key", place.alias("place")).agg(F.max_by("id", "score").alias("id"))
        pivots = common.stage(picks.select("key", "id"), folder, f"pivots-{turn}")
        if not pivots.take(1):
            break
        chosen = now.join(pivots, ["key", "id"]).select("key", F.col("id").alias("pid"), F.col("d1").alias("p1"), F.col("n").alias("pn"), F.col("label").alias("plabel"), F.col("parity").alias("pparity"))
        pairs = (
            now.join(chosen, "key").where("not used and label <> plabel and id <> pid").where(may_link(percent))
            .select(
                F.when(F.col("id") < F.col("pid"), F.struct(F.col("id").alias("a"), F.col("d1").alias("a1"), F.col("pid").alias("b"), F.col("p1").alias("b1")))
                .otherwise(F.struct(F.col("pid").alias("a"), F.col("p1").alias("a1"), F.col("id").alias("b"), F.col("d1").alias("b1"))).alias("x")
            ).select("x.*").distinct()
        )
        pairs = common.stage(pairs, folder, f"pairs-{turn}")
        left = sets.select(F.col("doc_id").alias("a"), F.col("d1").alias("a1"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("d1").alias("b1"), F.col("shingles").alias("sb"))
        both = pairs.join(left, ["a", "a1"]).join(right, ["b", "b1"]).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        found = common.stage(both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b"), folder, f"links-{turn}")
        if found.take(1):
            links = found if links is None else links.union(found)
            labels = common.components(spark, links, folder, f"labels-{turn}")
        members = now.join(pivots.withColumn("was", F.lit(True)), ["key", "id"], "left").select(
            "key", "id", "d1", "n", "parity", "score", F.coalesce("was", "used").alias("used")
        )
    of_class = classes if labels is None else classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id") if labels is not None else F.coalesce("rep", "doc_id")
    linked = F.col("n_shingles") > 0
    return (
        rows.select("doc_id", "n_shingles", F.when(linked, F.col("d1")).alias("d1"), F.when(linked, F.col("d2")).alias("d2"))
        .join(of_class, ["d1", "d2"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
