"""Line dedup: exact copies by digest, near copies by a deletion-neighbourhood join.

The edit distance is that of word sequences, the bound one edit: a word replaced, left out or put
in. Lines (split at "\\n", white space between words levelled) of at least ``min_words`` words take
part (1: all lines that have words), those of at least ``near_words`` (3 or more) also by near copies;
both are exact at any setting. By default short lines such as headings and list marks, which repeat in
clean texts, are left alone. Order is (doc_id, line number).
A line is dropped if an earlier line is equal to it or lies within the bound; the keeper named is
the earliest such line. Dropped lines still count as earlier lines for later ones.

1. Equal lines form a class whose first line is found by a minimum, before the shuffle in part.
2. Two classes within one edit agree in their first or in their last half (of lengths c - 1 or c,
   the first or last (c - 1) // 2 words). Only classes that share such a half with another go on.
3. These emit hashes of their variants: the sequence with word i blanked (equal ones differ by a
   replacement), and without word i (which may equal a whole shorter line). The earliest member of
   each key is a minimum; each member is joined to that, never to all others of its key.
4. The pair of each line and its keeper is verified on the words.

Null or empty texts have no lines. Null ids: their lines are kept and keep no others. Rows that
repeat an id are the same document: the same line in the same place is not its own copy. Other
columns are not read by ``repeated_lines``; ``drop_lines`` returns them as they are, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, NEAR_WORDS = 5, 5
#: Places are doc_id * PLACE + line number.
PLACE = 1 << 32
#: Odd multiplier of the sequence hash.
BASE = 0xD1342543DE82EF95


def place(doc, line):
    return (F.col(doc).cast("decimal(20,0)") * F.lit(PLACE).cast("decimal(10,0)") + F.col(line)).cast("decimal(31,0)")


def doc_of(at):
    return F.floor((F.col(at) - F.pmod(F.col(at), F.lit(PLACE).cast("decimal(31,0)"))) / F.lit(PLACE).cast("decimal(31,0)")).cast("long")


def line_of(at):
    return F.pmod(F.col(at), F.lit(PLACE).cast("decimal(31,0)")).cast("int")


def digest(words: list[bytes]) -> tuple[int, int]:
    whole = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
    return int(whole[0]), int(whole[1])


def h64(*parts) -> int:
    """A signed 64-bit hash of words or numbers."""
    x = xxhash.xxh3_64_intdigest(b"\0".join(p if isinstance(p, bytes) else b"%d" % p for p in parts))
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[bytes]) -> list[int]:
    """Keys of the first and last halves, for pairs of lengths (n - 1, n) or (n, n) and (n, n + 1)."""
    out = []
    for c in (len(words), len(words) + 1):
        k = (c - 1) // 2
        out += [h64(b"first", c, *words[:k]), h64(b"last", c, *words[len(words) - k :])]
    return out


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]), dtype=np.uint64)


def variants(words: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Hashes with word i blanked, hashes without word i, hash of the whole sequence."""
    n = len(words)
    term = words * power[:n]
    whole = term.sum(dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)[:-1]])
    # what follows word i moves one place to the front
    shifted = words[1:] * power[: n - 1]
    after = np.concatenate([np.cumsum(shifted[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
    blank = common.mix(whole - term + common.mix(np.arange(n, dtype=np.uint64) + np.uint64(n << 32)))
    salt = np.uint64(n - 1)
    return blank, common.mix(before + after + salt), common.mix(np.array([whole + np.uint64(n)]))[0]


def within_one(a: list[str], b: list[str]) -> int:
    """Edits between two word sequences: 0, 1, or 2 for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    i, j = len(a), len(b)
    while min(i, j) > k and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    return 1 if max(i, j) - k <= 1 else 2


def lines_of(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """doc_id, line, h1, h2 (digest), near (keys of halves; null for short lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.trimmed(batches):
            for at in range(0, batch.num_rows, 100):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, 100).to_pylist(), batch.column(1).slice(at, 100).to_pylist(), strict=True):
                    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")) if text else ():
                        words = line.split()
                        if len(words) >= min_words:
                            rows.append((doc, k, *digest(words), halves(words) if len(words) >= near_words else None))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "line", "h1", "h2", "near"])

    return docs.mapInArrow(run, "doc_id long, line int, h1 long, h2 long, near array<long>")


def line_words(docs: DataFrame) -> DataFrame:
    """doc_id, line, first, last, words (joined by one space) of chosen lines."""

    @F.pandas_udf("array<string>")
    def pick(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, lines, strict=True):
            split = text.encode("utf-8", "surrogatepass").split(b"\n")
            out.append([b" ".join(split[k].split()).decode("utf-8", "surrogatepass") if k < len(split) else "" for k in own])
        return pd.Series(out)

    got = docs.select("doc_id", F.explode(F.arrays_zip(F.col("chosen").alias("x"), pick("text", "chosen.line").alias("words"))).alias("y"))
    return got.select("doc_id", "y.x.line", "y.x.first", "y.x.last", "y.words")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, line, keep_doc_id, keep_line, edits (0 or 1) of every line that is dropped."""
    if min_words < 1 or near_words < 3:
        raise ValueError("lines have one word at least, and near copies three")
    near_words = max(min_words, near_words)
    folder = common.shared_dir(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = common.stage(lines_of(given, min_words, near_words), folder, "lines")
    # equal digests have equal words, so any value of the class is the value; from here on one row a class
    sides = [F.max(F.col("near")[k]).alias(f"side{k}") for k in range(4)]
    classes = common.stage(lines.groupBy("h1", "h2").agg(F.min(place("doc_id", "line")).alias("at"), F.count("*").alias("copies"), *sides), folder, "classes")
    keyed = classes.where("side0 is not null and at is not null").select("at", "h1", F.posexplode(F.array(*[f"side{k}" for k in range(4)])).alias("side", "key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")
    chosen = keyed.join(shared, "key", "left_semi").groupBy("at").agg(F.max(F.col("side") % 2 == 0).alias("first"), F.max(F.col("side") % 2 == 1).alias("last"))
    chosen = chosen.select(doc_of("at").alias("doc_id"), F.struct(line_of("at").alias("line"), "first", "last").alias("x"))
    by_doc = common.stage(chosen.groupBy("doc_id").agg(F.collect_list("x").alias("chosen")), folder, "chosen")  # lines of one document
    # both sides are dealt by id, whatever their size: the ids grow with the documents
    texts = given.where("text is not null").join(by_doc.hint("merge"), "doc_id")
    texts = common.stage(line_words(texts).dropDuplicates(["doc_id", "line"]), folder, "words")
    keys = common.stage(emitted(texts).withColumn("at", place("doc_id", "line")).drop("doc_id", "line"), folder, "variants")
    near = None
    for mine, theirs in (("kind = 0", "kind = 0"), ("kind = 2", "kind = 1"), ("kind = 1", "kind = 2")):
        first = keys.where(theirs).groupBy("key").agg(F.min("at").alias("keep"))
        part = keys.where(mine).select("key", "at").join(first, "key").where("keep < at").select("at", "keep")
        near = part if near is None else near.union(part)
    near = near.groupBy("at").agg(F.min("keep").alias("keep"))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="int32")

    spoken = texts.select(place("doc_id", "line").alias("at"), "words")
    near = near.join(spoken, "at").join(spoken.select(F.col("at").alias("keep"), F.col("words").alias("others")), "keep")
    near = common.stage(near.where(edits("words", "others") == 1).select("at", "keep"), folder, "near")
    fate = classes.join(near, "at", "left").select("h1", "h2", "copies", F.col("at").alias("first"), F.coalesce("keep", "at").alias("keep"))
    # classes of one line without an earlier near copy drop nothing
    fate = fate.where("copies > 1 or keep < first").drop("copies")
    return (
        lines.select("doc_id", "line", "h1", "h2", place("doc_id", "line").alias("at")).join(fate, ["h1", "h2"]).where("keep < at")
        .select("doc_id", "line", doc_of("keep").alias("keep_doc_id"), line_of("keep").alias("keep_line"), (F.col("keep") < F.col("first")).cast("int").alias("edits"))
        .distinct()
    )


def emitted(lines: DataFrame) -> DataFrame:
    """Variants of lines (doc_id, line, first, last, words): doc_id, line, kind, key.

    A line that shares its first half can only differ behind it, and the other way round. Kinds: 0 a word blanked, 1 the whole line, 2 a word left out; 1 and 2 share one space of keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.trimmed(batches):
            parts: list[tuple[np.ndarray, ...]] = []
            held = 0
            names = ["doc_id", "line", "kind", "key"]

            def out(parts) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

            for doc, line, first, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                blank, less, whole = variants(hashes.of(words), powers(n))
                where = slice(0 if last else (n - 1) // 2, n if first else n - (n - 1) // 2)
                blank, less = blank[where], less[where]
                key = np.concatenate([blank, less, np.array([whole], np.uint64)]).view(np.int64)
                kind = np.repeat(np.array([0, 2, 1], np.int8), [len(blank), len(less), 1])
                parts.append((np.full(len(key), doc, np.int64), np.full(len(key), line, np.int32), kind, key))
                held += len(key)
                if held > 100_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)

    return lines.select("doc_id", "line", "first", "last", "words").mapInArrow(run, "doc_id long, line int, kind byte, key long")


def drop_lines(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines. A document none of whose words are left goes; one that had no words stays."""
    doc, gone, left = common.fresh(docs.columns, "doc", "gone", "left")
    lines = repeated.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("line").alias(gone))  # lines of one document

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, drop in zip(texts, lines, strict=True):
            if text is None or drop is None:
                out.append(text)
                continue
            drop = set(drop)
            out.append("\n".join([line for k, line in enumerate(text.split("\n")) if k not in drop]))
        return pd.Series(out, dtype=object)

    joined = docs.join(lines, F.col(f"`{id_col}`") == F.col(doc), "left").withColumn(left, rest(F.col(f"`{text_col}`"), F.col(gone)))
    kept = joined.where(F.col(gone).isNull() | (F.trim(F.regexp_replace(F.col(left), r"\s+", " ")) != ""))
    return kept.select(*[F.col(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
