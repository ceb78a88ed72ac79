"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows of items or their pieces, verification.

Words are symbols. The CGK walk reads a sequence with a pointer that advances, at each step, by a
random bit of (step, symbol): sequences within a small edit distance give outputs within a small
Hamming distance. Each of ``TABLES`` tables has its own walk and samples ``SAMPLES`` output places;
windows of the size of an item whose samples equal the item's are candidates, and the best
alignment of the item with the text around them is computed exactly.

The share of equal places falls with the number of edits, so items of more than ``PIECE`` words are
looked up by equal pieces of at most so many. If every piece of l words had more than l // 5 edits,
the item of L words would have more than L // 5; so one piece at least is within its own bound, and
a window that equals the samples of any piece makes its whole item a candidate.

An item of L words is found where at most L // 5 word edits (none below 6 words) turn it into a
passage of the text. Such a passage keeps at least L - 2 - 3 * (L // 5) of the item's (or piece's)
three-word runs, so windows with fewer runs of any item are left out before the walk; nothing is
lost by it. With a place of the outputs equal at a share p, a table misses with 1 - p ** SAMPLES; 24
tables of 2 samples reach 0.99 at p = 0.42. Tests and the README measure the recall at the bound.

Items go to the tasks in blocks of at most ``BLOCK`` (one scan of the documents a block), so what is
sent does not grow with the benchmark. Null, empty texts and items: no match. Items of fewer than
three words are not searched. Null ids come back as null; repeated rows give their rows again.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLES, SAMPLES = 24, 2
#: Words of a piece at most; longer items are looked up by several.
PIECE = 30
#: Items that one scan of the documents looks for; their tables take some 1 KB each in a task.
BLOCK = 20_000
SEED = 11
#: Lengths in one class differ by this factor at most.
SPREAD = 1.25
#: Windows that are walked at once.
AT_ONCE = 4096
MAP_BITS = 22
END = np.uint64(0x5EED)
RUN = 3


def bound(length: int) -> int:
    """Word edits that an item of this length may have."""
    return length // 5 if length >= 6 else 0


def runs_kept(length: int) -> int:
    return max(1, length - (RUN - 1) - RUN * bound(length))


def pieces(length: int) -> list[tuple[int, int]]:
    """Start and end of the pieces by which an item of this length is looked up."""
    n = -(-length // PIECE)
    return [(k * length // n, (k + 1) * length // n) for k in range(n)]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any part of the text, and that part (start, end)."""

    def last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row, steps = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
        for k, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = k
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = last_row(item, text)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1])
    # the longest part of least cost that ends there and starts as far right as possible
    start = end - int(np.flatnonzero(back == row[end])[0]) if (back == row[end]).any() else 0
    return int(row[end]), start, end


class Finder:
    """Tables of one block of items. ``items``: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hashes = common.WordHashes()
        found = [(i, self.hashes.of(common.ascii_words(t))) for i, t in items]
        self.items = sorted(((i, w) for i, w in found if len(w) >= RUN), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        runs = np.unique(np.concatenate([common.shingle_hashes(w, RUN) for _, w in self.items])) if self.items else np.zeros(0, np.uint64)
        self.runs = runs
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[(runs & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)] = True
        # (words, item, first word) of each piece
        self.pieces = sorted(((w[a:b], i, a) for i, (_, w) in enumerate(self.items) for a, b in pieces(len(w))), key=lambda x: len(x[0]))
        self.classes = []
        k = 0
        r = np.random.default_rng(SEED)
        while k < len(self.pieces):
            least = len(self.pieces[k][0])
            n = k
            while n < len(self.pieces) and len(self.pieces[n][0]) <= least * SPREAD:
                n += 1
            most = len(self.pieces[n - 1][0])
            steps = max(3, int(1.6 * least))
            seeds = r.integers(1, 1 << 63, (TABLES, steps), dtype=np.uint64)
            places = np.stack([r.choice(steps, SAMPLES, replace=False) for _ in range(TABLES)])
            need = min(runs_kept(len(w)) for w, *_ in self.pieces[k:n])
            padded = np.full((n - k, most + steps + 1), END)
            for j, (w, *_) in enumerate(self.pieces[k:n]):
                padded[j, : len(w)] = w
            starts = np.arange(n - k, dtype=np.int64) * padded.shape[1]
            tables = []
            for keys in self.keys(padded.reshape(-1), starts, seeds, places):
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order + k))
            self.classes.append((need, most + bound(most), seeds, places, tables))
            k = n

    @staticmethod
    def keys(words: np.ndarray, starts: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(tables, starts): the sampled places of the CGK outputs from each start, as one hash."""
        at = np.tile(starts, (len(seeds), 1))
        out = np.zeros(at.shape, np.uint64)
        wanted = np.zeros(seeds.shape, bool)
        wanted[np.arange(len(seeds))[:, None], places] = True
        for step in range(int(places.max()) + 1):
            word = words[at]
            if (own := np.flatnonzero(wanted[:, step])).size:
                out[own] = common.mix(out[own] + word[own])
            at += (common.mix(word ^ seeds[:, step, None]) >> np.uint64(63)).astype(np.int64)
        return out

    def known(self, runs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.runs, runs)
        return self.runs[np.minimum(at, len(self.runs) - 1)] == runs

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) in words, the best place of each item found."""
        words = self.hashes.of(common.ascii_words(text))
        n = len(words)
        if n < RUN or not self.items:
            return []
        runs = common.shingle_hashes(words, RUN)
        hit = self.map[(runs & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)]
        if not hit.any():
            return []
        places = np.flatnonzero(hit)
        sure = np.zeros(len(runs) + 1, np.int64)
        sure[places + 1] = self.known(runs[places])
        total = np.cumsum(sure)
        candidates: dict[int, list[int]] = {}
        for need, span, seeds, sampled, tables in self.classes:
            if total[-1] < need:
                continue
            starts = np.arange(len(runs))
            ends = np.minimum(starts + span, len(runs))
            starts = starts[total[ends] - total[starts] >= need]
            if not len(starts):
                continue
            padded = np.concatenate([words, np.full(seeds.shape[1] + 1, END)])
            walked = [self.keys(padded, starts[k : k + AT_ONCE], seeds, sampled) for k in range(0, len(starts), AT_ONCE)]
            for own, (keys, owners) in zip(np.concatenate(walked, 1), tables, strict=True):
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                for s, a, b in zip(starts[low < high], low[low < high], high[low < high], strict=True):
                    for k in owners[a:b]:
                        _, item, first = self.pieces[k]
                        candidates.setdefault(item, []).append(int(s) - first)
        out = []
        for k, found in candidates.items():
            item_id, item = self.items[k]
            length, most = len(item), bound(len(item))
            # a hit is off by the edits in its piece, and by those before it
            slack = most if length <= PIECE else most + bound(PIECE)
            found = sorted(set(found))
            best = None
            groups = [[found[0], found[0]]]
            for s in found[1:]:
                if s - groups[-1][1] <= length:
                    groups[-1][1] = s
                else:
                    groups.append([s, s])
            for first, last in groups:
                low, high = max(0, first - slack), min(n, last + length + most + slack)
                # a passage within the bound keeps so many of the item's words
                if np.isin(words[low:high], item).sum() < length - most:
                    continue
                edits, start, end = align(item, words[low:high])
                if edits <= most and (best is None or edits < best[1]):
                    best = item_id, edits, low + start, low + end
            if best:
                out.append(best)
        return sorted(out, key=lambda x: (x[2], x[0] is None, x[0] or 0))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, at most ``BLOCK`` at a time."""
    block = []
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, start_word, end_word: every document and item found in it."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "item_id", "edits", "start_word", "end_word"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    schema = "doc_id long, item_id long, edits int, start_word long, end_word long"

    def of(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in finder.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return given.mapInArrow(run, schema)

    out = None
    for items in blocks(benchmark):
        out = of(items) if out is None else out.union(of(items))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no item is found, all columns; a filter without a shuffle."""

    def of(items):
        @F.pandas_udf("boolean")
        def leaked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = Finder(items)
            for texts in parts:
                yield pd.Series([bool(finder.matches(t)) for t in texts], dtype=bool)

        return leaked

    for items in blocks(benchmark):
        docs = docs.where(~of(items)(F.col(text_col)))
    return docs
