"""Jaccard similarity of groups, and their order by hierarchical clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Linkage


def shared_weights(sets: DataFrame, n: int) -> DataFrame:
    """x, y, shared: summed weights of the sets (weight, groups) that hold both groups.

    A task adds up one matrix of n by n and returns what is not zero, so a set of k groups costs no
    k * k rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                member = np.zeros((part.num_rows, n))
                member[np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
                total += member.T @ (member * part.column(0).to_numpy()[:, None])
        x, y = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[x, y].astype(np.int64))], names=["x", "y", "shared"])

    return sets.select(F.col("weight").cast("long"), F.col("groups").cast("array<int>")).mapInArrow(run, "x int, y int, shared long").groupBy("x", "y").agg(F.sum("shared").alias("shared"))


def jaccard(presence: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """x, y, value for all pairs of the n groups.

    Items with the same set of groups are summed first; pairs are made of the distinct sets only.
    Groups without items have similarity 0.
    """
    sets = presence.groupBy("item").agg(F.sort_array(F.collect_set("group_idx")).alias("groups"))  # at most n
    weights = sets.join(items.select("item", "weight"), "item").groupBy("groups").agg(F.sum("weight").alias("weight"))
    both = shared_weights(weights, n)
    own = both.where("x = y")
    spark = presence.sparkSession
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("x"), (F.col("id") % n).cast("int").alias("y"))
    a, b = own.select("x", F.col("shared").alias("a")), own.select("y", F.col("shared").alias("b"))
    rows = grid.join(both, ["x", "y"], "left").join(a, "x", "left").join(b, "y", "left")
    shared = F.coalesce("shared", F.lit(0))
    union = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - shared
    return rows.select("x", "y", F.when(union > 0, shared / union).otherwise(F.lit(0.0)).alias("value"))


def linkage(rows: np.ndarray, method: Linkage = Linkage.CENTROID) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) by Lance-Williams updates of Euclidean distances; new clusters count on from n."""
    n = len(rows)
    squared = method in (Linkage.WARD, Linkage.CENTROID, Linkage.MEDIAN)
    d = ((rows[:, None] - rows[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        a, b = sorted(np.unravel_index(int(d.argmin()), d.shape))
        dist, sa, sb = d[a, b], sizes[a], sizes[b]
        da, db = d[a].copy(), d[b].copy()
        if method is Linkage.SINGLE:
            new = np.minimum(da, db)
        elif method is Linkage.COMPLETE:
            new = np.maximum(da, db)
        elif method is Linkage.AVERAGE:
            new = (sa * da + sb * db) / (sa + sb)
        elif method is Linkage.WEIGHTED:
            new = (da + db) / 2
        elif method is Linkage.WARD:
            s = np.array(sizes, float)
            new = ((sa + s) * da + (sb + s) * db - s * dist) / (sa + sb + s)
        elif method is Linkage.CENTROID:
            new = (sa * da + sb * db) / (sa + sb) - sa * sb * dist / (sa + sb) ** 2
        else:
            new = (da + db) / 2 - dist / 4
        out.append((*sorted((names[a], names[b])), float(np.sqrt(max(dist, 0)) if squared else dist)))
        new[[a, b]] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        names[a], sizes[a] = n + step, sa + sb
    return out


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Observations in the order in which merges first name them."""
    if n < 2:
        return list(range(n))
    return [x for a, b, _ in merges for x in (a, b) if x < n]


def clustered(matrix: np.ndarray, labels: list[str], method: Linkage = Linkage.CENTROID) -> tuple[np.ndarray, list[str]]:
    order = leaf_order(linkage(matrix, method), len(matrix))
    return matrix[np.ix_(order, order)], [labels[k] for k in order]
