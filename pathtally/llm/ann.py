"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its points at the median of their projection on
the difference of two of them. Where ``SAMPLE`` points no longer fill the leaves of a large table,
each cell is split further by random directions, one a level and tree, at the median of the cell's
sample points; so the leaves' size does not grow with the table. Every vector is put into one leaf of
each tree. A query walks all trees through one priority queue, ordered by the largest margin on the
way, until it has enough leaves. The vectors of these leaves are compared in double precision, leaf
by leaf as matrices; all that come within a rounding margin of the best go on to the exact measure,
and the best of all leaves are merged. How many leaves are enough is measured: for a bounded number
of sampled queries the true neighbours are found by brute force over all vectors, and the queue is
followed until the wanted share of them has been met.

Hot groups: of equal vectors only the smallest k + 1 ids can be among a query's k nearest, so no more
are indexed, and equal queries are asked once and answered each; both exact. The ``HOT`` largest
leaves of more than ``FULL`` vectors are salted: their vectors are dealt over several tasks, and a
query visits all of them. A leaf's rows travel in the precision that the table has.

The measure is the cosine of the original vectors, each scaled by a power of two, which changes no
digit but keeps squares in range. Ties go to the smaller vec_id. Vectors that are null, empty, zero,
of another length than most of the sample, or hold null or non-finite components take no part,
neither do null ids. A row never is its own neighbour. Several vectors of one id are one candidate
(with its best score) and one query (the least vector asks). Other columns are not read. With fewer
than k candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
TREES = 16
LEAF = 400
#: Sample points that a fitted leaf has at least; below it, levels of random directions follow.
POINTS = 16
#: Leaves of more than FULL vectors are dealt over tasks, the HOT largest of them.
FULL, HOT = 8 * LEAF, 4096
#: Recall that the number of leaves is set for, measured on so many sampled queries.
RECALL, PROBES = 0.96, 200
#: Rows of results that a task merges at once, and pairs that are measured at once.
HELD, PAIRS = 200_000, 50_000
#: Scores so close may be equal but for rounding.
MARGIN = 1e-9
SEED = 3


class Forest:
    """Perfect binary trees: ``way`` (trees, nodes, dim) and ``cut`` (trees, nodes) of the fitted
    levels, ``far`` (trees, levels, dim) and ``bar`` (trees, cells, levels) of those below."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF):
        self.top = self.deep = 0
        while total / (1 << self.top) > leaf and len(sample) / (1 << self.top) >= POINTS:
            self.top += 1
        while total / (1 << (self.top + self.deep)) > leaf:
            self.deep += 1
        self.depth = self.top + self.deep
        nodes, dim = (1 << self.top) - 1, sample.shape[1]
        r = np.random.default_rng(SEED)
        self.way = np.zeros((trees, nodes, dim), np.float32)
        self.cut = np.zeros((trees, nodes), np.float32)
        self.far = r.normal(size=(trees, self.deep, dim)).astype(np.float32) / np.float32(np.sqrt(dim))
        self.bar = np.zeros((trees, 1 << self.top, self.deep), np.float32)
        for t in range(trees):
            inside = [np.arange(len(sample))]
            for node in range(nodes):
                points = inside[node]
                way = r.normal(size=dim)
                if len(points) > 1:
                    a, b = sample[r.choice(points, 2, replace=False)]
                    way = a - b if np.any(a != b) else way
                way = (way / np.linalg.norm(way)).astype(np.float32)
                side = sample[points] @ way
                self.way[t, node], self.cut[t, node] = way, np.median(side) if len(side) else 0
                inside += [points[side <= self.cut[t, node]], points[side > self.cut[t, node]]]
            # a heap order of nodes: children of k are 2k + 1 and 2k + 2
            for cell in range(1 << self.top if self.deep else 0):
                if len(points := inside[nodes + cell]):
                    self.bar[t, cell] = np.median(sample[points] @ self.far[t].T, 0)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.empty((len(x), len(self.way)), np.int64)
        for t in range(len(self.way)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.top):
                right = np.einsum("ij,ij->i", x, self.way[t][node]) > self.cut[t][node]
                node = 2 * node + 1 + right
            cell = node - ((1 << self.top) - 1)
            sides = x @ self.far[t].T > self.bar[t][cell]
            for level in range(self.deep):
                node = 2 * node + 1 + sides[:, level]
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        nodes, last = (1 << self.top) - 1, (1 << self.depth) - 1
        margin, beyond = self.way @ q - self.cut, self.far @ q
        queue = [(-np.inf, t, 0, -1, 0) for t in range(len(self.way))]
        out = []
        while queue and len(out) < wanted:
            away, t, node, cell, level = heapq.heappop(queue)
            if node >= last:
                out.append((t, node - last))
                continue
            if node < nodes:
                m = float(margin[t, node])
            else:
                cell = node - nodes if cell < 0 else cell
                m = float(beyond[t, level] - self.bar[t, cell, level])
                level += 1
            near = 2 * node + 1 + (m > 0)
            heapq.heappush(queue, (away, t, near, cell, level))
            heapq.heappush(queue, (max(away, abs(m)), t, 4 * node + 3 - near, cell, level))
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest part near 1."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    return (x / norms(x)[:, None]).astype(np.float32)


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, each vector once with its best score, ties to the smaller id."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[new], vec[new], score[new]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], vec[best], score[best]


class Leaf:
    """The vectors of one leaf (or a part of it), for exact answers to queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norms = ids, x, norms(x)
        self.unit = x / self.norms[:, None]
        self.twice = len(ids) - len(np.unique(ids))

    def answer(self, names: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        own = norms(q)
        rough = (q / own[:, None]) @ self.unit.T
        n = min(len(self.ids), k + self.twice)
        least = np.partition(rough, -n, 1)[:, -n] - MARGIN
        rows, cols = np.nonzero(rough >= least[:, None])
        score = np.empty(len(rows))
        for a in range(0, len(rows), PAIRS):
            i, j = rows[a : a + PAIRS], cols[a : a + PAIRS]
            score[a : a + PAIRS] = (q[i] * self.x[j]).sum(1) / (own[i] * self.norms[j])
        return best_of(names[rows], self.ids[cols], score, k)


def enough(forest: Forest, x: np.ndarray, indexed: DataFrame, k: int, recall: float) -> int:
    """Leaves of the queue in which the share ``recall`` of the true neighbours of the rows of ``x`` is met.

    One scan of the indexed vectors, of which each task returns its k best for each row. What equals
    a probe is met in its own leaf and says nothing, so it is left out.
    """
    q, dim = unit(x), x.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            v = matrix(batch.column(1), dim)
            if not len(v):
                continue
            score = q @ unit(v).T
            score[score > 1 - 1e-6] = -np.inf
            row = np.repeat(np.arange(len(q)), min(k, len(v)))
            pick = np.argpartition(-score, min(k, len(v)) - 1, 1)[:, :k].reshape(-1)
            found = row, score[row, pick], v[pick]
            top = found if top is None else tuple(np.concatenate(c) for c in zip(top, found, strict=True))
            order = np.lexsort((-top[1], top[0]))
            first = np.searchsorted(top[0][order], np.arange(len(q)))
            order = order[np.arange(len(order)) - first[top[0][order]] < k]
            top = tuple(c[order] for c in top)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1].astype(np.float64)), pa.array(list(top[2]), pa.list_(pa.float64()))], names=["probe", "score", "v"])

    found = indexed.mapInArrow(best, "probe long, score double, v array<double>")
    order = Window.partitionBy("probe").orderBy(F.desc("score"))
    found = found.withColumn("n", F.row_number().over(order)).where((F.col("n") <= k) & (F.col("score") > -2)).select("probe", "v").toArrow()  # PROBES * k rows
    if not found.num_rows:
        return len(forest.way)
    at = forest.leaves(unit(matrix(found.column("v").combine_chunks(), dim)))
    reached, owner = [], found.column("probe").to_numpy()
    for p in range(len(q)):
        wanted = {(t, int(leaf)) for row in at[owner == p] for t, leaf in enumerate(row)}
        place = met(forest, q[p], wanted, at[owner == p])
        reached += place
    return int(np.quantile(reached, recall, method="higher"))


def met(forest: Forest, q: np.ndarray, wanted: set[tuple[int, int]], rows: np.ndarray) -> list[int]:
    """For each row of leaves, how many leaves of the queue it takes until one of them is met."""
    n = len(forest.way)
    while True:
        place = {leaf: i for i, leaf in enumerate(forest.search(q, n), 1) if leaf in wanted}
        out = [min((place[t, int(leaf)] for t, leaf in enumerate(row) if (t, int(leaf)) in place), default=0) for row in rows]
        if all(out):
            return out
        n *= 2


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, recall: float = RECALL, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    folder = common.shared_dir(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "float" if vectors.select(F.col(vec_col).alias("v")).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.exists("v", lambda x: x != 0.0)
    )
    first = Window.partitionBy("v").orderBy("vec_id")
    indexed = common.stage(rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"), folder, "indexed")
    total = indexed.count()
    fitted = indexed.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow().column("v").combine_chunks()
    if not total:
        return empty
    dim = sorted(Counter(fitted.value_lengths().to_pylist()).items(), key=lambda x: (-x[1], x[0]))[0][0]
    forest = Forest(unit(matrix(fitted.filter(pa.compute.equal(fitted.value_lengths(), dim)), dim)), total, trees, leaf)
    wanted = F.size("v") == dim
    # equal queries are asked once, under the least of their ids
    asking = common.stage(rows.where(wanted & (F.col("vec_id") % every == 0)).groupBy("vec_id").agg(F.min("v").alias("v")), folder, "asking")
    asked = common.stage(asking.groupBy("v").agg(F.min("vec_id").alias("asker")), folder, "asked")
    probes = asked.orderBy(F.xxhash64("asker"), "asker").limit(PROBES).toArrow().column("v").combine_chunks()
    if not len(probes):
        return empty
    leaves = enough(forest, matrix(probes, dim), indexed.where(wanted), k, recall)
    sent = spark.sparkContext.broadcast(forest)  # trees * (2 * SAMPLE / POINTS + levels) rows of dim floats at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the leaf in each tree."""
        for batch in batches:
            own = sent.value.leaves(unit(matrix(batch.column(1), dim)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "leaves"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the (tree, leaf) to look into, as tree + trees * leaf."""
        for batch in batches:
            found = [[t + trees * n for t, n in sent.value.search(q, leaves)] for q in unit(matrix(batch.column(0), dim))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (leaf, salt, kind): the leaf's vectors come before its queries."""
        here, ids, xs, own, out, held = None, [], [], None, [], 0

        def sent_on(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["asker", "vec_id", "score"])

        for batch in batches:
            at, salt, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            names, x = batch.column(3).to_numpy(), matrix(batch.column(4), dim)
            breaks = np.flatnonzero((np.diff(at) != 0) | (np.diff(salt) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *breaks], [*breaks, len(at)], strict=True):
                if a == b:
                    continue
                if here != (at[a], salt[a]):
                    here, ids, xs, own = (at[a], salt[a]), [], [], None
                if not asks[a]:
                    ids.append(names[a:b])
                    xs.append(x[a:b])
                elif ids:
                    own = own or Leaf(np.concatenate(ids), np.concatenate(xs))
                    out.append(own.answer(names[a:b], x[a:b], k + 1))
                    held += len(out[-1][0])
            if held > HELD:  # the best so far of each query; sent on if these are many
                out = [best_of(*(np.concatenate(c) for c in zip(*out, strict=True)), k + 1)]
                held = len(out[0][0])
                if 2 * held > HELD:
                    yield sent_on(out[0])
                    out, held = [], 0
        if out:
            yield sent_on(best_of(*(np.concatenate(c) for c in zip(*out, strict=True)), k + 1))

    placed = common.stage(indexed.where(wanted).mapInArrow(place, f"vec_id long, v array<{kind}>, leaves array<long>"), folder, "placed")
    dealt = placed.select("vec_id", "v", F.posexplode("leaves").alias("tree", "n")).select("vec_id", "v", (F.col("tree") + trees * F.col("n")).alias("leaf"))
    sizes = dealt.groupBy("leaf").count().where(F.col("count") > FULL).orderBy(F.desc("count"), "leaf").limit(HOT)
    hot = [(r["leaf"], -(-r["count"] // FULL)) for r in sizes.collect()]  # HOT rows at most
    hot = F.broadcast(spark.createDataFrame(hot, "leaf long, salts long"))
    salts = F.coalesce("salts", F.lit(1))
    looks = asked.mapInArrow(look, f"vec_id long, v array<{kind}>, leaves array<long>").select("vec_id", "v", F.explode("leaves").alias("leaf"))
    given = dealt.join(hot, "leaf", "left").select("leaf", F.pmod(F.xxhash64("vec_id"), salts).alias("salt"), F.lit(False).alias("asks"), "vec_id", "v")
    looks = looks.join(hot, "leaf", "left").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(True).alias("asks"), "vec_id", "v")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = given.union(looks).repartition(n, "leaf", "salt").sortWithinPartitions("leaf", "salt", "asks")
    found = both.mapInArrow(rank, "asker long, vec_id long, score double").groupBy("asker", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # k + 1 of each asker
    answers = found.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    names = asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")).join(asked, F.col("w") == F.col("v")).select("query_id", "asker")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return names.join(answers, "asker").select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
