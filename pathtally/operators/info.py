"""Statistics of a graph: sizes, degrees, components, lengths of nodes and paths, groups; node hexbins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .counting import Counted


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree; a loop counts twice."""
    each = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(each, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in that of ``spark.checkpoint.dir``; where no folder is set, a temporary one is if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pathtally-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pathtally-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: neither its plan nor Spark's estimate of its size goes on."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component (its smallest node), by least labels and pointer jumping.

    Each round is written to a folder that driver and executors share, and the one before is deleted,
    so plans stay small, lost executors cost a round at most, and nothing is kept in memory. A
    checkpoint would not do: it keeps the estimated size, for a join the product of both sides, so
    that the digits of this number double in each round and fill the driver. Joins are by sorting, as
    the files' sizes may be below the limit for a broadcast while the rows they hold are many.
    """
    spark, k = nodes.sparkSession, 0
    folder = shared_folder(spark)
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
    both = staged(both, f"{folder}/edges")
    # the first round needs no labels: a node's own number and the least of those beside it
    near = both.groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("near"))
    labels = nodes.select("node_id").join(near.hint("merge"), "node_id", "left").select("node_id", F.least("node_id", F.coalesce("near", "node_id")).alias("component"))
    labels = staged(labels, f"{folder}/round-0")
    while True:
        near = both.join(labels.withColumnRenamed("node_id", "b").hint("merge"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        low = labels.join(near.hint("merge"), "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        # what a node has found goes to the node that labels it too, else a label moves along a chain by few steps a round
        hook = low.groupBy(F.col("component").alias("node_id")).agg(F.min("low").alias("hook"))
        low = low.join(hook.hint("merge"), "node_id", "left").select("node_id", "component", F.least("low", F.coalesce("hook", "low")).alias("low"))
        far = labels.select(F.col("node_id").alias("low"), F.col("component").alias("far"))
        step = low.join(far.hint("merge"), "low").select("node_id", F.least("low", "far").alias("new"), "component")
        step, k = staged(step, f"{folder}/round-{k + 1}"), k + 1
        dropped(spark, f"{folder}/round-{k - 1}")
        labels = step.select("node_id", F.col("new").alias("component"))
        if not step.where("new < component").take(1):
            dropped(spark, f"{folder}/edges")
            return labels


def n50(lengths: DataFrame, column: str) -> DataFrame:
    """One row: the length at which the longest first hold half of the total.

    Counted by distinct lengths, of which there are far fewer than rows.
    """
    each = lengths.groupBy(F.col(column).alias("len")).agg((F.count("*") * F.col(column)).alias("bp"))
    w = Window.orderBy(F.desc("len"))
    run = each.select("len", F.sum("bp").over(w).alias("run")).crossJoin(each.agg(F.sum("bp").alias("total")))
    return run.where("2 * run >= total").agg(F.max("len").alias("n50"))


def graph_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges).agg(F.avg("degree").alias("degree_avg"), F.max("degree").alias("degree_max"), F.min("degree").alias("degree_min"), F.sum((F.col("degree") == 0).cast("long")).alias("zero_degree"))
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("len").alias("bp"))
    return size.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(d)


def component_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.min("size").alias("smallest"), F.median("size").alias("median"))


def node_info(nodes: DataFrame) -> DataFrame:
    base = nodes.agg(F.avg("len").alias("avg"), F.max("len").alias("max"), F.min("len").alias("min"), F.median("len").alias("median"))
    return base.crossJoin(n50(nodes, "len"))


def path_info(lengths: DataFrame) -> DataFrame:
    aggs = [f(c).alias(f"{c}_{n}") for c in ("bp", "nodes") for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))]
    return lengths.agg(F.count("*").alias("paths"), *aggs)


def group_info(counted: Counted) -> DataFrame:
    """group_name, nodes, bp over all paths of each group."""
    names = counted.grouped.select("path_id", "group_name")
    return counted.path_lengths().join(names, "path_id").groupBy("group_name").agg(F.sum("nodes").alias("nodes"), F.sum("bp").alias("bp"))


def info_table(counted: Counted) -> list[tuple[str, str, str, float]]:
    """feature, category, countable, value: 24 scalars, then two rows a group by name."""
    g = counted.graph
    a, c, n = graph_info(g.nodes, g.edges).first(), component_info(g.nodes, g.edges).first(), node_info(g.nodes).first()
    p = path_info(counted.path_lengths()).first()
    groups = counted.grouped.agg(F.countDistinct("group_name")).first()[0]
    out = [
        ("graph", "total", "node", a.nodes), ("graph", "total", "bp", a.bp), ("graph", "total", "edge", a.edges), ("graph", "total", "path", p.paths), ("graph", "total", "group", groups),
        ("graph", "total", "0-degree node", a.zero_degree), ("graph", "total", "component", c.components), ("graph", "largest", "component", c.largest), ("graph", "smallest", "component", c.smallest),
        ("graph", "median", "component", c["median"]), ("node", "average", "bp", n.avg), ("node", "average", "degree", a.degree_avg), ("node", "longest", "bp", n["max"]), ("node", "shortest", "bp", n["min"]),
        ("node", "median", "bp", n["median"]), ("node", "N50 node", "bp", n.n50), ("node", "max", "degree", a.degree_max), ("node", "min", "degree", a.degree_min),
        ("path", "average", "bp", p.bp_avg), ("path", "longest", "bp", p.bp_max), ("path", "shortest", "bp", p.bp_min), ("path", "average", "node", p.nodes_avg), ("path", "longest", "node", p.nodes_max), ("path", "shortest", "node", p.nodes_min),
    ]
    for r in group_info(counted).orderBy("group_name").collect():
        out += [("group", r.group_name, "bp", r.bp), ("group", r.group_name, "node", r.nodes)]
    return out


def rebin(values: dict[str, float], most: int = 100, bins: int = 50) -> list[tuple[str, float]]:
    """Bars of groups: one each, or counts over equal ranges if there are more than ``most``."""
    if len(values) <= most:
        return sorted(values.items())
    low, high = min(values.values()), max(values.values())
    width = max((high - low) / bins, 1)
    counts = [0] * bins
    for v in values.values():
        counts[min(int((v - low) / width), bins - 1)] += 1
    return [(f"{low + k * width:g}-{low + (k + 1) * width:g}", float(n)) for k, n in enumerate(counts)]


def hexbin_nodes(coverage: DataFrame, nx: int = 15, ny: int = 9) -> DataFrame:
    """item, x, y: the bin of each node, by coverage and log10 of its length, on two interleaved lattices.

    ``coverage``: node coverage with column len. A point belongs to the nearer lattice centre.
    """
    points = coverage.select("item", F.col("cov").cast("double").alias("x"), F.log10(F.col("len").cast("double")).alias("y"))
    top = points.agg((F.max("x") / (nx - 1)).alias("dx0"), (F.max("y") / (ny - 1)).alias("dy0"))
    top = top.select(F.when(F.col("dx0") > 0, F.col("dx0")).otherwise(1.0).alias("dx"), F.when(F.col("dy0") > 0, F.col("dy0")).otherwise(1.0).alias("dy"))
    p = points.crossJoin(F.broadcast(top))  # one row
    ax, ay = F.round(F.col("x") / F.col("dx")), F.round(F.col("y") / F.col("dy"))
    bx, by = F.floor(F.col("x") / F.col("dx")), F.floor(F.col("y") / F.col("dy"))
    p = p.select("item", "dx", "dy", ax.alias("ax"), ay.alias("ay"), bx.cast("double").alias("bx"), by.cast("double").alias("by"), (F.col("x") / F.col("dx")).alias("ux"), (F.col("y") / F.col("dy")).alias("uy"))

    def far(x: str, y: str, shift: float):
        return F.hypot((F.col("ux") - F.col(x) - shift) * F.col("dx"), (F.col("uy") - F.col(y) - shift) * F.col("dy"))

    near = far("ax", "ay", 0.0) < far("bx", "by", 0.5)
    return p.select("item", F.when(near, F.col("ax") * F.col("dx")).otherwise((F.col("bx") + 0.5) * F.col("dx")).alias("x"), F.when(near, F.col("ay") * F.col("dy")).otherwise((F.col("by") + 0.5) * F.col("dy")).alias("y"))


def hexbins(coverage: DataFrame, nx: int = 15, ny: int = 9) -> DataFrame:
    """x, y, size: nodes a bin."""
    return hexbin_nodes(coverage, nx, ny).groupBy(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).agg(F.count("*").alias("size"))
