"""Graph text (segments, links, paths, walks) to tables.

Every parser takes a DataFrame with a column ``value`` (one line) and ``rank`` (order), so that the
same code reads files and lines made from other tables. Path lines are filtered by masks before
their steps are exploded; rows are dealt anew after the explode, because one line may hold a whole
chromosome.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names


#: Steps of a path that one window sees at most; longer paths are dealt over tasks.
BLOCK = 1 << 16


class GraphError(ValueError):
    pass


@dataclass
class Graph:
    """nodes(node_id, name, len), edges(edge_id, u, u_fwd, v, v_fwd), paths(path_id, kind, sample,
    hap, seqid, start, end, id, display), steps(path_id, pos, node_id, fwd, len, p)."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    steps: DataFrame
    nice: bool = False
    #: Whether edges were made from the paths and have their labels as ids: steps need no look-up then.
    labelled: bool = False
    #: Frames that are kept for the numbers of nodes, edges and paths.
    held: list[DataFrame] = field(default_factory=list)

    def persist(self) -> Graph:
        for df in (self.nodes, self.edges, self.paths, self.steps):
            df.persist()
        return self

    def unpersist(self) -> None:
        """Releases all that the graph keeps; frames made from it are computed anew when read."""
        for df in (self.nodes, self.edges, self.paths, self.steps, *self.held):
            df.unpersist()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain or gzip file with their order in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("rank", F.struct("block", F.monotonically_increasing_id().alias("n"))).select("value", "rank")


def numbered(df: DataFrame, name: str, first: int = 1, held: list[DataFrame] | None = None) -> DataFrame:
    """Adds dense numbers in the order of ``rank``.

    The global order is found by a range sort; each partition numbers its rows from the counts of
    those before it, so no task sees all rows. The sorted rows are kept; ``held`` gets them.
    """
    ranged = df.repartitionByRange(F.col("rank")).sortWithinPartitions("rank").withColumn("__part", F.spark_partition_id())
    ranged = ranged.persist()
    if held is not None:
        held.append(ranged)
    counts = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())  # one row a partition
    at, offsets = first, []
    for part, n in counts:
        offsets.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(offsets or [(0, first)], "__part int, __first long")
    w = Window.partitionBy("__part").orderBy("rank")
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__first") + F.row_number().over(w) - 1).drop("__part", "__first")


def parse_nodes(lines: DataFrame, nice: bool = False, use_ln: bool = False, held: list[DataFrame] | None = None) -> DataFrame:
    """Segments: id by order (or their own number if ``nice``), length of the sequence.

    ``*`` has length 1 unless ``use_ln`` and the line has an LN tag.
    """
    cols = F.split("value", "\t")
    length = F.char_length(F.rtrim(cols[2]))
    if use_ln:
        length = F.when(cols[2] == "*", F.coalesce(F.nullif(F.regexp_extract("value", r"\tLN:i:([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))).otherwise(length)
    rows = lines.where(F.startswith("value", F.lit("S"))).select("rank", cols[1].alias("name"), length.cast("long").alias("len"))
    rows = rows.withColumn("node_id", F.col("name").cast("long")) if nice else numbered(rows, "node_id", held=held)
    return rows.select("node_id", "name", "len")


def check_nodes(nodes: DataFrame) -> None:
    twice = nodes.groupBy("name").count().where("count > 1").take(1)
    if twice:
        raise GraphError(f"segment {twice[0]['name']} occurs more than once")


def parse_links(lines: DataFrame, nodes: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Links in canonical direction, each once, numbered by first occurrence."""
    cols = F.split("value", "\t")
    rows = lines.where(F.startswith("value", F.lit("L"))).select("rank", cols[1].alias("a"), names.forward(cols[2]).alias("a_fwd"), cols[3].alias("b"), names.forward(cols[4]).alias("b_fwd"))
    a = nodes.select(F.col("name").alias("a"), F.col("node_id").alias("ua"))
    b = nodes.select(F.col("name").alias("b"), F.col("node_id").alias("vb"))
    rows = rows.join(a, "a", "left").join(b, "b", "left")
    edge = names.canonical_edge(F.col("ua"), F.col("a_fwd"), F.col("vb"), F.col("b_fwd"))
    rows = rows.select("rank", F.when(F.col("ua").isNull() | F.col("vb").isNull(), F.raise_error(F.concat(F.lit("link to an unknown segment: "), F.col("a"), F.lit(" "), F.col("b")))).otherwise(edge).alias("e"))
    return numbered(rows.groupBy("e").agg(F.min("rank").alias("rank")), "edge_id", held=held).select("edge_id", "e.*")


def parse_paths(lines: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Identity and raw step list of P and W lines."""
    cols = F.split("value", "\t")
    star = [F.when(cols[k] != "*", cols[k]) for k in range(1, 6)]
    p = lines.where(F.startswith("value", F.lit("P"))).select("rank", F.lit("P").alias("kind"), names.parse_name(cols[1]).alias("n"), F.rtrim(cols[2]).alias("raw"))
    w = lines.where(F.startswith("value", F.lit("W"))).select(
        "rank", F.lit("W").alias("kind"),
        F.struct(cols[1].alias("sample"), cols[2].alias("hap"), cols[3].alias("seqid"), star[3].cast("long").alias("start"), star[4].cast("long").alias("end")).alias("n"),
        F.rtrim(cols[6]).alias("raw"),
    )
    rows = numbered(p.unionByName(w), "path_id", 0, held).select("path_id", "kind", "n.*", "raw")
    own = names.path_id(F.col("sample"), F.col("hap"), F.col("seqid"))
    return rows.withColumn("id", own).withColumn("display", names.display(F.col("id"), F.col("start"), F.col("end")))


def explode_steps(paths: DataFrame, nodes: DataFrame, nice: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """path_id, pos, node_id, fwd, len, p (bp offset, from the path's start), and columns of the paths to carry.

    Carried are also ``name``, the segment's own, if asked for.
    """
    own = [c for c in carry if c != "name"]
    tokens = F.when(F.col("kind") == "P", F.filter(F.split("raw", ","), lambda t: t != "")).otherwise(F.regexp_extract_all("raw", F.lit("[<>][^<>]+"), F.lit(0)))
    steps = paths.select("path_id", F.col("kind").alias("__kind"), F.coalesce("start", F.lit(0)).alias("__start"), *own, F.posexplode(tokens).alias("pos", "token"))
    is_p = F.col("__kind") == "P"
    name = F.when(is_p, F.expr("left(token, length(token) - 1)")).otherwise(F.expr("substring(token, 2)"))
    fwd = F.when(is_p, F.right("token", F.lit(1)) == "+").otherwise(F.left("token", F.lit(1)) == ">")
    steps = steps.select("path_id", "__start", "pos", name.alias("name"), fwd.alias("fwd"), *own)
    if nice:
        steps = steps.withColumn("name", F.col("name").cast("long")).join(nodes.select(F.col("node_id").alias("name"), "node_id", "len"), "name", "left")
    else:
        steps = steps.join(nodes.select("name", "node_id", "len"), "name", "left")
    known = F.when(F.col("node_id").isNull(), F.raise_error(F.concat(F.lit("path over an unknown segment: "), F.col("name").cast("string")))).otherwise(F.col("node_id"))
    return with_offsets(steps.withColumn("node_id", known)).select("path_id", "pos", "node_id", "fwd", "len", (F.col("__start") + F.col("p")).alias("p"), *carry)


def with_offsets(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``p``, the lengths of the steps before; a window sees ``block`` steps of a path at most."""
    steps = steps.withColumn("__block", F.floor(F.col("pos") / block).cast("int"))
    inside = Window.partitionBy("path_id", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("p", F.sum("len").over(inside) - F.col("len"))
    # one row a block, and of paths of a single block none goes on
    sums = steps.groupBy("path_id", "__block").agg(F.sum("len").alias("__sum"))
    before = Window.partitionBy("path_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.sum("__sum").over(before)).where("__block > 0").select("path_id", "__block", "__before")
    return steps.join(sums, ["path_id", "__block"], "left").withColumn("p", F.col("p") + F.coalesce("__before", F.lit(0))).drop("__block", "__before")


def with_next(steps: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``next``, those columns of the step that follows on the path, and leaves last steps out."""
    steps = steps.withColumn("__block", F.floor(F.col("pos") / block).cast("int"))
    here = F.struct(*columns)
    firsts = steps.where((F.col("__block") > 0) & (F.col("pos") % block == 0)).select("path_id", (F.col("__block") - 1).alias("__block"), here.alias("__first"))
    inside = Window.partitionBy("path_id", "__block").orderBy("pos")
    # the last step of a block goes on with the first of the next one
    steps = steps.withColumn("next", F.lead(here).over(inside)).join(firsts, ["path_id", "__block"], "left")
    return steps.withColumn("next", F.coalesce("next", F.when((F.col("pos") + 1) % block == 0, F.col("__first")))).where("next is not null").drop("__block", "__first")


def graph_of(lines: DataFrame, nice: bool = False, use_ln: bool = False, check: bool = True) -> Graph:
    held: list[DataFrame] = []
    nodes = parse_nodes(lines, nice, use_ln, held)
    if check:
        check_nodes(nodes)
    paths = parse_paths(lines, held)
    return Graph(nodes, parse_links(lines, nodes, held), paths.drop("raw"), explode_steps(paths, nodes, nice), nice, held=held)


def read_graph(spark: SparkSession, path: str, nice: bool = False, use_ln: bool = False) -> Graph:
    return graph_of(read_lines(spark, path), nice, use_ln)
