"""Masks, groups, presence, coverage and histograms.

One relation drives everything: presence(item, group_idx, visits). Steps are reduced to distinct
(item, group) pairs before they are counted, so an item that every path visits costs at most one
row a group; Spark combines on the map side. Masks are joined on the path id with an overlap
condition; they are as small as users write them, and Spark broadcasts them only below its limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..model import Grouping
from ..sources import tables
from ..sources.graph import Graph, GraphError, with_next

END = tables.OPEN_END


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching [start, end) of each key become one. One without a start begins nothing: it goes with the key's last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"), F.lit(0)))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (low < end) & (high > start)


def subtract_intervals(df: DataFrame, less: DataFrame, keys: list[str]) -> DataFrame:
    """keys, covered: length of the merged intervals of ``df`` that ``less`` leaves."""
    own = merge_intervals(df, keys).withColumn("size", F.col("end") - F.col("start"))
    gone = merge_intervals(less, keys).select(*keys, F.col("start").alias("ls"), F.col("end").alias("le"))
    cut = own.join(gone, keys).where(overlap(F.col("start"), F.col("end"), F.col("ls"), F.col("le")))
    cut = cut.groupBy(*keys).agg(F.sum(F.least("end", "le") - F.greatest("start", "ls")).alias("cut"))
    return own.groupBy(*keys).agg(F.sum("size").alias("size")).join(cut, keys, "left").select(*keys, (F.col("size") - F.coalesce("cut", F.lit(0))).alias("covered"))


def load_coords(spark: SparkSession, text: str, paths: DataFrame) -> DataFrame:
    """A list of paths or intervals: a file, else an expression that path names match."""
    import os

    if os.path.exists(text.removeprefix("file://")):
        return tables.read_bed(spark, text)
    got = paths.where(F.col("display").rlike(text)).select(F.struct(F.lit(0).alias("block"), F.col("path_id").alias("n")).alias("rank"), "id", "start", "end", "display")
    if not got.take(1):
        raise GraphError(f"{text!r} is neither a file nor an expression that a path matches")
    return got


def assign_groups(paths: DataFrame, grouping: Grouping, groups: DataFrame | None = None) -> DataFrame:
    """paths with group_name. Paths that a group file leaves out are their own group."""
    if grouping.kind == "sample":
        return paths.withColumn("group_name", F.col("sample"))
    if grouping.kind == "haplotype":
        return paths.withColumn("group_name", F.concat_ws("#", "sample", F.coalesce("hap", F.lit(""))))
    if groups is None:
        return paths.withColumn("group_name", F.col("id"))
    twice = groups.distinct().groupBy("key").count().where("count > 1").take(1)
    if twice:
        raise GraphError(f"path {twice[0]['key']} is in two groups")
    return paths.join(groups.distinct().withColumnRenamed("key", "id"), "id", "left").withColumn("group_name", F.coalesce("group_name", "id"))


def expand_groups(coords: DataFrame, grouped: DataFrame) -> DataFrame:
    """Entries that name no path but a group become the paths of that group; others go."""
    ids = grouped.select("id").distinct()
    direct = coords.join(ids, "id", "left_semi")
    rest = coords.join(ids, "id", "left_anti").select("rank", F.col("id").alias("group_name"))
    via = rest.join(grouped.select("group_name", "id", "start", "end", "display"), "group_name").select("rank", "id", "start", "end", "display")
    return direct.select("rank", "id", "start", "end", "display").unionByName(via)


def unknown_names(coords: DataFrame, grouped: DataFrame, most: int = 20) -> list[str]:
    """Up to ``most`` entries of a list that name neither a path nor a group; these are passed over."""
    known = grouped.select("id").union(grouped.select(F.col("group_name").alias("id"))).distinct()
    return [r["id"] for r in coords.select("id").distinct().join(known, "id", "left_anti").orderBy("id").limit(most).collect()]


def group_order(grouped: DataFrame, source: DataFrame | None, excluded: DataFrame | None = None) -> DataFrame:
    """group_name, group_idx: groups by the first mention of a path of theirs.

    ``source``: an order list or the subset (rank, id); without one the order of the file, less
    paths that are excluded by their full name.
    """
    if source is None:
        rows = grouped if excluded is None else grouped.join(excluded.select("display").distinct(), "display", "left_anti")
        rows = rows.select("group_name", F.struct(F.lit(0).cast("long").alias("block"), F.col("path_id").cast("long").alias("n")).alias("rank"))
    else:
        rows = source.join(grouped.select("id", "group_name").distinct(), "id").select("group_name", F.struct(F.col("rank.block").cast("long").alias("block"), F.col("rank.n").cast("long").alias("n")).alias("rank"))
    first = rows.groupBy("group_name").agg(F.min("rank").alias("rank"))
    # one row a group: their number is that of genomes, not of the data
    return first.select("group_name", (F.row_number().over(Window.orderBy("rank")) - 1).cast("int").alias("group_idx"))


def check_order(grouped: DataFrame, order: DataFrame) -> list[str]:
    """Groups whose paths the order list does not keep together; an error if there are any."""
    rows = order.join(grouped.select("id", "group_name").distinct(), "id").select("rank", "group_name")
    # groups are kept together if their ranges of places do not overlap: one row a group is compared
    spans = rows.groupBy("group_name").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    w = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max(F.struct("high", "group_name")).over(w)).where(F.col("before.high") > F.col("low"))
    # a group that another one stands inside is the parted one
    broken = {r["group_name"] for r in spans.select(F.col("before.group_name").alias("group_name")).distinct().collect()}
    if broken:
        raise GraphError(f"the order parts the paths of {', '.join(sorted(broken))}")
    return broken


@dataclass
class Counted:
    """A graph with masks and groups; each property is a plan over them.

    ``include``, ``exclude``: rank, id, start, end, display. ``strict_bp``: excluded base pairs are
    taken off also where no subset is given.
    """

    graph: Graph
    grouping: Grouping = Grouping()
    include: DataFrame | None = None
    exclude: DataFrame | None = None
    groups: DataFrame | None = None
    order: DataFrame | None = None
    strict_bp: bool = False

    @cached_property
    def grouped(self) -> DataFrame:
        return assign_groups(self.graph.paths, self.grouping, self.groups)

    @cached_property
    def included(self) -> DataFrame | None:
        return None if self.include is None else expand_groups(self.include, self.grouped)

    @cached_property
    def excluded(self) -> DataFrame | None:
        return None if self.exclude is None else expand_groups(self.exclude, self.grouped)

    @cached_property
    def group_index(self) -> DataFrame:
        source = None if self.order is None else expand_groups(self.order, self.grouped)
        if source is not None:
            check_order(self.grouped, source)
        if source is None:
            source = self.included
        return group_order(self.grouped, source, self.excluded)

    @cached_property
    def group_counts(self) -> tuple[int, int]:
        """Groups; those of them that have a name."""
        return tuple(self.group_index.agg(F.count("*"), F.count("group_name")).first())

    @property
    def n_groups(self) -> int:
        return self.group_counts[0]

    @property
    def n_named(self) -> int:
        """The most groups an item can have: paths without a name of their group count in none."""
        return self.group_counts[1]

    def spans(self, mask: DataFrame) -> DataFrame:
        rows = mask.select("id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(END)).alias("end"))
        return merge_intervals(rows, ["id"]).select("id", F.col("start").alias("ms"), F.col("end").alias("me"))

    @cached_property
    def owners(self) -> DataFrame:
        """path_id, id, group_idx of the paths that the masks touch."""
        rows = self.grouped.select("path_id", "id", "group_name", F.coalesce("start", F.lit(0)).alias("ps"), F.coalesce("end", F.lit(END)).alias("pe"))
        if self.included is not None:
            masks = self.spans(self.included)
            if self.excluded is not None:
                masks = masks.unionByName(self.spans(self.excluded))
            # path masks touch if they meet, ends included
            hit = rows.join(masks, "id").where("ms <= pe and me >= ps").select("path_id").distinct()
            rows = rows.join(hit, "path_id", "left_semi")
        return rows.join(self.group_index, "group_name", "left").select("path_id", "id", "group_idx")

    @cached_property
    def placed(self) -> DataFrame:
        """Steps of masked paths: path_id, pos, node_id, fwd, len, p, id, group_idx."""
        return self.graph.steps.join(self.owners, "path_id")

    @cached_property
    def links(self) -> DataFrame:
        """Consecutive steps as edges, placed on their second node."""
        rows = with_next(self.placed, ["node_id", "fwd", "len", "p"])
        edge = names.canonical_edge(F.col("node_id"), F.col("fwd"), F.col("next.node_id"), F.col("next.fwd"))
        rows = rows.select("path_id", "pos", "id", "group_idx", edge.alias("e"), F.col("next.p").alias("p"), F.col("next.len").alias("len"))
        rows = rows.select("*", "e.*").drop("e")
        if self.graph.labelled:
            return rows.select("path_id", "pos", "id", "group_idx", names.edge_label(F.col("u"), F.col("u_fwd"), F.col("v"), F.col("v_fwd")).alias("item"), "p", "len")
        edges = self.graph.edges.withColumnRenamed("edge_id", "item")
        known = rows.join(edges, ["u", "u_fwd", "v", "v_fwd"], "left")
        item = F.when(F.col("item").isNull(), F.raise_error(F.concat(F.lit("path over an edge that is not in the graph: "), names.edge_label(F.col("u"), F.col("u_fwd"), F.col("v"), F.col("v_fwd"))))).otherwise(F.col("item"))
        return known.select("path_id", "pos", "id", "group_idx", item.alias("item"), "p", "len")

    def rows_of(self, measure: str) -> DataFrame:
        return self.links if measure == "edge" else self.placed.withColumn("item", F.col("node_id"))

    def kept_rows(self, measure: str) -> DataFrame:
        rows = self.rows_of(measure)
        if self.included is not None:
            inside = rows.join(self.spans(self.included), "id").where(overlap(F.col("p"), F.col("p") + F.col("len"), F.col("ms"), F.col("me")))
            rows = inside.drop("ms", "me").dropDuplicates(["path_id", "pos"])
        gone = self.excluded_items(measure)
        return rows if gone is None else rows.join(gone, "item", "left_anti")

    def node_spans(self, mask: DataFrame) -> DataFrame:
        """node_id, start, end, len of the parts of nodes that a mask covers, in node coordinates."""
        hit = self.placed.join(self.spans(mask), "id").where(overlap(F.col("p"), F.col("p") + F.col("len"), F.col("ms"), F.col("me")))
        a, b = F.greatest(F.col("ms") - F.col("p"), F.lit(0)), F.least(F.col("me") - F.col("p"), F.col("len"))
        return hit.select("node_id", "len", F.when(F.col("fwd"), a).otherwise(F.col("len") - b).alias("start"), F.when(F.col("fwd"), b).otherwise(F.col("len") - a).alias("end"))

    def excluded_items(self, measure: str) -> DataFrame | None:
        """Nodes and edges that an excluded interval touches on any path; for bp, nodes it covers."""
        if self.excluded is None:
            return None
        if measure == "bp":
            merged = merge_intervals(self.node_spans(self.excluded), ["node_id", "len"])
            return merged.where("start <= 0 and end >= len").select(F.col("node_id").alias("item")).distinct()
        hit = self.rows_of(measure).join(self.spans(self.excluded), "id").where(overlap(F.col("p"), F.col("p") + F.col("len"), F.col("ms"), F.col("me")))
        return hit.select("item").distinct()

    @cached_property
    def uncovered(self) -> DataFrame | None:
        """item, uncovered: base pairs of visited nodes that the masks leave out."""
        if self.included is None and not (self.strict_bp and self.excluded is not None):
            return None
        if self.included is not None:
            spans = self.node_spans(self.included)
        else:
            spans = self.placed.select("node_id", "len", F.lit(0).cast("long").alias("start"), F.col("len").alias("end"))
        less = self.node_spans(self.excluded) if self.excluded is not None else spans.where("false")
        covered = subtract_intervals(spans.drop("len"), less.drop("len"), ["node_id"])
        rows = covered.join(self.graph.nodes.select("node_id", "len"), "node_id").select(F.col("node_id").alias("item"), (F.col("len") - F.col("covered")).alias("uncovered"))
        gone = self.excluded_items("bp")
        rows = rows if gone is None else rows.join(gone, "item", "left_anti")
        return rows.where("uncovered > 0")

    def presence(self, measure: str = "node") -> DataFrame:
        """item, group_idx, visits."""
        return self.kept_rows(measure).where("group_idx is not null").groupBy("item", "group_idx").agg(F.count("*").alias("visits"))

    def items(self, measure: str = "node") -> DataFrame:
        """item, weight (1, or base pairs that count), uncovered."""
        if measure == "edge":
            return self.graph.edges.select(F.col("edge_id").alias("item"), F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("uncovered"))
        nodes = self.graph.nodes.select(F.col("node_id").alias("item"), F.col("len"))
        if measure == "node":
            return nodes.select("item", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("uncovered"))
        if self.uncovered is None:
            return nodes.select("item", F.col("len").alias("weight"), F.lit(0).cast("long").alias("uncovered"))
        rows = nodes.join(self.uncovered, "item", "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))
        return rows.select("item", (F.col("len") - F.col("uncovered")).alias("weight"), "uncovered")

    def coverage(self, measure: str = "node") -> DataFrame:
        """item, cov, weight, uncovered; items that no path visits have cov 0."""
        cov = self.presence(measure).groupBy("item").agg(F.count("*").cast("int").alias("cov"))
        return self.items(measure).join(cov, "item", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))

    def hist(self, measure: str = "node") -> DataFrame:
        """count, coverage 0..G, n."""
        return self.hists([measure])

    def hists(self, measures: Sequence[str]) -> DataFrame:
        """count, coverage 0..G, n of several measures. Without masks nodes and base pairs are one pass."""
        spark = self.graph.nodes.sparkSession
        passes = [["node", "bp"], *[[m] for m in measures if m not in ("node", "bp")]] if {"node", "bp"} <= set(measures) and self.uncovered is None and self.excluded is None else [[m] for m in measures]
        parts = []
        for own in passes:
            cov = self.coverage(own[-1])
            beyond = F.raise_error(F.concat(F.lit("an item has more groups than there are: "), F.col("item").cast("string")))
            cov = cov.withColumn("cov", F.when(F.col("cov") > self.n_named, beyond).otherwise(F.col("cov")))
            # base pairs that masks leave out count as not covered
            sums = {m: F.count("*") if m == "node" and len(own) > 1 else F.sum("weight") for m in own}
            rows = cov.groupBy(F.col("cov").alias("coverage")).agg(*[x.alias(m) for m, x in sums.items()], F.sum("uncovered").alias("left_out"))
            # both from one row: a union of two selections would plan and compile everything below twice
            pairs = [(m, at, n) for m in own for at, n in ((F.col("coverage"), F.col(m)), (F.lit(0), F.col("left_out")))]
            parts.append(rows.select(F.inline(F.array(*[F.struct(F.lit(m).alias("count"), at.alias("coverage"), n.alias("n")) for m, at, n in pairs]))))
        rows = reduce(DataFrame.unionByName, parts).groupBy("count", "coverage").agg(F.sum("n").alias("n"))
        full = spark.range(self.n_named + 1).select(F.explode(F.array(*map(F.lit, measures))).alias("count"), F.col("id").cast("int").alias("coverage"))
        return full.join(rows, ["count", "coverage"], "left").select("count", "coverage", F.coalesce("n", F.lit(0)).alias("n"))

    def table(self, measure: str = "node", total: bool = False) -> DataFrame:
        """Long form of the coverage table: item, group_idx, value (visits, weighed for bp), or item, value (groups)."""
        p = self.presence(measure)
        if total:
            return self.items(measure).select("item").join(p.groupBy("item").agg(F.count("*").alias("value")), "item", "left").select("item", F.coalesce("value", F.lit(0)).alias("value"))
        return p.join(self.items(measure), "item").select("item", "group_idx", (F.col("visits") * F.col("weight")).alias("value"))

    def path_lengths(self) -> DataFrame:
        """path_id, nodes, bp. With a subset, a node counts once for each interval that it meets."""
        rows = self.placed
        if self.included is not None:
            rows = rows.join(self.spans(self.included), "id").where(overlap(F.col("p"), F.col("p") + F.col("len"), F.col("ms"), F.col("me")))
            rows = rows.withColumn("len", F.least(F.col("p") + F.col("len"), F.col("me")) - F.greatest("p", "ms"))
        return rows.groupBy("path_id").agg(F.count("*").alias("nodes"), F.sum("len").alias("bp"))
