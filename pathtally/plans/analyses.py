"""The analyses: each gives a table as text and a section of the report."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..model import Count, Linkage, Run, pairs_of
from ..operators import growth, info, similarity
from ..operators.counting import Counted, load_coords, unknown_names
from ..sources import graph as graphs
from ..sources import tables


class State:
    """One run's graph with masks and groups; built once, never changed."""

    def __init__(self, spark: SparkSession, run: Run, graph: graphs.Graph | None = None):
        self.spark, self.run = spark, run
        self._graph = graph

    @cached_property
    def graph(self) -> graphs.Graph:
        return (self._graph or graphs.read_graph(self.spark, self.run.graph, self.run.nice)).persist()

    def counted(self, order: str | None = None) -> Counted:
        r, paths = self.run, self.graph.paths
        out = Counted(
            self.graph, r.grouping,
            include=load_coords(self.spark, r.subset, paths) if r.subset else None,
            exclude=load_coords(self.spark, r.exclude, paths) if r.exclude else None,
            groups=tables.read_groups(self.spark, r.grouping.file) if r.grouping.file else None,
            order=load_coords(self.spark, order, paths) if order else None,
        )
        for what, given in (("subset", out.include), ("exclusion", out.exclude), ("order", out.order)):
            for name in unknown_names(given, out.grouped) if given is not None else ():
                logging.getLogger("pathtally").warning("%s: %s is no path or group of the graph and is passed over", what, name)
        return out

    @cached_property
    def base(self) -> Counted:
        return self.counted()

    def hist(self, measure: str) -> list[int]:
        """A histogram, kept for all analyses of the run: one row a group."""
        if not hasattr(self, "_hists"):
            self._hists: dict[str, list[int]] = {}
        if measure not in self._hists:
            masked = self.run.subset or self.run.exclude
            wanted = [measure] if measure == "edge" or masked else ["node", "bp"]  # without masks these two cost one pass
            for r in self.base.hists(wanted).orderBy("count", "coverage").collect():
                self._hists.setdefault(r["count"], []).append(r.n)
        return self._hists[measure]

    def group_names(self, counted: Counted) -> list[str]:
        return [r.group_name for r in counted.group_index.orderBy("group_idx").collect()]


class Analysis(Protocol):
    def table(self, state: State) -> str: ...

    def section(self, state: State) -> list[dict]: ...

    def needs(self) -> set[str]: ...


def bar(id_: str, labels: list, values: list, log: bool = True) -> dict:
    return {"kind": "bar", "id": id_, "labels": labels, "values": values, "log_toggle": log}


@dataclass
class Hist:
    count: Count = Count.NODE

    def needs(self) -> set[str]:
        return {"hist", *self.count.measures}

    def table(self, state: State) -> str:
        m = self.count.measures
        heads = [["panel", *["hist"] * len(m)], ["count", *m], ["coverage", *[""] * len(m)], ["quorum", *[""] * len(m)]]
        return tables.format_table(heads, [state.hist(x) for x in m])

    def section(self, state: State) -> list[dict]:
        return [{"title": f"coverage histogram ({x})", "items": [bar(f"hist-{x}", list(range(len(h))), h)], "table": self.table(state)} for x in self.count.measures for h in [state.hist(x)]]


@dataclass
class CoverageLine:
    count: Count = Count.NODE
    reference: str | None = None

    def needs(self) -> set[str]:
        return {"hist", *self.count.measures}

    def table(self, state: State) -> str:
        m = self.count.measures
        return tables.format_table([["panel", *["coverage"] * len(m)], ["count", *m]], [state.hist(x) for x in m], start=1)

    def section(self, state: State) -> list[dict]:
        out = []
        for x in self.count.measures:
            h = state.hist(x)
            out.append({"title": f"coverage line ({x})", "items": [{"kind": "line", "id": f"line-{x}", "x": list(range(1, len(h))), "y": h[1:], "log_x": True, "log_y": True}], "table": self.table(state)})
        return out


def growth_text(hists: dict[str, list[int]], coverage: str, quorum: str, add_hist: bool, by_quorum: bool = False) -> tuple[str, dict[str, list[list[float]]]]:
    """The growth table and the curves; ``by_quorum``: columns in the order of quorum, then coverage."""
    pairs = pairs_of(coverage, quorum)
    heads = [["panel"], ["count"], ["coverage"], ["quorum"]]
    columns, curves = [], {}
    if add_hist:
        for m, h in hists.items():
            for head, x in zip(heads, ("hist", m, "", ""), strict=True):
                head.append(x)
            columns.append(h)
    for m, h in hists.items():
        for c, q in sorted(pairs, key=lambda x: (x[1].value, x[0].value)) if by_quorum else pairs:
            for head, x in zip(heads, ("growth", m, f"{c.value:g}", f"{q.value:g}"), strict=True):
                head.append(x)
            curve = growth.growth(h, c, q)
            curves.setdefault(m, []).append(curve)
            columns.append([float("nan"), *curve])
    return tables.format_table(heads, columns), curves


@dataclass
class Growth:
    coverage: str = "1"
    quorum: str = "0"
    add_hist: bool = False
    count: Count = Count.NODE
    by_quorum: bool = False

    def needs(self) -> set[str]:
        return {"hist", *self.count.measures}

    def hists(self, state: State) -> dict[str, list[int]]:
        return {m: state.hist(m) for m in self.count.measures}

    def table(self, state: State) -> str:
        return growth_text(self.hists(state), self.coverage, self.quorum, self.add_hist, self.by_quorum)[0]

    @staticmethod
    def of_file(spark: SparkSession, path: str, coverage: str = "1", quorum: str = "0", add_hist: bool = False, by_quorum: bool = False) -> str:
        """Growth from a histogram table, without a graph."""
        hists: dict[str, dict[int, int]] = {}
        for r in tables.read_hist(spark, path).collect():
            hists.setdefault(r["count"], {})[r["coverage"]] = r["n"]
        return growth_text({m: [h.get(i, 0) for i in range(max(h) + 1)] for m, h in hists.items()}, coverage, quorum, add_hist, by_quorum)[0]

    def section(self, state: State) -> list[dict]:
        text, curves = growth_text(self.hists(state), self.coverage, self.quorum, self.add_hist)
        labels = [f"coverage >= {c.value:g}, quorum >= {q.value:.0%}" for c, q in pairs_of(self.coverage, self.quorum)]
        return [{"title": f"growth ({m})", "items": [{"kind": "multibar", "id": f"growth-{m}", "names": labels, "labels": list(range(1, len(y[0]) + 1)), "values": y}], "table": text} for m, y in curves.items() if y and y[0]]


@dataclass
class OrderedGrowth:
    coverage: str = "1"
    quorum: str = "0"
    order: str | None = None
    count: Count = Count.NODE
    strict_quorum: bool = False

    def needs(self) -> set[str]:
        return {"presence", *self.count.measures}

    def curves(self, state: State) -> tuple[list[str], list[list[float]]]:
        if self.count is Count.ALL:
            raise ValueError("ordered growth takes one count")
        x, m = state.counted(self.order), self.count.value
        out = []
        for c, q in pairs_of(self.coverage, self.quorum):
            rows = growth.ordered_growth(x.presence(m), x.items(m), x.n_groups, c, q, self.strict_quorum).orderBy("group_idx").collect()
            out.append([r.value for r in rows])
        return state.group_names(x), out

    def table(self, state: State) -> str:
        names_, curves = self.curves(state)
        pairs = pairs_of(self.coverage, self.quorum)
        heads = [["panel", *["ordered-growth"] * len(pairs)], ["count", *[self.count.value] * len(pairs)], ["coverage", *[f"{c.value:g}" for c, _ in pairs]], ["quorum", *[f"{q.value:g}" for _, q in pairs]]]
        return tables.format_table(heads, curves, names_)

    def section(self, state: State) -> list[dict]:
        names_, curves = self.curves(state)
        labels = [f"coverage >= {c.value:g}, quorum >= {q.value:.0%}" for c, q in pairs_of(self.coverage, self.quorum)]
        return [{"title": f"ordered growth ({self.count.value})", "items": [{"kind": "multibar", "id": f"ordered-{self.count.value}", "names": labels, "labels": names_, "values": curves}], "table": self.table(state)}]


@dataclass
class Table:
    count: Count = Count.NODE
    total: bool = False
    order: str | None = None

    def needs(self) -> set[str]:
        return {"presence", *self.count.measures}

    def frame(self, state: State):
        """One row an item, one column a group: a DataFrame, for writing at any size."""
        if self.count is Count.ALL:
            raise ValueError("a table takes one count")
        x, m = state.counted(self.order), self.count.value
        long = x.table(m, self.total)
        if m == "edge":
            e = state.graph.edges
            label = e.select(F.col("edge_id").alias("item"), names.edge_label(F.col("u"), F.col("u_fwd"), F.col("v"), F.col("v_fwd")).alias("name"))
        else:
            label = state.graph.nodes.select(F.col("node_id").alias("item"), "name")
        if self.total:
            return label.join(long, "item").select("item", "name", F.col("value").alias("total"))
        groups = state.group_names(x)
        wide = long.groupBy("item").pivot("group_idx", list(range(len(groups)))).agg(F.sum("value"))
        cells = [F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(g) for k, g in enumerate(groups)]
        return label.join(wide, "item", "left").select("item", "name", *cells)

    def write(self, state: State, path: str) -> None:
        self.frame(state).drop("item").write.mode("overwrite").csv(path, sep="\t", header=True)

    def table(self, state: State) -> str:
        df = self.frame(state).orderBy("item").drop("item")
        rows = ["\t".join(map(str, r)) for r in df.toLocalIterator()]
        return "\n".join(["\t".join([self.count.value, *df.columns[1:]]), *rows]) + "\n"

    def section(self, state: State, most: int = 1000) -> list[dict]:
        """The first rows, by item; the whole table is what ``write`` is for."""
        df = self.frame(state).orderBy("item").drop("item")
        rows = [[str(v) for v in r] for r in df.limit(most).collect()]
        return [{"title": f"table ({self.count.value})", "items": [{"kind": "table", "header": [self.count.value, *df.columns[1:]], "values": rows}], "table": ""}]


@dataclass
class Similarity:
    count: Count = Count.NODE
    method: Linkage = Linkage.CENTROID

    def needs(self) -> set[str]:
        return {"presence", *self.count.measures}

    def matrix(self, state: State) -> tuple[np.ndarray, list[str]]:
        if self.count is Count.ALL:
            raise ValueError("similarity takes one count")
        x, m = state.base, self.count.value
        n = x.n_groups
        out = np.zeros((n, n))
        items = x.items(m) if m != "bp" else state.graph.nodes.select(F.col("node_id").alias("item"), F.col("len").alias("weight"))
        for r in similarity.jaccard(x.presence(m), items, n).collect():  # groups squared
            out[r.x, r.y] = r.value
        return similarity.clustered(out, state.group_names(x), self.method)

    def table(self, state: State) -> str:
        matrix, labels = self.matrix(state)
        return "\n".join(["\t".join(["group", *labels]), *("\t".join([g, *(f"{v:g}" for v in np.float32(row))]) for g, row in zip(labels, matrix, strict=True))]) + "\n"

    def section(self, state: State) -> list[dict]:
        matrix, labels = self.matrix(state)
        return [{"title": f"similarity ({self.count.value})", "items": [{"kind": "heatmap", "id": f"similarity-{self.count.value}", "x": labels, "y": labels, "values": matrix.tolist()}], "table": self.table(state)}]


@dataclass
class NodeDistribution:
    radius: int = 20
    lattice: tuple[int, int] = (15, 9)

    def needs(self) -> set[str]:
        return {"node"}

    def coverage(self, state: State):
        return state.base.coverage("node").join(state.graph.nodes.select(F.col("node_id").alias("item"), "len", "name"), "item")

    def bins(self, state: State) -> list:
        return info.hexbins(self.coverage(state), *self.lattice).orderBy("x", "y").collect()  # at most the lattice

    def nodes(self, state: State, most: int = 100_000) -> list[list[str]] | None:
        """Names of the nodes of each bin, for a page; graphs of more than ``most`` nodes use ``write_nodes``."""
        if state.graph.nodes.count() > most:
            return None
        bins = info.hexbin_nodes(self.coverage(state), *self.lattice).join(state.graph.nodes.select(F.col("node_id").alias("item"), "name"), "item")
        rows = bins.groupBy(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).agg(F.sort_array(F.collect_list("name")).alias("names"))
        return [r.names for r in rows.orderBy("x", "y").collect()]

    def write_nodes(self, state: State, path: str) -> None:
        """name, x, y of every node, written by Spark."""
        bins = info.hexbin_nodes(self.coverage(state), *self.lattice).join(state.graph.nodes.select(F.col("node_id").alias("item"), "name"), "item")
        bins.select("name", "x", "y").write.mode("overwrite").csv(path, sep="\t", header=True)

    def table(self, state: State) -> str:
        rows = [f"{k}\t{b.x:g}\t{b.y:g}\t{np.log10(b['size']):g}" for k, b in enumerate(self.bins(state))]
        return "\n".join(["Bin\tCoverage\tLog-Length\tLog-Size", *rows]) + "\n"

    def section(self, state: State) -> list[dict]:
        return [{"title": "nodes by coverage and length", "items": [{"kind": "hexbin", "id": "nodes", "bins": [[b.x, b.y, b["size"]] for b in self.bins(state)], "nodes": self.nodes(state)}], "table": self.table(state)}]


@dataclass
class Info:
    def needs(self) -> set[str]:
        return {"node", "bp", "edge", "path lengths"}

    def rows(self, state: State) -> list[tuple]:
        return info.info_table(state.base)

    def table(self, state: State) -> str:
        return "\n".join(["feature\tcategory\tcountable\tvalue", *("\t".join([a, b, c, f"{v:g}" if isinstance(v, float) else str(v)]) for a, b, c, v in self.rows(state))]) + "\n"

    def section(self, state: State) -> list[dict]:
        rows = self.rows(state)
        items = [{"kind": "table", "header": ["feature", "category", "countable", "value"], "values": [[*r[:3], str(r[3])] for r in rows if r[0] != "group"]}]
        for what in ("node", "bp"):
            bars = info.rebin({b: v for a, b, c, v in rows if a == "group" and c == what})
            items.append(bar(f"info-{what}", [x for x, _ in bars], [y for _, y in bars], False))
        return [{"title": "graph info", "items": items, "table": self.table(state)}]


@dataclass
class Custom:
    name: str = ""
    file: str = ""
    extra: dict = field(default_factory=dict)

    def needs(self) -> set[str]:
        return set()

    def table(self, state: State) -> str:
        return ""

    def section(self, state: State) -> list[dict]:
        import base64
        import json
        import os

        kind = os.path.splitext(self.file)[1].lstrip(".").lower()
        if kind in ("csv", "tsv"):
            df = state.spark.read.csv(self.file, sep="," if kind == "csv" else "\t", header=True)
            item = {"kind": "table", "header": df.columns, "values": [[str(v) for v in r] for r in df.limit(1000).collect()]}  # what a page shows
        elif kind in ("svg", "json"):
            with open(self.file, encoding="utf-8") as f:
                item = {"kind": kind, "file": f.read() if kind == "svg" else json.load(f)}
        elif kind in ("png", "pdf"):
            with open(self.file, "rb") as f:
                item = {"kind": kind, "file": base64.b64encode(f.read()).decode()}
        else:
            raise ValueError(f"a custom section can't show {self.file}")
        return [{"title": self.name, "items": [item], "table": ""}]


#: Names in configurations, in the order in which analyses of a run are computed.
KINDS = {"Hist": Hist, "Growth": Growth, "Table": Table, "NodeDistribution": NodeDistribution, "Info": Info, "OrderedGrowth": OrderedGrowth, "CoverageLine": CoverageLine, "Similarity": Similarity, "Custom": Custom}


def planned(run: Run) -> list[str]:
    """The steps that a run takes, as a dry run prints them."""
    needs = sorted(set().union(*(a.needs() for a in run.analyses))) if run.analyses else []
    return [f"graph {run.graph} grouped by {run.grouping.kind}: {', '.join(needs)}", *(f"  {type(a).__name__} {a}" for a in run.analyses)]


def execute(spark: SparkSession, runs: list[Run]) -> tuple[str, list[dict]]:
    """The table of the last analysis, and all sections."""
    text, sections = "", []
    rank = list(KINDS.values())
    for run in sorted(runs, key=lambda r: (r.graph, r.run_name())):
        state = State(spark, run)
        for a in sorted(run.analyses, key=lambda a: rank.index(type(a))):
            for s in a.section(state):
                sections.append({"run": run.run_name(), "run_id": run.run_id(), "analysis": type(a).__name__, **s})
            text = a.table(state)
        state.graph.unpersist()
    return text, sections
