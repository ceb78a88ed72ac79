"""Command line: one sub-command an analysis, reports from YAML, rendering of JSON reports."""

from __future__ import annotations

import argparse
import sys

from .model import Count, Grouping, Linkage, Run
from .plans import analyses as an
from .plans import config, report
from .sources import tables

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathtally")
    top.add_argument("-t", "--threads", type=int, default=0, help="0: all")
    top.add_argument("-v", "--verbose", action="store_true")
    subs = top.add_subparsers(dest="command", required=True)

    def graph(name: str, count: bool = True) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.add_argument("graph")
        for short, long in (("-s", "--subset"), ("-e", "--exclude"), ("-g", "--groupby")):
            p.add_argument(short, long)
        p.add_argument("-H", "--groupby-haplotype", action="store_true")
        p.add_argument("-S", "--groupby-sample", action="store_true")
        if count:
            p.add_argument("-c", "--count", choices=[c.value for c in Count], default="node")
        return p

    def thresholds(p: argparse.ArgumentParser) -> None:
        p.add_argument("-l", "--coverage", default="1")
        p.add_argument("-q", "--quorum", default="0")

    graph("hist")
    for name in ("growth", "histgrowth"):
        p = graph(name)
        thresholds(p)
        p.add_argument("-a", "--hist", action="store_true")
        p.add_argument("--by-quorum", action="store_true", help="columns in the order of quorum, then coverage")
    graph("info", count=False)
    p = graph("ordered-histgrowth")
    thresholds(p)
    p.add_argument("-O", "--order")
    p = graph("table")
    p.add_argument("-a", "--total", action="store_true")
    p.add_argument("-O", "--order")
    p.add_argument("-w", "--write", help="a folder that Spark writes the table to, at any size")
    p = graph("node-distribution", count=False)
    p.add_argument("-r", "--radius", type=int, default=20)
    p = graph("similarity")
    p.add_argument("-m", "--method", choices=[m.value for m in Linkage], default="centroid")
    graph("coverage-line")
    p = subs.add_parser("report")
    p.add_argument("yaml")
    p.add_argument("-d", "--dry-run", action="store_true")
    p.add_argument("-j", "--json", action="store_true")
    p = subs.add_parser("render")
    p.add_argument("json", nargs="+")
    return top


def analysis(a: argparse.Namespace) -> object:
    count = Count(getattr(a, "count", "node"))
    return {
        "hist": lambda: an.Hist(count),
        "growth": lambda: an.Growth(a.coverage, a.quorum, a.hist, count, a.by_quorum),
        "histgrowth": lambda: an.Growth(a.coverage, a.quorum, True, count, a.by_quorum),
        "info": an.Info,
        "ordered-histgrowth": lambda: an.OrderedGrowth(a.coverage, a.quorum, a.order, count),
        "table": lambda: an.Table(count, a.total, a.order),
        "node-distribution": lambda: an.NodeDistribution(a.radius),
        "similarity": lambda: an.Similarity(count, Linkage(a.method)),
        "coverage-line": lambda: an.CoverageLine(count),
    }[a.command]()


def session(threads: int = 0):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(f"local[{threads or '*'}]").appName("pathtally").config("spark.ui.enabled", "false").getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> str:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    if a.command == "render":
        texts = []
        for path in a.json:
            with open(path, encoding="utf-8") as f:
                texts.append(f.read())
        return report.to_html(report.merge(texts))
    if a.command == "report":
        with open(a.yaml, encoding="utf-8") as f:
            runs = config.runs_of(f.read())
        if a.dry_run:
            return "\n".join(x for r in runs for x in an.planned(r)) + "\n"
        sections = an.execute(spark or session(a.threads), runs)[1]
        return report.to_json(sections) if a.json else report.to_html(sections)
    spark = spark or session(a.threads)
    head = tables.metadata(["pathtally", *argv], VERSION)
    if a.command in ("growth", "histgrowth") and a.graph.endswith("tsv"):
        if a.subset or a.exclude or a.groupby or a.groupby_haplotype or a.groupby_sample:
            raise SystemExit("a histogram table takes no graph options")
        return head + an.Growth.of_file(spark, a.graph, a.coverage, a.quorum, a.hist or a.command == "histgrowth", a.by_quorum)
    run = Run(a.graph, subset=a.subset, exclude=a.exclude, grouping=Grouping.of(a.groupby_sample, a.groupby_haplotype, a.groupby))
    state = an.State(spark, run)
    if a.command == "table" and a.write:
        analysis(a).write(state, a.write)
        return head
    return head + analysis(a).table(state)


if __name__ == "__main__":
    sys.stdout.write(main())
