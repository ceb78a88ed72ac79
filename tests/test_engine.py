"""The graph engine on small graphs, against expected values and brute force."""

import random

import pytest

from pathtally.cli import main
from pathtally.functions import names
from pathtally.model import Grouping, Linkage, Threshold, pairs_of
from pathtally.operators import growth, info, similarity
from pathtally.operators.counting import Counted, check_order, merge_intervals, subtract_intervals
from pathtally.plans import charts, config, report
from pathtally.sources import graph, tables
from pathtally.sources.graph import GraphError, check_nodes, parse_nodes, read_graph

WALKS = """H\tVN:Z:1.0
S\ta\tACGT
S\tb\tAC
S\tc\tACG
S\td\tA
S\te\t*
L\ta\t+\tb\t+\t0M
L\tb\t+\tc\t-\t0M
L\tc\t+\tb\t-\t0M
L\tb\t+\tb\t+\t0M
L\tc\t-\td\t+\t0M
P\tx#1#one:10-20\ta+,b+,b+\t*
P\tx#2\ta+,b+,c-,d+\t*
W\ty\t1\tchr\t*\t*\t>b<c
W\ty\t1\tchr2\t5\t9\t<c>d
"""


@pytest.fixture(scope="module")
def walks(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "walks.gfa"
    path.write_text(WALKS)
    return str(path)


def dense(df):
    return [r.n for r in df.orderBy("coverage").collect()]


def test_walks(spark, walks):
    g = read_graph(spark, walks)
    assert [(r.name, r.len) for r in g.nodes.orderBy("node_id").collect()] == [("a", 4), ("b", 2), ("c", 3), ("d", 1), ("e", 1)]
    assert g.edges.count() == 4
    assert [r.display for r in g.paths.orderBy("path_id").collect()] == ["x#1#one:10-20", "x#2", "y#1#chr", "y#1#chr2:5-9"]
    assert [(r.p, r.fwd) for r in g.steps.where("path_id = 0").orderBy("pos").collect()] == [(10, True), (14, True), (16, True)]
    c = Counted(g, Grouping("sample"))
    assert dense(c.hist("node")) == [1, 1, 3]
    assert dense(c.hist("bp")) == [1, 4, 6]
    assert dense(c.hist("edge")) == [0, 2, 2]
    table = {(r["item"], r.group_idx): r.value for r in c.table("node").collect()}
    assert table[(2, 0)] == 3 and table[(3, 1)] == 2
    d = {r.node_id: r.degree for r in info.degrees(g.nodes, g.edges).collect()}
    assert d == {1: 1, 2: 4, 3: 2, 4: 1, 5: 0}
    assert info.components(g.nodes, g.edges).select("component").distinct().count() == 2


def test_gzip_and_errors(spark, walks, tmp_path):
    import gzip

    path = tmp_path / "w.gfa.gz"
    path.write_bytes(gzip.compress(WALKS.encode()))
    assert read_graph(spark, str(path)).edges.count() == 4
    bad = tmp_path / "bad.gfa"
    bad.write_text("S\ta\tA\nS\ta\tC\nP\tx\ta+\t*\n")
    with pytest.raises(GraphError):
        read_graph(spark, str(bad))
    bad = tmp_path / "bad2.gfa"
    bad.write_text("S\ta\tA\nP\tx\tq+\t*\n")
    with pytest.raises(Exception, match="unknown segment"):
        read_graph(spark, str(bad)).steps.collect()


def test_names(spark):
    texts = ["s", "s#1", "s#1#c", "s#1#c:3-9", "s#2:4-5", "s:1-2", "#odd", "a##b"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.parse_name(F.col("t")).alias("n"))
    got = {r.t: tuple(r.n) for r in df.collect()}
    assert got["s#1#c:3-9"] == ("s", "1", "c", 3, 9)
    assert got["s#2:4-5"] == ("s", "2", None, 4, 5)
    assert got["s:1-2"] == ("s", None, None, 1, 2)
    assert got["#odd"][0] == "#odd"
    row = spark.range(1).select(names.reverse_complement(F.lit("AACG")).alias("r"), names.kmer_text(names.kmer_code(F.lit("GATTACA")), 7).alias("k")).first()
    assert tuple(row) == ("CGTT", "GATTACA")


def test_growth_values():
    one, all_ = pairs_of("1", "0")[0], pairs_of("1", "1")[0]
    # fixed values: known histograms and their growth
    assert growth.growth([0, 5, 3, 2], *one) == pytest.approx([17 / 3, 25 / 3, 10])
    assert growth.growth([0, 5, 3, 2], *all_) == pytest.approx([17 / 3, 3, 2])
    want = [11.888889, 7.027778, 4.761905, 3.444444, 2.595238, 2, 1.555556, 1.222222, 1]
    assert growth.growth([0, 5, 3, 2, 3, 5, 0, 4, 2, 1], *pairs_of("1", "0.9")[0]) == pytest.approx(want, abs=1e-6)
    assert growth.growth([0], *one) == []
    assert Threshold(0.5, True).absolute(5) == 3
    for bad in (("1,2,3", "0,1"), ("x", "0"), ("1", "2")):
        with pytest.raises(ValueError):
            pairs_of(*bad)
    fit = growth.heaps([100 * m**0.4 for m in range(1, 20)])
    assert fit["gamma"] == pytest.approx(0.4) and fit["k1"] == pytest.approx(100)


def brute_ordered(sets, n, c, q):
    import math

    out = [0] * n
    for groups in sets:
        g = sorted(groups)
        if len(g) < max(1, c):
            continue
        for r, at in enumerate(g, 1):
            if r >= math.ceil((at + 1) * q):
                for j in range(at, g[r] if r < len(g) else n):
                    out[j] += 1
    return out


def test_ordered_growth_and_jaccard_against_brute_force(spark):
    r = random.Random(4)
    n = 6
    sets = [{g for g in range(n) if r.random() < 0.5} for _ in range(60)]
    p = spark.createDataFrame([(i, g, 1) for i, s in enumerate(sets) for g in s], "item long, group_idx int, visits long")
    items = spark.createDataFrame([(i, 1) for i in range(60)], "item long, weight long")
    for c, q in (("1", "0"), ("2", "0.5"), ("1", "1"), ("3", "0.34")):
        got = growth.ordered_growth(p, items, n, *pairs_of(c, q)[0]).orderBy("group_idx").collect()
        assert [x.value for x in got] == brute_ordered(sets, n, int(c), float(q))
    for x in similarity.jaccard(p, items, n).collect():
        a, b = ({i for i, s in enumerate(sets) if g in s} for g in (x.x, x.y))
        assert x.value == pytest.approx(len(a & b) / len(a | b))


@pytest.mark.parametrize("method", list(Linkage))
def test_clusters_keep_close_rows_together(method):
    import numpy as np

    m = np.array([[1, 0, 0.9, 0], [0, 1, 0, 0.8], [0.9, 0, 1, 0], [0, 0.8, 0, 1]])
    order = similarity.leaf_order(similarity.linkage(m, method), 4)
    assert sorted(order) == [0, 1, 2, 3] and abs(order.index(0) - order.index(2)) == 1


def bitmap_runs(intervals):
    """Maximal runs of covered places; intervals that only touch leave no gap."""
    covered = {x for a, b in intervals for x in range(a, b)}
    starts = sorted(x for x in covered if x - 1 not in covered)
    return [(x, next(y for y in range(x, 10**6) if y not in covered)) for x in starts]


def test_intervals_merge_and_subtract_against_bitmaps(spark):
    r = random.Random(31)
    draw = lambda n: [(a, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(n))]
    own, less = ({k: draw(r.randrange(1, 9)) for k in range(12)} for _ in range(2))
    del less[3], less[7]
    frame = lambda x: spark.createDataFrame([(k, *i) for k, v in x.items() for i in v], "key int, start long, end long")
    got = {}
    for x in merge_intervals(frame(own), ["key"]).collect():
        got.setdefault(x.key, []).append((x.start, x.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: bitmap_runs(v) for k, v in own.items()}
    left = {x.key: x.covered for x in subtract_intervals(frame(own), frame(less), ["key"]).collect()}
    places = lambda v: {x for a, b in v for x in range(a, b)}
    assert left == {k: len(places(v) - places(less.get(k, []))) for k, v in own.items()}


def test_offsets_and_followers_over_blocks(spark):
    r = random.Random(12)
    paths = {k: [r.randrange(1, 9) for _ in range(n)] for k, n in enumerate((1, 3, 4, 5, 8, 13))}
    steps = spark.createDataFrame([(k, i, z) for k, v in paths.items() for i, z in enumerate(v)], "path_id int, pos int, len long")
    got = {(x.path_id, x.pos): x.p for x in graph.with_offsets(steps, block=4).collect()}
    assert got == {(k, i): sum(v[:i]) for k, v in paths.items() for i in range(len(v))}
    got = {(x.path_id, x.pos): (x.next.pos, x.next.len) for x in graph.with_next(steps, ["pos", "len"], block=4).collect()}
    assert got == {(k, i): (i + 1, v[i + 1]) for k, v in paths.items() for i in range(len(v) - 1)}


# Graphs of the same shape as known ones, with the values that are known for them.


def bubbles(spark, tmp_path):
    """A chain of four two-way bubbles and links; one sample in five pieces, one whole."""
    lens = [8, 1, 1, 1, 1, 3, 1, 1, 19, 1, 1, 4, 1, 1, 11]
    name = lambda k: "u" + "abcdefghijklmno"[k - 1]
    links = [(1, 2), (1, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 6), (5, 6)]
    for k in (6, 9, 12):
        links += [(k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3)]
    walk = [1, 3, 5, 6, 8, 9, 11, 12, 14, 15]
    pieces = [walk[:2], walk[2:5], walk[5:8], walk[8:9], walk[9:]]
    lines = [f"S\t{name(k)}\t{'ACGT'[k % 4] * z}" for k, z in enumerate(lens, 1)] + [f"L\t{name(a)}\t+\t{name(b)}\t+\t0M" for a, b in links]
    lines += [f"P\ty#{k}\t{','.join(name(n) + '+' for n in p)}\t*" for k, p in enumerate([*pieces], 1)] + [f"P\tx\t{','.join(name(n) + '+' for n in walk)}\t*"]
    path = tmp_path / "bubbles.gfa"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_known_values_of_bubbles(spark, tmp_path):
    path = bubbles(spark, tmp_path)
    g = read_graph(spark, path)
    by_sample, by_path = Counted(g, Grouping("sample")), Counted(g)
    # fixed values: known histograms and group rows
    assert dense(by_sample.hist("node")) == [5, 0, 10] and dense(by_sample.hist("bp")) == [5, 0, 50] and dense(by_sample.hist("edge")) == [11, 4, 5]
    assert dense(by_path.hist("node"))[:3] == [5, 0, 10]
    rows = main(["info", path, "-S"], spark).split("\n")
    assert {"group\tx\tbp\t50", "group\tx\tnode\t10", "group\ty\tbp\t50", "group\ty\tnode\t10"} <= set(rows)
    assert {"graph\ttotal\tcomponent\t1", "graph\tlargest\tcomponent\t15"} <= set(rows)
    g.unpersist()


def test_known_values_of_a_compacted_graph(spark, tmp_path):
    """Five segments that overlap, links given twice and flipped, a link of a segment to itself."""
    names_ = dict(zip(range(1, 6), ("one", "two", "three", "four", "five"), strict=True))
    lens = {1: 5, 2: 7, 3: 5, 4: 7, 5: 5}
    there = [(1, 2), (1, 4), (2, 3), (2, 5), (4, 3), (4, 5)]
    lines = [f"S\t{names_[k]}\t{'G' * z}" for k, z in lens.items()]
    for a, b in there:
        lines += [f"L\t{names_[a]}\t+\t{names_[b]}\t+\t3M", f"L\t{names_[b]}\t-\t{names_[a]}\t-\t3M"]
    lines.append("L\tthree\t+\tthree\t-\t3M")
    walks = [("a", 1, 1, (1, 2, 3)), ("b", 1, 1, (1, 2, 3)), ("c", 1, 1, (1, 2, 3)), ("c", 1, 2, (1, 2)), ("c", 2, 1, (1, 4, 3)), ("d", 1, 1, (1, 4, 5))]
    lines += [f"P\t{s}#{h}#part{q}\t{','.join(names_[n] + '+' for n in p)}\t*" for s, h, q, p in walks]
    path = tmp_path / "compacted.gfa"
    path.write_text("\n".join(lines) + "\n")
    g = read_graph(spark, str(path))
    # fixed values: distinct links, nodes by path, nodes by sample, numbers of groups
    assert g.edges.count() == 7
    cover = {r["item"]: r["cov"] for r in Counted(g).coverage("node").collect()}
    assert [cover[k] for k in range(1, 6)] == [6, 4, 4, 2, 1]
    assert dense(Counted(g, Grouping("sample")).hist("node")) == [0, 1, 1, 2, 1]
    assert Counted(g, Grouping("sample")).n_groups == 4 and Counted(g, Grouping("haplotype")).n_groups == 5
    g.unpersist()


def test_known_growth_of_four_samples():
    # fixed values: the histogram of four samples and the growth that is known for it
    hist = [0, 39, 29, 41, 45]
    for pair, want in ((("1", "0"), [100, 129.667, 144.25, 154]), (("1", "1"), [100, 70.333, 55.25, 45]), (("1", "0.5"), [100, 129.667, 100.5, 115])):
        assert growth.growth(hist, *pairs_of(*pair)[0]) == pytest.approx(want, abs=1e-3)


def test_masks_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    for turn in range(2):
        lens = [r.randrange(1, 6) for _ in range(8)]
        paths = [[(r.randrange(8), r.random() < 0.5) for _ in range(r.randrange(1, 7))] for _ in range(4)]
        text = "".join(f"S\tn{k}\t{'A' * z}\n" for k, z in enumerate(lens)) + "".join(f"P\tg{k % 3}#{k}\t{','.join(f'n{a}{"+" if f else "-"}' for a, f in p)}\t*\n" for k, p in enumerate(paths))
        gfa = tmp_path / f"r{turn}.gfa"
        gfa.write_text(text)
        masks = {}
        for name in ("in", "ex"):
            rows = [(f"g{k % 3}#{k}", s, s + r.randrange(1, 6)) for k in range(4) for s in [r.randrange(12)] if r.random() < 0.7] or [("g0#0", 0, 3)]
            (tmp_path / f"{name}{turn}").write_text("".join(f"{a}\t{b}\t{c}\n" for a, b, c in rows))
            masks[name] = rows
        c = Counted(read_graph(spark, str(gfa)), Grouping("sample"), tables.read_bed(spark, str(tmp_path / f"in{turn}")), tables.read_bed(spark, str(tmp_path / f"ex{turn}")))
        groups, gone, n = {}, set(), []
        for k, p in enumerate(paths):
            at = 0
            for a, _ in p:
                for name in masks:
                    hit = any(x == f"g{k % 3}#{k}" and s < at + lens[a] and e > at for x, s, e in masks[name])
                    if hit and name == "in":
                        groups.setdefault(a, set()).add(k % 3)
                    if hit and name == "ex":
                        gone.add(a)
                at += lens[a]
        n = len({x.split("#")[0] for x, _, _ in masks["in"]})
        want = [0] * (n + 1)
        for a in range(8):
            want[len(groups.get(a, ())) if a not in gone else 0] += 1
        assert dense(c.hist("node")) == want


def test_readers(spark, tmp_path):
    (tmp_path / "b12").write_text("track x\n#c\np#1\t100\t200\tn\t0\t+\t0\t0\t0\t2\t5,6\t0,50\n")
    assert [(r.start, r.end) for r in tables.read_bed(spark, str(tmp_path / "b12")).orderBy("start").collect()] == [(100, 105), (150, 156)]
    (tmp_path / "b2").write_text("p#1\t100\n")
    with pytest.raises(Exception, match="two columns"):
        tables.read_bed(spark, str(tmp_path / "b2")).collect()
    (tmp_path / "g").write_text("a#0\tG1\r\nb#0\tG1\n")
    assert [r.group_name for r in tables.read_groups(spark, str(tmp_path / "g")).collect()] == ["G1", "G1"]
    (tmp_path / "h.tsv").write_text("# c\npanel\thist\ncount\tnode\n0\t1\n2\t10\n3\t4\n")
    assert [(r.coverage, r.n) for r in tables.read_hist(spark, str(tmp_path / "h.tsv")).collect()] == [(0, 1), (1, 0), (2, 10), (3, 4)]
    text = main(["growth", str(tmp_path / "h.tsv"), "-l", "1", "-q", "0"], spark)
    assert text.rstrip().split("\n")[-1] == "3\t14"


def test_command_line_and_report(spark, walks, tmp_path):
    assert main(["hist", walks, "-S", "-c", "all"], spark).rstrip().split("\n")[-3:] == ["0\t1\t1\t0", "1\t1\t4\t2", "2\t3\t6\t2"]
    assert "graph\ttotal\tnode\t5" in main(["info", walks, "-S"], spark)
    cfg = tmp_path / "c.yaml"
    cfg.write_text(f"- graph: {walks}\n  grouping: Sample\n  analyses:\n    - !Hist {{count_type: Node}}\n    - !Growth {{coverage: 1, quorum: 0}}\n    - !Similarity {{count_type: Bp, cluster_method: Ward}}\n    - !CoverageLine {{count_type: Node}}\n    - !NodeDistribution {{radius: 20}}\n")
    assert "Growth" in main(["report", "-d", str(cfg)], spark)
    text = main(["report", "-j", str(cfg)], spark)
    (tmp_path / "r.json").write_text(text)
    assert "vega-lite" in main(["render", str(tmp_path / "r.json")])
    assert len(report.merge([text, text])) == 10
    assert config.grouping_of("Haplotype") == Grouping("haplotype")


def test_report_draws_its_charts(spark, walks, tmp_path):
    hist = {"kind": "bar", "id": "h", "labels": [0, 1, 2], "values": [0, 5, 5000], "log_toggle": True}
    hexes = {"kind": "hexbin", "id": "h", "bins": [[0, 0, 1], [2, 1.5, 30]], "nodes": [["a"], ["b</script>", "c"]]}
    table = {"kind": "table", "header": ["a", "b"], "values": [["x", "1"], ["x", "2"], ["y", "2"]]}
    page = report.to_html([{"title": "t", "items": [hist, hexes, table], "table": ""}])
    assert page.count("<svg") == 3 and page.count("<rect") == 3 + 2 and page.count("<polygon") == 2  # zero has no bar on a logarithmic axis
    assert 'id="h-log" hidden' in page and 'id="h-2"' in page and "</script>\"" not in page and "Download as png" in page
    assert "<td>x</td><td>1</td></tr><tr><td></td><td>2</td>" in page
    assert report.unrepeated([["a", "b"], ["a", "b"], ["c", "b"]]) == [["a", "b"], ["", ""], ["c", "b"]]
    assert [charts.humanize(x) for x in (0, 999, 1234, 5_600_000)] == ["0", "999", "1K", "6M"]
    for item in ({"kind": "line", "id": "l", "x": [0, 1], "y": [0, 0], "log_x": True, "log_y": True}, {"kind": "multibar", "id": "m", "names": ["p"], "labels": [], "values": [[]]}, {"kind": "heatmap", "id": "e", "x": [], "y": [], "values": []}, {"kind": "hexbin", "id": "x", "bins": []}):
        assert charts.chart(item).startswith("<svg")


def test_written_tables_and_thresholds(spark, walks, tmp_path):
    main(["table", walks, "-S", "-w", str(tmp_path / "t")], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert "name\tx\ty\n" in text and "b\t3\t1\n" in text
    (tmp_path / "th").write_text("3\tx\n0.5\n")
    assert tables.read_thresholds(spark, str(tmp_path / "th")) == [Threshold(3), Threshold(0.5, True)]
    (tmp_path / "th").write_text("many\n")
    with pytest.raises(ValueError):
        tables.read_thresholds(spark, str(tmp_path / "th"))
    assert tables.hist_text("node", [1, 2]) == "hist\tnode\n0\t1\n1\t2\n"
    c = Counted(read_graph(spark, walks), Grouping("sample"))
    tables.write_presence(c.presence("node"), str(tmp_path / "p"))
    assert sum(len(p.read_text().split("\n")) - 2 for p in (tmp_path / "p").glob("part-*") if p.read_text()) == c.presence("node").count()
    (tmp_path / "h.tsv").write_text("panel\thist\ncount\tnode\n0\t1\n1\t10\n2\t4\n")
    rows = main(["growth", str(tmp_path / "h.tsv"), "-l", "1,1", "-q", "1,0", "--by-quorum"], spark).rstrip().split("\n")
    assert next(r for r in rows if r.startswith("quorum")) == "quorum\t0\t1"


def test_orders_that_part_groups_and_unknown_names(spark, walks, tmp_path, caplog):
    g = read_graph(spark, walks)
    c = Counted(g, Grouping("sample"))
    frame = lambda ids: spark.createDataFrame([((0, k), i) for k, i in enumerate(ids)], "rank struct<block:long,n:long>, id string")
    assert not check_order(c.grouped, frame(["y#1#chr", "y#1#chr2", "x#2", "x#1#one"]))
    with pytest.raises(GraphError, match="paths of x"):
        check_order(c.grouped, frame(["x#2", "y#1#chr", "x#1#one", "y#1#chr2"]))
    (tmp_path / "s").write_text("x\nnobody#1\n")
    with caplog.at_level("WARNING", "pathtally"):
        assert "0\t1\n1\t4\n" in main(["hist", walks, "-S", "-s", str(tmp_path / "s")], spark)  # x visits a to d
    assert "nobody#1" in caplog.text and "x is no path" not in caplog.text


def test_bars_of_groups():
    assert info.rebin({"b": 2, "a": 1}) == [("a", 1), ("b", 2)]
    many = info.rebin({str(k): float(k) for k in range(200)})
    assert len(many) == 50 and sum(n for _, n in many) == 200 and many[0][0] == "0-3.98"


def test_codes_of_kmers(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(names.code_reverse_complement(names.kmer_code(F.lit("GATTACA")), 7).alias("c"), names.canonical_code(names.kmer_code(F.lit("TTT")), 3).alias("d"))
    row = row.select(names.kmer_text(F.col("c"), 7).alias("c"), names.kmer_text(F.col("d"), 3).alias("d")).first()
    assert tuple(row) == ("TGTAATC", "AAA")


def test_duplicate_nodes(spark):
    lines = spark.createDataFrame([("S\ta\tAC", 0), ("S\tb\tA", 1)], "value string, rank long")
    check_nodes(parse_nodes(lines))


def test_streamed_presence(spark, tmp_path):
    from pathtally.streaming.paths import running_coverage, stream_presence

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("P\tx#1\ta+,b+\t*\nP\ty#1\tb+\t*\nP\tx#2\ta+\t*\n")
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "name string, node_id long")
    q = running_coverage(stream_presence(spark.readStream.text(str(tmp_path / "in")), nodes)).writeStream.format("memory").queryName("cov").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["item"]: r["cov"] for r in spark.table("cov").collect()} == {1: 1, 2: 2}


SMALL = "/root/testdata/sf0.001"


def small_paths(spark):
    """Sample and parts of each order of the smallest tables, in the order of its steps."""
    from pathtally.plans import mapped

    nations = {r.c_custkey: r.c_nationkey for r in mapped.load(spark, SMALL, "customer").collect()}
    sample = {r.o_orderkey: nations[r.o_custkey] for r in mapped.load(spark, SMALL, "orders").collect() if r.o_custkey in nations}
    sizes = {r.p_partkey: r.p_size for r in mapped.load(spark, SMALL, "part").collect()}
    steps = {}
    for r in sorted(mapped.load(spark, SMALL, "lineitem").select("l_orderkey", *mapped.STEP_ORDER).collect()):
        if r.l_orderkey in sample and r.l_partkey in sizes:
            steps.setdefault(r.l_orderkey, []).append(r.l_partkey)
    return sample, sizes, steps


def test_components_of_all_edges_against_brute_force(spark):
    from pathtally.plans import mapped

    _, sizes, steps = small_paths(spark)
    root = {n: n for n in sizes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for path in steps.values():
        for a, b in zip(path, path[1:]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.node_id: r.component for r in mapped.QUERIES["components"](spark, SMALL).collect()}
    assert got == {n: top(n) for n in sizes}


def test_components_of_a_long_chain_keep_size_estimates_small(spark):
    r = random.Random(9)
    chain = r.sample(range(400), 400)
    nodes = spark.createDataFrame([(n,) for n in range(402)], "node_id long")
    edges = spark.createDataFrame([*zip(chain[:250], chain[1:250]), *zip(chain[250:], chain[251:]), (400, 400)], "u long, v long")
    got = info.components(nodes, edges)
    parts = [set(chain[:250]), set(chain[250:]), {400}, {401}]
    assert {x.node_id: x.component for x in got.collect()} == {n: min(p) for p in parts for n in p}
    assert tuple(info.component_info(nodes, edges).first()) == (4, 250, 1, 75.5)
    # each round multiplied Spark's estimate, a number whose digits filled the driver's memory
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64


def test_brands_join_by_sorting_however_small_their_file(spark):
    from pathtally.plans import mapped

    _, edges = mapped.brand_links(spark, SMALL)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    # broadcasts of the parts filled the driver, as their file is much smaller than their rows
    for key in ("u", "ub"):
        assert f"SortMergeJoin [{key}#" in plan and f"BroadcastHashJoin [{key}#" not in plan


def test_an_order_without_lines_does_not_stand_for_a_nation(spark, tmp_path):
    from pathtally.plans import mapped

    tables_ = {
        "customer": ([(1, 7, "A"), (2, 8, "A")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(1, 20), (2, 30)], "p_partkey long, p_size int"),
        # order 7 has no lines, and 7 is the nation of order 100
        "orders": ([(7, 1, "2-HIGH"), (100, 1, "1-URGENT"), (101, 2, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(100, 1, 1, 1, 1.0, 1.0, "F"), (101, 2, 1, 1, 1.0, 1.0, "F")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string"),
    }
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert dense(mapped.QUERIES["hist_bp_interval"](spark, str(tmp_path))) == [30, 20]
    assert dense(mapped.QUERIES["hist_bp_exclude"](spark, str(tmp_path))) == [34, 16]


def test_customers_without_a_nation_add_no_coverage(spark, tmp_path):
    from pathtally.plans import mapped

    tables_ = {
        "customer": ([(1, 7, "A"), (2, None, "A")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(1, 20), (2, 30)], "p_partkey long, p_size int"),
        "orders": ([(100, 1, "2-HIGH"), (101, 2, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(100, 1, 1, 1, 1.0, 1.0, "F"), (101, 2, 1, 1, 1.0, 1.0, "F")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string"),
    }
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    # one nation, so coverage 0 and 1 alone, as the SQL has it; part 2 is of no nation
    assert dense(mapped.QUERIES["hist_bp_exclude"](spark, str(tmp_path))) == [40, 10]


def test_a_histogram_plans_its_graph_once(spark):
    from pathtally.plans import mapped

    plan = mapped.QUERIES["hist_node"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # what masks leave out was a second branch with all of the graph below it, which filled the driver
    assert "Union" not in plan


def test_bed_merge_rounds_quantities_and_takes_lines_without_an_order_as_its_sql_does(spark, tmp_path):
    from pathtally.plans import mapped

    rows = [(5010, 1, 1.5), (12, 1, 2.5), (20, 1, 3.7), (24, 1, 0.5), (None, 1, 4.0), (None, 2, 1.0), (30, None, 1.0), (40, 3, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in mapped.QUERIES["bed_merge"](spark, str(tmp_path)).collect()}
    # as DuckDB gives them: 10 + 2 meets 12, 20 + 4 meets 24; lines without an order begin nothing
    assert got == {(1, 10, 14), (1, 20, 24), (2, None, None), (None, 30, 31), (3, 40, None)}


def test_similarity_and_clusters_of_all_orders_against_brute_force(spark):
    import numpy as np

    from pathtally.plans import mapped

    sample, sizes, steps = small_paths(spark)
    parts = {}
    for path in sorted(steps):  # groups in the order of their first paths
        parts.setdefault(sample[path], set()).update(steps[path])
    sets, weigh = list(parts.values()), lambda items: sum(sizes[n] for n in items)
    want = np.array([[weigh(a & b) / weigh(a | b) for b in sets] for a in sets])
    got = np.full(want.shape, -1.0)
    for r in mapped.QUERIES["similarity"](spark, SMALL).collect():
        got[r.x, r.y] = r.value
    assert np.abs(got - want).max() < 1e-6
    order = [r.group_idx for r in mapped.QUERIES["cluster_order"](spark, SMALL).orderBy("place").collect()]
    assert order == similarity.leaf_order(similarity.linkage(want), len(sets))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 26
