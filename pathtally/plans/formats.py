"""Queries over the readers, writers and name functions, on lines made from the driver's order tables.

Lines go through the same parsers as files, and tables come back as numbered lines of text, so that
SQL can state every line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..model import Count, Grouping, Run, pairs_of
from ..operators import growth, info
from ..operators.counting import Counted, load_coords
from ..sources import tables
from ..sources.graph import Graph, explode_steps, parse_links, parse_nodes, parse_paths
from . import analyses
from .mapped import EDGE_STEPS, HEXBINS, ORDER, PART_STEPS, by_sample, gfa_lines, growth_sql, hist_sql, load, mapped_graph, ordered_sql, path_name


def ranked(df: DataFrame, key: str, value, block: int = 0) -> DataFrame:
    """rank, value: lines in the order of a column."""
    return df.select(F.struct(F.lit(block).cast("long").alias("block"), F.col(key).cast("long").alias("n")).alias("rank"), value.alias("value"))


def numbered_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line int, value string")


def state(spark: SparkSession, sf_dir: str, suppliers: bool = False) -> analyses.State:
    return analyses.State(spark, Run("orders", grouping=Grouping("sample")), mapped_graph(spark, sf_dir, suppliers))


def as_text(make: Callable[[], object], suppliers: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: numbered_text(spark, make().table(state(spark, sf_dir, suppliers)))


# --- groupings, orders and lists ------------------------------------------------------------------


def hist_haplotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Counted(mapped_graph(spark, sf_dir), Grouping("haplotype")).hist("node")


def hist_group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a group file: the priority of each order."""
    lines = load(spark, sf_dir, "orders").select(F.concat_ws("\t", path_name(F.col("o_orderkey")), "o_orderpriority").alias("value"))
    return Counted(mapped_graph(spark, sf_dir), Grouping("file", "orders"), groups=tables.parse_groups(lines)).hist("bp")


def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth along a list of orders: nations from the last name to the first."""
    g = mapped_graph(spark, sf_dir)
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sample"), "n_name")
    # lines have numbers: the place of the nation, then of the order
    first = nation.select("sample", F.expr("row_number() over (order by n_name desc)").alias("block"))  # one row a nation
    order = g.paths.join(first, "sample").select(F.struct("block", F.col("path_id").alias("n")).alias("rank"), "id", "start", "end", "display")
    x = Counted(g, Grouping("sample"), order=order)
    return growth.ordered_growth(x.presence("node"), x.items("node"), x.n_groups, *pairs_of("1", "0")[0])


def hist_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset by an expression that names match: paths of one market segment."""
    g = named_graph(spark, sf_dir)
    return Counted(g, Grouping("sample"), include=load_coords(spark, "^[0-9]+#BUILDING#", g.paths)).hist("node")


def named_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The parts graph with paths named nation#segment#order."""
    g = mapped_graph(spark, sf_dir)
    seqid = F.concat(F.lit("o"), F.col("path_id").cast("string"))
    id_ = names.path_id(F.col("sample"), F.col("hap"), seqid)
    paths = g.paths.withColumns({"seqid": seqid, "id": id_, "display": names.display(id_, F.col("start"), F.col("end"))})
    return Graph(g.nodes, g.edges, paths, g.steps, labelled=True)


# --- graph text -----------------------------------------------------------------------------------


def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S lines of the suppliers and L lines of the edges, each edge also flipped."""
    g = mapped_graph(spark, sf_dir, suppliers=True)
    s = ranked(g.nodes, "node_id", F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), "name"), F.repeat(F.lit("A"), F.col("len").cast("int"))))
    sign = lambda c: F.when(c, "+").otherwise("-")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    there = F.concat_ws("\t", F.lit("L"), name("u"), sign(F.col("u_fwd")), name("v"), sign(F.col("v_fwd")), F.lit("0M"))
    back = F.concat_ws("\t", F.lit("L"), name("v"), sign(~F.col("v_fwd")), name("u"), sign(~F.col("u_fwd")), F.lit("0M"))
    return s.union(ranked(g.edges, "u", there, 1)).union(ranked(g.edges, "v", back, 2))


def gfa_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links parsed from text, canonical and each once, by the names of their segments."""
    lines = link_lines(spark, sf_dir)
    nodes = parse_nodes(lines)
    edges = parse_links(lines, nodes)
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.expr("cast(substring(name, 2) as bigint)").alias(f"{c}_name"))
    rows = edges.join(at("u"), "u").join(at("v"), "v")
    e = names.canonical_edge(F.col("u_name"), F.col("u_fwd"), F.col("v_name"), F.col("v_fwd"))
    return rows.select(e.alias("e")).select("e.*", names.edge_label(F.col("e.u"), F.col("e.u_fwd"), F.col("e.v"), F.col("e.v_fwd")).alias("label"))


def gfa_nice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of graph text whose segment names are their numbers."""
    segments, lines = (x.withColumn("value", F.regexp_replace("value", r"s([0-9]+)", "$1")) for x in gfa_lines(spark, sf_dir))
    nodes, paths = parse_nodes(segments, nice=True), parse_paths(lines)
    steps = explode_steps(paths, nodes, nice=True)
    return steps.groupBy("node_id").agg(F.count("*").alias("steps"), F.sum("p").cast("long").alias("places"), F.sum(F.col("fwd").cast("long")).alias("forward"))


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one, three and twelve columns, with comments between them."""
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, day = F.col("o_orderkey").cast("string"), F.dayofmonth("o_orderdate")
    name = F.concat_ws("#", F.col("c_nationkey").cast("string"), F.lit("1"), key)
    value = (
        F.when(F.col("o_orderstatus") == "F", F.concat(name, F.lit(":"), day.cast("string"), F.lit("-"), (day + 40).cast("string")))
        .when(F.col("o_orderstatus") == "O", F.concat_ws("\t", name, day.cast("string"), (day + 9).cast("string"), F.lit("more")))
        .otherwise(F.concat_ws("\t", name, day.cast("string"), (day + 100).cast("string"), F.lit("n"), F.lit("0"), F.lit("+"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("2"), F.lit("5,7"), F.concat(F.lit("0,"), (day + 10).cast("string"))))
    )
    rows = ranked(o, "o_orderkey", value, 1)
    heads = spark.createDataFrame([(0, "browser x"), (1, "track y"), (2, "# z"), (3, "")], "n long, value string")
    return rows.union(ranked(heads, "n", F.col("value")))


def bed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parse_bed(bed_lines(spark, sf_dir)).select("id", "start", "end", "display")


# --- tables ---------------------------------------------------------------------------------------


def table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a group: visits of suppliers by market segment."""
    return analyses.Table(Count.NODE).frame(state(spark, sf_dir, True))


def table_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by their labels and the number of groups that use them."""
    return analyses.Table(Count.EDGE, total=True).frame(state(spark, sf_dir, True)).select("name", "total")


def growth_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth from a histogram that is written as a table and read again."""
    text = analyses.Hist(Count.NODE).table(state(spark, sf_dir))
    hist = tables.parse_hist_rows([line.split("\t") for line in text.rstrip("\n").split("\n")])["node"]
    curve = [round(v, 6) for v in growth.growth(hist, *pairs_of("1", "0")[0])]
    return spark.createDataFrame([(m, v, round(d, 6)) for m, (v, d) in enumerate(zip(curve, growth.differences(curve), strict=True), 1)], "m int, value double, new_items double")


def hexbin_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every node."""
    x = by_sample(spark, sf_dir)
    return info.hexbin_nodes(x.coverage("node").join(x.graph.nodes.select(F.col("node_id").alias("item"), "len"), "item")).select("item", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def group_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the haplotypes' sizes; more than 100 groups fall into 50 ranges."""
    x = Counted(mapped_graph(spark, sf_dir), Grouping("haplotype"))
    values = {r.group_name: r.nodes for r in info.group_info(x).collect()}  # one row a group
    return spark.createDataFrame([(k, label, float(v)) for k, (label, v) in enumerate(info.rebin(values))], "bar int, label string, value double")


# --- names and sequences --------------------------------------------------------------------------


def path_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = names.parse_name(F.concat(F.lit("s#"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit(":"), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") + 9).cast("string"))).otherwise("")))
    id_ = names.path_id(F.col("n.sample"), F.col("n.hap"), F.col("n.seqid"))
    return c.select("c_custkey", n.alias("n")).select("c_custkey", names.display(id_, F.col("n.start"), F.col("n.end")).alias("display"))


def kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences from the digits of the customers' numbers: reverse complement, canonical form, codes, ends."""
    seq = F.translate(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), "0123456789", "ACGTACGTAC")
    rows = load(spark, sf_dir, "customer").select("c_custkey", seq.alias("seq"))
    return rows.select(
        "c_custkey", "seq", names.reverse_complement(F.col("seq")).alias("back"), names.canonical_kmer(F.col("seq")).alias("canonical"), names.kmer_code(F.col("seq")).alias("code"),
        names.code_reverse_complement(names.kmer_code(F.col("seq")), 7).alias("back_code"), names.canonical_code(names.kmer_code(F.col("seq")), 7).alias("canonical_code"),
        names.kmer_text(names.kmer_code(F.col("seq")), 7).alias("again"), names.ends(F.col("seq"), 3)["left"].alias("first3"), names.ends(F.col("seq"), 3)["right"].alias("last3"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hist_haplotype": hist_haplotype,
    "hist_group_file": hist_group_file,
    "hist_regex": hist_regex,
    "ordered_growth_list": ordered_list,
    "gfa_links": gfa_links,
    "gfa_nice": gfa_nice,
    "bed_parse": bed_parse,
    "table_wide": table_wide,
    "table_edge": table_edge,
    "hist_tsv": as_text(lambda: analyses.Hist(Count.NODE)),
    "coverage_line_tsv": as_text(lambda: analyses.CoverageLine(Count.BP)),
    "ordered_growth_tsv": as_text(lambda: analyses.OrderedGrowth("1", "0", count=Count.NODE)),
    "node_distribution_tsv": as_text(lambda: analyses.NodeDistribution()),
    "growth_of_text": growth_of_text,
    "hexbin_nodes": hexbin_nodes,
    "group_bars": group_bars,
    "path_displays": path_displays,
    "kmers": kmers,
}

HAP_STEPS = PART_STEPS.replace("c_nationkey AS g", "c_nationkey || '#' || c_mktsegment AS g")
LINES = """SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS line, value FROM ({rows})"""
CODE = "list_sum(list_transform(range(7), lambda i: ((instr('ACGT', substr({s}, i + 1, 1)) - 1) * (4 ** (6 - i)))::BIGINT))::BIGINT"
KMERS = f"""WITH s AS (SELECT c_custkey, translate(lpad(c_custkey::VARCHAR, 7, '0'), '0123456789', 'ACGTACGTAC') AS seq FROM customer),
b AS (SELECT *, reverse(translate(seq, 'ACGT', 'TGCA')) AS back FROM s)
SELECT c_custkey, seq, back, least(seq, back) AS canonical, {CODE.format(s="seq")} AS code, {CODE.format(s="back")} AS back_code, least({CODE.format(s="seq")}, {CODE.format(s="back")}) AS canonical_code,
  seq AS again, substr(seq, 1, 3) AS first3, right(seq, 3) AS last3 FROM b"""
ORACLES: dict[str, str] = {
    "hist_haplotype": hist_sql("node", HAP_STEPS),
    "hist_group_file": hist_sql("bp", PART_STEPS.replace("c_nationkey AS g", "o_orderpriority AS g")),
    "hist_regex": hist_sql("node", PART_STEPS.replace("c_nationkey AS g", "c_nationkey AS g, c_mktsegment AS seg"), where="seg = 'BUILDING'", groups="SELECT count(DISTINCT g) FROM st WHERE seg = 'BUILDING'"),
    "ordered_growth_list": ordered_sql("1", 1, 0.0).replace(ORDER, "gx AS (SELECT g, row_number() OVER (ORDER BY n_name DESC) - 1 AS gi FROM (SELECT DISTINCT g FROM st) JOIN nation ON g = n_nationkey)"),
    "gfa_links": f"""WITH {EDGE_STEPS}, e AS (SELECT DISTINCT item FROM ed)
SELECT item[1] AS u, item[2] AS u_fwd, item[3] AS v, item[4] AS v_fwd, CASE WHEN item[2] THEN '>' ELSE '<' END || item[1] || CASE WHEN item[4] THEN '>' ELSE '<' END || item[3] AS label FROM e""",
    "gfa_nice": f"WITH {PART_STEPS} SELECT item AS node_id, 2 * count(*) AS steps, 2 * sum(p)::BIGINT AS places, 2 * sum(fwd::BIGINT)::BIGINT AS forward FROM st GROUP BY 1",
    "bed_parse": """WITH r AS (SELECT c_nationkey || '#1#' || o_orderkey AS id, day(o_orderdate)::BIGINT AS d, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT id, d AS "start", d + 40 AS "end" FROM r WHERE s = 'F' UNION ALL SELECT id, d, d + 9 FROM r WHERE s = 'O'
  UNION ALL SELECT id, d, d + 5 FROM r WHERE s NOT IN ('F', 'O') UNION ALL SELECT id, d + d + 10, d + d + 17 FROM r WHERE s NOT IN ('F', 'O'))
SELECT *, id || ':' || "start" || '-' || "end" AS display FROM x""",
    "table_wide": """WITH v AS (SELECT l_suppkey AS item, c_mktsegment AS g, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT s_suppkey AS item, s_suppkey::VARCHAR AS name, """ + ", ".join(f"coalesce(max(n) FILTER (g = '{g}'), 0)::BIGINT AS \"{g}\"" for g in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM supplier LEFT JOIN v ON item = s_suppkey GROUP BY 1",
    "table_edge": f"""WITH {EDGE_STEPS} SELECT CASE WHEN item[2] THEN '>' ELSE '<' END || item[1] || CASE WHEN item[4] THEN '>' ELSE '<' END || item[3] AS name, count(DISTINCT g) AS total FROM ed GROUP BY item""",
    "hist_tsv": LINES.format(rows=f"""SELECT -4 AS k, 'panel' || chr(9) || 'hist' AS value UNION ALL SELECT -3, 'count' || chr(9) || 'node' UNION ALL SELECT -2, 'coverage' || chr(9) UNION ALL SELECT -1, 'quorum' || chr(9)
UNION ALL SELECT coverage, coverage || chr(9) || n FROM ({hist_sql("node")})"""),
    "coverage_line_tsv": LINES.format(rows=f"""SELECT -2 AS k, 'panel' || chr(9) || 'coverage' AS value UNION ALL SELECT -1, 'count' || chr(9) || 'bp' UNION ALL SELECT coverage, coverage || chr(9) || n FROM ({hist_sql("bp")}) WHERE coverage > 0"""),
    "ordered_growth_tsv": LINES.format(rows=f"""SELECT -4 AS k, 'panel' || chr(9) || 'ordered-growth' AS value UNION ALL SELECT -3, 'count' || chr(9) || 'node' UNION ALL SELECT -2, 'coverage' || chr(9) || '1' UNION ALL SELECT -1, 'quorum' || chr(9) || '0'
UNION ALL SELECT group_idx, g || chr(9) || value::BIGINT FROM ({ordered_sql("1", 1, 0.0).replace("SELECT gi::INTEGER AS group_idx,", "SELECT g, gi::INTEGER AS group_idx,")})"""),
    "node_distribution_tsv": LINES.format(rows=f"""SELECT -1 AS k, array_to_string(['Bin', 'Coverage', 'Log-Length', 'Log-Size'], chr(9)) AS value
UNION ALL SELECT b, b || chr(9) || printf('%g', x) || chr(9) || printf('%g', y) || chr(9) || printf('%g', log10(size::DOUBLE)) FROM (SELECT *, row_number() OVER (ORDER BY x, y) - 1 AS b FROM ({HEXBINS}))"""),
    "growth_of_text": f"SELECT m, value, round(value - lag(value, 1, 0) OVER (ORDER BY m), 6) AS new_items FROM ({growth_sql('union', 1, 0.0)})",
    "hexbin_nodes": HEXBINS.replace("END AS c FROM u)", "END AS c, item FROM u)").replace("round(c[2], 9) AS y, count(*)::BIGINT AS size FROM c GROUP BY 1, 2", "round(c[2], 9) AS y, item FROM c"),
    "path_displays": "SELECT c_custkey, 's#' || c_mktsegment || CASE WHEN c_acctbal > 0 THEN ':' || c_custkey || '-' || (c_custkey + 9) ELSE '' END AS display FROM customer",
    "kmers": KMERS,
    "group_bars": f"""WITH {HAP_STEPS}, v AS (SELECT g, count(*) AS n FROM st GROUP BY 1), r AS (SELECT min(n) AS low, max(n) AS high, greatest((max(n) - min(n)) / 50.0, 1.0)::DOUBLE AS w FROM v),
b AS (SELECT least(floor((n - low) / w), 49)::INTEGER AS bar, count(*) AS c FROM v, r GROUP BY 1)
SELECT k::INTEGER AS bar, printf('%g-%g', low + k * w, low + (k + 1) * w) AS label, coalesce(c, 0)::DOUBLE AS value FROM (SELECT unnest(range(50)) AS k), r LEFT JOIN b ON b.bar = k""",
}
