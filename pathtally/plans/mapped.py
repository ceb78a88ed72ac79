"""The driver's order tables as sequence graphs, and the queries over them with their SQL.

Parts graph: a node is a part (length p_size), a path an order, a step a line item, forward if its
status is F; the sample is the customer's nation, the haplotype the market segment. Supplier graph:
nodes are suppliers (length 1 + s_nationkey), the sample is the segment; its few nodes make edges
that many paths share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..model import Grouping, pairs_of
from ..operators import growth, info, similarity
from ..operators.counting import Counted, merge_intervals
from ..sources.graph import Graph, explode_steps, parse_nodes, parse_paths

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
SOURCE = "SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, * FROM lineitem"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_name(order: Column) -> Column:
    """The name of an order's path. A bare number could be a nation: a mask that names an order without lines would take that group in."""
    return F.concat(F.lit("o"), order.cast("string"))


def mapped_graph(spark: SparkSession, sf_dir: str, suppliers: bool = False, urgent: bool = False) -> Graph:
    """``urgent``: only orders of the first priority, so that some nodes stay unvisited."""
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if urgent:
        orders = orders.where("o_orderpriority = '1-URGENT'")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", *STEP_ORDER, "l_linestatus")
    if suppliers:
        nodes = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_suppkey").cast("string").alias("name"), (1 + F.col("s_nationkey")).cast("long").alias("len"))
        node, sample, hap = "l_suppkey", F.col("c_mktsegment"), F.lit(None).cast("string")
    else:
        nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("long").alias("len"))
        node, sample, hap = "l_partkey", F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    paths = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(
        F.col("o_orderkey").alias("path_id"), F.lit("P").alias("kind"), sample.alias("sample"), hap.alias("hap"), F.lit(None).cast("string").alias("seqid"),
        F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), path_name(F.col("o_orderkey")).alias("id"), path_name(F.col("o_orderkey")).alias("display"),
    )
    w = Window.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
    steps = lines.withColumn("pos", F.row_number().over(w) - 1).join(nodes.select(F.col("node_id").alias(node), "len"), node)
    steps = steps.join(paths.select(F.col("path_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    run = Window.partitionBy("l_orderkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(F.col("l_orderkey").alias("path_id"), "pos", F.col(node).alias("node_id"), (F.col("l_linestatus") == "F").alias("fwd"), "len", (F.sum("len").over(run) - F.col("len")).alias("p"))
    pair = Window.partitionBy("path_id").orderBy("pos")
    nxt = steps.select("node_id", "fwd", F.lead("node_id").over(pair).alias("v"), F.lead("fwd").over(pair).alias("v_fwd")).where("v is not null")
    edges = nxt.select(names.canonical_edge(F.col("node_id"), F.col("fwd"), F.col("v"), F.col("v_fwd")).alias("e")).distinct()
    # the label tells edges apart for sure, which a hash would not
    edges = edges.select("e.*").select(names.edge_label(F.col("u"), F.col("u_fwd"), F.col("v"), F.col("v_fwd")).alias("edge_id"), "*")
    return Graph(nodes, edges, paths, steps, labelled=True)


def by_sample(spark: SparkSession, sf_dir: str, suppliers: bool = False, **masks) -> Counted:
    urgent = masks.pop("urgent", False)
    return Counted(mapped_graph(spark, sf_dir, suppliers, urgent), Grouping("sample"), **masks)


def whole(ids: DataFrame) -> DataFrame:
    """A mask of whole paths."""
    none = F.lit(None).cast("long")
    return ids.select(F.struct(F.lit(0).alias("block"), F.col("path_id").alias("n")).alias("rank"), path_name(F.col("path_id")).alias("id"), none.alias("start"), none.alias("end"), path_name(F.col("path_id")).alias("display"))


def some_orders(spark: SparkSession, sf_dir: str, priority: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority).select(F.col("o_orderkey").alias("path_id"))


def short_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of the customers of nation 7."""
    customers = load(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(customers, "o_custkey", "left_semi")
    return orders.select(F.col("o_orderkey").alias("path_id"))


def intervals(spark: SparkSession, sf_dir: str, priority: str, low: int, high: int) -> DataFrame:
    return whole(some_orders(spark, sf_dir, priority)).withColumns({"start": F.lit(low).cast("long"), "end": F.lit(high).cast("long")})


# --- SQL pieces -----------------------------------------------------------------------------------

PART_STEPS = f"""o AS (SELECT o_orderkey, c_nationkey, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
l AS ({SOURCE}),
st AS (SELECT l_orderkey AS path_id, pos, l_partkey AS item, p_size::BIGINT AS len, l_linestatus = 'F' AS fwd, c_nationkey AS g, o_orderpriority AS prio,
  sum(p_size) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT - p_size AS p
  FROM l JOIN o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
EDGE_STEPS = f"""o AS (SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
l AS ({SOURCE}),
st AS (SELECT l_orderkey AS path_id, pos, l_suppkey AS n, l_linestatus = 'F' AS f, c_mktsegment AS g, 1 + s_nationkey AS len FROM l JOIN o ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
pr AS (SELECT *, lead(n) OVER w AS n2, lead(f) OVER w AS f2 FROM st WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
ed AS (SELECT g, CASE WHEN n > n2 OR (n = n2 AND NOT f) THEN (n2, NOT f2, n, NOT f) ELSE (n, f, n2, f2) END AS item FROM pr WHERE n2 IS NOT NULL)"""


def hist_sql(measure: str, source: str = PART_STEPS, where: str = "true", groups: str = "SELECT count(DISTINCT g) FROM st", items: str = "SELECT p_partkey AS item, p_size AS len FROM part", rows: str = "st") -> str:
    weight = "sum(len)" if measure == "bp" else "count(*)"
    return f"""WITH {source},
pz AS (SELECT DISTINCT item, g FROM {rows} WHERE {where}),
cv AS (SELECT i.item, i.len, count(pz.g) AS cov FROM ({items}) i LEFT JOIN pz ON pz.item = i.item GROUP BY 1, 2),
hs AS (SELECT cov, {weight} AS n FROM cv GROUP BY 1),
al AS (SELECT unnest(range(0, ({groups}) + 1)) AS coverage)
SELECT '{measure}' AS "count", coverage::INTEGER AS coverage, coalesce(n, 0)::BIGINT AS n FROM al LEFT JOIN hs ON cov = coverage"""


EDGE_MASKS = f"""o AS (SELECT o_orderkey, c_mktsegment, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
l AS ({SOURCE}),
st AS (SELECT l_orderkey AS path_id, pos, l_suppkey AS n, l_linestatus = 'F' AS f, c_mktsegment AS g, c_nationkey AS nation, o_orderpriority AS prio, 1 + s_nationkey AS len,
  sum(1 + s_nationkey) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT - (1 + s_nationkey) AS p FROM l JOIN o ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
pr AS (SELECT *, lead(n) OVER w AS n2, lead(f) OVER w AS f2, lead(p) OVER w AS p2, lead(len) OVER w AS len2 FROM st WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
ed AS (SELECT g, prio, nation, p2, len2, CASE WHEN n > n2 OR (n = n2 AND NOT f) THEN (n2, NOT f2, n, NOT f) ELSE (n, f, n2, f2) END AS item FROM pr WHERE n2 IS NOT NULL)"""
EDGE_ITEMS = "SELECT DISTINCT item, 1 AS len FROM ed"
EDGE_HIST = hist_sql("edge", EDGE_STEPS, items=EDGE_ITEMS, rows="ed")


def growth_sql(kind: str, c: int, q: float) -> str:
    lc = "lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0)"
    choose = lambda a, b: "(" + lc.format(f"({a})", f"({b})") + ")"
    head = f"WITH hs AS ({hist_sql('node')}), k AS (SELECT max(coverage) AS n FROM hs), ms AS (SELECT unnest(range(1, (SELECT n FROM k) + 1)) AS m)"
    share = f"exp({choose('coverage', 'm')} - {choose('n', 'm')})"
    core = f"coalesce(sum(CASE WHEN coverage >= greatest(m, {c}) THEN hs.n * {share.replace('(n)', '(k.n)')} END), 0)"
    if kind == "union":
        miss = f"exp({choose('k.n - coverage', 'm')} - {choose('k.n', 'm')})"
        value = f"sum(CASE WHEN coverage >= {c} THEN hs.n ELSE 0 END) - coalesce(sum(CASE WHEN coverage >= {c} AND coverage <= k.n - m THEN hs.n * {miss} END), 0)"
        body = f"SELECT m, {value} AS value FROM hs, k, ms GROUP BY m"
    elif kind == "core":
        body = f"SELECT m, {core} AS value FROM hs, k, ms GROUP BY m"
    else:
        term = f"exp({choose('coverage', 'j')} + {choose('k.n - coverage', 'm - j')} - {choose('k.n', 'm')})"
        part = f"""SELECT m, sum(hs.n * {term}) AS value FROM hs, k, ms, (SELECT unnest(range(0, (SELECT n FROM k) + 1)) AS j) js
WHERE coverage >= ceil(m * {q}) AND coverage < k.n AND j >= greatest(ceil(m * {q}), {c}) AND j < m AND j <= coverage AND m - j <= k.n - coverage GROUP BY m"""
        body = f"SELECT a.m, a.value + coalesce(b.value, 0) AS value FROM (SELECT m, {core} AS value FROM hs, k, ms GROUP BY m) a LEFT JOIN ({part}) b ON a.m = b.m"
    return f"{head} SELECT 'node' AS \"count\", {float(c)}::DOUBLE AS coverage, {q}::DOUBLE AS quorum, m::INTEGER AS m, round(value, 6) AS value FROM ({body})"


ORDER = "gx AS (SELECT g, row_number() OVER (ORDER BY min(path_id)) - 1 AS gi FROM st GROUP BY g)"


def ordered_sql(weight: str, c: int, q: float) -> str:
    return f"""WITH {PART_STEPS}, {ORDER}, n AS (SELECT count(*) AS n FROM gx),
pz AS (SELECT DISTINCT item, gi, len FROM st JOIN gx USING (g)),
rk AS (SELECT *, row_number() OVER w AS r, lead(gi) OVER w AS nx, count(*) OVER (PARTITION BY item) AS k FROM pz WINDOW w AS (PARTITION BY item ORDER BY gi)),
ok AS (SELECT gi, coalesce(nx, (SELECT n FROM n)) AS nx, {weight} AS w FROM rk WHERE k >= {c} AND r >= ceil((gi + 1) * {q})),
d AS (SELECT gp, sum(w) AS d FROM (SELECT gi AS gp, w FROM ok UNION ALL SELECT nx, -w FROM ok) GROUP BY gp)
SELECT gi::INTEGER AS group_idx, sum(coalesce(d, 0)) OVER (ORDER BY gi)::DOUBLE AS value FROM gx LEFT JOIN d ON gp = gi"""


def ordered(measure: str, c: str, q: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = by_sample(spark, sf_dir)
        return growth.ordered_growth(x.presence(measure), x.items(measure), x.n_groups, *pairs_of(c, q)[0])

    return run


def grown(c: str, q: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return growth.growth_table(by_sample(spark, sf_dir).hist("node"), pairs_of(c, q)).withColumn("value", F.round("value", 6))

    return run


def hist(measure: str, suppliers: bool = False, **masks) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {k: f(spark, sf_dir) if callable(f) else f for k, f in masks.items()}
        return by_sample(spark, sf_dir, suppliers, **own).hist(measure)

    return run


def orders_of(priority: str):
    return lambda s, d: whole(some_orders(s, d, priority))


def hist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_sample(spark, sf_dir, suppliers=True).hists(["node", "bp", "edge"])


def gfa_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parts graph as graph text: S lines; P lines and the same paths as W lines."""
    g = mapped_graph(spark, sf_dir)
    s = g.nodes.select(F.struct(F.lit(0).cast("long").alias("block"), F.col("node_id").alias("n")).alias("rank"), F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), "name"), F.repeat(F.lit("A"), F.col("len").cast("int"))).alias("value"))
    step = g.steps.join(g.paths.select("path_id", "sample", "hap"), "path_id").groupBy("path_id", "sample", "hap").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "fwd"))).alias("x"))
    plus = F.array_join(F.transform("x", lambda t: F.concat(F.lit("s"), t["node_id"].cast("string"), F.when(t["fwd"], "+").otherwise("-"))), ",")
    sign = F.array_join(F.transform("x", lambda t: F.concat(F.when(t["fwd"], ">").otherwise("<"), F.lit("s"), t["node_id"].cast("string"))), "")
    seqid = F.concat(F.lit("o"), F.col("path_id").cast("string"))
    name = F.concat_ws("#", F.col("sample"), F.regexp_replace("hap", " ", ""), seqid)
    p, w = F.concat_ws("\t", F.lit("P"), name, plus, F.lit("*")), F.concat_ws("\t", F.lit("W"), "sample", "hap", seqid, F.lit("*"), F.lit("*"), sign)
    both = step.select("path_id", F.posexplode(F.array(p, w)).alias("block", "value"))
    return s, both.select(F.struct((1 + F.col("block")).cast("long").alias("block"), F.col("path_id").alias("n")).alias("rank"), "value")


def gfa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, lines = gfa_lines(spark, sf_dir)
    nodes, paths = parse_nodes(segments), parse_paths(lines)
    steps = explode_steps(paths, nodes, carry=["kind", "sample", "seqid", "name"])
    return steps.select("kind", "sample", F.expr("cast(substring(seqid, 2) as bigint)").alias("o"), F.col("pos").cast("long").alias("pos"), F.expr("cast(substring(name, 2) as bigint)").alias("part"), "fwd", "len", "p")


def pansn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    name = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("#"), F.col("c_mktsegment"))).otherwise(""), F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("#"), F.col("c_name"))).otherwise(""), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(":"), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") + 9).cast("string"))).otherwise(""))
    n = names.parse_name(name)
    return c.select("c_custkey", n.alias("n")).select("c_custkey", "n.*", names.path_id(F.col("n.sample"), F.col("n.hap"), F.col("n.seqid")).alias("id"))


def bed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.rint("l_quantity").cast("long")  # the SQL's cast rounds halves to even
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") % 5000).alias("start"), (F.col("l_orderkey") % 5000 + size).alias("end"))
    return merge_intervals(rows, ["key"]).select("key", "start", "end")


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = by_sample(spark, sf_dir)
    return similarity.jaccard(x.presence("bp"), x.items("bp"), x.n_groups).withColumn("value", F.round("value", 6))


def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_sample(spark, sf_dir).group_index


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return info.components(g.nodes, g.edges)


def brand_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph that joins parts of one brand only: nodes, edges. It falls into many components.

    Joins are by sorting: the file of the parts may be below the limit for a broadcast, while their rows fill the driver.
    """
    g, brand = mapped_graph(spark, sf_dir), load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    u, v = brand.select(F.col("k").alias("u"), F.col("p_brand").alias("ub")), brand.select(F.col("k").alias("v"), F.col("p_brand").alias("vb"))
    return g.nodes, g.edges.join(u.hint("merge"), "u").join(v.hint("merge"), "v").where("ub = vb")


def hexbins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = by_sample(spark, sf_dir)
    return info.hexbins(x.coverage("node").join(x.graph.nodes.select(F.col("node_id").alias("item"), "len"), "item"))


def group_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.group_info(by_sample(spark, sf_dir))


def heaps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = growth.growth_table(by_sample(spark, sf_dir).hist("node"), pairs_of("1", "0")).orderBy("m").collect()
    return spark.createDataFrame([(k, float(v)) for k, v in growth.heaps([r.value for r in rows]).items()], "name string, value double")


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    x = by_sample(spark, sf_dir)
    n = x.n_groups
    m = np.zeros((n, n))
    for r in similarity.jaccard(x.presence("bp"), x.items("bp"), n).collect():  # groups squared
        m[r.x, r.y] = r.value
    order = similarity.leaf_order(similarity.linkage(m), n)
    return spark.createDataFrame([(k, int(g)) for k, g in enumerate(order)], "place int, group_idx int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hist_node": hist("node"),
    "hist_bp": hist("bp"),
    "hist_edge": hist("edge", True),
    "hist_all": hist_all,
    "hist_urgent": hist("node", urgent=True),
    "hist_subset": hist("node", include=orders_of("1-URGENT")),
    "hist_exclude": hist("node", exclude=lambda s, d: whole(short_list(s, d))),
    "hist_edge_subset": hist("edge", True, include=lambda s, d: intervals(s, d, "2-HIGH", 10, 60)),
    "hist_edge_exclude": hist("edge", True, exclude=lambda s, d: whole(short_list(s, d))),
    "hist_bp_exclude": hist("bp", include=lambda s, d: intervals(s, d, "2-HIGH", 10, 60), exclude=lambda s, d: intervals(s, d, "2-HIGH", 20, 24)),
    "hist_bp_interval": hist("bp", include=lambda s, d: intervals(s, d, "2-HIGH", 10, 60)),
    "coverage_line": lambda s, d: hist("node")(s, d).where("coverage > 0"),
    "growth_union": grown("1", "0"),
    "growth_core": grown("1", "1"),
    "growth_quorum": grown("2", "0.5"),
    "ordered_growth_node": ordered("node", "1", "0"),
    "ordered_growth_bp": ordered("bp", "2", "0"),
    "ordered_growth_quorum": ordered("node", "1", "0.5"),
    "table_total": lambda s, d: by_sample(s, d).table("node", total=True),
    "table_group": lambda s, d: by_sample(s, d).table("bp"),
    "similarity": jaccard,
    "node_distribution": hexbins,
    "info_graph": lambda s, d: (lambda g: info.graph_info(g.nodes, g.edges))(mapped_graph(s, d, True)),
    "info_node": lambda s, d: info.node_info(mapped_graph(s, d).nodes),
    "info_path": lambda s, d: info.path_info(by_sample(s, d).path_lengths()),
    "info_group": group_info,
    "components": components,
    "components_of_brands": lambda s, d: info.components(*brand_links(s, d)),
    "component_info": lambda s, d: info.component_info(*brand_links(s, d)),
    "gfa_parse_roundtrip": gfa_parse,
    "pansn_parse": pansn,
    "bed_merge": bed_merge,
    "group_order": group_order,
    "heaps_fit": heaps_fit,
    "cluster_order": cluster_order,
}

PANSN = """WITH c AS (SELECT *, 's' || c_nationkey AS s, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS st FROM customer)
SELECT c_custkey, s AS sample, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS hap, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS seqid, st::BIGINT AS "start", (st + 9)::BIGINT AS "end",
  s || CASE WHEN c_custkey % 3 > 0 THEN '#' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 3 = 2 THEN '#' || c_name ELSE '' END AS id FROM c"""
ISLANDS = """{a} AS (SELECT *, CASE WHEN "start" > coalesce(max("end") OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS nw FROM {src}),
{b} AS (SELECT key, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS rn FROM {a}) GROUP BY key, rn)"""
BED_MERGE = "WITH b AS (SELECT l_suppkey AS key, l_orderkey % 5000 AS \"start\", l_orderkey % 5000 + l_quantity::BIGINT AS \"end\" FROM lineitem), " + ISLANDS.format(a="i1", b="i2", src="b") + ' SELECT key, "start", "end" FROM i2'
BP_INTERVAL = f"""WITH {PART_STEPS},
iv AS (SELECT item, len, g, path_id, CASE WHEN fwd THEN greatest(10 - p, 0) ELSE len - least(60 - p, len) END AS "start", CASE WHEN fwd THEN least(60 - p, len) ELSE len - greatest(10 - p, 0) END AS "end"
  FROM st WHERE prio = '2-HIGH' AND p < 60 AND p + len > 10),
kv AS (SELECT item AS key, "start", "end" FROM iv), {ISLANDS.format(a="i1", b="i2", src="kv")},
un AS (SELECT key AS item, sum("end" - "start") AS covered FROM i2 GROUP BY key),
cv AS (SELECT p_partkey AS item, p_size AS len, coalesce(p_size - covered, 0) AS unc, count(DISTINCT g) AS cov FROM part LEFT JOIN un ON un.item = p_partkey LEFT JOIN iv ON iv.item = p_partkey GROUP BY ALL),
hs AS (SELECT cov, sum(len - unc) AS n FROM cv GROUP BY 1 UNION ALL SELECT 0, sum(unc) FROM cv),
ht AS (SELECT cov, sum(n) AS n FROM hs GROUP BY 1),
al AS (SELECT unnest(range(0, (SELECT count(DISTINCT g) FROM st WHERE prio = '2-HIGH') + 1)) AS coverage)
SELECT 'bp' AS "count", coverage::INTEGER AS coverage, coalesce(n, 0)::BIGINT AS n FROM al LEFT JOIN ht ON cov = coverage"""
SPANS = """SELECT item AS key, len, g, CASE WHEN fwd THEN greatest({a} - p, 0) ELSE len - least({b} - p, len) END AS "start", CASE WHEN fwd THEN least({b} - p, len) ELSE len - greatest({a} - p, 0) END AS "end"
  FROM st WHERE prio = '2-HIGH' AND p < {b} AND p + len > {a}"""
BP_EXCLUDE = f"""WITH {PART_STEPS}, iv AS ({SPANS.format(a=10, b=60)}), xv AS ({SPANS.format(a=20, b=24)}),
{ISLANDS.format(a="i1", b="i2", src="iv")}, {ISLANDS.format(a="x1", b="x2", src="xv")},
gone AS (SELECT DISTINCT x2.key FROM x2 JOIN part ON p_partkey = key WHERE x2."start" <= 0 AND x2."end" >= p_size),
sz AS (SELECT key, sum("end" - "start") AS size FROM i2 GROUP BY key),
ct AS (SELECT i2.key, sum(least(i2."end", x2."end") - greatest(i2."start", x2."start")) AS cut FROM i2 JOIN x2 ON i2.key = x2.key AND i2."start" < x2."end" AND i2."end" > x2."start" GROUP BY 1),
un AS (SELECT sz.key AS item, p_size - size + coalesce(cut, 0) AS unc FROM sz LEFT JOIN ct ON ct.key = sz.key JOIN part ON p_partkey = sz.key WHERE sz.key NOT IN (SELECT key FROM gone)),
pz AS (SELECT DISTINCT key AS item, g FROM iv WHERE key NOT IN (SELECT key FROM gone)),
cv AS (SELECT p_partkey AS item, p_size - coalesce(unc, 0) AS w, coalesce(unc, 0) AS unc, count(g) AS cov FROM part LEFT JOIN un ON un.item = p_partkey LEFT JOIN pz ON pz.item = p_partkey GROUP BY ALL),
ht AS (SELECT cov, sum(n) AS n FROM (SELECT cov, w AS n FROM cv UNION ALL SELECT 0, unc FROM cv) GROUP BY 1),
al AS (SELECT unnest(range(0, (SELECT count(DISTINCT g) FROM st WHERE prio = '2-HIGH') + 1)) AS coverage)
SELECT 'bp' AS "count", coverage::INTEGER AS coverage, coalesce(n, 0)::BIGINT AS n FROM al LEFT JOIN ht ON cov = coverage"""
JACCARD = f"""WITH {PART_STEPS}, gx AS (SELECT g, row_number() OVER (ORDER BY min(path_id)) - 1 AS gi FROM st GROUP BY g),
pz AS (SELECT DISTINCT item, gi, len FROM st JOIN gx USING (g)), ln AS (SELECT gi, sum(len) AS s FROM pz GROUP BY gi),
bo AS (SELECT a.gi AS x, b.gi AS y, sum(a.len) AS i FROM pz a JOIN pz b USING (item) GROUP BY 1, 2)
SELECT a.gi::INTEGER AS x, b.gi::INTEGER AS y, round(coalesce(i, 0)::DOUBLE / (a.s + b.s - coalesce(i, 0)), 6) AS value FROM ln a CROSS JOIN ln b LEFT JOIN bo ON x = a.gi AND y = b.gi"""
HEXBINS = f"""WITH {PART_STEPS}, pz AS (SELECT DISTINCT item, g FROM st),
pt AS (SELECT p_partkey AS item, count(pz.g)::DOUBLE AS x, log10(p_size::DOUBLE) AS y FROM part LEFT JOIN pz ON item = p_partkey GROUP BY p_partkey, p_size),
tp AS (SELECT max(x) / 14 AS dx, max(y) / 8 AS dy FROM pt),
u AS (SELECT *, x / dx AS ux, y / dy AS uy, round(x / dx) AS ax, round(y / dy) AS ay, floor(x / dx) AS bx, floor(y / dy) AS by_ FROM pt, tp),
c AS (SELECT CASE WHEN sqrt(pow((ux - ax) * dx, 2) + pow((uy - ay) * dy, 2)) < sqrt(pow((ux - bx - 0.5) * dx, 2) + pow((uy - by_ - 0.5) * dy, 2)) THEN (ax * dx, ay * dy) ELSE ((bx + 0.5) * dx, (by_ + 0.5) * dy) END AS c FROM u)
SELECT round(c[1], 9) AS x, round(c[2], 9) AS y, count(*)::BIGINT AS size FROM c GROUP BY 1, 2"""
INFO_GRAPH = f"""WITH {EDGE_STEPS}, e AS (SELECT DISTINCT item FROM ed), d AS (SELECT s_suppkey, count(n)::BIGINT AS degree FROM supplier LEFT JOIN (SELECT item[1] AS n FROM e UNION ALL SELECT item[3] FROM e) ON n = s_suppkey GROUP BY 1)
SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT sum(1 + s_nationkey)::BIGINT FROM supplier) AS bp, (SELECT count(*) FROM e) AS edges, avg(degree) AS degree_avg, max(degree) AS degree_max, min(degree) AS degree_min, count(*) FILTER (degree = 0) AS zero_degree FROM d"""
INFO_NODE = """WITH w AS (SELECT p_size::BIGINT AS len, sum(p_size) OVER (ORDER BY p_size DESC) AS run, sum(p_size) OVER () AS total FROM part)
SELECT avg(len) AS avg, max(len) AS max, min(len) AS min, median(len)::DOUBLE AS median, max(len) FILTER (2 * run >= total) AS n50 FROM w"""
INFO_PATH = f"""WITH {PART_STEPS}, pl AS (SELECT path_id, count(*) AS nodes, sum(len)::BIGINT AS bp FROM st GROUP BY 1)
SELECT count(*) AS paths, max(bp) AS bp_max, min(bp) AS bp_min, avg(bp) AS bp_avg, max(nodes) AS nodes_max, min(nodes) AS nodes_min, avg(nodes) AS nodes_avg FROM pl"""
LINKED = f"""WITH RECURSIVE o AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), l AS ({SOURCE}),
st AS (SELECT l_orderkey AS path_id, pos, l_partkey AS n, p_brand AS w FROM l JOIN o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
pr AS (SELECT n, lead(n) OVER p AS n2, w, lead(w) OVER p AS w2 FROM st WINDOW p AS (PARTITION BY path_id ORDER BY pos)),
e AS (SELECT DISTINCT n, n2 FROM pr WHERE n2 IS NOT NULL AND {{where}}), b AS (SELECT n AS a, n2 AS b FROM e UNION SELECT n2, n FROM e),
r(node_id, c) USING KEY (node_id) AS (SELECT p_partkey, p_partkey FROM part
  UNION SELECT b.b, min(r.c) FROM r JOIN b ON b.a = r.node_id JOIN recurring.r AS k ON k.node_id = b.b WHERE r.c < k.c GROUP BY b.b)"""
COMPONENTS, OF_BRANDS = (LINKED.format(where=w) + " SELECT node_id, c AS component FROM r" for w in ("true", "w = w2"))
COMPONENT_INFO = f"""WITH s AS (SELECT component, count(*) AS size FROM ({OF_BRANDS}) GROUP BY 1)
SELECT count(*) AS components, max(size) AS largest, min(size) AS smallest, median(size)::DOUBLE AS median FROM s"""
ROUNDTRIP = f"""WITH {PART_STEPS}, k AS (SELECT unnest(['P', 'W']) AS kind)
SELECT kind, g::VARCHAR AS sample, path_id AS o, pos::BIGINT AS pos, item AS part, fwd, len, p::BIGINT AS p FROM st, k"""

ORACLES: dict[str, str] = {
    "hist_node": hist_sql("node"),
    "hist_bp": hist_sql("bp"),
    "hist_edge": EDGE_HIST,
    "hist_all": " UNION ALL ".join(
        f"SELECT * FROM ({hist_sql(m, EDGE_STEPS.replace('l_suppkey AS n,', 'l_suppkey AS n, l_suppkey AS item,'), items='SELECT s_suppkey AS item, 1 + s_nationkey AS len FROM supplier')})" for m in ("node", "bp")
    ) + f" UNION ALL SELECT * FROM ({EDGE_HIST})",
    "hist_urgent": hist_sql("node", where="prio = '1-URGENT'", groups="SELECT count(DISTINCT g) FROM st WHERE prio = '1-URGENT'"),
    "hist_subset": hist_sql("node", where="prio = '1-URGENT'", groups="SELECT count(DISTINCT g) FROM st WHERE prio = '1-URGENT'"),
    "hist_exclude": hist_sql("node", where="item NOT IN (SELECT item FROM st WHERE prio = '1-URGENT' AND g = 7)", groups="SELECT count(DISTINCT g) FROM st WHERE NOT (prio = '1-URGENT' AND g = 7)"),
    "hist_edge_subset": hist_sql("edge", EDGE_MASKS, where="prio = '2-HIGH' AND p2 < 60 AND p2 + len2 > 10", groups="SELECT count(DISTINCT g) FROM st WHERE prio = '2-HIGH'", items=EDGE_ITEMS, rows="ed"),
    "hist_edge_exclude": hist_sql("edge", EDGE_MASKS, where="item NOT IN (SELECT item FROM ed WHERE prio = '1-URGENT' AND nation = 7)", groups="SELECT count(DISTINCT g) FROM st WHERE NOT (prio = '1-URGENT' AND nation = 7)", items=EDGE_ITEMS, rows="ed"),
    "hist_bp_exclude": BP_EXCLUDE,
    "hist_bp_interval": BP_INTERVAL,
    "coverage_line": f"SELECT * FROM ({hist_sql('node')}) WHERE coverage > 0",
    "growth_union": growth_sql("union", 1, 0.0),
    "growth_core": growth_sql("core", 1, 1.0),
    "growth_quorum": growth_sql("quorum", 2, 0.5),
    "ordered_growth_node": ordered_sql("1", 1, 0.0),
    "ordered_growth_bp": ordered_sql("len", 2, 0.0),
    "ordered_growth_quorum": ordered_sql("1", 1, 0.5),
    "table_total": f"WITH {PART_STEPS} SELECT p_partkey AS item, count(DISTINCT g) AS value FROM part LEFT JOIN st ON item = p_partkey GROUP BY 1",
    "table_group": f"WITH {PART_STEPS}, {ORDER} SELECT item, gi::INTEGER AS group_idx, sum(len)::BIGINT AS value FROM st JOIN gx USING (g) GROUP BY 1, 2",
    "similarity": JACCARD,
    "node_distribution": HEXBINS,
    "info_graph": INFO_GRAPH,
    "info_node": INFO_NODE,
    "info_path": INFO_PATH,
    "info_group": f"WITH {PART_STEPS} SELECT g::VARCHAR AS group_name, count(*) AS nodes, sum(len)::BIGINT AS bp FROM st GROUP BY 1",
    "components": COMPONENTS,
    "components_of_brands": OF_BRANDS,
    "component_info": COMPONENT_INFO,
    "gfa_parse_roundtrip": ROUNDTRIP,
    "pansn_parse": PANSN,
    "bed_merge": BED_MERGE,
    "group_order": f"WITH {PART_STEPS}, {ORDER} SELECT g::VARCHAR AS group_name, gi::INTEGER AS group_idx FROM gx",
}
