"""New paths as a stream: steps are joined to the static nodes, presence is kept by distinct (item, group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def stream_presence(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """item, group of each new pair, from a stream of P lines (column value); groups are samples.

    State is the set of pairs seen: at most nodes times samples.
    """
    cols = F.split("value", "\t")
    p = lines.where(F.startswith("value", F.lit("P"))).select(names.parse_name(cols[1])["sample"].alias("group"), F.explode(F.split(cols[2], ",")).alias("token"))
    p = p.select("group", F.expr("left(token, length(token) - 1)").alias("name")).join(nodes.select("name", F.col("node_id").alias("item")), "name")
    return p.select("item", "group").dropDuplicates(["item", "group"])


def running_coverage(presence: DataFrame) -> DataFrame:
    """Coverage by item so far, for output mode complete or update."""
    return presence.groupBy("item").agg(F.count("*").alias("cov"))
