"""Readers of mask, group, order and histogram files, and writers of tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..model import Threshold

OPEN_END = (1 << 63) - 1


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order, without carriage returns."""
    from .graph import read_lines

    return read_lines(spark, path).select(F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("value"), "rank")


def parse_bed(lines: DataFrame, blocks: bool = True) -> DataFrame:
    """rank, id, start, end, display from lines of 1, 3 or more, or 12 columns.

    A name alone is the whole path, with its own coordinates if it has any. ``blocks``: twelve
    columns give one row a block. Lines of two columns are an error.
    """
    rows = lines.where(~F.col("value").rlike(r"^(browser |track |#)") & (F.col("value") != "")).select("rank", F.split("value", "\t").alias("c"))
    n = F.size("c")
    rows = rows.select("rank", F.when(n == 2, F.raise_error(F.concat(F.lit("a line of two columns: "), F.col("c")[0]))).otherwise(F.col("c")).alias("c"))
    name = names.parse_name(F.col("c")[0])
    # masks are short lists; cached here, the parsed names enter later plans as columns
    rows = rows.select("rank", "c", name.alias("n"), F.size("c").alias("size")).persist()
    start = F.when(F.col("size") == 1, F.col("n.start")).otherwise(F.col("c")[1].cast("long"))
    end = F.when(F.col("size") == 1, F.col("n.end")).otherwise(F.col("c")[2].cast("long"))
    if blocks:
        sizes = F.transform(F.filter(F.split(F.col("c")[10], ","), lambda x: x != ""), lambda x: x.cast("long"))
        starts = F.transform(F.filter(F.split(F.col("c")[11], ","), lambda x: x != ""), lambda x: x.cast("long"))
        bad = F.raise_error(F.lit("block sizes and starts differ in number"))
        spans = F.when((F.size(sizes) != F.size(starts)), bad).otherwise(
            F.zip_with(starts, sizes, lambda s, z: F.struct((F.col("c")[1].cast("long") + s).alias("start"), (F.col("c")[1].cast("long") + s + z).alias("end")))
        )
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        rows = rows.withColumn("x", F.explode(F.when(F.col("size") >= 12, spans).otherwise(one)))
        start, end = F.col("x.start"), F.col("x.end")
    id_ = names.path_id(F.col("n.sample"), F.col("n.hap"), F.col("n.seqid"))
    rows = rows.select("rank", id_.alias("id"), start.alias("start"), end.alias("end"))
    return rows.withColumn("display", names.display(F.col("id"), F.col("start"), F.col("end"))).persist()


def read_bed(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    return parse_bed(text_rows(spark, path), blocks)


def parse_groups(lines: DataFrame) -> DataFrame:
    """key (path id without coordinates), group_name; exactly two columns a line."""
    c = F.split("value", "\t")
    rows = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.when(F.size(c) != 2, F.raise_error(F.concat(F.lit("not two columns: "), F.col("value")))).otherwise(c).alias("c"))
    n = names.parse_name(F.col("c")[0])
    return rows.select(n.alias("n"), F.trim(F.col("c")[1]).alias("group_name")).select(names.path_id(F.col("n.sample"), F.col("n.hap"), F.col("n.seqid")).alias("key"), "group_name")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return parse_groups(text_rows(spark, path))


def read_tsv(spark: SparkSession, path: str) -> tuple[list[str], list[list[str]]]:
    """Comment lines and the rows of a small table, blank rows left out."""
    lines = [r.value for r in text_rows(spark, path).orderBy("rank").collect()]
    return [x for x in lines if x.startswith("#")], [x.split("\t") for x in lines if x.strip() and not x.startswith("#")]


def parse_hist_rows(rows: list[list[str]]) -> dict[str, list[int]]:
    """Dense vectors by count from a histogram table: row 1 the kind, row 2 the count of each column."""
    kinds, counts = rows[0], rows[1]
    out: dict[str, list[int]] = {}
    body = [r for r in rows[2:] if r[0].strip().isdigit()]
    top = max((int(r[0]) for r in body), default=-1)
    for k in range(1, len(kinds)):
        if kinds[k] != "hist":
            continue
        values = [0] * (top + 1)
        for r in body:
            values[int(r[0])] = int(float(r[k]))
        out[counts[k]] = values
    return out


def read_hist(spark: SparkSession, path: str) -> DataFrame:
    """hist(count, coverage, n) from a table file."""
    _, rows = read_tsv(spark, path)
    long = [(c, i, n) for c, values in parse_hist_rows(rows).items() for i, n in enumerate(values)]
    return spark.createDataFrame(long, "count string, coverage int, n long")


def read_thresholds(spark: SparkSession, path: str) -> list[Threshold]:
    """Thresholds of a file, one a line in the first column: whole numbers of groups, else shares."""
    out = []
    for n, r in enumerate(text_rows(spark, path).orderBy("rank").collect(), 1):
        word = r.value.split("\t")[0]
        try:
            out.append(Threshold(int(word)) if word.isdigit() else Threshold(float(word), True))
        except ValueError:
            raise ValueError(f"threshold {word!r} in line {n} is no number") from None
    return out


def write_presence(presence: DataFrame, path: str) -> None:
    """The sparse matrix of items and groups as rows (item, group_idx, visits), written by Spark."""
    presence.select("item", "group_idx", "visits").write.mode("overwrite").csv(path, sep="\t", header=True)


def hist_text(count: str, values: list[int]) -> str:
    """A single histogram: a head of two cells, then a line a coverage."""
    return "\n".join([f"hist\t{count}", *(f"{k}\t{v}" for k, v in enumerate(values))]) + "\n"


def metadata(argv: list[str], version: str) -> str:
    return f"# {' '.join(argv)}\n# version {version}\n"


def cell(value: float | None) -> str:
    """As tables show it: rounded down, but not below a whole number that arithmetic just missed."""
    if value is None or math.isnan(value):
        return "NaN"
    return str(math.floor(round(value, 9)))


def format_table(headers: list[list[str]], columns: list[list[float]], index: list[str] | None = None, start: int = 0) -> str:
    """Header rows and columns with an index; ``index`` names rows, else they count from ``start``."""
    out = ["\t".join(h) for h in headers]
    n = max(map(len, columns), default=0)
    for i in range(start, n):
        name = index[i - start] if index else str(i)
        out.append("\t".join([name, *(cell(c[i]) if i < len(c) else "NaN" for c in columns)]))
    return "\n".join(out) + "\n"
