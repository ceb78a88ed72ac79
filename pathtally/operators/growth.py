"""Growth curves: expected union, core and quorum over subsets of groups, and along an order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Threshold


def log_choose(top: int) -> np.ndarray:
    """Natural logs of factorials up to ``top``."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))]) if top else np.zeros(1)


def _share(lf: np.ndarray, i, m: int, n: int):
    """C(i, m) / C(n, m) for i >= m."""
    return np.exp(lf[i] - lf[i - m] + lf[n - m] - lf[n])


def growth(hist: list[int], coverage: Threshold, quorum: Threshold) -> list[float]:
    """Expected items in m = 1..n groups. Bucket 0 never counts; m * quorum is rounded up."""
    n = len(hist) - 1
    if n < 1:
        return []
    h, lf = np.asarray(hist, float), log_choose(n)
    c, q = max(1, coverage.absolute(n)), quorum.share(n) if quorum.relative else quorum.value / n
    need = max(1, math.ceil(n * q))
    out = []
    for m in range(1, n + 1):
        if need == 1:  # in any of m
            missed = sum(h[i] * math.exp(lf[n - i] - lf[n - i - m] + lf[n - m] - lf[n]) for i in range(c, n - m + 1))
            out.append(float(h[c:].sum() - missed))
            continue
        i = np.arange(max(m, c), n + 1)
        value = float((h[i] * _share(lf, i, m, n)).sum())
        if need < n:
            mq = math.ceil(m * q)
            for k in range(mq, n):
                j = np.arange(max(mq, c, m - (n - k)), min(m - 1, k) + 1)
                if len(j) and h[k]:
                    value += h[k] * float(np.exp(lf[k] - lf[j] - lf[k - j] + lf[n - k] - lf[m - j] - lf[n - k - m + j] - lf[n] + lf[m] + lf[n - m]).sum())
        out.append(value)
    return out


def growth_table(hist: DataFrame, pairs: list[tuple[Threshold, Threshold]]) -> DataFrame:
    """count, coverage, quorum, m, value for every count in ``hist`` and every threshold pair.

    A histogram has one row a group, so this is the driver's work.
    """
    vectors: dict[str, dict[int, int]] = {}
    for r in hist.collect():
        vectors.setdefault(r["count"], {})[r["coverage"]] = r["n"]
    rows = []
    for count, values in vectors.items():
        dense = [values.get(i, 0) for i in range(max(values) + 1)]
        for c, q in pairs:
            rows += [(count, float(c.value), float(q.value), m, float(v)) for m, v in enumerate(growth(dense, c, q), 1)]
    return hist.sparkSession.createDataFrame(rows, "count string, coverage double, quorum double, m int, value double")


def ordered_growth(presence: DataFrame, items: DataFrame, n: int, coverage: Threshold, quorum: Threshold, strict: bool = False) -> DataFrame:
    """group_idx, value: items among the first groups of the order.

    An item counts from a visit on if it has been visited by enough of the groups up to that visit;
    each visit adds at its group and takes off at the next one. ``strict``: the quorum is asked at
    every position, not only at visits.
    """
    c, q = max(1, coverage.absolute(n)), quorum.share(n) if quorum.relative else quorum.value / n
    w = Window.partitionBy("item").orderBy("group_idx")
    rows = presence.select("item", "group_idx").withColumn("r", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("group_idx").over(w), F.lit(n)))
    rows = rows.withColumn("k", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(F.col("k") >= c)
    rows = rows.join(items.where("weight > 0").select("item", "weight"), "item").where(F.col("r") >= F.ceil((F.col("group_idx") + 1) * F.lit(q)))
    end = F.least("next", F.floor(F.col("r") / F.lit(q)).cast("int")) if strict and q > 0 else F.col("next")
    steps = rows.select(F.col("group_idx").alias("at"), "weight").union(rows.select(end.alias("at"), -F.col("weight")))
    steps = steps.groupBy("at").agg(F.sum("weight").alias("d"))
    spark = presence.sparkSession
    line = spark.range(n).select(F.col("id").cast("int").alias("group_idx")).join(steps, F.col("group_idx") == F.col("at"), "left")
    # one row a group
    return line.select("group_idx", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("group_idx")).cast("double").alias("value"))


def differences(values: list[float]) -> list[float]:
    """New items with each further group."""
    return [v - (values[k - 1] if k else 0) for k, v in enumerate(values)]


def power_law(x, y) -> tuple[float, float]:
    """Least squares k * x ** g by Gauss-Newton from the fit of logarithms."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = (x > 0) & (y > 0)
    if ok.sum() < 2:
        return float("nan"), float("nan")
    g, k = np.polyfit(np.log(x[ok]), np.log(y[ok]), 1)
    k = math.exp(k)
    for _ in range(100):
        p = x**g
        j = np.stack([p, k * p * np.log(x)], 1)
        step, *_ = np.linalg.lstsq(j, y - k * p, rcond=None)
        k, g = k + step[0], g + step[1]
        if np.abs(step).max() < 1e-12:
            break
    return float(k), float(g)


def heaps(values: list[float]) -> dict[str, float]:
    """Growth k1 * m ** gamma, and new items k2 * m ** -alpha."""
    m = np.arange(1, len(values) + 1)
    k1, gamma = power_law(m, values)
    k2, alpha = power_law(m[1:], differences(values)[1:])
    return {"k1": k1, "gamma": gamma, "k2": k2, "alpha": -alpha}
