"""Evaluation measures: exact percentiles, ranking metrics, thresholds, confusion tables, intervals.

Nothing here sorts or collects raw rows in one task: rows are first grouped by value, and order statistics are found from
bucket totals, so only counts pass through an ordered window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import prf
from .running import cumulative


def value_bucket(v: Column) -> Column:
    """A bucket number that never decreases with v, at most 0.025% wide: some 3,000 buckets for values in 0..1."""
    return (F.signum(v) * F.ceil(F.log1p(F.abs(v)) * 4096)).cast("bigint")


def percentiles(df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, per group, for groups of any size."""
    by = list(by)
    g = by or ["_all"]
    d = (df if by else df.withColumn("_all", F.lit(1))).where(F.col(value).isNotNull())
    counts = d.groupBy(*g, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", value_bucket(F.col("_v")))
    per_bucket = counts.groupBy(*g, "_b").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*g).orderBy("_b")
    spans = per_bucket.select(
        *g, "_b", "_m", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_m").over(Window.partitionBy(*g)).alias("_total"),
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(q)).alias("f")) for n, q in qs.items()])
    t = spans.select("*", F.explode(wanted).alias("_q")).withColumn("_k", (F.col("_total") - 1) * F.col("_q.f"))
    t = t.withColumn("_lo", F.floor("_k")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_total") - 1))
    t = t.where("(_lo >= _off AND _lo < _off + _m) OR (_hi >= _off AND _hi < _off + _m)")
    inside = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    # only the buckets that hold a wanted position keep their values
    needed = t.select(*g, "_b").distinct()
    pos = counts.join(needed, [*g, "_b"], "left_semi").withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    x = pos.join(t, [*g, "_b"]).withColumn("_from", F.col("_off") + F.col("_in")).withColumn("_to", F.col("_from") + F.col("_n"))
    lo = F.max(F.when(F.expr("_lo >= _from AND _lo < _to"), F.col("_v")))
    hi = F.max(F.when(F.expr("_hi >= _from AND _hi < _to"), F.col("_v")))
    r = x.groupBy(*g, F.col("_q.q").alias("_name"), "_k", "_lo").agg(lo.alias("_vl"), hi.alias("_vh"))
    r = r.withColumn("_p", F.col("_vl") + (F.col("_vh") - F.col("_vl")) * (F.col("_k") - F.col("_lo")))
    out = r.groupBy(*g).agg(*[F.max(F.when(F.col("_name") == n, F.col("_p"))).alias(n) for n in qs])
    return out if by else out.drop("_all")


def _by_score(df: DataFrame, y: str, s: str) -> DataFrame:
    return df.groupBy(F.col(s).cast("double").alias("s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """Mann-Whitney AUC with tied scores at their average rank; null when a class is missing."""
    c = cumulative(_by_score(df, y, s), F.col("s"), value_bucket(F.col("s")), {"upto": F.col("n")})
    g = c.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("total"))
    neg = F.col("total") - F.col("p")
    return g.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("roc_auc"), "p", neg.alias("n"))


def average_precision(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    c = cumulative(_by_score(df, y, s), F.col("s").desc(), -value_bucket(F.col("s")), {"tp": F.col("pos"), "k": F.col("n")})
    g = c.agg(F.sum(F.col("pos") * F.col("tp") / F.col("k")).alias("a"), F.sum("pos").alias("p"))
    return g.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("average_precision"))


def at_thresholds(df: DataFrame, thresholds: Sequence[float], y: str = "y", s: str = "s") -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold, in one pass over the rows."""
    grid = sorted(set(thresholds))
    arr = F.array(*[F.lit(float(x)) for x in grid])
    passed = F.size(F.filter(arr, lambda x: x <= F.col(s)))
    return _confusions(df.groupBy(passed.alias("k")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")), grid)


def _confusions(by_k: DataFrame, grid: list[float]) -> DataFrame:
    # by_k has at most len(grid) + 1 rows; every row passes its first k thresholds
    arr = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(x)).alias("threshold")) for i, x in enumerate(grid)])
    x = by_k.select("*", F.inline(arr))
    hit = F.col("k") >= F.col("i")
    g = x.groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("n") - F.col("pos"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_grid_threshold(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """Largest F1 over .05, .06 … .99; ties go to the highest threshold. Rows are bucketed once, not scanned 95 times."""
    grid = [x / 100 for x in range(5, 100)]
    k = F.least(F.lit(99), F.floor(F.col(s) * 100 + 1e-6).cast("int"))
    k = F.when(k / 100 > F.col(s), k - 1).otherwise(k)
    passed = F.greatest(F.lit(0), k - 4)
    by_k = df.groupBy(passed.alias("k")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return _confusions(by_k, grid).orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)


def best_pr_threshold(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """The score value with the largest F1 on the precision-recall curve; ties go to the lowest score."""
    c = cumulative(_by_score(df, y, s), F.col("s").desc(), -value_bucket(F.col("s")), {"tp": F.col("pos"), "k": F.col("n")})
    total = df.agg(F.sum(F.col(y).cast("bigint")).alias("p"))
    x = c.crossJoin(F.broadcast(total))  # one row
    pr, rc = F.col("tp") / F.col("k"), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(F.lit(0.0))
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))
    return x.select(F.col("s").alias("threshold"), F.round(f1, 9).alias("f1"), "tp", F.col("k").alias("flagged")).orderBy(F.col("f1").desc(), "threshold").limit(1)


def precision_at_k(df: DataFrame, ks: Sequence[int], order: Sequence[Column], y: str = "y") -> DataFrame:
    """Share of positives in the first k rows of an order. Only the largest k rows are ever ranked."""
    top = df.orderBy(*order).limit(max(ks))
    ranked = top.select(F.col(y).alias("y"), F.row_number().over(Window.orderBy(*order)).alias("rn"))
    x = ranked.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    g = x.groupBy("k").agg(F.sum(F.when(F.col("rn") <= F.col("k"), F.col("y").cast("bigint")).otherwise(0)).alias("hits"), F.max("rn").alias("have"))
    return g.where("k <= have").select("k", (F.col("hits") / F.col("k")).alias("precision"))


def histogram(df: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """Ten score bins; the last one is closed at 1."""
    b = F.least(F.floor(F.col(s) * 10), F.lit(9)).cast("bigint").alias("bin")
    return df.groupBy(b).agg(F.sum(F.col(y).cast("bigint")).alias("fraud"), F.sum(1 - F.col(y).cast("bigint")).alias("clean"))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.array([lgamma(x) + lgamma(y) - lgamma(x + y) for x, y in zip(a, b)])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by the standard continued fraction (Lentz), vectorised."""
    flip = x > (a + 1) / (a + b + 2)
    xx, aa, bb = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    c, d = np.ones_like(xx), 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(aa * np.log(np.maximum(xx, tiny)) + bb * np.log1p(-np.minimum(xx, 1 - 1e-16)) - _log_beta(aa, bb)) / aa
    return np.where(flip, 1 - front * h, front * h)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def clopper_pearson(k: str, n: str, alpha: float = 0.05) -> Column:
    """Exact binomial interval as struct<lo,hi>."""
    @F.pandas_udf("struct<lo:double,hi:double>")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        kk, nn = ks.to_numpy(float), ns.to_numpy(float)
        lo = beta_quantile(alpha / 2, np.maximum(kk, 1), nn - kk + 1)
        hi = beta_quantile(1 - alpha / 2, kk + 1, np.maximum(nn - kk, 1))
        return pd.DataFrame({"lo": np.where(kk == 0, 0.0, lo), "hi": np.where(kk == nn, 1.0, hi)})
    return interval(F.col(k), F.col(n))
