"""Running aggregates that survive hot keys.

A sliding time window over a key is written as a running sum over *events*: a row enters at its own time (+x) and leaves
just after the last moment at which it still counts (-x). Running sums merge, so a hot key is cut into time segments:
each segment is windowed on its own, and the totals of the earlier segments (one row per segment, aggregated before the
shuffle) are added. Cold keys stay in one segment. No task ever sees more than one segment of a hot key, and the cost is
O(n log n) where a sliding RANGE frame re-reads its whole frame for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SPLIT, Split
from ..session import cut, spread

SEG = "_seg"


def hot_keys(df: DataFrame, keys: Sequence[str], split: Split = SPLIT) -> DataFrame | None:
    """Keys with more than `split.hot_rows` rows (map-side counts), or None when there are none.

    This is measured before the plan is built, so the usual case plans one plain window. There are at most
    rows / hot_rows such keys; they are written to the checkpoint folder and never come to the driver.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split.hot_rows).select(*keys, F.lit(True).alias("_hot"))
    return None if hot.isEmpty() else cut(hot)


def with_segment(df: DataFrame, keys: Sequence[str], hot: DataFrame | None, t_us: str = "t_us", split: Split = SPLIT) -> DataFrame:
    """Adds the segment number: -1 for cold keys, the time segment for hot ones. Without hot keys nothing is added."""
    if hot is None:
        return df
    seg = F.floor(F.col(t_us) / split.segment_us).cast("bigint")
    return df.join(hot, list(keys), "left").withColumn(SEG, F.when(F.col("_hot"), seg).otherwise(F.lit(-1))).drop("_hot")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    include_current: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Running sums and maxima per key in `order`. A table that carries `_seg` is windowed per segment.

    Hot keys (segments >= 0) get the totals of their earlier segments added; that side holds one row per hot segment.
    With `rows`, about how many there are, rows are moved and sorted as they come, in as many tasks as so many need; what is
    summed is derived behind the sort. Otherwise Spark derives it first, and a row grows by every sum before it moves.
    """
    sums, maxes = sums or {}, maxes or {}
    k = list(keys)
    cols = list(df.columns)
    split_up = SEG in cols
    part = [*k, *([SEG] if split_up else [])]
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    placed = df if rows is None else spread(df, rows, *part).sortWithinPartitions(*part, *order)
    out = placed.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()], *[F.max(c).over(frame).alias(n) for n, c in maxes.items()])
    if not split_up:
        return out.select(*cols, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in sums], *maxes)
    totals = df.where(F.col(SEG) >= 0).groupBy(*k, SEG).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()]
    )
    before = Window.partitionBy(*k).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *k, SEG, *[F.sum(n).over(before).alias(f"_b_{n}") for n in sums], *[F.max(n).over(before).alias(f"_b_{n}") for n in maxes]
    )
    joined = out.join(carried, [*k, SEG], "left")
    return joined.select(
        *cols,
        *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_b_{n}")).alias(n) for n in maxes],
    )


def global_index(df: DataFrame, order: Sequence[str | Column], bucket: Column, name: str = "seq", start: int = 1) -> DataFrame:
    """A dense global number in `order` without sorting everything in one task.

    `bucket` must not decrease along `order` (a time bucket, for instance). Rows are numbered inside a bucket and shifted
    by the number of rows in earlier buckets; only the per-bucket counts pass through one ordered window.
    """
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_bkt", F.coalesce(F.sum("_c").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_bkt").orderBy(*order))
    return b.withColumn("_rn", inside).join(offsets, "_bkt").withColumn(name, F.col("_rn") + F.col("_off") + F.lit(start - 1)).drop("_rn", "_off", "_bkt")


def cumulative(df: DataFrame, order: Column, bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """Cumulative sums along one global order, cut into buckets that do not decrease along it."""
    b = df.withColumn("_bkt", bucket)
    totals = b.groupBy("_bkt").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    ordered = totals.withColumn("_ord", F.col("_bkt"))
    carried = ordered.select("_bkt", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]).join(carried, "_bkt")
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
