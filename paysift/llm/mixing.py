"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.session import cut

#: A Poisson draw of a large mean is the sum of draws of at most this mean; beyond STEPS the chance is below 1e-17.
PART, STEPS = 8, 64
#: Source statistics of more rows than this are joined by key instead of being broadcast.
BROADCAST_ROWS = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, the same in any engine."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, key: Column, seed: int) -> Column:
    """The Poisson count whose distribution function first exceeds a hash of the key.

    A mean above PART is divided into equal parts, each inverted with a hash of its own; the sum is Poisson again.
    """
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")

    def one(part: Column) -> Column:
        start = F.struct(F.exp(-mean / parts).alias("p"), F.exp(-mean / parts).alias("below"), F.lit(0).alias("n"), uniform(key, F.lit(str(seed)), part.cast("string")).alias("u"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * (mean / parts) / k
            return F.struct(p.alias("p"), (s["below"] + p).alias("below"), (s["n"] + F.when(s["u"] >= s["below"], 1).otherwise(0)).alias("n"), s["u"].alias("u"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["n"])

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, part: total + one(part))


def repetition_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", size: float = 1.0) -> DataFrame:
    """(mix_source, mix_rate): how often a document of each source is repeated on average.

    The mix has about `size` times the input's rows, shared by the weights (normalised over the sources that occur;
    all equal when none are given). A source that is not among the given weights gets 0. A null source is a source.
    """
    counted = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n"))
    if weights is None:
        counted = counted.withColumn("mix_weight", F.lit(1.0))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        if any(v < 0 for _, v in rows):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame(rows, "k string, mix_weight double") if rows else docs.sparkSession.createDataFrame([], "k string, mix_weight double")
        counted = counted.join(given, F.col("mix_source").eqNullSafe(F.col("k")), "left").select("mix_source", "mix_n", F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"))
    counted = cut(counted)
    n, w = counted.agg(F.coalesce(F.sum("mix_n"), F.lit(0)), F.coalesce(F.sum("mix_weight"), F.lit(0.0))).first()
    rate = F.lit(size * n / w) * F.col("mix_weight") / F.col("mix_n") if w else F.lit(0.0)
    return counted.select("mix_source", rate.alias("mix_rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", size: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as often as its Poisson count says, in a globally shuffled order.

    Columns: those of `docs`, then mix_copy (0, 1, ... of a document), mix_rate, and mix_order, the random number by whose
    hash rows are dealt over partitions and by which they are sorted in each; columns of these names are replaced. A count
    depends on key, seed and rate alone: repeated rows get the same count. A null key or source is a value of its own; an
    empty table gives an empty one. The statistics are one row per source and are broadcast only up to BROADCAST_ROWS.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_order", "mix_source", "mix_n")
    rates = cut(repetition_rates(docs, weights, source, size))
    small = rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rated = docs.join(F.broadcast(rates) if small else rates, F.col(source).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    count = poisson(F.col("mix_rate"), name, seed)
    copies = rated.withColumn("mix_n", count).where("mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    order = uniform(name, F.lit(f"order {seed}"), F.col("mix_copy").cast("string"))
    columns = [f"`{c}`" for c in docs.columns]
    return copies.select(*columns, "mix_copy", "mix_rate", order.alias("mix_order")).repartition(F.col("mix_order")).sortWithinPartitions("mix_order")
