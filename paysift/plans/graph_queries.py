"""Registered queries: paths, neighbourhoods, graph features, model jobs, model comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as Gr
from ..operators import metrics as M
from ..operators import models as Md
from ..params import DAY, LIVE, R20
from ..session import cut
from ..sources import files
from . import profile_queries
from . import views as V
from .account_queries import stored_alerts
from .metric_queries import in_split

QUERIES = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def edges(spark, sf) -> DataFrame:
    return V.payments(spark, sf).select("row", "t_us", "from_id", "to_id", "amount", "channel", "score", "is_fraud")


def seeds(spark, sf) -> DataFrame:
    return stored_alerts(spark, sf).where(LIVE).select("account_id").distinct()


def paths(spark, sf) -> DataFrame:
    return Gr.downstream_paths(edges(spark, sf), seeds(spark, sf), 3, 200)


@query("downstream_paths")
def downstream(spark, sf):
    """The first 200 time-respecting paths of up to three hops out of each account under a live alert."""
    p = paths(spark, sf)
    return p.select("seed", "path_no", F.array_join("nodes", ">").alias("nodes"), F.array_join(F.transform("legs", lambda x: x.r.cast("string")), ",").alias("rows"))


@query("downstream_paths_not_stopped")
def downstream_open(spark, sf):
    """The same without payments that a freeze stopped, the first 20 per account, told whether there are more."""
    p = Gr.downstream_paths(edges(spark, sf), seeds(spark, sf), 3, 20, profile_queries.stopped_rows(spark, sf))
    return p.select("seed", "path_no", F.array_join("nodes", ">").alias("nodes"), F.array_join(F.transform("legs", lambda x: x.r.cast("string")), ",").alias("rows"), "truncated")


@query("path_summary")
def summary(spark, sf):
    return Gr.path_summary(cut(paths(spark, sf)), stored_alerts(spark, sf).where(LIVE))


@query("path_accounts_by_hop")
def by_hop(spark, sf):
    return Gr.reached_by_hop(paths(spark, sf))


@query("context_edges_two_hop")
def context(spark, sf):
    """The whole two-hop context of every payment, summed up per payment."""
    return Gr.context_edges(edges(spark, sf), summed=True)


@query("recent_in_edges_cap")
def recent_in(spark, sf):
    return Gr.recent_in_edges(edges(spark, sf), 8).select("to_id", "row", "rk")


@query("bidirectional_edges")
def both(spark, sf):
    e = Gr.bidirectional(edges(spark, sf).select("row", "from_id", "to_id"))
    return e.select("row", "from_id", "to_id", "direction")


@query("undirected_pairs")
def undirected(spark, sf):
    return Gr.bidirectional(edges(spark, sf).select("from_id", "to_id")).select("from_id", "to_id").distinct()


@query("port_numbers")
def ports(spark, sf):
    return Gr.with_ports(edges(spark, sf)).select("row", "in_port", "out_port")


@query("time_deltas")
def deltas(spark, sf):
    return Gr.with_time_deltas(edges(spark, sf)).select("row", "in_delta_us", "out_delta_us")


@query("neighbour_multi_aggregates")
def pna(spark, sf):
    return Gr.multi_aggregates(edges(spark, sf), S.log_amount(F.col("amount")))


@query("neighbour_attention_mean")
def attention(spark, sf):
    x = S.log_amount(F.col("amount"))
    raw = F.col("score") * 2 - x / 10
    return Gr.attention_mean(edges(spark, sf), F.when(raw > 0, raw).otherwise(0.2 * raw), x)


@query("neighbour_relation_means")
def relation(spark, sf):
    return Gr.relation_means(edges(spark, sf), "channel", ["P2M", "P2P"], S.log_amount(F.col("amount")))


@query("ego_flags")
def ego(spark, sf):
    e = edges(spark, sf)
    return Gr.ego_flags(e, e.where("is_fraud = 1"))


@query("paid_by_flagged")
def paid(spark, sf):
    e = edges(spark, sf)
    s = e.groupBy(F.col("to_id").alias("account_id")).agg(F.max("score").alias("s"))
    return Gr.paid_by_flagged(e, s, 1.0)


@query("spliced_node_ids")
def splice(spark, sf):
    """Accounts of the test days on the ids of those seen in the train days; unseen accounts get the next ids in first-seen
    order."""
    e = edges(spark, sf)
    train = e.where(in_split("train"))
    bucket = F.floor(F.col("row") / 65_536)
    known = files.dense_ids(train, ["row"], bucket, ["from_id", "to_id"], "id")
    test = files.dense_ids(e.where(in_split("test")), ["row"], bucket, ["from_id", "to_id"], "test_id")
    fresh = test.join(known, "key", "left_anti")
    new = files.global_index(fresh, ["test_id"], F.floor(F.col("test_id") / 65_536), "k", start=0)
    base = known.agg((F.max("id") + 1).alias("n0"))
    added = new.crossJoin(F.broadcast(base)).select("key", (F.col("k") + F.col("n0")).alias("id"), F.lit(False).alias("known"))  # one row
    return test.join(known, "key").select("key", "id", F.lit(True).alias("known")).unionByName(added)


@query("positive_class_weight")
def pos_weight(spark, sf):
    return Md.positive_weight(edges(spark, sf).where(in_split("train")).withColumn("y", F.col("is_fraud")))


def model_edges(spark, sf) -> DataFrame:
    hour = F.pmod(F.col("t_us") / 1_000_000, F.lit(86_400.0)) / 3600
    f = F.array((hour - 12) / 7, (S.log_amount(F.col("amount")) - 10) / 2, (F.col("channel") == "P2M").cast("double"))
    return edges(spark, sf).select("row", "t_us", "from_id", "to_id", f.alias("features"))


def model(spark) -> Md.Weights:
    return Md.load_weights(Md.weights_table(spark))


@query("edge_scores_full_graph")
def gin(spark, sf):
    return Md.score_edges(model_edges(spark, sf), model(spark))


@query("edge_scores_in_time")
def gin_time(spark, sf):
    return Md.score_edges_in_time(model_edges(spark, sf), model(spark))


@query("edge_scores_cached")
def gin_cached(spark, sf):
    """Cached against exact scores: how far apart they are."""
    e, w = model_edges(spark, sf), model(spark)
    exact, cached = Md.score_edges_both(e, w, refresh_s=300)
    a, b = exact.withColumnRenamed("probability", "exact"), cached.withColumnRenamed("probability", "cached")
    d = F.abs(F.col("exact") - F.col("cached"))
    return a.join(b, "row").agg(F.count(F.lit(1)).alias("edges"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.sum(((F.col("exact") >= 0.5) != (F.col("cached") >= 0.5)).cast("bigint")).alias("flips"))


@query("chain_scores")
def chain(spark, sf):
    """Suspected chains scored on the current graph: the legs are extra edges, only they are kept."""
    e = model_edges(spark, sf)
    legs = e.join(seeds(spark, sf).withColumnRenamed("account_id", "to_id"), "to_id", "left_semi").withColumn("row", -F.col("row") - 1)
    s = Md.score_edges(e.unionByName(legs), model(spark)).where("row < 0")
    return s.select((-F.col("row") - 1).alias("row"), "probability", S.score_reading(F.col("probability")).alias("reading"))


def tabular(spark, sf) -> DataFrame:
    return edges(spark, sf).select("row", "t_us", F.col("is_fraud").alias("y"), S.log_amount(F.col("amount")).alias("log_amount"), (F.pmod(F.col("t_us") / 1_000_000, F.lit(86_400.0)) / 3600).alias("hour"), (F.col("channel") == "P2M").cast("double").alias("p2m"))


def _train(df: DataFrame) -> DataFrame:
    return df.where(in_split("train"))


@query("amount_only_model_auc")
def amount_model(spark, sf):
    t = tabular(spark, sf)
    s = Md.amount_model(_train(t), t.where(in_split("test")))
    return M.roc_auc(s.join(t.select("row", "y"), "row").withColumnRenamed("score", "s"))


@query("tabular_model_auc")
def tab_model(spark, sf):
    t = tabular(spark, sf)
    s = Md.tabular_model(_train(t), t.where(in_split("test")))
    return M.roc_auc(s.join(t.select("row", "y"), "row").withColumnRenamed("score", "s"))


@query("node_forest_auc")
def forest(spark, sf):
    """Random forest on node features: does an account receive or send fraud money?"""
    e = edges(spark, sf)
    legs = e.select("amount", "is_fraud", "score", F.inline(F.array(F.struct(F.col("to_id").alias("a"), F.lit(1.0).alias("i")), F.struct(F.col("from_id").alias("a"), F.lit(0.0).alias("i")))))
    n = legs.groupBy("a").agg(F.max("is_fraud").alias("y"), F.count(F.lit(1)).cast("double").alias("deg"), F.avg(F.log1p("amount")).alias("mean_amount"), F.max(F.log1p("amount")).alias("max_amount"), F.avg("i").alias("in_share"))
    n = n.withColumn("row", F.substring("a", 2, 12).cast("bigint"))
    f = ["deg", "mean_amount", "max_amount", "in_share"]
    s = Md.forest_model(n.where("row % 5 < 3"), n.where("row % 5 >= 3"), f)
    return M.roc_auc(s.join(n.select("row", "y"), "row").withColumnRenamed("score", "s"))


@query("f1_by_time_step")
def by_step(spark, sf):
    """Confusion per day and before/after day 5, at the model threshold."""
    x = edges(spark, sf).select(S.day_of(F.col("t_us"), V.BASE_US).alias("day"), F.col("is_fraud").alias("y"), (F.col("score") >= R20.model_threshold).alias("hit"))
    part = F.explode(F.array(F.concat(F.lit("day "), F.col("day").cast("string")), F.when(F.col("day") < 5, "before").otherwise("after")))
    g = x.select("*", part.alias("part")).groupBy("part").agg(F.sum((F.col("hit") & (F.col("y") == 1)).cast("bigint")).alias("tp"), F.sum((F.col("hit") & (F.col("y") == 0)).cast("bigint")).alias("fp"), F.sum((~F.col("hit") & (F.col("y") == 1)).cast("bigint")).alias("fn"))
    _, _, f1 = S.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("part", "tp", "fp", "fn", F.round(f1, 9).alias("f1"))


@query("amounts_permuted_in_test")
def permuted(spark, sf):
    """The log amount shuffled among the test-day payments only (seeded): rank by row meets rank by hash."""
    t = edges(spark, sf).where(in_split("test")).select("row", "amount", F.md5(F.concat(F.lit("42|"), F.col("row").cast("string"))).alias("h"))
    b = files.global_index(t.select("row"), ["row"], F.floor(F.col("row") / 65_536), "k")
    c = files.global_index(t.select("amount", "h", "row"), ["h", "row"], F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), "k").select("k", F.col("amount").alias("new_amount"))
    moved = b.join(c, "k").select("row", "new_amount")
    return edges(spark, sf).join(moved, "row", "left").select("row", F.round(S.log_amount(F.coalesce("new_amount", "amount")), 9).alias("log_amount"))
