"""Account-level views: profiles, trails, networks, onboarding, evidence packs, decisions and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rupees
from ..params import R20, Rules
from .alerts import SEV_RANK


def legs(payments: DataFrame, *extra: str) -> DataFrame:
    """Both ends of every payment: (account_id, other_id, dir, …)."""
    def end(a: str, b: str, d: str) -> Column:
        return F.struct(F.col(f"{a}_id").alias("account_id"), F.col(f"{b}_id").alias("other_id"), F.lit(d).alias("dir"),
                        F.col(f"{b}_vpa").alias("other_vpa"), F.col(f"{b}_state").alias("other_state"))
    return payments.select("row", "t_us", "amount_p", "amount", "score", *extra, F.inline(F.array(end("to", "from", "in"), end("from", "to", "out"))))


def profile(payments: DataFrame) -> DataFrame:
    """Counts, sums, distinct counterparties, first in and out, turnaround and counterparty states per account.

    Counterparties are first reduced to one row per pair, so the distinct counts need no second pass over payments."""
    x = legs(payments)
    pair = x.groupBy("account_id", "other_id", "dir").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_p").alias("p"), F.min("t_us").alias("t"),
        F.count(F.when(F.col("amount").between(450_000, 560_000), 1)).alias("band"), F.min("other_state").alias("s"))
    i, o = F.col("dir") == "in", F.col("dir") == "out"
    g = pair.groupBy("account_id").agg(
        F.sum(F.when(i, F.col("n")).otherwise(0)).alias("in_n"), F.sum(F.when(o, F.col("n")).otherwise(0)).alias("out_n"),
        F.sum(F.when(i, F.col("p")).otherwise(0)).alias("in_p"), F.sum(F.when(o, F.col("p")).otherwise(0)).alias("out_p"),
        F.count(F.when(i, 1)).alias("payers"), F.count(F.when(o, 1)).alias("payees"),
        F.min(F.when(i, F.col("t"))).alias("first_in_us"), F.min(F.when(o, F.col("t"))).alias("first_out_us"), F.sum("band").alias("band_n"),
        F.array_join(F.sort_array(F.collect_set("s")), ",").alias("states"))  # states are a small fixed set
    return g.select("account_id", "in_n", "out_n", rupees(F.col("in_p")).alias("total_in"), rupees(F.col("out_p")).alias("total_out"), "payers", "payees", "first_in_us", "first_out_us", "band_n",
                    F.floor((F.col("first_out_us") - F.col("first_in_us")) / 1_000_000).alias("turnaround_s"), "states")


def first_seen_vpas(payments: DataFrame) -> DataFrame:
    """VPA -> account id, the first payment that shows the VPA wins (sender before receiver)."""
    x = payments.select("t_us", "row", F.inline(F.array(F.struct(F.col("from_vpa").alias("vpa"), F.col("from_id").alias("id"), F.lit(0).alias("o")), F.struct(F.col("to_vpa").alias("vpa"), F.col("to_id").alias("id"), F.lit(1).alias("o")))))
    return x.groupBy("vpa").agg(F.min_by("id", F.struct("t_us", "row", "o")).alias("account_id"))


def resolve_handles(handles: DataFrame, payments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Handle -> account: label id or payment id, then payment VPA, then label VPA."""
    ids = accounts.select("account_id").union(payments.select(F.explode(F.array("from_id", "to_id")).alias("account_id"))).distinct()
    seen = first_seen_vpas(payments)
    x = handles.join(ids.select(F.col("account_id").alias("handle"), F.col("account_id").alias("by_id")), "handle", "left")
    x = x.join(seen.select(F.col("vpa").alias("handle"), F.col("account_id").alias("by_vpa")), "handle", "left")
    x = x.join(accounts.select(F.col("vpa").alias("handle"), F.col("account_id").alias("by_label")), "handle", "left")
    return x.select("handle", F.coalesce("by_id", "by_vpa", "by_label").alias("account_id"))


def degrees(payments: DataFrame) -> DataFrame:
    """In and out degree per account, and both divided by the largest degree."""
    d = legs(payments).groupBy("account_id").agg(F.count(F.when(F.col("dir") == "in", 1)).alias("in_degree"), F.count(F.when(F.col("dir") == "out", 1)).alias("out_degree"))
    top = d.agg(F.greatest(F.max("in_degree"), F.max("out_degree"), F.lit(1)).alias("top"))
    return d.crossJoin(F.broadcast(top)).select("account_id", "in_degree", "out_degree", F.round(F.col("in_degree") / F.col("top"), 3).alias("in_velocity"), F.round(F.col("out_degree") / F.col("top"), 3).alias("out_velocity"))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rk") -> DataFrame:
    """First k rows per key. Spark prunes to k rows per key before the shuffle, so a hot key costs no more than others."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def trail(payments: DataFrame, direction: str, top: int) -> DataFrame:
    """Money by counterparty; beyond `top` counterparties the smallest are rolled up into one 'others' row."""
    g = legs(payments).where(F.col("dir") == direction).groupBy("account_id", F.col("other_id").alias("party")).agg(
        F.sum("amount_p").alias("amount_p"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"))
    many = g.groupBy("account_id").agg(F.count(F.lit(1)).alias("parties"))
    ranked = top_k(g, ["account_id"], [F.col("amount_p").desc(), F.col("party")], top).join(many, "account_id")
    keep = ranked.where((F.col("parties") <= top) | (F.col("rk") < top)).select("account_id", "party", "amount_p", "n", "top_score")
    rest = g.join(keep.select("account_id", "party"), ["account_id", "party"], "left_anti").groupBy("account_id").agg(
        F.sum("amount_p").alias("amount_p"), F.sum("n").alias("n"), F.max("top_score").alias("top_score"))
    return keep.unionByName(rest.withColumn("party", F.lit("others")))


def network(payments: DataFrame, alerts: DataFrame, limit: int = 40, per_account: int = 6) -> DataFrame:
    """One edge per pair around the worst alerted accounts: all links among them, and each one's largest other flows."""
    worst = alerts.where("status NOT IN ('superseded', 'cleared')").groupBy("account_id").agg(F.max(F.struct(F.expr(SEV_RANK).alias("sev"), "updated_us")).alias("w"))
    centre = worst.orderBy(F.col("w.sev").desc(), F.col("w.updated_us").desc(), "account_id").limit(limit).select("account_id")
    c = F.broadcast(centre)  # at most `limit` rows
    pairs = payments.join(c.select(F.col("account_id").alias("from_id"), F.lit(1).alias("fc")), "from_id", "left").join(
        c.select(F.col("account_id").alias("to_id"), F.lit(1).alias("tc")), "to_id", "left").where("fc = 1 OR tc = 1")
    g = pairs.groupBy("from_id", "to_id", "fc", "tc").agg(F.sum("amount_p").alias("amount_p"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"), F.max("t_us").alias("last_us"))
    inner = g.where("fc = 1 AND tc = 1")
    outer = g.where("fc IS NULL OR tc IS NULL").withColumn("centre", F.when(F.col("fc") == 1, F.col("from_id")).otherwise(F.col("to_id")))
    kept = top_k(outer, ["centre"], [F.col("amount_p").desc(), F.col("from_id"), F.col("to_id")], per_account)
    cols = ["from_id", "to_id", "amount_p", "n", F.round("top_score", 4).alias("top_score"), "last_us"]
    return inner.select(*cols).unionByName(kept.select(*cols))


def counterparties(payments: DataFrame) -> DataFrame:
    return legs(payments).where("account_id <> other_id").select("account_id", "other_id").distinct()


def account_status(vpas: DataFrame, seen: DataFrame, alerts: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """VPA -> seen, account, flagged, held, frozen, number of uncleared alerts. `accounts` is the lifecycle's third table;
    without it nothing is held or frozen."""
    live = alerts.where("status <> 'cleared'").groupBy("account_id").agg(F.count(F.lit(1)).alias("live_alerts"))
    x = vpas.select("vpa").distinct().join(seen, "vpa", "left").join(live, "account_id", "left")
    no = F.lit(False)
    x = x.withColumns({"held": no, "frozen": no}) if accounts is None else x.join(accounts.select("account_id", (F.col("level") > 0).alias("held"), F.col("frozen_us").isNotNull().alias("frozen")), "account_id", "left")
    return x.select("vpa", "account_id", F.col("account_id").isNotNull().alias("seen"), (F.coalesce("live_alerts", F.lit(0)) > 0).alias("flagged"), F.coalesce("held", no).alias("held"),
                    F.coalesce("frozen", no).alias("frozen"), F.coalesce("live_alerts", F.lit(0)).alias("live_alerts"))


def evidence_pack(payments: DataFrame, members: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Per case: payments touching it, internal links, money in, money that left and money that was stopped. `members` is
    (case_id, account_id), `blocked` the rows of payments that did not go through."""
    m = members.select("case_id", "account_id").distinct()
    p = payments.withColumn("stopped", F.lit(0)) if blocked is None else payments.join(blocked.select("row", F.lit(1).alias("stopped")).distinct(), "row", "left")
    x = legs(p.withColumn("stopped", F.coalesce("stopped", F.lit(0))), "stopped").join(m, "account_id")
    per = x.groupBy("case_id", "row").agg(
        F.max(F.when(F.col("dir") == "in", 1).otherwise(0)).alias("i"), F.max(F.when(F.col("dir") == "out", 1).otherwise(0)).alias("o"), F.max("amount_p").alias("amount_p"), F.max("stopped").alias("stopped"))

    def money(cond: str) -> Column:
        return F.sum(F.when(F.expr(cond), F.col("amount_p")).otherwise(0))

    return per.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("transactions"), F.count(F.when((F.col("i") == 1) & (F.col("o") == 1), 1)).alias("links"), money("i = 1 AND o = 0 AND stopped = 0").alias("money_in_p"),
        money("i = 0 AND o = 1 AND stopped = 0").alias("exited_p"), money("stopped = 1").alias("blocked_p"))


def apply_actions(alerts: DataFrame, actions: DataFrame, rules: Rules = R20) -> DataFrame:
    """Alert status after analyst actions (clear, escalate, freeze), each needing a note.

    A freeze closes every live alert of its account; an action on a closed alert is rejected. Everything follows from the
    first valid clear per alert and the first freeze per account that hits a live alert, so no ordered fold is needed.
    """
    k = ["detector", "account_id"]
    base = alerts.select(*k, "gnn_max", F.col("status").alias("before"))
    a = actions.join(base, k).withColumn("valid", (F.trim("note") != "") & F.col("action").isin("clear", "escalate", "freeze") & (F.col("before") != "superseded"))
    own = a.where("valid").groupBy(*k).agg(
        F.min(F.when(F.col("action") == "clear", F.col("at_us"))).alias("clear_us"), F.min(F.when(F.col("action") == "freeze", F.col("at_us"))).alias("freeze_us"), F.min(F.when(F.col("action") == "escalate", F.col("at_us"))).alias("esc_us"))
    frozen = own.where("freeze_us IS NOT NULL AND (clear_us IS NULL OR freeze_us < clear_us)").groupBy("account_id").agg(F.min("freeze_us").alias("tf_us"))
    x = base.join(own, k, "left").join(frozen, "account_id", "left")
    cleared = F.col("clear_us").isNotNull() & (F.col("tf_us").isNull() | (F.col("clear_us") < F.col("tf_us")))
    status = (F.when(F.col("before") == "superseded", F.col("before")).when(cleared, "cleared").when(F.col("tf_us").isNotNull(), "frozen").when(F.col("esc_us").isNotNull(), "escalated").otherwise(F.col("before")))
    return x.select(*k, status.alias("status"), "gnn_max", (cleared & (F.col("before") != "superseded") & (F.col("gnn_max") >= rules.model_threshold)).alias("override"))


def feedback_labels(decisions: DataFrame) -> DataFrame:
    """Latest decision per payment row: freeze -> 1, clear -> 0. `decisions` is one row per (decision, row)."""
    d = decisions.where(F.col("decision").isin("freeze", "clear"))
    # a max per row merges before the shuffle; a ranking window would not
    return d.groupBy("row").agg(F.max(F.struct("at_us", "tie", F.when(F.col("decision") == "freeze", 1).otherwise(0).alias("label"))).alias("m")).select("row", F.col("m.label").alias("label"))
