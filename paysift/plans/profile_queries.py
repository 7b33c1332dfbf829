"""Registered queries: account views, decisions, feedback, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import detectors as D
from ..operators import lifecycle as Lc
from ..operators import onboarding as On
from ..operators import profiles as P
from ..operators.metrics import percentiles
from ..operators.running import global_index
from ..params import HOUR, LEVEL_HOURS, LIVE
from ..session import cut
from . import views as V
from .account_queries import evidence, stored_alerts
from .metric_queries import in_split

QUERIES = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


@query("payments_in_order")
def payments_in_order(spark, sf):
    """Global sequence number in (time, row) order."""
    p = V.payments(spark, sf).select("row", "t_us")
    return global_index(p, ["t_us", "row"], F.floor(F.col("t_us") / HOUR)).select("row", "seq")


@query("new_payee_flags")
def new_payee(spark, sf):
    return D.with_pair_history(V.payments(spark, sf)).select("row", "new_payee")


@query("daily_totals")
def daily(spark, sf):
    return D.daily_totals(V.payments(spark, sf))


@query("account_baselines")
def baselines(spark, sf):
    return D.baselines(D.daily_totals(V.payments(spark, sf))).select("account_id", "day", "base_p", F.round("base_ratio", 9).alias("base_ratio"), "active_days")


@query("rolling_inflow_24h")
def rolling(spark, sf):
    """Inbound sum and count over the last 24 h at every payment, inclusive lower bound, ties by row."""
    p = V.payments(spark, sf)
    w = D.window_sums(D.with_pair_history(p), D.hot_accounts(p))
    return w.where("side = 'i'").select("row", F.col("in_2").alias("in_24h_p"), F.col("new_n_24").alias("new_payers_24h"))


@query("rolling_outflow_6h")
def rolling_out(spark, sf):
    p = V.payments(spark, sf)
    w = D.window_sums(D.with_pair_history(p), D.hot_accounts(p))
    return w.where("side = 'o'").select("row", F.col("in_1").alias("in_6h_p"), F.col("out_1").alias("out_6h_p"), F.col("outs_1").alias("outs_6h"), F.col("payees_1").alias("payees_6h"))


@query("account_profile")
def profile(spark, sf):
    return P.profile(V.payments(spark, sf))


@query("vpa_directory")
def vpas(spark, sf):
    return P.first_seen_vpas(V.payments(spark, sf))


@query("handle_resolution")
def handles(spark, sf):
    p, a = V.payments(spark, sf), V.accounts(spark, sf)
    h = a.select(F.col("account_id").alias("handle")).union(a.select("vpa")).union(a.select(F.concat(F.lit("zz"), F.col("vpa"))))
    return P.resolve_handles(h, p, a)


@query("payments_with_labels")
def labelled(spark, sf):
    a = V.accounts(spark, sf).select(F.col("account_id").alias("to_id"), "role", "bank", "kind")
    x = V.payments(spark, sf).select("row", F.when(F.col("row") % 97 == 0, F.concat(F.lit("N"), F.col("to_id"))).otherwise(F.col("to_id")).alias("to_id"))
    return x.join(a, "to_id", "left").groupBy(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("kind", F.lit("individual")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("degree_and_velocity")
def degrees(spark, sf):
    return P.degrees(V.payments(spark, sf))


@query("money_trail_sources")
def sources(spark, sf):
    return P.trail(V.payments(spark, sf), "in", 6).select("account_id", "party", "amount_p", "n", F.round("top_score", 9).alias("top_score"))


@query("money_trail_destinations")
def destinations(spark, sf):
    """Five destinations per account and, for each, its own three largest onward destinations."""
    p = V.payments(spark, sf)
    d = P.trail(p, "out", 5)
    nxt = P.trail(p, "out", 3).select(F.col("account_id").alias("party"), F.col("party").alias("next_party"), F.col("amount_p").alias("next_p"))
    return d.select("account_id", "party", "amount_p", "n").join(nxt, "party", "left")


@query("alert_network")
def network(spark, sf):
    return P.network(V.payments(spark, sf), stored_alerts(spark, sf))


@query("counterparty_sets")
def cps(spark, sf):
    return P.counterparties(V.payments(spark, sf)).groupBy("account_id").agg(F.count(F.lit(1)).alias("counterparties"))


def applicants(spark, sf):
    return P.first_seen_vpas(V.payments(spark, sf)).join(V.entity_accounts(spark, sf).select("vpa").distinct(), "vpa", "left_semi")


def onboarding_report(spark, sf):
    """Every settlement VPA of the registry against the accounts under a live alert."""
    vpas = V.entity_accounts(spark, sf).select("vpa").distinct().join(P.first_seen_vpas(V.payments(spark, sf)), "vpa", "left")
    flagged = stored_alerts(spark, sf).where(LIVE).groupBy("account_id").agg(F.max("score").alias("score"))
    return On.onboarding_report(vpas, V.payments(spark, sf), flagged)


@query("onboarding_vpas")
def onboarding_vpas(spark, sf):
    """Per settlement VPA, unknown ones too: links, the worst second-hop account, over whom it is reached, and the decision."""
    return onboarding_report(spark, sf)


@query("onboarding_check")
def onboarding(spark, sf):
    return onboarding_report(spark, sf).where("known").select("account_id", "txns", "counterparties", "self_flagged", "direct", "second_hop", "decision", "reason").distinct()


@query("account_status")
def status(spark, sf):
    """Settlement VPAs with what is known of their accounts after holds, lifts and people's actions."""
    alerts, _, accounts = lifecycle(spark, sf)
    return P.account_status(V.entity_accounts(spark, sf), P.first_seen_vpas(V.payments(spark, sf)), alerts, accounts)


@query("evidence_pack")
def pack(spark, sf):
    """Per case of escalated or frozen alerts: its payments, internal links, money in, money that left, money stopped by a freeze."""
    from .decision_queries import cases

    m = cases(spark, sf).select(F.col("case_event").alias("case_id"), "account_id")
    return P.evidence_pack(V.payments(spark, sf), m, stopped_rows(spark, sf))


@query("evidence_timeline")
def timeline(spark, sf):
    """Alerts and actions of a case in one ordered list."""
    al = stored_alerts(spark, sf).select("account_id", F.col("created_us").alias("at_us"), F.lit("alert").alias("kind"), F.concat("detector", F.lit(" ("), "severity", F.lit(")")).alias("text"))
    ac = actions(spark, sf).where("note <> ''").select("account_id", "at_us", F.lit("action").alias("kind"), F.concat(F.lit("analyst: "), "action", F.lit(". "), "note").alias("text"))
    return al.unionByName(ac).orderBy("account_id", "at_us")


def actions(spark, sf):
    """Analyst actions derived from the alerts: what is done depends on the account number."""
    n = F.substring("account_id", 2, 10).cast("bigint")
    x = stored_alerts(spark, sf).select("detector", "account_id", (F.col("created_us") + HOUR + A.detector_order() * 1_000_000).alias("at_us"), n.alias("n"))
    act = F.when(F.col("n") % 4 == 0, "clear").when(F.col("n") % 4 == 1, F.when(F.col("detector") == "pass_through", "freeze").otherwise("clear")).when(F.col("n") % 4 == 2, "escalate").otherwise("freeze")
    return x.select("detector", "account_id", act.alias("action"), "at_us", F.when(F.col("n") % 7 == 0, "").otherwise("reviewed").alias("note"), F.concat(F.lit("run-"), (F.col("n") % 3).cast("string")).alias("run_id"))


@query("alert_status_after_actions")
def after_actions(spark, sf):
    return P.apply_actions(stored_alerts(spark, sf), actions(spark, sf)).drop("gnn_max")


def lifecycle_events(spark, sf) -> DataFrame:
    """The alert table as a log: keys are raised when first and last seen, the router holds by severity and model agreement,
    every hold ends after its hours, and people act as in `actions`."""
    a = stored_alerts(spark, sf).withColumn("o", A.detector_order().cast("bigint"))
    level = F.expr("CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE 0 END")
    level = F.when(F.col("detector") == "model_only", 0).when((level > 0) & (F.col("gnn_max") >= 0.86), level + 1).otherwise(level)
    hours = F.element_at(F.array(*[F.lit(LEVEL_HOURS[k]) for k in (1, 2, 3)]), F.col("level"))
    at = F.explode(F.array_distinct(F.array("created_us", "updated_us")))
    x = a.select("account_id", "detector", "o", "gnn_max", level.alias("level"), at.alias("at_us"))
    n = {c: F.lit(None).cast(t).alias(c) for c, t in (("detector", "string"), ("level", "int"), ("score", "double"), ("note", "string"))}
    raised = x.select("account_id", "detector", F.lit("raise").alias("kind"), n["level"], F.col("gnn_max").alias("score"), n["note"], "at_us", (F.col("o") + 10).alias("seq"))
    holds = x.where("level > 0").select("account_id", "detector", F.lit("hold").alias("kind"), "level", n["score"], n["note"], "at_us", (F.col("o") + 20).alias("seq"))
    lifts = x.where("level > 0").select("account_id", n["detector"], F.lit("lift").alias("kind"), n["level"], n["score"], n["note"], (F.col("at_us") + hours * HOUR).alias("at_us"), (F.col("o") + 30).alias("seq"))
    acts = actions(spark, sf).select("account_id", "detector", F.col("action").alias("kind"), n["level"], n["score"], "note", "at_us", (A.detector_order().cast("bigint") + 40).alias("seq"))
    return raised.unionByName(holds).unionByName(lifts).unionByName(acts)


def lifecycle(spark, sf):
    return Lc.lifecycle(cut(lifecycle_events(spark, sf)))


def stopped_rows(spark, sf) -> DataFrame:
    """Payments from or to an account after its freeze."""
    frozen = lifecycle(spark, sf)[2].where("frozen_us IS NOT NULL").select("account_id", "frozen_us")
    ends = V.payments(spark, sf).select("row", "t_us", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("account_id"))
    return ends.join(frozen, "account_id").where("t_us > frozen_us").select("row").distinct()


@query("alert_lifecycle")
def alert_lifecycle(spark, sf):
    """Status of every alert and the moment it went to a case."""
    return lifecycle(spark, sf)[0].select("account_id", "detector", "raised_us", "status", "filed_us")


@query("action_outcomes")
def action_outcomes(spark, sf):
    """What became of every action: accepted or why not, whether it overrode a hold or the model, what is logged."""
    return lifecycle(spark, sf)[1].drop("seq")


@query("account_restrictions")
def account_restrictions(spark, sf):
    """Restriction in force, the alert it rests on, and the freeze of every alerted account."""
    return lifecycle(spark, sf)[2]


@query("router_levels")
def router(spark, sf):
    return A.route(stored_alerts(spark, sf)).select("account_id", "level", "action")


@query("router_levels_after_actions")
def router_after(spark, sf):
    st = P.apply_actions(stored_alerts(spark, sf), actions(spark, sf)).select("detector", "account_id", "status")
    x = stored_alerts(spark, sf).drop("status").join(st, ["detector", "account_id"])
    return A.route(x).select("account_id", "level", "action")


@query("lead_seconds")
def lead(spark, sf):
    return A.lead_seconds(stored_alerts(spark, sf), V.payments(spark, sf)).select("detector", "account_id", F.round("lead_seconds", 6).alias("lead_seconds"))


@query("alert_ids")
def alert_ids(spark, sf):
    return A.numbered(stored_alerts(spark, sf)).select("alert_id", "detector", "account_id", "created_us")


@query("alert_order")
def alert_order(spark, sf):
    return stored_alerts(spark, sf).select("detector", "account_id", "severity", "score", "updated_us").orderBy(F.expr(A.SEV_RANK).desc(), F.col("score").desc(), F.col("updated_us").desc())


@query("alert_explanations")
def explain(spark, sf):
    """Reason text and fact list of every alert, from the aggregates of its last firing (or of its evidence)."""
    a = stored_alerts(spark, sf)
    hours = F.concat((F.col("w_us") / HOUR).cast("int").cast("string"), F.lit(" h"))
    money = F.format_string("%.2f", F.col("total_p") / 100)
    out = F.format_string("%.2f", F.col("out_p") / 100)
    text = (
        F.when(F.col("detector").isin("inflow_new_payers", "fan_in_new_payers"), F.concat(F.col("people").cast("string"), F.lit(" new payers sent "), money, F.lit(" within "), hours))
        .when(F.col("detector") == "structuring", F.concat(F.col("hits").cast("string"), F.lit(" transfers near the cap from "), F.col("people").cast("string"), F.lit(" payers, "), money))
        .when(F.col("detector") == "hop_from_flagged", F.concat(F.col("people").cast("string"), F.lit(" accounts under alert sent "), money, F.lit(" in "), F.col("hits").cast("string"), F.lit(" transfers")))
        .when(F.col("detector") == "model_only", F.concat(F.lit("model score of "), F.floor(F.col("gnn_max") * 100).cast("string"), F.lit("% or more on "), F.col("hits").cast("string"), F.lit(" transfers, "), money))
        .otherwise(F.concat(F.lit("received "), money, F.lit(", sent "), out, F.lit(" to "), F.col("people").cast("string"), F.lit(" accounts within "), hours)))
    facts = F.array(F.struct(F.lit("people").alias("label"), F.col("people").cast("string").alias("value")), F.struct(F.lit("total").alias("label"), money.alias("value")), F.struct(F.lit("transfers").alias("label"), F.col("hits").cast("string").alias("value")))
    return a.select("detector", "account_id", text.alias("reason"), F.array_join(F.transform(facts, lambda f: F.concat(f.label, F.lit("="), f.value)), "; ").alias("facts"))


@query("turnaround_first_in_first_out")
def turnaround(spark, sf):
    """First inflow to the first outflow at or after it, per account."""
    x = P.legs(V.payments(spark, sf))
    first = x.where("dir = 'in'").groupBy("account_id").agg(F.min("t_us").alias("first_in"))
    o = x.where("dir = 'out'").select("account_id", "t_us").join(first, "account_id").where("t_us >= first_in")
    return o.groupBy("account_id").agg(F.round((F.min("t_us") - F.min("first_in")) / 1e6, 6).alias("seconds"))


@query("recent_payments")
def recent(spark, sf):
    return V.payments(spark, sf).orderBy(F.col("t_us").desc(), F.col("row").desc()).limit(60).select("row", "from_id", "to_id", "amount", "channel")


@query("downstream_transfers")
def downstream(spark, sf):
    """The first 20 outgoing transfers of every account."""
    x = P.top_k(V.payments(spark, sf), ["from_id"], [F.col("t_us"), F.col("row")], 20)
    return x.select(F.col("from_id").alias("account_id"), "rk", "to_vpa", "to_state", "amount", "layer")


@query("chain_legs")
def chain_legs(spark, sf):
    """First 12 payments in or out of every alerted account."""
    al = stored_alerts(spark, sf).select("account_id").distinct()
    x = P.legs(V.payments(spark, sf)).join(al, "account_id", "left_semi")
    return P.top_k(x, ["account_id"], [F.col("t_us"), F.col("row"), F.col("dir")], 12).select("account_id", "rk", "row", "dir")


@query("chain_request_nodes")
def chain_nodes(spark, sf):
    """Chain legs as scoring requests: one node per resolved account, unknown handles as ext:<vpa>; numbered per chain."""
    al = stored_alerts(spark, sf).where(LIVE).select("account_id").distinct()
    x = P.legs(V.payments(spark, sf)).join(al, "account_id", "left_semi")
    legs = P.top_k(x, ["account_id"], [F.col("t_us"), F.col("row"), F.col("dir")], 12).withColumn("vpa", F.when(F.col("row") % 5 == 0, F.concat(F.lit("new"), F.col("other_vpa"))).otherwise(F.col("other_vpa")))
    named = legs.join(P.first_seen_vpas(V.payments(spark, sf)).withColumnRenamed("account_id", "known"), "vpa", "left").withColumn("node", F.coalesce("known", F.concat(F.lit("ext:"), "vpa")))
    first = named.groupBy(F.col("account_id").alias("chain"), "node").agg(F.min("rk").alias("pos"))
    return first.withColumn("node_no", F.row_number().over(Window.partitionBy("chain").orderBy("pos"))).drop("pos")  # a chain has at most 12 legs


@query("sample_feed")
def sample_feed(spark, sf):
    """First 30 fraud rows and a seeded pick of 30 clean ones (a sampling operator)."""
    p = V.payments(spark, sf).select("row", "is_fraud", "from_id", "to_id", "score")
    fraud = p.where("is_fraud = 1").orderBy("row").limit(30)
    clean = p.where("is_fraud = 0").orderBy(F.md5(F.concat(F.lit("7|"), F.col("row").cast("string")))).limit(30)
    return fraud.unionByName(clean).withColumn("band", S.score_band(F.col("score")))


@query("onboarding_second_hop")
def second_hop(spark, sf):
    """Second-hop sets: neighbours of neighbours among accounts under a live alert, minus direct ones and self."""
    return onboarding(spark, sf).select("account_id", "direct", "second_hop")


@query("peer_busiest_day_p95")
def peer(spark, sf):
    p = V.payments(spark, sf).where((F.col("channel") == "P2P") & in_split("train"))
    d = p.groupBy("to_id", S.epoch_day(F.col("t_us")).alias("day")).agg(F.sum("amount_p").alias("p")).groupBy("to_id").agg(F.max("p").alias("busiest_p"))
    k = V.accounts(spark, sf).select(F.col("account_id").alias("to_id"), "kind")
    x = d.join(k, "to_id").withColumn("busiest", F.col("busiest_p") / 100)
    return percentiles(x, "busiest", {"p95": 0.95}, ["kind"]).select("kind", F.round("p95", 4).alias("p95"))


def _fan_in_days(spark, sf):
    p = V.payments(spark, sf).where((F.col("channel") == "P2P") & in_split("train"))
    k = V.accounts(spark, sf).where("kind = 'individual'").select(F.col("account_id").alias("to_id"))
    x = p.join(k, "to_id", "left_semi").withColumn("day", S.day_of(F.col("t_us"), V.BASE_US))
    active = x.select("to_id", "day").distinct()
    first = x.groupBy("from_id", "to_id").agg(F.min("day").alias("day")).where("day >= 3").groupBy("to_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return active.join(first, ["to_id", "day"], "left").select("to_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("fan_in_histogram")
def fan_in_hist(spark, sf):
    return _fan_in_days(spark, sf).groupBy("n").agg(F.count(F.lit(1)).alias("account_days"))


@query("fan_in_p999")
def fan_in_p(spark, sf):
    return percentiles(_fan_in_days(spark, sf), "n", {"p999": 0.999}).select(F.round("p999", 6).alias("p999"))


@query("day_split_60_20_20")
def day_split(spark, sf):
    """The day boundaries (i, j) whose three parts are closest to 60/20/20 (largest relative error is smallest)."""
    d = V.payments(spark, sf).groupBy(S.day_of(F.col("t_us"), V.BASE_US).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_fraud").cast("bigint")).alias("f"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    c = d.select("day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")).crossJoin(d.agg(F.sum("n").alias("total")))
    a, b = c.select(F.col("day").alias("i"), F.col("before").alias("bi"), "total"), c.select(F.col("day").alias("j"), F.col("before").alias("bj"))
    x = a.join(b, F.col("i") < F.col("j"))  # days x days
    def err(part, want):
        return F.abs(part / F.col("total") - want) / want
    e = F.greatest(err(F.col("bi"), 0.6), err(F.col("bj") - F.col("bi"), 0.2), err(F.col("total") - F.col("bj"), 0.2))
    return x.withColumn("error", F.round(e, 9)).orderBy("error", "i", "j").limit(1).select("i", "j", "error")


@query("daily_illicit_ratio")
def illicit(spark, sf):
    g = V.payments(spark, sf).groupBy(S.day_of(F.col("t_us"), V.BASE_US).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_fraud").cast("bigint")).alias("illicit"))
    return g.withColumn("ratio", F.round(F.col("illicit") / F.col("n"), 9))


@query("stratified_split")
def stratified(spark, sf):
    """60/20/20 per label in a seeded hash order: deterministic, and numbered without one big sort."""
    p = V.payments(spark, sf).select("row", "is_fraud", F.md5(F.concat(F.lit("42|"), F.col("row").cast("string"))).alias("h"))
    total = p.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("total"))
    b = p.withColumn("b", F.substring("h", 1, 2))
    per = b.groupBy("is_fraud", "b").agg(F.count(F.lit(1)).alias("c"))
    off = per.select("is_fraud", "b", F.coalesce(F.sum("c").over(Window.partitionBy("is_fraud").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))  # 256 buckets
    x = b.withColumn("rn", F.row_number().over(Window.partitionBy("is_fraud", "b").orderBy("h"))).join(off, ["is_fraud", "b"]).join(total, "is_fraud").withColumn("k", F.col("off") + F.col("rn"))
    part = F.when(F.col("k") * 10 <= F.col("total") * 6, "train").when(F.col("k") * 10 <= F.col("total") * 8, "val").otherwise("test")
    return x.select("row", part.alias("part"))


@query("score_comparison")
def compare(spark, sf):
    """Two scores of the same rows: exact against one rounded to two decimals (stands in for a cached score)."""
    x = V.payments(spark, sf).select(F.col("score").alias("a"), (F.floor(F.col("score") * 100 + 0.5) / 100).alias("b")).withColumn("d", F.abs(F.col("a") - F.col("b")))
    g = x.agg(F.round(F.max("d"), 6).alias("max_diff"), F.round(F.avg("d"), 6).alias("mean_diff"), F.sum(((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).cast("bigint")).alias("flips"))
    return g.crossJoin(percentiles(x, "d", {"p99": 0.99}).select(F.round("p99", 6).alias("p99_diff")))  # one row each


def decision_rows(spark, sf):
    ev = _stored_evidence(spark, sf)
    a = actions(spark, sf).where("note <> ''").select("detector", "account_id", F.col("action").alias("decision"), "at_us", "run_id", F.concat("detector", F.lit("|"), "account_id").alias("tie"))
    return ev.join(a, ["detector", "account_id"])


_EV: dict[tuple, DataFrame] = {}


def _stored_evidence(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EV:
        _EV[key] = cut(evidence(spark, sf))
    return _EV[key]


@query("feedback_labels")
def feedback(spark, sf):
    return P.feedback_labels(decision_rows(spark, sf))


@query("feedback_report")
def feedback_report(spark, sf):
    lab = P.feedback_labels(decision_rows(spark, sf))
    x = lab.join(V.payments(spark, sf).select("row", "is_fraud"), "row")
    g = x.agg(F.count(F.lit(1)).alias("labelled"), F.sum((F.col("label") == 1).cast("bigint")).alias("fraud_labels"), F.sum((F.col("label") == F.col("is_fraud")).cast("bigint")).alias("agree"), F.sum((F.col("label") != F.col("is_fraud")).cast("bigint")).alias("would_flip"))
    roles = V.accounts(spark, sf).select("account_id", "role")
    d = actions(spark, sf).where("note <> ''").join(roles, "account_id", "left")
    mule = A.is_mule(F.col("role"))
    c = d.agg(F.count_distinct("run_id").alias("runs"), F.count(F.when(F.col("action") == "freeze", 1)).alias("freezes"), F.count(F.when((F.col("action") == "freeze") & mule, 1)).alias("freezes_on_mules"),
              F.count(F.when(F.col("action") == "clear", 1)).alias("clears"), F.count(F.when((F.col("action") == "clear") & mule, 1)).alias("clears_on_mules"))
    return g.crossJoin(c)  # one row each


@query("relabelled_edges")
def relabelled(spark, sf):
    lab = P.feedback_labels(decision_rows(spark, sf))
    return V.payments(spark, sf).select("row", "is_fraud").join(lab, "row", "left").select("row", F.coalesce("label", "is_fraud").alias("label"), (F.coalesce("label", "is_fraud") != F.col("is_fraud")).alias("changed"))


@query("decisions_by_detector")
def by_detector(spark, sf):
    return actions(spark, sf).where("note <> ''").groupBy("detector").pivot("action", ["clear", "escalate", "freeze"]).count().na.fill(0)


@query("prior_decisions")
def prior(spark, sf):
    """Latest 20 decisions per account from other runs than the current one."""
    d = actions(spark, sf).where("note <> '' AND run_id <> 'run-0'")
    return P.top_k(d, ["account_id"], [F.col("at_us").desc(), F.col("detector")], 20).select("account_id", "detector", "action", "run_id", "at_us", "rk")


@query("store_counts")
def counts(spark, sf):
    """Rows per table and per decision kind in one list."""
    al, ac = stored_alerts(spark, sf), actions(spark, sf)
    x = al.groupBy(F.concat(F.lit("alerts."), "status").alias("what")).count().union(ac.groupBy(F.concat(F.lit("decisions."), "action")).count()).union(
        V.payments(spark, sf).groupBy(F.concat(F.lit("payments."), "channel")).count())
    return x.select("what", F.col("count").alias("n"))


@query("throughput_per_second")
def throughput(spark, sf):
    """Tumbling windows (10 minutes here): payments per window."""
    p = V.payments(spark, sf).select(F.timestamp_micros("t_us").alias("ts"))
    return p.groupBy(F.window("ts", "10 minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("start_us"), "n")


@query("duplicates_dropped")
def dedupe(spark, sf):
    """First arrival per transaction id wins; a tenth of the payments is sent twice."""
    p = V.payments(spark, sf).select("txn_id", "t_us", "row")
    sent = p.union(p.where("row % 10 = 0").select("txn_id", F.col("t_us") + 1000, "row"))
    first = sent.groupBy("txn_id").agg(F.min("t_us").alias("t_us"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return first.select("txn_id", "t_us", "dropped")
