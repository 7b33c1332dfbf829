"""From firings to alerts: evidence, scores, the hop and model-only detectors, the router, alert order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alert_score, score_level
from ..params import DAY, DETECTORS, HOUR, MULE_ROLES, PRIMARY, R20, SPLIT, Rules, Split
from ..session import cut
from .detectors import baselines, daily_totals, firings, measure_hot, window_sums, with_pair_history
from .running import global_index, running, with_segment

Hot = tuple[DataFrame | None, DataFrame | None]

SEV_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
SEV_NAME = "CASE {} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
#: What the primary stage reads of a payment, and the most hits one can be.
PAIRED = ("row", "t_us", "from_id", "to_id", "amount_p", "channel", "score", "near")
HITS_A_PAYMENT = 5
ALERT_COLUMNS = (
    "detector", "account_id", "created_us", "created_row", "updated_us", "updated_row", "severity", "score", "gnn_max", "evidence_rows",
    "first_evidence_us", "total_p", "people", "hits", "w_us", "bar_p", "out_p", "status",
)


def hits_of(paired: DataFrame, detectors: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Which payments count for which detector on which account (before any window is applied)."""
    def one(det: str, account: str, cond: str) -> str:
        return f"IF({cond}, named_struct('detector', '{det}', 'account_id', {account}), NULL)"

    new, near = "new_payee AND channel = 'P2P'", "near AND channel = 'P2P'"
    parts = {
        "inflow_new_payers": [one("inflow_new_payers", "to_id", new)],
        "structuring": [one("structuring", "to_id", near)],
        "fan_in_new_payers": [one("fan_in_new_payers", "to_id", new)],
        "pass_through": [one("pass_through", "to_id", "true"), one("pass_through", "from_id", "from_id <> to_id")],
    }
    arr = ", ".join(x for d in detectors for x in parts[d])
    return paired.selectExpr("row", "t_us", "score", f"inline_outer(array({arr}))").where("detector IS NOT NULL")


def judged(paired: DataFrame, fires: DataFrame, rules: Rules = R20, hot: DataFrame | None = None, split: Split = SPLIT, rows: int | None = None) -> DataFrame:
    """Hits and firings of the alerted accounts in one ordered stream. `rows`: how many hits and firings there are at most.

    A hit is evidence when some firing's window covers it: windows open at their start (+1) and close at the firing (-1).
    The highest model score inside a window is read from "last time a hit scored level k or more", one running maximum
    per level, so no firing is ever joined to its hits.
    """
    alerted = fires.select("detector", "account_id").distinct()
    hits = hits_of(paired).join(alerted, ["detector", "account_id"], "left_semi")
    z = "CAST(NULL AS BIGINT)"
    facts = ("w_us", "severity", "base_score", "total_p", "people", "hits", "bar_p", "out_p")
    # a firing's facts travel as one column, which hits and starts leave empty
    given = F.struct(*facts).alias("f")
    none = F.lit(None).cast("struct<w_us: bigint, severity: string, base_score: int, total_p: bigint, people: bigint, hits: bigint, bar_p: bigint, out_p: bigint>").alias("f")
    h = hits.selectExpr("detector", "account_id", "t_us", "1 AS o1", "row", "0 AS o2", "score", "0 AS d").select("*", none)
    start = fires.selectExpr("detector", "account_id", "t_us - w_us AS t_us", "0 AS o1", f"{z} AS row", "0 AS o2", "CAST(NULL AS DOUBLE) AS score", "1 AS d").select("*", none)
    end = fires.select("detector", "account_id", "t_us", F.lit(1).alias("o1"), "row", F.lit(1).alias("o2"), F.lit(None).cast("double").alias("score"), F.lit(-1).alias("d"), given)
    ev = h.unionByName(start).unionByName(end)
    ev = with_segment(ev, ["account_id"], hot, split=split)
    level = score_level(F.col("score"))
    maxes: dict[str, Column] = {f"last_{k}": F.when(level >= k, F.col("t_us")) for k in range(1, 11)}
    maxes["last_model"] = F.when(F.col("score") >= rules.model_threshold, F.col("t_us"))
    out = running(ev, ["detector", "account_id"], ["t_us", "o1", "row", "o2"], sums={"cover": F.col("d")}, maxes=maxes, rows=rows)
    lo = F.col("t_us") - F.col("f.w_us")
    reached = sum((F.when(F.col(f"last_{k}") >= lo, 1).otherwise(0) for k in range(2, 11)), F.when(F.col("last_1") >= lo, 1).otherwise(0))
    return out.select(
        "detector", "account_id", "t_us", "row", "score", *[F.col(f"f.{c}").alias(c) for c in facts],
        ((F.col("o1") == 1) & (F.col("o2") == 0) & (F.col("cover") > 0)).alias("is_evidence"),
        ((F.col("o1") == 1) & (F.col("o2") == 1)).alias("is_firing"),
        F.when(F.col("o2") == 1, alert_score(F.col("f.base_score"), reached)).alias("firing_score"),
        F.coalesce(F.col("last_model") >= lo, F.lit(False)).alias("model_agrees"),
    )


def primary_alerts(j: DataFrame) -> DataFrame:
    """One alert per (detector, account): first firing creates it; severity and score only rise; last firing gives the facts."""
    fired = F.col("is_firing")
    pos = F.struct("t_us", "row")
    last = F.struct("t_us", "row", "total_p", "people", "hits", "w_us", "bar_p", "out_p")
    g = j.where("is_firing OR is_evidence").groupBy("detector", "account_id").agg(
        F.min(F.when(fired, pos)).alias("created"),
        F.max(F.when(fired, last)).alias("last"),
        F.max(F.when(fired, F.expr(SEV_RANK))).alias("sev"),
        F.max("firing_score").alias("score"),
        F.max(F.when(F.col("is_evidence"), F.col("score"))).alias("gnn_max"),
        F.count(F.when(F.col("is_evidence"), 1)).alias("evidence_rows"),
        F.min(F.when(F.col("is_evidence"), F.col("t_us"))).alias("first_evidence_us"),
    )
    return g.select(
        "detector", "account_id", F.col("created.t_us").alias("created_us"), F.col("created.row").alias("created_row"),
        F.col("last.t_us").alias("updated_us"), F.col("last.row").alias("updated_row"), F.expr(SEV_NAME.format("sev")).alias("severity"), "score", "gnn_max",
        "evidence_rows", "first_evidence_us", "last.total_p", "last.people", "last.hits", "last.w_us", "last.bar_p", "last.out_p", F.lit("open").alias("status"),
    )


def hop_hits(payments: DataFrame, primary: DataFrame) -> DataFrame:
    """Payments from a sender that a primary rule flags, with the moment from which each counts.

    A payment counts once its sender has an alert created no earlier than a day before the payment, so an alert raised later
    turns old payments into hits. At most one alert per detector exists, so the array per sender has at most four entries.
    """
    flags = primary.where(F.col("detector").isin(*PRIMARY)).groupBy(F.col("account_id").alias("from_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("created_us").alias("t"), F.col("created_row").alias("r")))).alias("flags")
    )
    own = "named_struct('t', t_us, 'r', row)"
    x = payments.join(flags, "from_id").selectExpr(
        "row", "t_us", "from_id", "to_id", "amount_p", "score",
        f"array_min(transform(filter(flags, a -> a.t >= t_us - {DAY}L), a -> greatest(a, {own}))) AS act",
    )
    return x.where("act IS NOT NULL").selectExpr("*", "act.t AS act_us", "act.r AS act_row", "act.t = t_us AND act.r = row AS is_trigger")


def hop_alerts(payments: DataFrame, accounts: DataFrame, primary: DataFrame, rules: Rules = R20, split: Split = SPLIT, measured: Hot | None = None, rows: int | None = None) -> DataFrame:
    accounts_hot, pairs_hot = measured if measured is not None else measure_hot(payments, split)
    hits = hop_hits(payments, primary)
    order = ["act_us", "act_row", "t_us", "row"]
    pair = with_segment(hits, ["to_id", "from_id"], pairs_hot, "act_us", split)
    first = running(pair, ["to_id", "from_id"], order, maxes={"prev": F.col("act_us")}, include_current=False, rows=rows)
    first = first.select(*hits.columns, F.col("prev").isNull().cast("int").alias("new_sender"))
    hot = None if accounts_hot is None else accounts_hot.withColumnRenamed("account_id", "to_id")
    seg = with_segment(first, ["to_id"], hot, "act_us", split)
    run = running(
        seg, ["to_id"], order,
        sums={"total_p": F.col("amount_p"), "senders": F.col("new_sender"), "n": F.lit(1)},
        maxes={"top": F.col("score"), "neg_first": -F.col("t_us")}, rows=rows,
    ).where("is_trigger")
    if rules.version == "r2.2":
        run = run.join(_hop_share(payments, hits, accounts, rules, hot, split), ["to_id", "row"], "left_semi")
    last = F.struct("t_us", "row", "total_p", "senders", "n", "top", "neg_first")
    g = run.groupBy("to_id").agg(F.min(F.struct("t_us", "row")).alias("created"), F.max(last).alias("last"))
    return g.select(
        F.lit("hop_from_flagged").alias("detector"), F.col("to_id").alias("account_id"), F.col("created.t_us").alias("created_us"),
        F.col("created.row").alias("created_row"), F.col("last.t_us").alias("updated_us"), F.col("last.row").alias("updated_row"),
        F.when(F.col("last.total_p") >= rules.hop_high_p, "high").otherwise("medium").alias("severity"),
        alert_score(62 + 4 * F.col("last.senders"), score_level(F.col("last.top"))).alias("score"),
        F.col("last.top").alias("gnn_max"), F.col("last.n").alias("evidence_rows"), (-F.col("last.neg_first")).alias("first_evidence_us"),
        F.col("last.total_p").alias("total_p"), F.col("last.senders").cast("bigint").alias("people"), F.col("last.n").alias("hits"),
        F.lit(None).cast("bigint").alias("w_us"), F.lit(0).cast("bigint").alias("bar_p"), F.lit(0).cast("bigint").alias("out_p"), F.lit("open").alias("status"),
    )


def _hop_share(payments: DataFrame, hits: DataFrame, accounts: DataFrame, rules: Rules, hot: DataFrame | None, split: Split) -> DataFrame:
    """Triggers at which flagged money of the last day is large enough and at least the set share of all inflow (individuals only)."""
    receivers = hits.select("to_id").distinct()
    inbound = payments.select("row", "t_us", "to_id", "amount_p").join(receivers, "to_id", "left_semi")
    cols = ("to_id", "t_us", "o1", "row", "o2", "d_all", "d_flag", "is_trigger")
    ev = inbound.selectExpr(
        f"inline(array(named_struct('to_id', to_id, 't_us', t_us, 'o1', 0, 'row', row, 'o2', 0, 'd_all', amount_p, 'd_flag', 0L, 'is_trigger', false), "
        f"named_struct('to_id', to_id, 't_us', t_us + {DAY}L, 'o1', 1, 'row', row, 'o2', 0, 'd_all', -amount_p, 'd_flag', 0L, 'is_trigger', false)))"
    )
    fl = hits.where(f"act_us <= t_us + {DAY}L").selectExpr(
        f"inline(array(named_struct('to_id', to_id, 't_us', act_us, 'o1', 0, 'row', act_row, 'o2', 1, 'd_all', 0L, 'd_flag', amount_p, 'is_trigger', false), "
        f"named_struct('to_id', to_id, 't_us', t_us + {DAY}L, 'o1', 1, 'row', row, 'o2', 0, 'd_all', 0L, 'd_flag', -amount_p, 'is_trigger', false)))"
    )
    tr = hits.where("is_trigger").selectExpr("to_id", "t_us", "0 AS o1", "row", "2 AS o2", "0L AS d_all", "0L AS d_flag", "true AS is_trigger")
    seg = with_segment(ev.select(*cols).unionByName(fl.select(*cols)).unionByName(tr.select(*cols)), ["to_id"], hot, split=split)
    run = running(seg, ["to_id"], ["t_us", "o1", "row", "o2"], sums={"all_24": F.col("d_all"), "flag_24": F.col("d_flag")}).where("is_trigger")
    kinds = accounts.select(F.col("account_id").alias("to_id"), "kind")
    return run.join(kinds, "to_id", "left").where(
        f"coalesce(kind, 'individual') = 'individual' AND flag_24 >= {rules.hop_min_p} AND all_24 > 0 AND flag_24 >= {rules.hop_share}D * all_24"
    ).select("to_id", "row")


def model_only_alerts(payments: DataFrame, rule_alerts: DataFrame, rules: Rules = R20) -> DataFrame:
    """High-scored inflow on accounts on which no rule has fired yet; superseded once one does."""
    first_rule = rule_alerts.groupBy("account_id").agg(F.min(F.struct(F.col("created_us").alias("t"), F.col("created_row").alias("r"))).alias("first_rule"))
    x = payments.where(F.col("score") >= rules.model_threshold).select(F.col("to_id").alias("account_id"), "row", "t_us", "score", "amount_p", "from_id")
    x = x.join(first_rule, "account_id", "left").where("first_rule IS NULL OR named_struct('t', t_us, 'r', row) < first_rule")
    g = x.groupBy("account_id").agg(
        F.min(F.struct("t_us", "row")).alias("c"), F.max(F.struct("t_us", "row")).alias("u"), F.max("score").alias("gnn_max"), F.count(F.lit(1)).alias("n"),
        F.sum("amount_p").alias("total_p"), F.max(F.col("first_rule").isNotNull()).alias("ruled"),
    )
    return g.select(
        F.lit("model_only").alias("detector"), "account_id", F.col("c.t_us").alias("created_us"), F.col("c.row").alias("created_row"),
        F.col("u.t_us").alias("updated_us"), F.col("u.row").alias("updated_row"), F.lit("medium").alias("severity"),
        alert_score(F.lit(45), score_level(F.col("gnn_max"))).alias("score"), "gnn_max", F.col("n").alias("evidence_rows"), F.col("c.t_us").alias("first_evidence_us"),
        "total_p", F.lit(0).cast("bigint").alias("people"), F.col("n").alias("hits"), F.lit(None).cast("bigint").alias("w_us"),
        F.lit(0).cast("bigint").alias("bar_p"), F.lit(0).cast("bigint").alias("out_p"), F.when(F.col("ruled"), "superseded").otherwise("open").alias("status"),
    )


def primary_stage(payments: DataFrame, accounts: DataFrame, rules: Rules, split: Split) -> tuple[DataFrame, DataFrame, Hot]:
    """(judged stream, primary alerts, hot keys). Firings and alerts are far smaller than the payments and are read several times,
    so both are written once instead of being derived again by every reader."""
    hot, pairs = measure_hot(payments, split)
    rows = payments.count()
    paired = cut(with_pair_history(payments.select(*PAIRED), split, pairs, measured=True, rows=rows))
    fires = cut(firings(window_sums(paired, hot, split, rows=rows), baselines(daily_totals(payments), rules), accounts, rules))
    j = judged(paired, fires, rules, hot, split, HITS_A_PAYMENT * rows + 2 * fires.count())
    return j, cut(primary_alerts(j).select(*ALERT_COLUMNS)), (hot, pairs)


def primary_rules(rules: Rules) -> Rules:
    """The same rules as far as the primary stage reads them: versions that share it get equal ones."""
    return replace(rules, version="r2.1" if rules.relative_floor else "r2.0", hop_rule=True)


def alert_table(payments: DataFrame, accounts: DataFrame, rules: Rules = R20, split: Split = SPLIT, primary: tuple[DataFrame, Hot] | None = None) -> DataFrame:
    """All alerts of an alert-only replay. `primary`: the primary alerts and hot keys of the same `primary_rules`, if they are at hand."""
    found, hot = primary or primary_stage(payments, accounts, rules, split)[1:]
    ruled = found
    if rules.hop_rule:
        ruled = cut(found.unionByName(hop_alerts(payments, accounts, found, rules, split, hot, payments.count()).select(*ALERT_COLUMNS)))
    return ruled.unionByName(model_only_alerts(payments, ruled, rules).select(*ALERT_COLUMNS))


def evidence_table(payments: DataFrame, accounts: DataFrame, rules: Rules = R20, split: Split = SPLIT) -> DataFrame:
    """(detector, account, row): every payment an alert rests on."""
    j, primary, hot = primary_stage(payments, accounts, rules, split)
    hop = cut(hop_alerts(payments, accounts, primary, rules, split, hot, payments.count()).select(*ALERT_COLUMNS))
    hits = hop_hits(payments, primary).join(hop.selectExpr("account_id AS to_id", "updated_us", "updated_row"), "to_id")
    hop_rows = hits.where("named_struct('a', act_us, 'b', act_row) <= named_struct('a', updated_us, 'b', updated_row)")
    ruled = primary.unionByName(hop)
    model = model_only_alerts(payments, ruled, rules).selectExpr("account_id AS to_id", "updated_us", "updated_row")
    model_rows = payments.where(F.col("score") >= rules.model_threshold).join(model, "to_id").where(
        "named_struct('a', t_us, 'b', row) <= named_struct('a', updated_us, 'b', updated_row)"
    )
    return (
        j.where("is_evidence").select("detector", "account_id", "row")
        .unionByName(hop_rows.select(F.lit("hop_from_flagged").alias("detector"), F.col("to_id").alias("account_id"), "row"))
        .unionByName(model_rows.select(F.lit("model_only").alias("detector"), F.col("to_id").alias("account_id"), "row"))
    )


def detector_order() -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DETECTORS]), F.col("detector"))


def numbered(alerts: DataFrame) -> DataFrame:
    """Alert ids in creation order; within one payment in check order."""
    n = global_index(alerts, ["created_us", "created_row", detector_order()], F.floor(F.col("created_us") / HOUR), "alert_no")
    return n.withColumn("alert_id", F.concat(F.lit("ALR-"), F.lpad(F.col("alert_no").cast("string"), 9, "0")))


def route(alerts: DataFrame, rules: Rules = R20) -> DataFrame:
    """Decision level per account from its live alerts (not cleared, not superseded); one step down after a clear."""
    live = F.col("status").isin("cleared", "superseded") == F.lit(False)
    rule = live & (F.col("detector") != "model_only")
    g = alerts.groupBy("account_id").agg(
        F.max(F.when(rule, F.expr(SEV_RANK))).alias("sev"),
        F.count_distinct(F.when(rule, F.col("detector"))).alias("detectors"),
        F.coalesce(F.max(F.when(live, F.col("gnn_max"))), F.lit(0.0)).alias("gnn_max"),
        F.max(F.col("status") == "cleared").alias("cleared_before"),
    )
    model = F.col("gnn_max") >= rules.model_threshold
    friction = F.lit(rules.friction) & (F.col("gnn_max") >= max(rules.friction_score, rules.model_threshold))
    level = (
        F.when(F.col("sev").isNull(), F.when(friction, 1).otherwise(0))
        .when(F.col("sev") <= 1, 0)
        .when(F.col("sev") == 2, F.when(model, 2).otherwise(1))
        .when(model & (F.col("detectors") >= 2), 3)
        .otherwise(2)
    )
    return g.withColumn("level", F.when((level > 0) & F.col("cleared_before"), level - 1).otherwise(level)).withColumn(
        "action", F.element_at(F.array(*[F.lit(x) for x in ("alert_only", "delay_settlement", "hold_outbound", "full_hold")]), F.col("level") + 1)
    )


def lead_seconds(alerts: DataFrame, payments: DataFrame) -> DataFrame:
    """Seconds from an inflow or structuring alert to the account's first later outgoing payment."""
    a = alerts.where(F.col("detector").isin("inflow_new_payers", "structuring")).select("detector", "account_id", "created_us", "created_row")
    later = F.expr("named_struct('a', t_us, 'b', row) > named_struct('a', created_us, 'b', created_row)")
    x = a.join(payments.select(F.col("from_id").alias("account_id"), "t_us", "row"), "account_id", "left")
    return x.groupBy("detector", "account_id", "created_us").agg(F.min(F.when(later, F.col("t_us"))).alias("t")).select(
        "detector", "account_id", ((F.col("t") - F.col("created_us")) / 1_000_000).alias("lead_seconds")
    )


def is_mule(role: Column) -> Column:
    return role.isin(*MULE_ROLES)
