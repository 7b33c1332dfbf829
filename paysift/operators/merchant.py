"""Merchant detectors D1-D4, settlement holds, batches, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAY, HOUR, P10, SPLIT, MerchantRules, Split
from ..session import cut, spread
from .metrics import percentiles
from .running import hot_keys, running, with_segment


def first_payments(pays: DataFrame, split: Split = SPLIT) -> DataFrame:
    """Adds `first`: the payer's first payment to this merchant (order: time, then the tie columns).

    Without hot merchants the result is dealt by merchant, so what follows per merchant needs no further shuffle.
    """
    keys = ["merchant_id", "payer_id"]
    hot = hot_merchants(pays, split)
    if hot is None:
        seg = spread(pays, pays.count(), "merchant_id")
    else:
        # only a hot merchant can have a hot payer
        seg = with_segment(pays, keys, hot_keys(pays.join(F.broadcast(hot), "merchant_id", "left_semi"), keys, split), split=split)
    h = running(seg, keys, ["t_us", "tie"], maxes={"prev_t": F.col("t_us")}, include_current=False)
    return h.select(*pays.columns, F.col("prev_t").isNull().alias("first"))


PLACE = ("times", "no", "lo", "hi", "top_amount")


def placed(firsts: DataFrame, merchants: DataFrame, bars: DataFrame, rules: MerchantRules = P10, hot: DataFrame | None = None, split: Split = SPLIT) -> DataFrame:
    """Adds each ticket's number within its merchant (`no`, in order of time and tie) and the window before it: tickets number
    `lo` + 1 to `hi` are its merchant's of the last `own_days` days. Rows of one tie share `lo`, `hi` and `top_amount`. A ticket
    that passes the bars of several rows of its merchant counts that many `times`.
    """
    span, m = rules.own_days * DAY, Window.partitionBy("merchant_id")
    bar = merchants.join(bars, "category", "left").groupBy("merchant_id").agg(F.collect_list(F.struct("cat_p99", "onboarded_us")).alias("_bars"))  # one, unless keys repeat
    of_tie = Window.partitionBy("merchant_id", "tie")
    passed = F.when(F.col("first"), F.expr(f"size(filter(_bars, b -> amount >= b.cat_p99 AND t_us - b.onboarded_us >= {rules.established_days * DAY}L))"))
    no = F.sum("times").over(m.orderBy("t_us", "tie").rowsBetween(Window.unboundedPreceding, 0))
    gone = F.coalesce(F.sum("times").over(m.orderBy("t_us").rangeBetween(Window.unboundedPreceding, -span - 1)), F.lit(0))

    def counted(df: DataFrame, of: DataFrame) -> DataFrame:
        x = df.join(of, "merchant_id", "left").withColumn("_passed", F.greatest(F.coalesce(passed, F.lit(0)), F.lit(0)).cast("bigint"))
        return x.select(*firsts.columns, F.greatest(F.sum("_passed").over(of_tie), F.lit(1)).alias("times"))

    def cold(df: DataFrame) -> DataFrame:
        x = counted(df, bar).withColumn("no", no).withColumn("lo", gone)
        return x.select(*firsts.columns, "times", "no", F.max("lo").over(of_tie).alias("lo"), (F.max("no").over(of_tie) - 1).alias("hi"), F.max("amount").over(of_tie).alias("top_amount"))

    if hot is None:
        return cold(firsts)
    few = F.broadcast(hot.select("merchant_id", F.lit(True).alias("_is_hot")))  # at most rows / hot_rows merchants
    marked = firsts.join(few, "merchant_id", "left").select(*firsts.columns, "_is_hot")
    h = counted(marked.where("_is_hot").drop("_is_hot"), F.broadcast(bar.join(few, "merchant_id", "left_semi"))).select(F.struct(*firsts.columns, "times").alias("x"))
    ev = h.select(F.inline(F.array(*[
        F.struct(F.col("x.merchant_id").alias("merchant_id"), (F.col("x.t_us") - shift).alias("t_us"), F.lit(o).alias("ord"), F.col("x.tie").alias("tie"), "x") for o, shift in ((0, span), (1, 0))])))
    r = cut(running(with_segment(ev, ["merchant_id"], hot, split=split), ["merchant_id"], ["t_us", "ord", "tie"], sums={"r": F.col("ord") * F.col("x.times")}))
    per = r.groupBy("merchant_id", "tie").agg(
        F.max(F.when(F.col("ord") == 0, F.col("r"))).alias("lo"), F.max(F.when(F.col("ord") == 1, F.col("r") - 1)).alias("hi"), F.max("x.amount").alias("top_amount"))
    rows = r.where("ord = 1").join(per, ["merchant_id", "tie"]).select(*[F.col(f"x.{c}").alias(c) for c in (*firsts.columns, "times")], F.col("r").alias("no"), "lo", "hi", "top_amount")
    return cold(marked.where("_is_hot IS NULL").drop("_is_hot")).unionByName(rows)


def category_p99(pays: DataFrame, merchants: DataFrame, start_us: int, rules: MerchantRules = P10) -> DataFrame:
    """Per category: p99 ticket of clean merchants on the train days."""
    clean = merchants.where("is_fraud = 0").select("merchant_id", "category")
    train = pays.where(F.col("t_us") < start_us + rules.train_days * DAY).join(clean, "merchant_id")
    return percentiles(train, "amount", {"cat_p99": 0.99}, ["category"])


_TOP_LEVEL = 6


def _rank_blocks(lo: str, hi: str) -> str:
    """The rank range [lo, hi) as whole blocks of 8^level ranks, the largest that fit, as an array of (level, block)."""
    pieces = f"""transform(sequence(0, {_TOP_LEVEL}), l -> named_struct('level', l, 'a', ceil({lo} / shiftleft(1L, 3 * l)), 'b', {hi} div shiftleft(1L, 3 * l),
      'pa', 8 * ceil({lo} / shiftleft(8L, 3 * l)), 'pb', 8 * ({hi} div shiftleft(8L, 3 * l))))"""
    none = "CAST(array() AS ARRAY<BIGINT>)"

    def span(x: str, y: str) -> str:
        return f"IF({x} < {y}, sequence({x}, {y} - 1), {none})"

    of_level = f"IF(p.level = {_TOP_LEVEL} OR p.pa >= p.pb, {span('p.a', 'p.b')}, concat({span('p.a', 'p.pa')}, {span('p.pb', 'p.b')}))"
    return f"flatten(transform({pieces}, p -> transform({of_level}, k -> named_struct('level', p.level, 'block', k))))"


def _own_tickets(tickets: DataFrame, asks: DataFrame, rules: MerchantRules, hot: DataFrame | None) -> DataFrame:
    """(merchant_id, tie, n, upto, below, over) of every ask: how many tickets its window holds, how many of them are at most its
    amount, and the values next to it on either side.

    A window is a range of the merchant's tickets in time order (see `placed`). It is the union of a few whole blocks of
    8^level tickets, and inside a block one sweep in order of amount answers all asks that use it. So the work is tickets x
    levels plus asks x levels: no ask meets its tickets one by one, and a block holds at most 8^6 tickets, however hot the
    merchant is. Without hot merchants a ticket moves once and its levels are made where its merchant is.
    """
    windows = asks.select("merchant_id", "tie", "lo", "hi", F.col("top_amount").alias("amount"), F.expr("hi - lo").alias("n")).distinct()
    windows = cut(windows.where(F.col("n") >= rules.own_min_tickets))
    levels = windows.groupBy("merchant_id").agg(F.least(F.lit(_TOP_LEVEL), F.floor(F.log2(F.max("n")) / 3)).cast("int").alias("top"))
    none = F.lit(None)
    no_tie = none.cast(windows.schema["tie"].dataType).alias("tie")
    # one row per ticket and per ask; a ticket's blocks are those of its number on every level its merchant's windows use
    line = tickets.select("merchant_id", "amount", F.col("amount").alias("ticket"), no_tie, (F.col("no") - F.col("times")).alias("lo"), (F.col("no") - 1).alias("last"), none.cast("bigint").alias("hi"))
    line = line.unionByName(windows.select("merchant_id", "amount", none.cast("double").alias("ticket"), "tie", "lo", none.cast("bigint").alias("last"), "hi"))
    line = (spread(line, tickets.count(), "merchant_id") if hot is None else line).join(levels, "merchant_id")
    blocks = F.expr(f"IF(hi IS NULL, flatten(transform(sequence(lo, last), k -> transform(sequence(0, top), l -> named_struct('level', l, 'block', k div shiftleft(1L, 3 * l))))), {_rank_blocks('lo', 'hi')})")
    line = line.select("merchant_id", "amount", "ticket", "tie", F.inline(blocks))
    # tickets come before asks of the same amount, so what precedes an ask is at most its amount and what follows is more
    sweep = Window.partitionBy("merchant_id", "level", "block").orderBy("amount", F.col("ticket").isNull())
    upto = sweep.rowsBetween(Window.unboundedPreceding, 0)
    seen = line.select("merchant_id", "tie", F.count("ticket").over(upto).alias("upto"), F.max("ticket").over(upto).alias("below"),
                       F.expr("lead(ticket) IGNORE NULLS OVER (PARTITION BY merchant_id, level, block ORDER BY amount, ticket IS NULL)").alias("over"))
    found = seen.where("tie IS NOT NULL").groupBy("merchant_id", "tie").agg(F.sum("upto").alias("upto"), F.max("below").alias("below"), F.min("over").alias("over"))
    return windows.select("merchant_id", "tie", "n").join(found, ["merchant_id", "tie"])


def above_bar(firsts: DataFrame, merchants: DataFrame, bars: DataFrame, rules: MerchantRules = P10, hot: DataFrame | None = None, split: Split = SPLIT) -> DataFrame:
    """First-time payments at or above the merchant's bar: the category p99, raised to the merchant's own recent p99.

    Only payments that already pass the category bar ask for the merchant's own tickets (see `_own_tickets`). `tie` names a
    payment within its merchant. `firsts` may carry what `placed` adds.
    """
    tickets = firsts if set(PLACE) <= set(firsts.columns) else cut(placed(firsts, merchants, bars, rules, hot, split))
    m = cut(merchants.select("merchant_id", "category", "onboarded_us").join(bars, "category", "left"))  # of known size: tickets move only if it is large
    c = cut(tickets.where("first").join(m, "merchant_id").where("cat_p99 IS NOT NULL AND amount >= cat_p99"))
    old = F.col("t_us") - F.col("onboarded_us") >= rules.established_days * DAY
    own = _own_tickets(tickets, c.where(old), rules, hot)
    k = (F.col("n") - 1) * 0.99
    lo = F.floor(k)
    at_gap = F.col("amount") >= F.col("below") + (F.col("over") - F.col("below")) * (k - lo)
    passes = F.when(F.col("n").isNull(), F.lit(True)).when(F.col("upto") >= lo + 2, True).when(F.col("upto") <= lo, False).otherwise(F.col("over").isNull() | at_gap)
    return c.join(own, ["merchant_id", "tie"], "left").where(passes).select(*firsts.columns)


def _in_out(df: DataFrame, t: str, extra: dict[str, str]) -> DataFrame:
    """Entry and 24 h exit events; `extra` columns carry a sign."""
    def ev(ord_: int, shift: int, sign: int) -> str:
        cols = ", ".join(f"'{n}', {sign} * ({e})" for n, e in extra.items())
        return f"named_struct('merchant_id', merchant_id, 't_us', {t} + {shift}L, 'ord', {ord_}, 'tie', tie, {cols})"
    return df.selectExpr(f"inline(array({ev(0, 0, 1)}, {ev(1, DAY, -1)}))")


def _first_time(df: DataFrame, cond: str, detector: str) -> DataFrame:
    return df.where(cond).groupBy("merchant_id").agg(F.min("t_us").alias("t_us")).withColumn("detector", F.lit(detector))


def hot_merchants(pays: DataFrame, split: Split = SPLIT) -> DataFrame | None:
    return hot_keys(pays, ["merchant_id"], split)


def d1_alerts(firsts: DataFrame, merchants: DataFrame, bars: DataFrame, rules: MerchantRules = P10, hot: DataFrame | None = None, split: Split = SPLIT) -> DataFrame:
    ev = _in_out(above_bar(firsts, merchants, bars, rules, hot, split), "t_us", {"d": "1"})
    r = running(with_segment(ev, ["merchant_id"], hot, split=split), ["merchant_id"], ["t_us", "ord", "tie"], sums={"n": F.col("d")})
    return _first_time(r, f"ord = 0 AND n >= {rules.d1_count}", "D1")


def d2_alerts(firsts: DataFrame, merchants: DataFrame, rules: MerchantRules = P10, hot: DataFrame | None = None, split: Split = SPLIT) -> DataFrame:
    """Distinct other states of first-time payers in 24 h: a state that is already inside enters with 0, and the exit of its
    earlier payment is undone."""
    local = merchants.where(F.col("category").isin(*rules.local)).select("merchant_id", F.col("state").alias("m_state"))
    f = firsts.where("first").join(local, "merchant_id").where("payer_state <> m_state").select("merchant_id", "payer_state", "t_us", "tie")
    seg = f.repartition("merchant_id") if hot is None else with_segment(f, ["merchant_id"], hot, split=split)
    prev = running(seg, ["merchant_id", "payer_state"], ["t_us", "tie"], maxes={"prev_t": F.col("t_us")}, include_current=False)
    again = f"coalesce(prev_t >= t_us - {DAY}L, false)"
    def ev(t: str, ord_: int, d: str) -> str:
        return f"named_struct('t_us', {t}, 'ord', {ord_}, 'tie', tie, 'd', {d})"
    events = prev.select("merchant_id", F.expr(
        f"inline_outer(array({ev('t_us', 0, f'IF({again}, 0, 1)')}, {ev(f't_us + {DAY}L', 1, '-1')}, IF({again}, {ev(f'prev_t + {DAY}L', 1, '1')}, NULL)))"
    )).where("ord IS NOT NULL")
    r = running(with_segment(events, ["merchant_id"], hot, split=split), ["merchant_id"], ["t_us", "ord", "tie"], sums={"n": F.col("d")})
    return _first_time(r, f"ord = 0 AND n >= {rules.d2_states}", "D2")


def stranger_collects(collects: DataFrame, pays: DataFrame) -> DataFrame:
    """Collect requests to payers who had never paid this merchant before the request was resolved."""
    paid = pays.groupBy("merchant_id", "payer_id").agg(F.min("t_us").alias("first_us"))
    c = collects.where("known_payer = 0").join(paid, ["merchant_id", "payer_id"], "left")
    return c.where("first_us IS NULL OR first_us >= resolved_us").select(*collects.columns).withColumn("failed", (F.col("outcome") != "approved").cast("int"))


def d3_alerts(collects: DataFrame, pays: DataFrame, rules: MerchantRules = P10, hot: DataFrame | None = None, split: Split = SPLIT) -> DataFrame:
    c = stranger_collects(collects, pays).withColumn("tie", F.col("request_id"))
    ev = _in_out(c, "resolved_us", {"d": "1", "f": "failed"})
    r = running(with_segment(ev, ["merchant_id"], hot, split=split), ["merchant_id"], ["t_us", "ord", "tie"], sums={"n": F.col("d"), "fails": F.col("f")})
    return _first_time(r, f"ord = 0 AND n >= {rules.d3_requests} AND fails / n >= {rules.d3_fail_share}D", "D3")


def d4_alerts(merchants: DataFrame, start_us: int) -> DataFrame:
    """Same settlement account under different legal entities, as of the later onboarding.

    A merchant's partner is the earliest merchant of any other entity, so the two earliest entities of an account decide
    every member; members are never paired with each other.
    """
    m = merchants.select("merchant_id", "settlement_account", "legal_entity", F.greatest(F.col("onboarded_us"), F.lit(start_us)).alias("t"))
    ent = m.groupBy("settlement_account", "legal_entity").agg(F.min("t").alias("t"))
    first = ent.groupBy("settlement_account").agg(F.min(F.struct("t", "legal_entity")).alias("e1"))
    second = ent.join(first, "settlement_account").where("legal_entity <> e1.legal_entity").groupBy("settlement_account").agg(F.min("t").alias("t2"))
    x = m.join(first, "settlement_account").join(second, "settlement_account")  # one entity only: no second, no alert
    other = F.when(F.col("legal_entity") == F.col("e1.legal_entity"), F.col("t2")).otherwise(F.col("e1.t"))
    return x.select("merchant_id", F.greatest(F.col("t"), other).alias("t_us"), F.lit("D4").alias("detector"))


def merchant_alerts(pays: DataFrame, collects: DataFrame, merchants: DataFrame, bars: DataFrame, start_us: int, rules: MerchantRules = P10, split: Split = SPLIT) -> DataFrame:
    """(merchant_id, detector, t_us): each detector alerts once per merchant. The payments are marked, placed and written once."""
    hot = hot_merchants(pays, split)
    firsts = cut(placed(first_payments(pays.select("merchant_id", "payer_id", "payer_state", "t_us", "tie", "amount"), split), merchants, bars, rules, hot, split))
    cols = ("merchant_id", "detector", "t_us")
    return (
        d1_alerts(firsts, merchants, bars, rules, hot, split).select(*cols)
        .unionByName(d2_alerts(firsts, merchants, rules, hot, split).select(*cols))
        .unionByName(d3_alerts(collects, pays, rules, hot_merchants(collects, split), split).select(*cols))
        .unionByName(d4_alerts(merchants, start_us).select(*cols))
    )


def holds(alerts: DataFrame, rules: MerchantRules = P10) -> DataFrame:
    """Hold intervals: 24 h from a D1-D3 alert, 72 h when D4 had been raised by then. At most three per merchant."""
    d4 = alerts.where("detector = 'D4'").select("merchant_id", F.col("t_us").alias("d4_us"))
    h = alerts.where("detector <> 'D4'").join(d4, "merchant_id", "left")
    hours = F.when(F.col("d4_us") <= F.col("t_us"), rules.hold_d4_hours).otherwise(rules.hold_hours)
    return h.select("merchant_id", "detector", F.col("t_us").alias("from_us"), (F.col("t_us") + hours * HOUR).alias("until_us"))


def batch_status(merchants: DataFrame, hold: DataFrame, start_us: int, days: int, rules: MerchantRules = P10) -> DataFrame:
    """(merchant, batch) with held flag and end of hold. The calendar has one batch a day, so this is merchants x days."""
    cal = merchants.select("merchant_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("batch"))
    cal = cal.withColumn("batch_us", F.lit(start_us) + F.col("batch").cast("bigint") * DAY + rules.batch_hour * HOUR)
    h = cal.join(hold, "merchant_id", "left").groupBy("merchant_id", "batch", "batch_us").agg(F.max(F.when(F.col("from_us") <= F.col("batch_us"), F.col("until_us"))).alias("until_us"))
    return h.withColumn("held", F.coalesce(F.col("until_us") > F.col("batch_us"), F.lit(False)))


def settle_days(status: DataFrame) -> DataFrame:
    """For each merchant and payment day: the batch that settles it (null: none yet) and whether it was ever held."""
    w = Window.partitionBy("merchant_id").orderBy("batch").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.min(F.when(~F.col("held"), F.struct("batch", "batch_us"))).over(w)
    return status.select("merchant_id", (F.col("batch") - 1).cast("bigint").alias("day"), nxt["batch"].alias("settled_batch"), nxt["batch_us"].alias("settled_us"), F.col("held").alias("was_held"))


def settlements(pays: DataFrame, settle: DataFrame, start_us: int) -> DataFrame:
    """Every payment with the batch time that settles it and whether it was held first."""
    d = pays.withColumn("day", F.floor((F.col("t_us") - start_us) / DAY))
    return d.join(settle, ["merchant_id", "day"], "left")


def batch_log(pays: DataFrame, status: DataFrame, start_us: int) -> DataFrame:
    """One row per merchant and batch with money due: held or settled."""
    daily = pays.groupBy("merchant_id", F.floor((F.col("t_us") - start_us) / DAY).alias("day")).agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount_p").alias("amount_p"), F.sum(F.when(F.col("is_fraud") == 1, F.col("amount_p")).otherwise(0)).alias("fraud_p"))
    x = daily.join(settle_days(status), ["merchant_id", "day"])
    # a day's money is due from the batch after it and leaves after the batch that settles it: running sums over batches
    sums = ("payments", "amount_p", "fraud_p")
    comes = x.select("merchant_id", (F.col("day") + 1).cast("int").alias("batch"), *sums)
    goes = x.where("settled_batch IS NOT NULL").select("merchant_id", (F.col("settled_batch") + 1).cast("int").alias("batch"), *[(-F.col(c)).alias(c) for c in sums])
    change = comes.unionByName(goes).groupBy("merchant_id", "batch").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy("merchant_id").orderBy("batch")
    due = status.join(change, ["merchant_id", "batch"], "left").select("merchant_id", "batch", "held", "until_us", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums])
    return due.where("payments > 0").select("merchant_id", "batch", "held", *sums, F.when(F.col("held"), F.col("until_us")).alias("hold_until_us"))


def day_stats(firsts: DataFrame, collects: DataFrame, pays: DataFrame, merchants: DataFrame, bars: DataFrame, start_us: int, rules: MerchantRules = P10) -> DataFrame:
    """Per merchant and day: first-timers above the bar, distinct other states, requests to strangers, failed ones."""
    def day(c: str) -> Column:
        return F.floor((F.col(c) - start_us) / DAY).alias("day")

    m = merchants.select("merchant_id", F.col("state").alias("m_state"))
    other = F.when(F.col("first") & (F.col("payer_state") != F.col("m_state")), F.col("payer_state"))
    base = firsts.join(m, "merchant_id").groupBy("merchant_id", day("t_us")).agg(F.count_distinct(other).alias("states"))
    above = above_bar(firsts, merchants, bars, rules).groupBy("merchant_id", day("t_us")).agg(F.count(F.lit(1)).alias("first_above"))
    col = stranger_collects(collects, pays).groupBy("merchant_id", day("resolved_us")).agg(F.count(F.lit(1)).alias("col_new"), F.sum("failed").alias("col_fail"))
    k = ["merchant_id", "day"]
    return base.join(above, k, "full").join(col, k, "full").na.fill(0, ["states", "first_above", "col_new", "col_fail"])


def calibrated(stats: DataFrame, merchants: DataFrame, rules: MerchantRules = P10) -> DataFrame:
    """Detector thresholds just above the p99.9 of clean merchant-days."""
    s = stats.join(merchants.where("is_fraud = 0").select("merchant_id", "category"), "merchant_id").where((F.col("day") >= rules.warmup_days) & (F.col("day") < rules.train_days))
    q = {"p": 0.999}
    one = s.agg(F.count(F.lit(1)).alias("merchant_days"))
    for name, d, v in (
        ("fa", s, "first_above"), ("ls", s.where(F.col("category").isin(*rules.local)), "states"), ("cn", s.where("col_new > 0"), "col_new"),
        ("fs", s.where("col_new >= 5").withColumn("share", F.col("col_fail") / F.col("col_new")), "share"),
    ):
        one = one.join(percentiles(d, v, q).withColumnRenamed("p", name), F.lit(True), "left")  # one row each
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("fa", "ls", "cn", "fs")}
    return one.select(
        "merchant_days", F.greatest(F.lit(2), F.floor(z["fa"]) + 1).alias("d1_count"), F.greatest(F.lit(3), F.floor(z["ls"]) + 1).alias("d2_states"),
        F.greatest(F.lit(5), F.floor(z["cn"]) + 1).alias("d3_requests"), F.least(F.lit(0.95), F.round(z["fs"] + 0.05, 3)).alias("d3_fail_share"))


def merged_hours(spans: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Hours covered by the union of possibly overlapping intervals per key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("from_us", "until_us").rowsBetween(Window.unboundedPreceding, -1)
    x = spans.withColumn("seen", F.max("until_us").over(w))
    start = F.greatest(F.col("from_us"), F.coalesce(F.col("seen"), F.col("from_us")))
    return x.groupBy(key).agg(F.round(F.sum(F.greatest(F.lit(0), F.col("until_us") - start)) / HOUR, 6).alias("hours"))


def onboarding_decision(applicants: DataFrame, merchants: DataFrame, alerts: DataFrame) -> DataFrame:
    """(settlement_account, legal_entity) -> hold, review or approve, from the merchants that already settle there."""
    flags = alerts.groupBy("merchant_id").agg(F.max(F.col("detector") != "D4").alias("active_alert"))
    peers = merchants.join(flags, "merchant_id", "left").groupBy("settlement_account", "legal_entity").agg(
        F.count(F.lit(1)).alias("n"), F.count("active_alert").alias("flagged"), F.max(F.coalesce("active_alert", F.lit(False)).cast("int")).alias("act"))
    total = peers.groupBy("settlement_account").agg(F.sum("n").alias("n_all"), F.sum("flagged").alias("flagged_all"), F.max("act").alias("act_all"))
    own = peers.select("settlement_account", "legal_entity", F.col("n").alias("n_same"))
    x = applicants.join(total, "settlement_account", "left").join(own, ["settlement_account", "legal_entity"], "left").na.fill(0, ["n_all", "flagged_all", "act_all", "n_same"])
    others = F.col("n_all") - F.col("n_same")
    return x.select(
        *applicants.columns, F.col("n_all").alias("shared_with"), others.alias("other_entities"), F.col("flagged_all").alias("flagged"),
        F.when(F.col("act_all") == 1, "hold").when(others > 0, "review").otherwise("approve").alias("decision"),
        F.when(F.col("act_all") == 1, F.concat(F.col("flagged_all").cast("string"), F.lit(" merchant(s) on this settlement account are under alert.")))
        .when(others > 0, F.concat(others.cast("string"), F.lit(" merchant(s) under other declared entities share this settlement account.")))
        .when(F.col("n_all") > 0, F.concat(F.col("n_all").cast("string"), F.lit(" merchant(s) under the same declared entity share it.")))
        .otherwise("No other merchant settles to this account.").alias("reason"))
