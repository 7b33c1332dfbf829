"""The primary account detectors: inflow from new payers, structuring, fan-in, pass-through.

One scan turns every payment into a handful of entry and exit events on the receiver and the sender; one running sum per
account yields every window of every detector at once. Only rows that can fire leave this stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_day
from ..params import DAY, HOUR, R20, SPLIT, Rules, Split
from ..session import prepare
from .running import SEG, hot_keys, running, with_segment

ORDER = ("t_us", "ord", "row", "side")


def hot_pairs(payments: DataFrame, split: Split = SPLIT) -> DataFrame | None:
    return hot_keys(payments, ["from_id", "to_id"], split)


#: Window events of a payment: five to thirteen, nearly nine on average.
EVENTS_A_PAYMENT = 9


def with_pair_history(payments: DataFrame, split: Split = SPLIT, hot: DataFrame | None = None, measured: bool = False, rows: int | None = None) -> DataFrame:
    """Adds new_payee and the time of the pair's previous payment (and previous just-under-cap P2P payment).

    With `measured` the hot pairs are those given (they may come from a larger table). `rows`: how many payments there are."""
    keys = ["from_id", "to_id"]
    seg = with_segment(payments, keys, hot if measured else hot_pairs(payments, split), split=split)
    near = F.when(F.col("near") & (F.col("channel") == "P2P"), F.col("t_us"))
    h = running(seg, keys, ["t_us", "row"], maxes={"prev_t": F.col("t_us"), "prev_near_t": near}, include_current=False, rows=rows)
    return h.drop(SEG).withColumn("new_payee", F.col("prev_t").isNull())


def daily_totals(payments: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(account, day, in, out) in paise, of all accounts or `only` those given; partial sums happen before the shuffle."""
    legs = F.inline(
        F.array(
            F.struct(F.col("to_id").alias("account_id"), F.col("amount_p").alias("in_p"), F.lit(0).cast("bigint").alias("out_p")),
            F.struct(F.col("from_id").alias("account_id"), F.lit(0).cast("bigint").alias("in_p"), F.col("amount_p").alias("out_p")),
        )
    )
    each = payments.select(epoch_day(F.col("t_us")).alias("day"), legs)
    each = each if only is None else each.join(only, "account_id", "left_semi")
    return each.groupBy("account_id", "day").agg(
        F.sum("in_p").alias("in_p"), F.sum("out_p").alias("out_p")
    )


def baselines(daily: DataFrame, rules: Rules = R20) -> DataFrame:
    """The account's own last days before `day`: largest daily inflow, share sent on, active days."""
    w = Window.partitionBy("account_id").orderBy("day").rangeBetween(-rules.baseline_days, -1)
    total_in, total_out = F.sum("in_p").over(w), F.sum("out_p").over(w)
    active = F.sum(F.when((F.col("in_p") != 0) | (F.col("out_p") != 0), 1).otherwise(0)).over(w)
    ratio = F.when(total_in >= rules.ratio_min_inflow_p, total_out / total_in).otherwise(F.lit(0.0))
    return daily.select(
        "account_id", "day",
        F.coalesce(F.max("in_p").over(w), F.lit(0)).alias("base_p"),
        F.coalesce(ratio, F.lit(0.0)).alias("base_ratio"),
        F.coalesce(active, F.lit(0)).alias("active_days"),
    )


def _window_event(account: str, side: str, t: str, ord_: int, w: int, sign: int, near_payers: str, payees: tuple[str, str, str], more: str = "") -> str:
    """One entry (w = 0), exit (w = window length) or correction (w = -1, no money) event."""
    money = f"amount_p * {sign}" if w >= 0 else "0L"
    return (
        f"named_struct('account_id', {account}, 't_us', {t}, 'ord', {ord_}, 'row', row, 'side', '{side}', 'w', {w}L, 'd_p', {money}, "
        f"'d_n', {sign if w >= 0 else 0}, 'new_in', new_in, 'near_in', near_in, 'd_near_payers', {near_payers}, "
        + ", ".join(f"'d_payees_{i}', {x}" for i, x in enumerate(payees)) + more + ")"
    )


def window_events(paired: DataFrame, model_threshold: float | None = None) -> DataFrame:
    """Entry and exit events of every window, on both ends of every payment; with a threshold, whether the model scores it so high.

    A repeat of a pair inside a window must not count its payee (or payer) twice: the repeat enters with 0, and the exit of
    the earlier payment is undone by a correction at the same moment.
    """
    wins = (HOUR, 6 * HOUR, DAY)
    none = ("0", "0", "0")
    more = "" if model_threshold is None else f", 'agrees', score >= {model_threshold}D"

    def _event(*a) -> str:
        return _window_event(*a, more)

    def only(i: int, x: str) -> tuple[str, ...]:
        return tuple(x if j == i else "0" for j in range(3))

    near = "IF(near_in, {}, 0)".format
    events = [
        _event("to_id", "i", "t_us", 0, 0, 1, "IF(near_in AND NOT near_again, 1, 0)", none),
        *[_event("to_id", "i", f"t_us + {w}L", 1, w, -1, near("-1") if w == DAY else "0", none) for w in wins],
        "IF(new_in, " + _event("to_id", "i", f"t_us + {3 * DAY}L", 1, 3 * DAY, -1, "0", none) + ", NULL)",
        "IF(near_again, " + _event("to_id", "i", f"prev_near_t + {DAY}L", 1, -1, 1, "1", none) + ", NULL)",
        _event("from_id", "o", "t_us", 0, 0, 1, "0", tuple(f"IF(again_{i}, 0, 1)" for i in range(3))),
        *[_event("from_id", "o", f"t_us + {w}L", 1, w, -1, "0", only(i, "-1")) for i, w in enumerate(wins)],
        *[f"IF(again_{i}, " + _event("from_id", "o", f"prev_t + {w}L", 1, -1, 1, "0", only(i, "1")) + ", NULL)" for i, w in enumerate(wins)],
    ]
    flagged = paired.selectExpr(
        "row", "t_us", "from_id", "to_id", "amount_p", "prev_t", "prev_near_t", *([] if model_threshold is None else ["score"]),
        "new_payee AND channel = 'P2P' AS new_in",
        "near AND channel = 'P2P' AS near_in",
        f"coalesce(near AND channel = 'P2P' AND prev_near_t >= t_us - {DAY}L, false) AS near_again",
        *[f"coalesce(prev_t >= t_us - {w}L, false) AS again_{i}" for i, w in enumerate(wins)],
    )
    return flagged.selectExpr("inline_outer(array(" + ", ".join(events) + "))").where("account_id IS NOT NULL")


def hot_accounts(payments: DataFrame, split: Split = SPLIT) -> DataFrame | None:
    return hot_keys(payments.select(F.explode(F.array("from_id", "to_id")).alias("account_id")), ["account_id"], split)


def window_sums(
    paired: DataFrame, hot: DataFrame | None = None, split: Split = SPLIT, only: DataFrame | None = None, model_threshold: float | None = None, rows: int | None = None
) -> DataFrame:
    """Per payment and side, the window aggregates at that moment (the payment included). `rows`: how many payments there are.

    `only` restricts them to some accounts. With a threshold, `model_new`, `model_near` and `model_any` are the last times of
    a new payer's transfer, a just-under-cap transfer, and any payment that the model scores so high.
    """
    events = window_events(paired, model_threshold)
    ev = with_segment(events if only is None else events.join(only, "account_id", "left_semi"), ["account_id"], hot, split=split)

    def over(cond: str, length: int, value: str) -> Column:
        return F.expr(f"IF({cond} AND w IN (0, {length}), {value}, 0)")

    sums: dict[str, Column] = {}
    for i, length in enumerate((HOUR, 6 * HOUR, DAY)):
        sums[f"in_{i}"] = over("side = 'i'", length, "d_p")
        sums[f"out_{i}"] = over("side = 'o'", length, "d_p")
        sums[f"outs_{i}"] = over("side = 'o'", length, "d_n")
        sums[f"payees_{i}"] = F.col(f"d_payees_{i}")
    for tag, length in (("24", DAY), ("72", 3 * DAY)):
        sums[f"new_sum_{tag}"] = over("side = 'i' AND new_in", length, "d_p")
        sums[f"new_n_{tag}"] = over("side = 'i' AND new_in", length, "d_n")
    sums["near_n"] = over("side = 'i' AND near_in", DAY, "d_n")
    sums["near_sum"] = over("side = 'i' AND near_in", DAY, "d_p")
    sums["near_new_n"] = over("side = 'i' AND near_in AND new_in", DAY, "d_n")
    sums["near_payers"] = F.col("d_near_payers")
    maxes: dict[str, Column] = {}
    if model_threshold is not None:
        high = {"model_new": "side = 'i' AND new_in", "model_near": "side = 'i' AND near_in", "model_any": "true"}
        maxes = {k: F.expr(f"IF(ord = 0 AND agrees AND {cond}, t_us, NULL)") for k, cond in high.items()}
    return running(ev, ["account_id"], list(ORDER), sums=sums, maxes=maxes, rows=None if rows is None else rows * EVENTS_A_PAYMENT).where("ord = 0")


def firings(sums: DataFrame, base: DataFrame, accounts: DataFrame, rules: Rules = R20) -> DataFrame:
    """Every moment at which a primary detector fires: (detector, account, t, row, window, severity, base score, facts).

    A pair is new once, so new-payer transfers and distinct new payers are the same number. If the sums carry the model's last
    high scores, `agrees` says whether one lies in the firing's window.
    """
    with_model = "model_any" in sums.columns
    prepare(sums.sparkSession)
    r, idx = rules, range(len(rules.pass_windows))
    moved = " OR ".join(f"(outs_{i} >= 2 AND payees_{i} >= 2 AND out_{i} >= {r.pass_ratio}D * in_{i})" for i in idx)
    # cheap necessary conditions first, so the baseline and kind joins see few rows
    t = sums.where(
        f"(side = 'i' AND ((new_in AND new_sum_72 >= {min(r.inflow_floor_p, r.fan_in_min_p)}) OR (near_in AND near_n >= 3))) OR (side = 'o' AND ({moved}))"
    ).withColumn("day", epoch_day(F.col("t_us")))
    if SEG in sums.columns:
        t = t.join(base, ["account_id", "day"])
    else:
        # an account's days come to where its window sums are, so these wide rows do not move again
        days = base.where("day IS NOT NULL").groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("day", F.struct("base_p", "base_ratio", "active_days")))).alias("_days"))
        t = t.join(days, "account_id").withColumn("_base", F.try_element_at("_days", "day")).where("_base IS NOT NULL").select("*", "_base.*").drop("_days", "_base")
    t = t.join(accounts.select("account_id", "kind"), "account_id", "left")
    t = t.selectExpr(
        "*",
        f"greatest({r.inflow_floor_p}L, {r.inflow_mult} * IF(active_days >= {r.baseline_min_active}, base_p, 0L)) AS thr",
        f"{pass_floor(r)} AS floor_p",
        f"active_days >= {r.baseline_min_active} AND base_ratio >= {r.forwarder_ratio}D AS forwards",
    )
    # first window that passes decides; an established forwarder at its usual scale ends the check without an alert
    steps = " ".join(
        f"WHEN in_{i} >= floor_p AND outs_{i} >= 2 AND payees_{i} >= 2 AND out_{i} >= {r.pass_ratio}D * in_{i} "
        f"THEN IF(forwards AND in_{i} < {r.forwarder_scale} * base_p, -1, {i})"
        for i in idx
    )
    t = t.selectExpr("*", "new_sum_24 >= thr AND new_n_24 >= 2 AS hit24", "new_sum_72 >= 2 * thr AND new_n_72 >= 2 AS hit72", f"CASE {steps} ELSE -1 END AS pick")

    def at(name: str) -> str:
        return f"element_at(array({', '.join(f'{name}_{i}' for i in idx)}), greatest(pick, 0) + 1)"

    t = t.selectExpr(
        "*",
        "IF(hit24, new_sum_24, new_sum_72) AS new_sum", "IF(hit24, new_n_24, new_n_72) AS new_n", "IF(hit24, thr, 2 * thr) AS bar",
        f"{at('in')} AS pin", f"{at('out')} AS pout", f"{at('outs')} AS pouts", f"{at('payees')} AS ppayees",
        f"element_at(array({', '.join(f'{w}L' for w in r.pass_windows)}), greatest(pick, 0) + 1) AS pw",
    ).selectExpr("*", "least(try_divide(pout, pin), 9.99D) AS ratio")

    def fire(name: str, cond: str, w: str, critical: str, score: str, total: str, out: str, people: str, hits: str, bar: str, model: str) -> str:
        agrees = f", 'agrees', coalesce({model} >= t_us - {w}, false)" if with_model else ""
        return (
            f"IF({cond}, named_struct('detector', '{name}', 'w_us', {w}, 'severity', IF({critical}, 'critical', 'high'), 'base_score', CAST({score} AS INT), "
            f"'total_p', CAST({total} AS BIGINT), 'out_p', CAST({out} AS BIGINT), 'people', CAST({people} AS BIGINT), 'hits', CAST({hits} AS BIGINT), 'bar_p', CAST({bar} AS BIGINT){agrees}), NULL)"
        )

    found = [
        fire("inflow_new_payers", "side = 'i' AND new_in AND (hit24 OR hit72)", f"IF(hit24, {DAY}L, {3 * DAY}L)", "new_n >= 3 OR new_sum >= 2 * bar",
             "78 + 3 * least(new_n, 5)", "new_sum", "0", "new_n", "new_n", "bar", "model_new"),
        fire("structuring", "side = 'i' AND near_in AND near_n >= 3 AND near_payers >= 2 AND near_new_n >= 1", f"{DAY}L", "near_n >= 5",
             "74 + 2 * least(near_n, 8)", "near_sum", "0", "near_payers", "near_n", "0", "model_near"),
    ]
    if r.relative_floor:
        found.append(
            fire("fan_in_new_payers",
                 f"side = 'i' AND new_in AND coalesce(kind, 'individual') = 'individual' AND new_n_24 >= {r.fan_in_payers} AND new_sum_24 >= {r.fan_in_min_p}",
                 f"{DAY}L", f"new_n_24 >= {2 * r.fan_in_payers}", "72 + 2 * least(new_n_24, 10)", "new_sum_24", "0", "new_n_24", "new_n_24", str(r.fan_in_min_p), "model_new")
        )
    found.append(
        fire("pass_through", "side = 'o' AND pick >= 0", "pw", f"ratio >= 0.85D AND pw <= {6 * HOUR}L", "70 + floor(least(ratio, 1.0D) * 20)", "pin", "pout", "ppayees", "pouts", "floor_p", "model_any")
    )
    return t.selectExpr("account_id", "t_us", "row", f"inline_outer(array({', '.join(found)}))").where("detector IS NOT NULL")


def pass_floor(rules: Rules) -> str:
    """The pass-through floor in paise, as SQL over kind, base_p and active_days."""
    if not rules.relative_floor:
        return f"{rules.pass_floor_p}L"
    peers = " ".join(f"WHEN '{k}' THEN {v}L" for k, v in rules.peer_busiest_p.items())
    return (
        f"IF(active_days >= {rules.baseline_min_active}, greatest({rules.rel_floor_p}L, {rules.own_mult} * base_p), "
        f"greatest({rules.rel_floor_p}L, CASE kind {peers} ELSE 0L END))"
    )


def measure_hot(payments: DataFrame, split: Split = SPLIT) -> tuple[DataFrame | None, DataFrame | None]:
    """(hot accounts, hot pairs), measured once for a whole run. Without a hot account there is no hot pair."""
    hot = hot_accounts(payments, split)
    return hot, None if hot is None else hot_pairs(payments, split)


def primary_firings(payments: DataFrame, accounts: DataFrame, rules: Rules = R20, split: Split = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(payments with pair history, firings)."""
    hot, pairs = measure_hot(payments, split)
    rows = payments.count()
    paired = with_pair_history(payments, split, pairs, measured=True, rows=rows)
    return paired, firings(window_sums(paired, hot, split, rows=rows), baselines(daily_totals(payments), rules), accounts, rules)
