"""The router and the policy fixpoint on hand-built streams."""

import pytest
from pyspark.sql import functions as F
from util import T0, frame, pay, people, random_rows

from paysift.operators import alerts as A
from paysift.operators import replay as Rp
from paysift.params import HOUR, R20, Rules

ALERT = "detector string, account_id string, severity string, gnn_max double, status string"


def level(spark, rows):
    return A.route(spark.createDataFrame([(d, "M", s, g, st) for d, s, g, st in rows], ALERT)).first()["level"]


def test_router_ladder(spark):
    assert level(spark, [("model_only", "medium", 0.99, "open")]) == 0
    assert level(spark, [("structuring", "high", 0.1, "open")]) == 1
    assert level(spark, [("structuring", "high", 0.9, "open")]) == 2
    assert level(spark, [("structuring", "critical", 0.1, "open")]) == 2
    assert level(spark, [("structuring", "critical", 0.9, "open"), ("pass_through", "high", 0.1, "open")]) == 3
    assert level(spark, [("structuring", "critical", 0.9, "open"), ("pass_through", "high", 0.1, "cleared")]) == 1
    assert level(spark, [("hop_from_flagged", "medium", 0.99, "open")]) == 0


def mule(score, amount=70_000):
    """Three new payers make a critical inflow; then the mule sends money on every ten minutes. Row 15 comes in late."""
    rows = [pay(i, 600 * i, f"victim{i}", "mule", amount, score=score, fraud=1) for i in range(3)]
    rows += [pay(3 + k, 2400 + 600 * k, "mule", f"out{k}", 15_000, score=score, fraud=1) for k in range(12)]
    return [*rows, pay(15, 6001, "late", "mule", 20_000, score=score, fraud=1)]


def hops(score=0.1):
    """A level 1 mule that still sends: the next account gets 1.2 lakh from it, then tries to send on."""
    rows = [pay(0, 0, "v1", "m", 80_000), pay(1, 300, "v2", "m", 80_000)]
    rows += [pay(2, 7200, "m", "n", 60_000, score=score), pay(3, 7300, "m", "n", 60_000, score=score), pay(4, 7400, "n", "z", 5_000)]
    return rows


DELAYED = [pay(0, 0, "v1", "m", 80_000), pay(1, 300, "v2", "m", 80_000), pay(2, 600, "m", "o1", 30_000)]
LEAD = [pay(0, 0, "v1", "mule", 12_000, score=0.97), pay(1, 300, "mule", "l2", 10_000)]
CLEARED = [("mule", 3000, "clear", "inflow_new_payers")]
DILUTED = [*hops()[:2], *[pay(10 + k, 3600 + k, "boss", "n", 99_000, channel="P2M") for k in range(3)], *hops()[2:]]
#: name: (rows, actions)
CASES = {
    "rise": ([pay(0, 0, "V1", "M", 80_000), pay(1, 60, "V2", "M", 80_000), pay(2, 120, "M", "X", 9_000), pay(3, 180, "V3", "M", 90_000),
              pay(4, 240, "M", "Y", 9_000), pay(5, 30 * 3600, "M", "Z", 9_000)], []),
    "low": (mule(0.1), []), "one": (mule(0.99), []), "two": ([*mule(0.99, 99_999), pay(16, 30 * 3600, "mule", "later", 10)], []),
    "expiry": ([*DELAYED, pay(3, 3 * 3600, "q", "r", 100)], []),
    "late_appeal": (mule(0.1), [("mule", 9000, "appeal", None)]),
    "upheld": (mule(0.1), [("mule", 3000, "appeal", None), ("mule", 3100, "uphold", None)]),
    "released": (mule(0.1), [("mule", 3000, "appeal", None), ("mule", 4300, "release", None)]),
    "no_appeal": (mule(0.1), [("mule", 4300, "release", None)]),
    "lapsed": ([*mule(0.99, 99_999), pay(16, 30 * 3600, "mule", "later", 10)], [("mule", 3000, "appeal", None)]),
    "lower": ([*mule(0.1)[:3], pay(3, 3600, "mule", "a", 90_000), pay(4, 3700, "mule", "b", 90_000), pay(5, 3800, "mule", "c", 10_000)], CLEARED),
    "not_again": ([*mule(0.1)[:3], pay(3, 3600, "v9", "mule", 90_000), pay(4, 3700, "mule", "b", 1_000)], CLEARED),
    "frozen": ([*DELAYED, pay(3, 10 * 86400, "m", "o2", 10), pay(4, 10 * 86400 + 1, "v1", "m", 10)], [("m", 700, "freeze", None)]),
    "lead": (LEAD, []), "hop": (hops(), []), "hop_model": (hops(0.9), []),
}


def run(spark, cases, rules=R20, kinds=()):
    """All cases in one replay, their accounts and rows kept apart: name -> ({row: (blocked, delayed, cancelled)}, [(account, s, level, how)])."""
    rows, acts, start = [], [], T0
    for i, (name, (mine, actions)) in enumerate(cases.items()):
        rows += [r | {"row": 1000 * i + r["row"]} | {c: f"{name}/{r[c]}" for c in ("from_id", "to_id")} for r in mine]
        acts += [(f"{name}/{a}", start + int(s * 1e6), what, d) for a, s, what, d in actions]
    who = people(spark, rows).where(~F.col("account_id").isin([a for a, _ in kinds]))
    if kinds:
        who = who.union(spark.createDataFrame([(a, kind, "clean") for a, kind in kinds], who.schema))
    flags, restr, _ = Rp.replay(frame(spark, rows), who, start, rules, spark.createDataFrame(acts, Rp.ACTIONS) if acts else None)
    out = {name: ({}, []) for name in cases}
    names = list(cases)
    for r in flags.collect():
        out[names[r["row"] // 1000]][0][r["row"] % 1000] = (r["blocked"], r["delayed"], r["cancelled"])
    for r in restr.collect():
        name, account = r["account_id"].split("/")
        out[name][1].append((account, (r["at_us"] - start) // 1_000_000, r["level"], r["how"]))
    return {name: (got, sorted(log)) for name, (got, log) in out.items()}


@pytest.fixture(scope="module")
def ran(spark):
    return run(spark, CASES)


def test_delay_then_escalation_recovers_the_payment(ran):
    got, log = ran["rise"]
    assert got[2] == (False, True, True) and got[4][0] and 5 not in got
    assert [x[:3] for x in log[:2]] == [("M", 60, 1), ("M", 180, 2)]


@pytest.mark.parametrize(("name", "top", "late"), [("low", 2, False), ("one", 2, False), ("two", 3, True)])
def test_hold_stops_money_out_and_a_full_hold_also_in(ran, name, top, late):
    got, log = ran[name]
    assert all(got[k][0] for k in range(3, 15)) and (15 in got) == late
    assert max(x[2] for x in log if x[0] == "mule") == top


def test_expiry_releases_what_was_delayed(ran):
    assert ran["expiry"] == ({2: (False, True, False)}, [("m", 300, 1, "restriction_expired")])


def test_appeals(ran):
    assert ran["late_appeal"][1][0] == ("mule", 1200, 2, "restriction_expired")  # the hold ends before the appeal is due
    got, log = ran["upheld"]
    assert log[0][3] == "restriction_expired" and got[14][0]
    got, log = ran["released"]
    assert log[0] == ("mule", 1200, 2, "cleared") and got[3][0] and got[6][0] and 7 not in got
    assert ran["no_appeal"][1][0][3] == "restriction_expired"  # nothing to decide
    got, log = ran["lapsed"]
    assert next(x for x in log if x[2] == 3)[3] == "appeal_sla_release" and 16 not in got
    assert ran["two"][0][16][0]


def test_after_a_clear_the_next_alert_holds_one_level_lower(ran):
    got, log = ran["lower"]
    assert log == [("mule", 1200, 2, "cleared"), ("mule", 3700, 1, "restriction_expired")]
    assert got == {5: (False, True, False)}


def test_cleared_alert_is_not_raised_again(ran):
    assert ran["not_again"] == ({}, [("mule", 1200, 2, "cleared")])


def test_freeze_blocks_both_ways_for_good(ran):
    got, log = ran["frozen"]
    assert got == {2: (False, True, True), 3: (True, False, False), 4: (True, False, False)}
    assert [x[2:] for x in log] == [(1, "frozen"), (4, "open")]


def test_hop_money_restricts_the_next_account(ran):
    got, log = ran["hop"]
    assert ("n", 7300, 1, "restriction_expired") in log and got[4] == (False, True, False)
    got, log = ran["hop_model"]
    assert ("n", 7300, 2, "restriction_expired") in log and got[4][0]
    assert ran["lead"] == ({}, [])


def test_switches_of_the_rules(spark):
    assert run(spark, {"hop": CASES["hop"]}, Rules(hop_rule=False))["hop"][1] == [("m", 300, 1, "restriction_expired")]
    got, log = run(spark, {"lead": CASES["lead"]}, Rules(version="r2.1", friction=True))["lead"]
    assert got == {1: (False, True, False)} and log[0][:3] == ("mule", 0, 1)


def test_hop_share_spares_shops_and_small_shares(spark):
    cases = {"hop": CASES["hop"], "shop": CASES["hop"], "diluted": (DILUTED, [])}
    out = run(spark, cases, Rules(version="r2.2"), [("shop/n", "merchant")])
    assert {name: any(x[0] == "n" for x in log) for name, (_, log) in out.items()} == {"hop": True, "shop": False, "diluted": False}


def plain_loop(rows, rules, actions, start):
    """A payment-by-payment run of the same policy, for comparison; windows are re-read for every payment."""
    days, out, accounts, blocked = 86400 * 10**6, {}, {}, set()
    grid = lambda t: start - Rp.GRID_OFFSET_US + -(-(t - start + Rp.GRID_OFFSET_US) // HOUR) * HOUR
    acc = lambda a: accounts.setdefault(a, Rp._Account(a, rules, grid))
    stopped = lambda a, t: acc(a).frozen or acc(a).level >= 2
    past, paid = [], set()
    todo = sorted(actions, key=lambda a: a[1])

    def flagged(a, x_t):
        own = acc(a)
        return stopped(a, None) or any(f[1] == "alert" and f[5] == Rp.FOREVER and f[3] >= x_t - days for f in own.facts)

    for p in sorted(rows, key=lambda r: (r["t_us"], r["row"])):
        t, row, f, to = p["t_us"], p["row"], p["from_id"], p["to_id"]
        while todo and todo[0][1] < t:
            a, at, what, det = todo.pop(0)
            acc(a).pass_time(at)
            acc(a).act(what, det, at)
        for a in list(accounts.values()):
            a.pass_time(t)
        s, r = (4 if acc(a).frozen else acc(a).level for a in (f, to))
        if s >= 2 or r >= 3:
            out[row] = (True, False)
            continue
        if s == 1:
            out[row] = (False, True)
        new = (f, to) not in paid
        paid.add((f, to))
        past.append(p | {"new": new})
        inn = lambda a, w: [x for x in past if x["to_id"] == a and x["t_us"] >= t - w]
        outs = lambda a, w: [x for x in past if x["from_id"] == a and x["t_us"] >= t - w]
        total = lambda xs: sum(x["amount"] for x in xs)
        model = lambda xs: int(any(x["score"] >= rules.model_threshold for x in xs))

        def base(a):
            day = t // days
            i = [sum(x["amount"] for x in past if x["to_id"] == a and x["t_us"] // days == d) for d in range(day - 7, day)]
            o = [sum(x["amount"] for x in past if x["from_id"] == a and x["t_us"] // days == d) for d in range(day - 7, day)]
            return max(i), (sum(o) / sum(i) if sum(i) >= 20_000 else 0.0), sum(bool(x or y) for x, y in zip(i, o, strict=True))

        if new and p["channel"] == "P2P":
            b, _, active = base(to)
            bar = max(150_000, 3 * b * (active >= 5))
            for w, k in ((1, 1), (3, 2)):
                hits = [x for x in inn(to, w * days) if x["new"] and x["channel"] == "P2P"]
                if total(hits) >= bar * k and not (len({x["from_id"] for x in hits}) < 2 and len(hits) < 3):
                    crit = len({x["from_id"] for x in hits}) >= 3 or total(hits) >= 2 * bar * k
                    acc(to).fire("inflow_new_payers", 3 if crit else 2, model(hits), t, row)
                    break
        near = lambda x: (90_000 <= x["amount"] <= 100_000 or x["amount"] == 49_999) and x["channel"] == "P2P"
        if near(p):
            hits = [x for x in inn(to, days) if near(x)]
            if len(hits) >= 3 and len({x["from_id"] for x in hits}) >= 2 and any(x["new"] for x in hits):
                acc(to).fire("structuring", 3 if len(hits) >= 5 else 2, model(hits), t, row)
        b, ratio, active = base(f)
        for w in (HOUR, 6 * HOUR, days):
            i, o = inn(f, w), outs(f, w)
            if total(i) >= 100_000 and len(o) >= 2 and len({x["to_id"] for x in o}) >= 2 and total(o) >= 0.6 * total(i):
                if not (active >= 5 and ratio >= 0.5 and total(i) < 3 * b):
                    crit = min(total(o) / total(i), 9.99) >= 0.85 and w <= 6 * HOUR
                    acc(f).fire("pass_through", 3 if crit else 2, model(i + o), t, row)
                break
        if not stopped(to, t) and flagged(f, t):
            hits = [x for x in past if x["to_id"] == to and flagged(x["from_id"], x["t_us"])]
            acc(to).fire("hop_from_flagged", 2 if total(hits) >= 100_000 else 1, model(hits), t, row)
        if p["score"] >= rules.model_threshold:
            acc(to).fire("model_only", 1, 1, t, row)
    for a in accounts.values():
        a.pass_time(Rp.FOREVER)
    return out, sorted((x[0], x[3], x[2], x[6]) for a in accounts.values() for x in a.facts if x[1] == "level")


def test_fixpoint_equals_a_payment_by_payment_run(spark):
    rows = random_rows(11, 220, 14, days=4)
    start = min(r["t_us"] for r in rows)
    actions = [(f"A{n}", start + h * HOUR, what, None) for n in range(0, 14, 2) for h, what in ((20, "appeal"), (26, "release"), (50, "appeal"))]
    actions += [("A3", start + 40 * HOUR, "freeze", None), ("A5", start + 30 * HOUR, "clear", "inflow_new_payers")]
    flags, restr, rounds = Rp.replay(frame(spark, rows), people(spark, rows), start, R20, spark.createDataFrame(actions, Rp.ACTIONS))
    want_flags, want_log = plain_loop(rows, R20, actions, start)
    assert {r["row"]: (r["blocked"], r["delayed"]) for r in flags.collect()} == want_flags
    assert sorted((r["account_id"], r["at_us"], r["level"], r["how"]) for r in restr.collect()) == want_log
    assert rounds > 2 and any(b for b, _ in want_flags.values())
