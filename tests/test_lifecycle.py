"""The alert lifecycle against an event-by-event loop, in one piece and in segments."""

import random

from util import T0

from paysift.operators import lifecycle as Lc
from paysift.params import DETECTORS, SEC, Split


def one_by_one(events):
    """Plain loop: {(account, detector): (status, gnn, filed)}, [(account, seq, accepted, override, logged)], {account: (level, by, frozen)}."""
    alerts, log, accounts = {}, [], {}
    for account, det, kind, level, score, note, at, seq in sorted(events, key=lambda e: (e[0], e[6], e[7])):
        mine = {d: a for (acc, d), a in alerts.items() if acc == account}
        state = accounts.setdefault(account, {"level": 0, "by": None, "frozen": None})
        alert = mine.get(det)
        is_live = alert is not None and alert["status"] in ("open", "held", "escalated")

        def lift():
            holder = mine.get(state["by"])
            if holder and holder["status"] == "held":
                holder["status"] = "open"
            state.update(level=0, by=None)

        def file(x):
            x["filed"] = at if x["filed"] is None else x["filed"]

        if kind == "raise":
            if alert:
                if alert["status"] != "cleared":
                    alert["gnn"] = max(alert["gnn"], score)
            elif state["frozen"] is None:
                if det != "model_only" and mine.get("model_only", {}).get("status") == "open":
                    mine["model_only"]["status"] = "superseded"
                alerts[account, det] = {"status": "open", "gnn": score, "filed": None}
        elif kind == "hold":
            level = min(level, 1) if det == "model_only" else level
            if is_live and state["frozen"] is None and level > state["level"]:
                state.update(level=level, by=det)
                if level >= 2:
                    alert["status"] = "held"
                    file(alert)
        elif kind == "lift":
            if state["level"] and state["frozen"] is None:
                lift()
        else:
            ok = bool(note.strip()) and is_live
            override = ok and kind == "clear" and (state["level"] > 0 or alert["gnn"] >= 0.86)
            logged = None if not ok else "release_hold" if kind == "clear" and alert["status"] == "held" else kind
            log.append((account, seq, ok, override, logged))
            if ok and kind == "clear":
                alert["status"] = "cleared"
                if state["level"] and not any(x["status"] == "held" for x in mine.values()):
                    state.update(level=0, by=None)
            elif ok and kind == "escalate":
                alert["status"] = "held" if alert["status"] == "held" else "escalated"
                file(alert)
            elif ok:
                for x in mine.values():
                    if x["status"] in ("open", "held", "escalated"):
                        x["status"] = "frozen"
                        file(x)
                state.update(level=0, by=None, frozen=at)
    have = {acc for acc, _ in alerts}
    return ({k: (a["status"], a["gnn"], a["filed"]) for k, a in alerts.items()}, sorted(log),
            {a: (s["level"], s["by"], s["frozen"]) for a, s in accounts.items() if a in have})


def check(spark, events, split=None):
    alerts, actions, accounts = Lc.lifecycle(spark.createDataFrame(events, Lc.EVENTS), **({"split": split} if split else {}))
    want = one_by_one([e for e in events if e[0] is not None and e[2] in ("raise", "hold", "lift", *Lc.ACTIONS)])
    assert {(r["account_id"], r["detector"]): (r["status"], r["gnn_max"], r["filed_us"]) for r in alerts.collect()} == want[0]
    assert sorted((r["account_id"], r["seq"], r["accepted"], r["override"], r["logged"]) for r in actions.collect()) == want[1]
    assert {r["account_id"]: (r["level"], r["held_by"], r["frozen_us"]) for r in accounts.collect()} == want[2]
    return want


def random_events(seed, n, accounts, freezes=1, clears=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choices(("raise", "hold", "lift", "clear", "escalate", "freeze"), (8, 8, 4, clears, 3, freezes))[0]
        out.append((f"A{r.randrange(accounts)}", None if kind == "lift" else r.choice(DETECTORS), kind, r.randrange(1, 4) if kind == "hold" else None,
                    r.choice((0.1, 0.5, 0.9)) if kind == "raise" else None, r.choice(("", " ", "seen", "seen")) if kind in Lc.ACTIONS else None, T0 + r.randrange(1 + n // 20) * 60 * SEC, i))
    return out


def test_equal_to_the_loop(spark):
    events = random_events(1, 3000, 120, freezes=0.4)
    want = check(spark, events)
    assert {s for s, _, _ in want[0].values()} == {"open", "escalated", "held", "cleared", "frozen", "superseded"}
    # the same in segments, and with rows that mean nothing
    odd = [(None, DETECTORS[0], "raise", None, 0.5, None, T0, 9001), ("A1", DETECTORS[0], "wave", None, None, None, T0, 9002), ("nobody", None, "lift", None, None, None, T0, 9003)]
    check(spark, events + odd, Split(hot_rows=3, segment_us=11 * 60 * SEC))
    check(spark, [])


def test_cleared_stays_cleared_and_freeze_closes(spark):
    a, b = DETECTORS[:2]
    events = [("m", a, "raise", None, 0.1, None, T0, 1), ("m", a, "hold", 2, None, None, T0, 2), ("m", b, "raise", None, 0.2, None, T0, 3), ("m", b, "hold", 1, None, None, T0, 4),
              ("m", a, "clear", None, None, "known shop", T0 + 1, 5), ("m", a, "raise", None, 0.99, None, T0 + 2, 6), ("m", b, "freeze", None, None, "", T0 + 3, 7),
              ("m", b, "freeze", None, None, "confirmed", T0 + 4, 8), ("m", DETECTORS[3], "raise", None, 0.9, None, T0 + 5, 9), ("m", b, "clear", None, None, "late", T0 + 6, 10)]
    alerts, log, accounts = check(spark, events)
    assert alerts == {("m", a): ("cleared", 0.1, T0), ("m", b): ("frozen", 0.2, T0 + 4)}
    assert log == [("m", 5, True, True, "release_hold"), ("m", 7, False, False, None), ("m", 8, True, False, "freeze"), ("m", 10, False, False, None)]
    assert accounts == {"m": (0, None, T0 + 4)}


def test_one_account_with_a_long_history_in_segments(spark):
    events = [("hub", *e[1:]) for e in random_events(2, 100_000, 1, freezes=0, clears=0.0002)] + random_events(3, 200, 9)
    want = check(spark, events, Split(hot_rows=5000, segment_us=200 * 60 * SEC))
    assert want[2]["hub"][2] is None
