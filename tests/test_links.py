"""Onboarding by bitmaps and paths by an index of out-edges, against plain loops on small graphs with a hub; cases by the greedy rule."""

import hashlib
import random

import numpy as np
from util import T0, frame, pay, random_rows

from paysift.operators import audit as Au
from paysift.operators import graph as Gr
from paysift.operators import onboarding as On
from paysift.params import Split


def test_onboarding_equals_the_loop(spark):
    rows = random_rows(4, 260, 90) + [pay(1000 + i, i, "hub", f"A{i}", 10) for i in range(0, 60, 2)] + [pay(2000, 5, "lonely", "other", 5), pay(2001, 9, "A1", "A1", 5)]
    flagged = {f"A{i}": 60 + i % 5 for i in range(0, 90, 7)} | {"other": 99}
    met = {}
    for r in rows:
        a, b = r["from_id"], r["to_id"]
        if a != b:
            met.setdefault(a, set()).add(b)
            met.setdefault(b, set()).add(a)
    applicants = [(f"{a}@x", a) for a in sorted(met)] + [("second@x", "A3"), ("nobody@x", None)]
    got = {r["vpa"]: r for r in On.onboarding_report(
        spark.createDataFrame(applicants, "vpa string, account_id string"), frame(spark, rows), spark.createDataFrame(sorted(flagged.items()), "account_id string, score int")).collect()}
    assert len(got) == len(applicants)
    assert (got["nobody@x"]["known"], got["nobody@x"]["decision"], got["nobody@x"]["second_hop"]) == (False, "approve", 0)
    for vpa, a in applicants[:-1]:
        second = {o for d in met[a] for o in met[d] if o != a and o not in met[a] and o in flagged}
        worst = min(second, key=lambda o: (-flagged[o], hashlib.md5(o.encode()).hexdigest()), default=None)
        via = min((d for d in met[a] if worst in met[d]), default=None) if worst else None
        r = got[vpa]
        assert (r["counterparties"], r["self_flagged"], r["direct"], r["second_hop"]) == (len(met[a]), a in flagged, len(met[a] & set(flagged)), len(second))
        assert (r["second_account"], r["second_score"], r["via"]) == (worst, flagged.get(worst), via)
    empty = spark.createDataFrame([], "account_id string, score int")
    assert {r["decision"] for r in On.onboarding_report(spark.createDataFrame([("lonely@x", "lonely")], "vpa string, account_id string"), frame(spark, rows), empty).collect()} == {"approve"}


def test_sets_are_packed_small(spark):
    r = random.Random(3)
    for numbers in ([], [0], [5], [On._BITS - 1], list(range(3000)), sorted(r.sample(range(On._BITS), 120)), [0, On._BITS - 1], sorted(r.sample(range(On._BITS), 200_000)), list(range(On._BITS))):
        packed = On.pack(np.array(numbers, np.int64))
        assert On.unpack(packed).tolist() == numbers
        assert len(packed) <= min(4 * len(numbers), On._BITS // 8) + 2
    # 120 of a million: two bytes each, where a bitmap of 4 KB per 32,768 numbers took 120 KB
    assert len(On.pack(np.arange(120) * 8000)) == 241


def walk(rows, seed, hops, limit):
    """Depth first over payments in (time, row) order."""
    out_edges = {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["row"])):
        out_edges.setdefault(r["from_id"], []).append(r)
    found = []

    def go(node, after, nodes, legs):
        for r in out_edges.get(node, []):
            if len(found) >= limit:
                return
            if r["t_us"] >= after and r["to_id"] not in nodes:
                found.append((nodes + [r["to_id"]], legs + [r["row"]]))
                if len(legs) + 1 < hops:
                    go(r["to_id"], r["t_us"], *found[-1])

    go(seed, -1, [seed], [])
    return found


def same_paths(spark, rows, seeds, hops, limit, blocked=(), **kw):
    s = spark.createDataFrame([(x,) for x in seeds], "account_id string")
    b = spark.createDataFrame([(x,) for x in blocked], "row bigint") if blocked else None
    got = {}
    for r in Gr.downstream_paths(frame(spark, rows), s, hops, limit, b, **kw).orderBy("seed", "path_no").collect():
        got.setdefault(r["seed"], []).append((r["nodes"], [x["r"] for x in r["legs"]]))
        assert r["truncated"] == (len(walk([x for x in rows if x["row"] not in blocked], r["seed"], hops, limit)) >= limit)
    want = {x: walk([r for r in rows if r["row"] not in blocked], x, hops, limit) for x in seeds}
    assert got == {x: p for x, p in want.items() if p}
    return got


def test_paths_equal_depth_first(spark):
    rows = random_rows(8, 400, 25)
    # a hub that pays the account its money came from a thousand times before anyone else, at equal times too
    rows += [pay(5000, 0, "src", "hub", 10), *[pay(5001 + i, 60 + i // 3, "hub", "src", 1) for i in range(1000)], *[pay(7000 + i, 5000, "hub", f"out{i}", 1) for i in range(300)], pay(8000, 10, "src", "src", 1)]
    seeds = ["src", "hub", "A0", "A3", "A9", "nowhere"]
    got = same_paths(spark, rows, seeds, 3, 40)
    assert len(got["src"]) == 40 and got["src"][1][1] == [5000, 7000]
    same_paths(spark, rows, seeds[:4], Gr.MAX_HOPS, 25, blocked=(5000, 7001, *range(0, 400, 3)), split=Split(hot_rows=50))


def test_asked_edges_do_not_go_to_the_driver(spark, monkeypatch):
    rows = random_rows(8, 400, 25)
    plans, cut = [], Gr.cut
    monkeypatch.setattr(Gr, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr(Gr, "FEW_ROWS", 0, raising=False)
    same_paths(spark, rows, ["A0", "A3", "A9"], 2, 40)
    reads = [p for p in plans if "explode(sequence(" in p]
    assert reads and not any("Broadcast" in p for p in reads)


def test_cases_equal_the_greedy_rule(spark):
    r = random.Random(5)
    rows = random_rows(6, 60, 40) + [pay(900 + i, r.randrange(4 * 86400), "hub", f"A{i}", 10) for i in range(3)] + [pay(990, 3, "A7", "A7", 5)]
    # the hub files many alerts, some at the same time
    at = sorted(T0 + r.randrange(4 * 24) * 3_600_000_000 for _ in range(150))
    events = [(i + 1, "hub" if r.random() < 0.4 else f"A{r.randrange(40)}", t) for i, t in enumerate(at)]
    cases, want = [], {}
    for no, account, t in events:
        met = {account} | {x for p in rows if p["t_us"] <= t for x in ({p["from_id"], p["to_id"]} if account in (p["from_id"], p["to_id"]) else ())}
        case = next((c for c in cases if c[1] & met), None)
        if case is None:
            case = (no, set())
            cases.append(case)
        case[1].add(account)
        want[no] = case[0]
    ev = spark.createDataFrame(events, "event_no bigint, account_id string, at_us bigint")
    for split in (Split(), Split(hot_rows=20)):
        assert {x["event_no"]: x["case_event"] for x in Au.form_cases(ev, frame(spark, rows), split).collect()} == want
    assert len(set(want.values())) > 3
