"""Text rules, percentiles, intervals, merchants, paths, models, registry and audit on hand-built rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import T0, frame, random_rows

from paysift.functions import registry_text as R
from paysift.functions import scalars as S
from paysift.operators import audit as Au
from paysift.operators import graph as Gr
from paysift.operators import merchant as Mr
from paysift.operators import metrics as M
from paysift.operators import models as Md
from paysift.operators import registry as G
from paysift.params import DAY, MerchantRules, Split
from paysift.session import cut
from paysift.sources import registry_files


def one(spark, expr, *values):
    return spark.createDataFrame([tuple(values)], ",".join(f"c{i} {'string' if isinstance(v, str) else 'double'}" for i, v in enumerate(values))).select(expr.alias("x")).first()["x"]


def test_digit_grouping(spark):
    for n, want in ((999.0, "₹999"), (1234.0, "₹1,234"), (1234567.0, "₹12,34,567"), (123456789.0, "₹12,34,56,789")):
        assert one(spark, S.group_indian(F.col("c0")), n) == want


def test_near_cap_edges(spark):
    for a, want in ((90_000.0, True), (100_000.0, True), (89_999.0, True), (89_998.0, False), (49_999.0, True), (9_999.0, True), (8_999.0, False), (100_001.0, False)):
        assert one(spark, S.near_cap(F.col("c0")), a) is want


def test_address_keys_collide_only_for_the_same_office(spark):
    key = lambda s: one(spark, R.address_key(F.col("c0")), s)
    assert key("12, M.G. Road, Pune") == key("12 M G RD PUNE") == "12 MG PUNE"
    assert key("Flat 3, 12 MG Road, Pune") != key("Flat 4, 12 MG Road, Pune")


def test_dates(spark):
    for s, want in (("05-03-2019", "2019-03-05"), ("5/3/2019", "2019-03-05"), ("2019-03-05", "2019-03-05"), ("05-Mar-2019", "2019-03-05"), ("05-Mar-19", "2019-03-05"), ("05/03/19", "2019-03-05"), ("2019/03/05", "2019-03-05"),
                    ("05.03.2019", "2019-03-05"), ("2019-03-05T10:11:12", "2019-03-05"), ("NA", None), ("", None), ("soon", None)):
        got = one(spark, R.parse_date(F.col("c0")), s)
        assert (got.isoformat() if got else None) == want, s


def test_director_numbers(spark):
    din = lambda s: one(spark, R.normal_din(F.col("c0")), s)
    assert din("12345.0") == "00012345" and din("123456789") == "123456789" and din(" ab1 ") == "AB1"


def test_headers_and_missing_columns(spark):
    d = spark.createDataFrame([("a", "b")], "`Company CIN` string, `Whatever` string")
    m, rest = registry_files.map_headers(d, "companies")
    assert m.columns == ["cin"] and rest == ["Whatever"]
    with pytest.raises(ValueError):
        registry_files.map_headers(d.select("Whatever"), "companies")


def test_percentiles_match_numpy(spark):
    r = random.Random(1)
    rows = [(g, float(r.choice([1, 5, 5, 7.5, 1e6, r.random() * 100, -3]))) for g in ("a", "b") for _ in range(301)]
    got = {x["g"]: x for x in M.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p1": 0.01, "p50": 0.5, "p999": 0.999}, ["g"]).collect()}
    for g in ("a", "b"):
        v = [x for k, x in rows if k == g]
        for n, q in (("p1", 1), ("p50", 50), ("p999", 99.9)):
            assert got[g][n] == pytest.approx(np.percentile(v, q))


def test_exact_interval(spark):
    x = spark.createDataFrame([(45, 57), (0, 10), (10, 10)], "k int, n int").select("k", M.clopper_pearson("k", "n").alias("c")).collect()
    assert x[0]["c"]["lo"] == pytest.approx(0.6611, abs=2e-3) and x[0]["c"]["hi"] == pytest.approx(0.8862, abs=2e-3)
    assert x[1]["c"]["lo"] == 0.0 and x[1]["c"]["hi"] == pytest.approx(1 - 0.025 ** 0.1, abs=1e-9)
    assert x[2]["c"]["lo"] == pytest.approx(0.025 ** 0.1, abs=1e-9) and x[2]["c"]["hi"] == 1.0


def test_own_p99_equals_numpy(spark):
    """The merchant's own bar against a recomputed percentile on every candidate."""
    r = random.Random(4)
    rows = [(1, i % 40 + 1000 * (i % 7 == 0) * i, 1, float(r.choice([100, 200, 900, 1000, r.randint(100, 1200)])), T0 + i * 3_000_000_000) for i in range(400)]
    p = spark.createDataFrame(rows, "merchant_id bigint, payer_id bigint, payer_state bigint, amount double, t_us bigint").withColumn("tie", F.struct("t_us", "payer_id"))
    m = spark.createDataFrame([(1, "kirana", T0 - 90 * DAY)], "merchant_id bigint, category string, onboarded_us bigint")
    bars = spark.createDataFrame([("kirana", 150.0)], "category string, cat_p99 double")
    f = Mr.first_payments(p, Split(hot_rows=5))
    hot = Mr.hot_merchants(p, Split(hot_rows=5))
    got = {x["t_us"] for x in Mr.above_bar(f, m, bars, MerchantRules(), hot, Split(hot_rows=5)).collect()}
    assert got == {x["t_us"] for x in Mr.above_bar(f, m, bars, MerchantRules()).collect()}
    seen, want = set(), set()
    for i, (_, payer, _, a, t) in enumerate(rows):
        first = payer not in seen
        seen.add(payer)
        own = [x[3] for x in rows[:i] if x[4] >= t - 7 * DAY]
        bar = max(150.0, np.percentile(own, 99)) if len(own) >= 50 else 150.0
        if first and a >= bar:
            want.add(t)
    assert got == want and want


def test_rank_blocks_cover_a_range_once(spark):
    r = random.Random(3)
    spans = [(lo, lo + r.randrange(0, 700)) for lo in (r.randrange(3000) for _ in range(200))] + [(0, 3 * 8**6 + 5), (7, 8), (0, 0)]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint").selectExpr("lo", "hi", f"{Mr._rank_blocks('lo', 'hi')} AS blocks")
    for x in df.collect():
        parts = sorted((b["block"] << 3 * b["level"], (b["block"] + 1) << 3 * b["level"]) for b in x["blocks"])
        ends = [x["lo"], *(e for _, e in parts)]
        assert [s for s, _ in parts] == ends[:-1] and ends[-1] == max(x["lo"], x["hi"]) and len(parts) <= 14 * 7 + 3


def test_shared_settlement_needs_different_entities(spark):
    m = spark.createDataFrame([(1, "S", "E1", T0), (2, "S", "E1", T0 + 5), (3, "S", "E2", T0 + 9), (4, "Z", "E1", T0)], "merchant_id bigint, settlement_account string, legal_entity string, onboarded_us bigint")
    assert {(r["merchant_id"], r["t_us"]) for r in Mr.d4_alerts(m, T0).collect()} == {(1, T0 + 9), (2, T0 + 9), (3, T0 + 9)}


def test_paths_equal_depth_first_search(spark):
    rows = random_rows(8, 120, 9)
    out = {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["row"])):
        out.setdefault(r["from_id"], []).append(r)
    def walk(at, after, nodes, legs, acc):
        for x in out.get(at, []):
            if x["t_us"] < after or x["to_id"] in nodes or len(acc) >= 40:
                continue
            acc.append(legs + [x["row"]])
            if len(legs) + 1 < 4:
                walk(x["to_id"], x["t_us"], nodes + [x["to_id"]], legs + [x["row"]], acc)
    seeds = spark.createDataFrame([(f"A{i}",) for i in range(9)], "account_id string")
    p = Gr.downstream_paths(frame(spark, rows), seeds, 4, 40).collect()
    for i in range(9):
        acc = []
        walk(f"A{i}", -1, [f"A{i}"], [], acc)
        mine = [[x["r"] for x in r["legs"]] for r in sorted((r for r in p if r["seed"] == f"A{i}"), key=lambda r: r["path_no"])]
        assert mine == acc[:40]


def _forward(rows, w, window=None, at=None):
    """Plain two-layer message passing with numpy, over the edges visible at one moment."""
    nodes = sorted({r["from_id"] for r in rows} | {r["to_id"] for r in rows})
    x = {n: w["node_b"].copy() for n in nodes}
    e = {r["row"]: np.array(r["features"]) @ w["edge_w"] + w["edge_b"] for r in rows}
    for i in (1, 2):
        agg = {n: np.zeros_like(w["node_b"]) for n in nodes}
        for r in rows:
            agg[r["to_id"]] = agg[r["to_id"]] + np.maximum(x[r["from_id"]] + e[r["row"]], 0)
        x = {n: Md._update(w, i, x[n][None], agg[n][None])[0] for n in nodes}
    return {r["row"]: Md._readout(w, x[r["from_id"]][None], x[r["to_id"]][None], e[r["row"]][None])[0, 0] for r in rows}


def test_message_passing_equals_numpy(spark):
    r = random.Random(2)
    rows = [dict(x, features=[r.random(), r.random(), float(r.random() < 0.5)]) for x in random_rows(6, 60, 8)]
    w = Md.load_weights(Md.weights_table(spark))
    df = spark.createDataFrame([(x["row"], x["t_us"], x["from_id"], x["to_id"], x["features"]) for x in rows], "row bigint, t_us bigint, from_id string, to_id string, features array<double>")
    want = _forward(rows, w)
    for x in Md.score_edges(df, w).collect():
        assert x["probability"] == pytest.approx(want[x["row"]], abs=1e-9)
    # in time: every edge sees the edges up to its own five-second bucket and inside the window
    day = 86_400
    got = {x["row"]: x["probability"] for x in Md.score_edges_in_time(df, w, window_s=day, split=Split(hot_rows=5)).collect()}
    for x in rows:
        now = max(y["t_us"] for y in rows if y["t_us"] // 5_000_000 == x["t_us"] // 5_000_000)
        seen = [y for y in rows if now - day * 1_000_000 <= y["t_us"] <= now]
        assert got[x["row"]] == pytest.approx(_forward(seen, w)[x["row"]], abs=1e-6)


def test_second_layer_corrections_are_linear_in_a_hub(spark):
    many = lambda n: [(i, T0 + i * 60_000_000, f"p{i}" if i % 2 else "hub", "hub" if i % 2 else f"q{i}") for i in range(n)]
    # a node paid by many, one that pays many, and both at once
    for make, most in ((lambda n: [(i, t, f"p{i}", "hub") for i, t, *_ in many(n)], 1), (lambda n: [(i, t, "hub", f"q{i}") for i, t, *_ in many(n)], 1), (many, 2)):
        for n in (60, 240):
            e = spark.createDataFrame(make(n), "row int, t_us bigint, from_id string, to_id string").withColumn("now_us", F.col("t_us"))
            asked = e.select(F.explode(F.array("from_id", "to_id")).alias("node"), "now_us").distinct()
            assert Md.refresh_points(e, asked, 72 * 3600, split=Split(hot_rows=20)).count() <= most * n


def test_scoring_in_time_writes_no_more_rows_than_asks(spark, monkeypatch):
    """Messages, many per edge, go from the sources to the receivers without being written or moved by their edge."""
    r = random.Random(4)
    rows = [(i, T0 + i * 600_000_000, f"n{r.randrange(5)}", f"n{r.randrange(5)}", [r.random() for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "row int, t_us bigint, from_id string, to_id string, features array<double>")
    w = Md.load_weights(Md.weights_table(spark))
    written, cut = [], Md.cut

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(Md, "cut", counted)
    alone = [{x["row"]: x["probability"] for x in Md.score_edges_in_time(df, w, refresh_s=s).collect()} for s in (None, 7200)]
    assert max(written) <= 2 * len(rows)
    once = len(written)
    exact, cached = Md.score_edges_both(df, w, 7200)
    assert len(written) - once < once
    for got, want in zip((exact, cached), alone, strict=True):
        assert {x["row"]: x["probability"] for x in got.collect()} == pytest.approx(want, abs=1e-12)
    assert alone[0] != pytest.approx(alone[1], abs=1e-6)


def test_scoring_in_time_by_slices_of_receivers(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, T0 + i * 600_000_000, f"n{r.randrange(9)}", f"n{r.randrange(9)}", [r.random() for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "row int, t_us bigint, from_id string, to_id string, features array<double>")
    w = Md.load_weights(Md.weights_table(spark))
    most, layer = [], Md._second_layer
    monkeypatch.setattr(Md, "_second_layer", lambda seen, *a: most.append(seen[0].count()) or layer(seen, *a))
    scores = []
    for at_once, refresh in ((1000, None), (30, None), (1000, 7200), (45, 7200)):
        monkeypatch.setattr(Md, "EDGES_A_SLICE", at_once, raising=False)
        most.clear()
        scores.append({x["row"]: x["probability"] for x in Md.score_edges_in_time(df, w, refresh_s=refresh).collect()})
        assert sum(most) == 90 and len(most) == max(1, 90 // at_once)
    assert scores[1] == pytest.approx(scores[0], abs=1e-12) and scores[3] == pytest.approx(scores[2], abs=1e-12)


def test_shuffle_files_go_once_a_table_is_written(spark, tmp_path):
    from paysift.session import cut, prepare

    df = prepare(spark).range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = lambda: set(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = len([f for f in kept() if "shuffle_" in f.getName()])
    assert cut(df).count() == 7
    assert len([f for f in kept() if "shuffle_" in f.getName()]) <= before


def test_scoring_in_time_with_a_null_feature(spark):
    """An edge without a feature sends nothing: the others are scored as if it were not there."""
    r = random.Random(6)
    rows = [(i, T0 + i * 600_000_000, f"n{i % 3}", f"n{(i * 2 + 1) % 3}", [r.random() if i != 4 else None for _ in range(3)]) for i in range(12)]
    kind = "row int, t_us bigint, from_id string, to_id string, features array<double>"
    w = Md.load_weights(Md.weights_table(spark))
    got, want = ({x["row"]: x["probability"] for x in Md.score_edges_in_time(spark.createDataFrame(part, kind), w).collect()} for part in (rows, [x for x in rows if x[0] != 4]))
    assert {k: v for k, v in got.items() if k != 4} == pytest.approx(want, abs=1e-9)


def test_cached_scores_use_the_last_refresh(spark):
    r = random.Random(8)
    day = 86_400
    rows = [{"row": i, "t_us": T0 + r.randrange(2 * day) * 1_000_000, "from_id": f"n{r.randrange(7)}", "to_id": f"n{r.randrange(7)}", "features": [r.random() for _ in range(3)]} for i in range(70)]
    df = spark.createDataFrame(rows, "row int, t_us bigint, from_id string, to_id string, features array<double>")
    w = Md.load_weights(Md.weights_table(spark))
    for refresh in (7200, 40_000):
        got = {x["row"]: x["probability"] for x in Md.score_edges_in_time(df, w, window_s=day, refresh_s=refresh, split=Split(hot_rows=9)).collect()}
        for x in rows:
            now = max(y["t_us"] for y in rows if y["t_us"] // 5_000_000 == x["t_us"] // 5_000_000)
            assert got[x["row"]] == pytest.approx(_cached(rows, w, now, x, day * 1_000_000, refresh * 1_000_000), abs=1e-6)


def _cached(rows, w, now, x, window, step):
    """One edge's score by the two layers written out, sources' embeddings as of the last refresh."""
    x0, last = w["node_b"], now // step * step
    at = lambda t, v: [y for y in rows if y["to_id"] == v and t - window <= y["t_us"] <= t]
    emb = lambda y: np.array(y["features"]) @ w["edge_w"] + w["edge_b"]
    zero = np.zeros((1, len(x0)))
    one = lambda v, t: Md._update(w, 1, x0[None], zero + sum(np.maximum(emb(y) + x0, 0) for y in at(t, v)))
    born = lambda v: min(y["t_us"] for y in rows if v in (y["from_id"], y["to_id"]))
    src = lambda v: one(v, last if born(v) <= last else now)
    two = lambda v: Md._update(w, 2, one(v, now), zero + sum(np.maximum(emb(y) + src(y["from_id"]), 0) for y in at(now, v)))
    return float(Md._readout(w, two(x["from_id"]), two(x["to_id"]), emb(x)[None])[0, 0])


def test_common_control_equals_pairing(spark):
    r = random.Random(9)
    comp = [(f"C{i}", f"{2000 + r.randrange(6)}-0{1 + r.randrange(9)}-01") for i in range(25)]
    seats = sorted({(c, f"D{r.randrange(9)}") for c, _ in comp for _ in range(4)})
    d = spark.createDataFrame([(c, x, None, 0) for c, x in seats], "cin string, din string, ceased_on date, disqualified int")
    c = spark.createDataFrame(comp, "cin string, s string").withColumn("incorporated_on", F.to_date("s"))
    got = {x["cin"]: (x["group_n"], x["batch_n"]) for x in G.common_control(d, c, "2026-01-01").collect()}
    import datetime as dt
    board = {}
    for k, x in seats:
        board.setdefault(k, set()).add(x)
    on = {k: dt.date.fromisoformat(s) for k, s in comp}
    for k, b in board.items():
        if len(b) < 2:
            continue
        g = [o for o, ob in board.items() if o != k and len(b & ob) >= 2]
        assert got[k] == (len(g), sum(abs((on[o] - on[k]).days) <= 365 for o in g))


def test_audit_chain_finds_the_first_change(spark):
    rows = [("r", i, T0 + i, None, "note", "ann", "analyst", f"n{i}", None, "A1", None, None) for i in range(30)]
    e = spark.createDataFrame(rows, "run_id string, entry_id bigint, at_us bigint, sim_us bigint, action string, actor string, role string, note string, alert_id string, account_id string, case_id string, payload string")
    s = cut(Au.seal(e))
    ok = Au.verify(s, Split(hot_rows=5)).first()
    assert ok["ok"] and ok["entries"] == 30
    edited = s.withColumn("note", F.when(F.col("entry_id") == 12, "x").otherwise(F.col("note")))
    assert (lambda v: (v["ok"], v["first_bad_entry"], v["reason"]))(Au.verify(edited).first()) == (False, 12, "content does not match its hash")
    gone = s.where("entry_id <> 20")
    assert Au.verify(gone).first()["first_bad_entry"] == 21




def _tickets(spark, n):
    r = random.Random(3)
    rows = [(k % 3, r.randrange(40), r.randrange(12 * DAY // 1_000_000) * 1_000_000, k, float(r.randrange(100, 900))) for k in range(n)]
    return spark.createDataFrame(rows, "merchant_id bigint, payer_id bigint, t_us bigint, tie bigint, amount double")


def test_placed_windows(spark):
    """Numbers and windows of tickets, hot merchants and others, against a count ticket by ticket."""
    p = _tickets(spark, 300)
    m = spark.createDataFrame([(k, "c", 0) for k in range(3)], "merchant_id bigint, category string, onboarded_us bigint")
    bars = spark.createDataFrame([("c", 1e9)], "category string, cat_p99 double")
    rows = [tuple(x) for x in p.collect()]
    want = {}
    for mid, _, t, tie, a in rows:
        mine = sorted((u, k) for q, _, u, k, _ in rows if q == mid)
        no = mine.index((t, tie)) + 1
        want[mid, tie] = (no, sum(u < t - 7 * DAY for u, _ in mine), no - 1, a)
    for split in (Split(), Split(hot_rows=50)):
        hot = Mr.hot_merchants(p, split)
        assert (hot is None) == (split.hot_rows > 50)
        got = Mr.placed(Mr.first_payments(p, split), m, bars, MerchantRules(), hot, split).collect()
        assert {(x["merchant_id"], x["tie"]): (x["no"], x["lo"], x["hi"], x["top_amount"]) for x in got} == want


def test_tickets_move_once(spark):
    """Marking and placing the tickets of merchants that are not hot shuffles them once."""
    p = _tickets(spark, 300).localCheckpoint()
    m = spark.createDataFrame([(0, "c", 0)], "merchant_id bigint, category string, onboarded_us bigint")
    bars = spark.createDataFrame([("c", 1.0)], "category string, cat_p99 double")
    plan = Mr.placed(Mr.first_payments(p), m, bars)._jdf.queryExecution().executedPlan().toString()
    by = [x.split("hashpartitioning(")[1] for x in plan.splitlines() if "Exchange hashpartitioning(merchant_id" in x]
    assert any("REPARTITION" in x for x in by) and not any("payer_id" in x or "tie" in x for x in by)
