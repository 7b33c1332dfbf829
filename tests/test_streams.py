"""Streams by micro-batches: repeated batches, late payments, lines that hold no payment."""

from util import T0, frame, pay, people, random_rows

from paysift.functions.registry_text import address_key
from paysift.functions.scalars import iso_time
from paysift.operators import audit
from paysift.operators import detectors as D
from paysift.params import R20, R21, Split
from paysift.sources import registry_files
from paysift.streaming import detect, ingest


def keys(df):
    return sorted((r["detector"], r["account_id"], r["row"]) for r in df.collect())


def test_repeated_batch_and_late_payment(spark, tmp_path):
    rows = [pay(0, 0, "V1", "M", 80_000), pay(1, 3600, "V2", "M", 80_000), pay(2, 7200, "M", "X", 60_000), pay(3, 9000, "M", "Y", 60_000), pay(4, 4 * 86400, "V1", "M", 80_000)]
    for rules, split, root in ((R20, Split(), f"{tmp_path}/a"), (R21, Split(hot_rows=2), f"{tmp_path}/b")):
        run = detect.account_sink(root, people(spark, rows), rules, split)
        run(frame(spark, [rows[0], rows[2]]), 0)
        run(frame(spark, [rows[3], rows[4]]), 1)
        # the second payment of M arrives last, and its batch is written twice
        run(frame(spark, [rows[1]]), 2)
        once = keys(detect.current_firings(spark, root))
        run(frame(spark, [rows[1]]), 2)
        assert keys(detect.current_firings(spark, root)) == once
        assert once == keys(D.primary_firings(frame(spark, rows), people(spark, rows), rules)[1])
    assert ("inflow_new_payers", "M", 1) in once


def test_landed_lines_never_vanish(spark, tmp_path):
    good = '{"txn_id":"T1","payer_vpa":"a@x","payee_vpa":"b@x","amount_inr":5,"timestamp":"2024-01-01T00:00:00"}'
    lines = [good, "junk", "junk", '{"payments": []}', '{"payments": "x"}', '{"payments": [%s, {"a": 1}]}' % good, '{"payments": [%s]}' % ",".join(["{}"] * 5001)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text("\n".join(lines))
    s = ingest.landed_payments(spark, f"{tmp_path}/in")
    s.writeStream.foreachBatch(ingest.ingest_sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/payments").count() == 2
    raw = sorted(r["raw"] for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect())
    assert raw == sorted([*lines[1:5], '{"a":1}', lines[6]])


def test_times_need_a_date(spark):
    from pyspark.sql import functions as F

    text = ["12:30:00", "T12:30", "2024", "2024-05-01", "2024-05-01T10:00:00+05:30", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(iso_time(F.col("t"))).collect()]
    assert [g is None for g in got] == [True, True, True, False, False, True, True]


def test_hashes_tell_rows_apart(spark):
    rows = [("a|", "b"), ("a", "|b"), (None, "~"), ("~", None), ("", None), (None, ""), ("1:a", ""), ("1", ":a")]
    df = spark.createDataFrame(rows, "x string, y string").select(audit.record_hash(("x", "y")))
    assert len({r[0] for r in df.collect()}) == len(rows)


def test_signature_is_hmac(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    for secret in ("s", "long " * 30):
        got = spark.createDataFrame([("bödy",)], "b string").select(audit.signature(F.col("b"), secret)).first()[0]
        assert got == "sha256=" + hmac.new(secret.encode(), "bödy".encode(), hashlib.sha256).hexdigest()


def test_long_addresses_stay_apart(spark):
    from pyspark.sql import functions as F

    a = "PLOT " * 100
    df = spark.createDataFrame([(a + "A1",), (a + "B2",)], "a string").select(address_key(F.col("a")))
    assert len({r[0] for r in df.collect()}) == 2


def test_headers_and_last_write(spark, tmp_path):
    import pytest

    mapped, rest = registry_files.map_headers(spark.createDataFrame([("x", "y", "z")], "`CIN ` string, `C.I.N` string, other string"), "companies")
    assert mapped.columns == ["cin"] and mapped.first()[0] == "x" and rest == ["C.I.N", "other"]
    with pytest.raises(ValueError):
        registry_files.map_headers(mapped.withColumnRenamed("cin", "q"), "companies")
    have = spark.createDataFrame([("1", None, 0, None)], "din string, name string, disqualified int, disqualified_note string")
    named = spark.createDataFrame([("1", "zz", 1), ("1", "aa", 2)], "din string, name string, seq int")
    dis = spark.createDataFrame([("1", None, "z", 1), ("1", None, "b", 2)], "din string, name string, note string, seq int")
    assert tuple(registry_files.upsert_directors(have, named, dis).first()) == ("1", "aa", 1, "b")


def test_context_has_no_cap_unless_asked(spark):
    from paysift.operators import graph

    rows = [pay(i, i * 60, f"P{i}", "M", 100) for i in range(12)]
    full = graph.context_edges(frame(spark, rows)).where("row = 11").count()
    capped = graph.context_edges(frame(spark, rows), max_fanin=4).where("row = 11").count()
    assert (full, capped) == (12, 4)


def _context_by_hand(rows):
    """(edges, ids added up, least, greatest) of each row id's two-hop context."""
    width, window = 5_000_000, 72 * 3600 * 1_000_000
    now, out = {}, {}
    for r in rows:
        now[r["t_us"] // width] = max(now.get(r["t_us"] // width, 0), r["t_us"])
    for r in rows:
        at = now[r["t_us"] // width]
        inside = [x for x in rows if at - window <= x["t_us"] <= at]
        nodes = {r["from_id"], r["to_id"]}
        nodes |= {x["from_id"] for x in inside if x["to_id"] in nodes}
        out.setdefault(r["row"], set()).update(x["row"] for x in inside if x["to_id"] in nodes)
    return {k: (len(v), sum(v), min(v), max(v)) for k, v in out.items() if v}


def test_context_sums_do_not_list_and_count_each_edge_once(spark):
    from paysift.operators import graph

    rows = [r | {"t_us": r["t_us"] // 4_000_000 * 4_000_000} for r in random_rows(11, 220, 14, days=6)]
    twice = [*rows, *rows[:30], rows[5] | {"to_id": "A9"}, rows[7] | {"t_us": rows[90]["t_us"]}, rows[8] | {"from_id": "A3", "to_id": "A0"}]
    for some in (rows, twice):
        df = graph.context_edges(frame(spark, some), summed=True)
        got = {r["row"]: (r["edges"], r["ctx_sum"], r["ctx_min"], r["ctx_max"]) for r in df.collect()}
        assert got == _context_by_hand(some)
    capped = graph.context_edges(frame(spark, rows), max_fanin=4, summed=True).agg({"edges": "sum"}).first()[0]
    assert capped == graph.context_edges(frame(spark, rows), max_fanin=4).count()


def test_context_sums_by_slices_of_payments(spark, monkeypatch):
    from paysift.operators import graph

    rows = random_rows(5, 120, 9)
    rows += [dict(rows[3]), {**rows[4], "from_id": "A8", "to_id": "A1"}, {**rows[5], "row": None}, {**rows[6], "row": None}]
    once, sums = [], lambda: sorted(tuple(-1 if x is None else x for x in r) for r in graph.context_edges(frame(spark, rows), summed=True).collect())
    want = sums()
    monkeypatch.setattr(graph, "ASKS_A_SLICE", 500, raising=False)
    tables = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: once.append("ctx_sum" in df.columns) or tables(df))
    assert sums() == want and sum(once) > 1


def test_context_asks_meet_a_node_over_many_batches(spark):
    """In-edges of a node that is still open are kept for the asks of the next batch."""
    import pyarrow as pa

    from paysift.operators.graph import DAY, _answers

    known = [(1, 0, 0, t, None, 10 * t, False) for t in range(5)] + [(2, 0, 0, t, None, t, t == 3) for t in range(7)]
    asks = [(2, 0, 1, 5 + DAY, i, None, i == 2) for i in range(4)] + [(2, 0, 1, 4, 9, None, False)]
    names = ["node", "day", "kind", "rel", "row", "value", "flag"]
    table = pa.table({n: pa.array([r[i] for r in known + asks], pa.bool_() if n == "flag" else pa.int64()) for i, n in enumerate(names)})
    for size in (3, 100):
        out = pa.Table.from_batches(list(_answers(iter(table.to_batches(size)), 2 * DAY, True))).to_pylist()
        sums = sorted((r["row"], r["n"], r["total"], r["low"], r["high"]) for r in out if r["n"])
        assert sums == [(0, 2, 11, 5, 6), (1, 2, 11, 5, 6), (3, 2, 11, 5, 6), (9, 4, 7, 0, 4)]
        assert sorted((r["row"], r["list"]) for r in out if r["list"]) == [(2, [5, 6]), (9, [3])]


def test_settlement_timers_hold_and_take_late_payments(spark, tmp_path):
    """A payment known only after its batch waits for the next one; a hold over two batches keeps all money back."""
    from paysift.params import DAY, HOUR
    from paysift.streaming import ingest
    from paysift.streaming.settlement import EVENTS, settlement_stream

    def at(day, hour):
        return T0 + day * DAY + hour * HOUR

    slices = [
        [(1, "pay", at(0, 9), at(0, 9), 500, 0, 0), (1, "pay", at(0, 10), at(0, 10), 700, 1, 0), (2, "pay", at(0, 11), at(0, 11), 40, 0, 0), (2, "hold", at(0, 12), at(0, 12), 0, 0, at(2, 12))],
        [(1, "pay", at(1, 7), at(0, 23), 9, 0, 0), (2, "pay", at(1, 8), at(1, 8), 60, 0, 0)],  # the first was made on day 0, known after its batch
        [(1, "pay", at(4, 1), at(4, 1), 3, 0, 0), (-1, "tick", at(5, 7), at(5, 7), 0, 0, 0)],
    ]
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    schema = spark.createDataFrame([], EVENTS).schema
    for name in ("once", "again"):  # again: one slice per run, so state and timers come back from the checkpoint
        for upto in [3] if name == "once" else [1, 2, 3]:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json([f"{tmp_path}/in/{{0,1,2}}", f"{tmp_path}/in/{{0,1}}", f"{tmp_path}/in/0"][3 - upto])
            out = settlement_stream(stream, T0)
            q = out.writeStream.foreachBatch(ingest.sink_to(f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/{name}_c").trigger(availableNow=True).start()
            q.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").drop("batch_id").collect())
        assert got == [
            (1, 1, False, 2, 1200, 700, None), (1, 2, False, 1, 9, 0, None), (1, 5, False, 1, 3, 0, None),
            (2, 1, True, 1, 40, 0, at(2, 12)), (2, 2, True, 2, 100, 0, at(2, 12)), (2, 3, False, 2, 100, 0, None),
        ]


def test_settlement_calls_the_state_once_per_group(spark):
    import pandas as pd

    from paysift.params import DAY, HOUR, P10
    from paysift.streaming import settlement

    calls, state, timers = [], [], []

    class Value:
        exists = lambda self: bool(state)
        get = lambda self: calls.append("get") or state[-1]
        update = lambda self, v: calls.append("update") or state.append(v)

    class Handle:
        getValueState = lambda self, name, schema: Value()
        getMapState = lambda self, *a: (_ for _ in ()).throw(AssertionError("a state of its own per merchant"))
        registerTimer = lambda self, ms: timers.append(ms)

    class Clock:
        getCurrentWatermarkInMs = lambda self: (T0 + 3 * DAY + 7 * HOUR) // 1000

    names = [c.split(" ")[0] for c in settlement._COMBINED.split(", ")]
    rows = [(m, "pay", T0 + b * DAY, b, 2, 10 * m, m, 0) for m in range(1, 200) for b in (2, 3, 5)] + [(7, "hold", T0, 0, 0, 0, 0, T0 + 4 * DAY)]
    s = settlement.Settlement(T0, P10)
    s.init(Handle())
    for part in (rows[:300], rows[300:]):
        list(s.handleInputRows((0,), iter([pd.DataFrame(part, columns=names)]), None))
    log = pd.concat(list(s.handleExpiredTimer((0,), Clock(), None)))
    assert len(log) == 2 * 199 and log["held"].sum() == 2 and log["payments"].sum() == 2 * 2 * 199 + 2
    # what a hold keeps back is due in the batch after the last one that was run
    due, *_, timer = s._load()
    assert (due[7, 4], due[7, 5], due[8, 5]) == ((4, 140, 14), (2, 70, 7), (2, 80, 8)) and timer == 4
    assert len(calls) <= 8 and len(timers) == 2


def test_d1_on_a_stream_equals_the_batch_detector(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from paysift.operators import merchant as Mr
    from paysift.params import DAY

    r = random.Random(12)
    rows = [(m, r.randrange(400), T0 + int(i * 9 * DAY / 600) + m, (i, m), float(r.choice([100, 150, 300, r.randint(90, 400)]))) for i in range(600) for m in (1, 2)]
    schema = "merchant_id bigint, payer_id bigint, t_us bigint, tie struct<i: int, m: bigint>, amount double"
    shops = spark.createDataFrame([(1, "kirana", T0 - 90 * DAY), (2, "kirana", T0)], "merchant_id bigint, category string, onboarded_us bigint")
    bars = spark.createDataFrame([("kirana", 290.0)], "category string, cat_p99 double")
    sink = detect.ticket_sink(str(tmp_path), shops, bars, split=Split(hot_rows=100))
    for i, lo in enumerate((0, 400, 800)):
        for _ in range(1 + (i == 1)):  # the second batch comes twice
            sink(spark.createDataFrame(rows[lo:lo + 400], schema), i)
    want = Mr.d1_alerts(Mr.first_payments(spark.createDataFrame(rows, schema)), shops, bars)
    got = detect.ticket_alerts(spark, str(tmp_path))
    assert sorted((x.merchant_id, x.t_us) for x in got.collect()) == sorted((x.merchant_id, x.t_us) for x in want.collect()) != []
    assert spark.read.parquet(f"{tmp_path}/tickets").agg(F.count("*")).first()[0] == len(rows)
