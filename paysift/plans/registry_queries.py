"""Registered queries: scalar rules, file sources, wire payments, registry imports and linkage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry_text as R
from ..functions import scalars as S
from ..operators import profiles as P
from ..operators import registry as G
from ..params import DAY, LIVE, SPLIT_DAYS
from ..session import checkpoint_dir, cut
from ..sources import files, registry_files, wire
from . import views as V
from .account_queries import stored_alerts
from .profile_queries import applicants as vpa_applicants
from .profile_queries import onboarding

QUERIES = {}
NOW_US = V.BASE_US + 10 * DAY


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


# ------------------------------------------------------------------ scalar rules


@query("dense_account_ids")
def dense(spark, sf):
    p = V.payments(spark, sf)
    return files.dense_ids(p, ["row"], F.floor(F.col("row") / 65_536), ["from_id", "to_id"], "id")


@query("edge_clock_seconds")
def clock(spark, sf):
    return files.payment_edges(V.payments(spark, sf)).select("edge_id", "timestamp")


@query("timestamp_parsing")
def ts_parsing(spark, sf):
    """Times written in four layouts and one unknown one."""
    p = V.payments(spark, sf).select("row", F.date_trunc("minute", F.timestamp_micros("t_us")).alias("t"))
    fmt = F.col("row") % 5
    text = (F.when(fmt == 0, F.date_format("t", "yyyy/MM/dd HH:mm")).when(fmt == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")).when(fmt == 2, F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
            .when(fmt == 3, F.date_format("t", "dd/MM/yyyy HH:mm")).otherwise(F.concat(F.lit("t"), F.col("row").cast("string"))))
    return p.select("row", F.unix_micros(S.parse_ts(text)).alias("parsed_us"))


@query("iso_time_normalised")
def iso(spark, sf):
    p = V.payments(spark, sf).select("row", F.timestamp_micros("t_us").alias("t"))
    base = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("row") % 4 == 0, F.concat(base, F.lit("+05:30"))).when(F.col("row") % 4 == 1, F.concat(base, F.lit("Z"))).when(F.col("row") % 4 == 2, base).otherwise("")
    text = F.when(F.col("row") % 16 == 3, F.date_format("t", "HH:mm:ss")).when(F.col("row") % 16 == 7, F.date_format("t", "'T'HH:mm")).when(F.col("row") % 16 == 11, F.date_format("t", "yyyy")).otherwise(text)
    return p.select("row", F.unix_micros(S.iso_time(text)).alias("utc_us"))


@query("edge_features")
def edge_features(spark, sf):
    e = files.payment_edges(V.payments(spark, sf))
    return e.select("edge_id", F.round(S.hour_of_day(F.col("timestamp")), 9).alias("hour_of_day"), F.round(S.log_amount(F.col("amount_received")), 9).alias("log_amount"), F.col("payment_format").alias("p2m"))


@query("near_cap_flags")
def near(spark, sf):
    return V.payments(spark, sf).select("row", "near")


@query("indian_digit_grouping")
def grouping(spark, sf):
    p = V.payments(spark, sf).groupBy("to_id").agg((F.sum("amount_p") / 100).alias("t"))
    one = V.payments(spark, sf).select(F.col("row").cast("string").alias("k"), F.col("amount").alias("t"))
    return p.select(F.col("to_id").alias("k"), "t").union(one).select("k", S.group_indian(F.col("t")).alias("text"))


@query("state_pairs")
def states(spark, sf):
    pair = F.concat("from_state", F.lit(" → "), "to_state")
    p = V.payments(spark, sf).withColumn("pair", pair).where(F.lower("pair").contains("s1"))
    return p.groupBy("pair", (F.col("from_state") != F.col("to_state")).alias("mismatch")).agg(F.count(F.lit(1)).alias("n"))


@query("score_bands")
def bands(spark, sf):
    return V.payments(spark, sf).groupBy(S.score_band(F.col("score")).alias("band"), S.score_reading(F.col("score")).alias("reading")).agg(F.count(F.lit(1)).alias("n"))


@query("time_buckets")
def buckets(spark, sf):
    return V.payments(spark, sf).groupBy(S.time_bucket(F.col("t_us"), 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("z_normalised_edges")
def znorm(spark, sf):
    """Each split normalised with its own mean and sample deviation (0 becomes 1): train, train+val, all."""
    e = V.payments(spark, sf).select("row", "t_us", S.log_amount(F.col("amount")).alias("x"), ((F.col("t_us") - V.BASE_US) / 1e6).alias("t"))
    ends = {"train": SPLIT_DAYS["train"][1], "train_val": SPLIT_DAYS["val"][1], "all": SPLIT_DAYS["test"][1]}
    scope = F.explode(F.array(*[F.when(F.col("t_us") < V.BASE_US + d * DAY, F.lit(n)) for n, d in ends.items()]))
    s = e.select("*", scope.alias("scope")).where("scope IS NOT NULL")
    st = s.groupBy("scope").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "t") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = s.join(F.broadcast(st), "scope")  # three rows
    return z.select("scope", "row", *[F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")), 6).alias(f"z_{c}") for c in ("x", "t")])


@query("feature_statistics")
def feature_stats(spark, sf):
    t = V.payments(spark, sf).where(F.col("t_us") < V.BASE_US + SPLIT_DAYS["train"][1] * DAY).select(S.log_amount(F.col("amount")).alias("x"))
    return t.agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_samp("x"), 9).alias("std"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ files


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, df: DataFrame) -> str:
    path = _folder(spark)
    df.write.option("header", True).csv(path)
    return path


@query("payments_csv_source")
def payments_csv(spark, sf):
    """Payments written as CSV without a channel column and read back."""
    # in files that follow each other in the order of their names
    ordered = V.payments(spark, sf).repartitionByRange(5, "row").sortWithinPartitions("row")
    p = ordered.select("txn_id", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("from_id").alias("sender_id"), F.col("from_vpa").alias("sender_vpa"),
                                     F.col("from_state").alias("sender_state"), F.col("to_id").alias("recv_id"), F.col("to_vpa").alias("recv_vpa"), F.col("to_state").alias("recv_state"), F.col("amount").alias("amount_inr"), "is_fraud", "layer")
    return files.read_payments(spark, _csv(spark, p)).select("row", "txn_id", "t_us", "from_id", "to_id", "amount", "channel", "is_fraud", "layer")


@query("accounts_csv_source")
def accounts_csv(spark, sf):
    return files.read_accounts(spark, _csv(spark, V.accounts(spark, sf)))


@query("merchant_folder_source")
def merchant_folder(spark, sf):
    root = _folder(spark)
    m = V.merchants(spark, sf)
    t = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss")
    none = F.lit(None).cast("string")
    m.select("merchant_id", none.alias("vpa"), "category", "state", "legal_entity", "settlement_account", t("onboarded_us").alias("onboarded_at"), none.alias("chain"), "is_fraud", none.alias("scenario"), none.alias("campaign")).write.option("header", True).csv(f"{root}/merchants")
    p = V.merchant_payments(spark, sf)
    p.select(none.alias("txn_id"), "payer_id", none.alias("payer_vpa"), "payer_state", "merchant_id", F.round("amount").cast("bigint").alias("amount_inr"), t("t_us").alias("timestamp"), F.lit("qr").alias("initiation"), "is_fraud", none.alias("campaign")).write.option("header", True).csv(f"{root}/payments")
    c = V.collects(spark, sf)
    c.select("request_id", "merchant_id", "payer_id", none.alias("payer_state"), F.lit(1).alias("amount_inr"), t("requested_us").alias("requested_at"), t("resolved_us").alias("resolved_at"), "outcome", "known_payer", "is_fraud", none.alias("campaign")).write.option("header", True).csv(f"{root}/collects")
    mm, pp, cc = files.read_merchant_folder(spark, root)
    a = pp.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("payments"))
    b = cc.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("collects"))
    return mm.join(a, "merchant_id", "left").join(b, "merchant_id", "left").select(F.col("merchant_id").cast("bigint").alias("merchant_id"), "category", "chain", "scenario", F.coalesce("payments", F.lit(0)).alias("payments"), F.coalesce("collects", F.lit(0)).alias("collects"))


def _raw_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bank transfers with variant headers and empty alternatives."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy/MM/dd HH:mm").alias("Timestamp"), (F.col("o_custkey") % 7).cast("string").alias("From Bank"), F.col("o_custkey").cast("string").alias("From Account"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("Payer"), (k % 5).cast("string").alias("To Bank"), (k % 100).cast("string").alias("To Account"), F.col("o_totalprice").cast("string").alias("Amount Paid"),
        F.when(k % 3 == 0, "").otherwise(F.round(F.col("o_totalprice") * 2, 2).cast("string")).alias("Amount Received"), F.element_at(F.array(F.lit("Rupee"), F.lit("Dollar"), F.lit("Euro")), (k % 3 + 1).cast("int")).alias("Payment Currency"),
        F.when(k % 4 == 0, "Yen").otherwise("Rupee").alias("Receiving Currency"), F.col("o_orderpriority").alias("Payment Format"), F.when(k % 50 == 0, "1").otherwise("0").alias("Is Laundering"))


@query("canonical_edges")
def canonical(spark, sf):
    return files.canonical_edges(_raw_transfers(spark, sf))


@query("legacy_edges")
def legacy(spark, sf):
    raw = _raw_transfers(spark, sf).withColumn("Timestamp", F.when(F.col("row") % 11 == 3, "n/a").otherwise(F.col("Timestamp"))).withColumn("Amount Received", F.when(F.col("Amount Received") == "", F.col("Amount Paid")).otherwise(F.col("Amount Received")))
    return files.legacy_edges(raw)


@query("own_edges")
def own_edges(spark, sf):
    return files.payment_edges(V.payments(spark, sf))


@query("labelled_graph_source")
def labelled_graph(spark, sf):
    """Customers as nodes (class by key), orders of one customer to the next as edges, read back from headerless CSV."""
    c = V.table(spark, sf, "customer")
    f, root = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 49 + 1).alias("step"), "c_acctbal"), _folder(spark)
    f.write.csv(f"{root}/features")
    x = spark.read.schema("id bigint, step int, f1 double").csv(f"{root}/features")
    k = c.where("c_custkey % 5 <> 4").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "1").when(F.col("c_custkey") % 7 < 4, "2").otherwise("unknown").alias("class"))
    e = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 13).alias("b"))
    nodes, edges = files.labelled_graph(x, k, e)
    out = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(out, "id", "left").groupBy("step", "y").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.coalesce("edges", F.lit(0))).alias("edges"))


# ------------------------------------------------------------------ wire payments


def wire_messages(spark, sf) -> DataFrame:
    """Gateway JSON of every payment, a few of them damaged in known ways."""
    g = wire.gateway_view(V.payments(spark, sf))
    r = F.col("row")
    v = (F.when(r % 101 == 0, F.substring("value", 1, 20)).when(r % 103 == 0, F.regexp_replace("value", '"amount_inr":[0-9.E]+', '"amount_inr":-1.0')).when(r % 107 == 0, F.regexp_replace("value", '"payer_vpa":"[^"]*"', '"payer_vpa":"a"'))
         .when(r % 109 == 0, F.regexp_replace("value", '"txn_id":"[^"]*"', '"txn_id":""')).when(r % 113 == 0, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"soon"')).otherwise(F.col("value")))
    return g.select(F.lit("file").alias("source"), F.col("row").alias("position"), v.alias("value"))


@query("wire_payment_validation")
def validation(spark, sf):
    p = wire.parse_payments(wire_messages(spark, sf))
    return p.select("position", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.col("amount_inr")).alias("amount"), F.when(F.col("error").isNull(), F.unix_micros("ts")).alias("ts_us"))


@query("dead_letter_table")
def dead(spark, sf):
    return wire.dead_letters(wire.parse_payments(wire_messages(spark, sf))).select("source", "position", "error")


@query("gateway_wire_view")
def gateway(spark, sf):
    g = wire.gateway_view(V.payments(spark, sf))
    return g.select("row", *[F.get_json_object("value", f"$.{n}").alias(n) for n in ("txn_id", "payer_vpa", "payee_vpa", "timestamp", "payer_state", "payee_account_id")])


def _outbox(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in (200, 500, 404, 408, 429, 503, 202)])
    return o.select(k.alias("id"), F.element_at(codes, (k % 7 + 1).cast("int")).alias("http_status"), (F.col("o_custkey") % 6).cast("int").alias("attempts"), F.when(k % 3 == 0, "delivered").otherwise("pending").alias("status"),
                    (F.lit(NOW_US) + (k % 11 - 5) * 1_000_000).alias("next_attempt_us"))


@query("outbox_transitions")
def outbox(spark, sf):
    return wire.next_delivery_state(_outbox(spark, sf).drop("next_attempt_us", "status"), NOW_US)


@query("outbox_due_items")
def outbox_due(spark, sf):
    return wire.due_items(_outbox(spark, sf), NOW_US)


# ------------------------------------------------------------------ registry


def raw_companies(spark, sf) -> DataFrame:
    """Company master rows as a download would show them: vendor headers, mixed date layouts, a few bad identifiers."""
    c = V.companies(spark, sf)
    n = F.col("no")
    d = F.when(n % 4 == 0, F.date_format("incorporated_on", "dd-MM-yyyy")).when(n % 4 == 1, F.date_format("incorporated_on", "yyyy/MM/dd")).when(n % 4 == 2, F.date_format("incorporated_on", "dd-MMM-yyyy")).otherwise("NA")
    return c.select(
        F.when(n % 17 == 0, F.concat(F.lit("X"), "cin")).when(n % 5 == 0, F.concat(F.lit(" "), F.lower("cin"))).otherwise(F.col("cin")).alias("Corporate Identification Number"), F.col("name").alias("Company Name"),
        F.col("status").alias("COMPANY_STATUS"), d.alias("Date of Registration"), F.col("address").alias("Registered Office Address"), F.concat(F.lit("INR "), F.format_number("paid_up_capital", 2)).alias("PaidUp Capital (Rs)"),
        F.concat(F.lit("FY "), F.col("last_annual_return").cast("string")).alias("Latest Year Annual Return"), F.lit("x").alias("Extra"))


@query("registry_import_companies")
def import_companies(spark, sf):
    raw = spark.read.option("header", True).csv(_csv(spark, raw_companies(spark, sf)))
    mapped, _ = registry_files.map_headers(raw, "companies")
    c = registry_files.clean(mapped, "companies")
    return c.select("cin", "name", "status", F.date_format("incorporated_on", "yyyy-MM-dd").alias("incorporated_on"), "paid_up_capital", "address_key", "last_annual_return", F.coalesce("error", F.lit("")).alias("error"))


@query("registry_import_report")
def import_report(spark, sf):
    mapped, unmapped = registry_files.map_headers(raw_companies(spark, sf), "companies")
    return registry_files.import_report(registry_files.clean(mapped, "companies"), "companies").withColumn("unmapped", F.lit(",".join(unmapped)))


@query("registry_import_rejects")
def import_rejects(spark, sf):
    """The first 20 rejects of a directorship and account import (a report limit)."""
    d = V.directorships(spark, sf).select(F.when(F.col("din").cast("int") % 6 == 0, "bad").otherwise(F.col("cin")).alias("CIN"), F.when(F.col("din").cast("int") % 10 == 0, " ").otherwise(F.col("din")).alias("DIN"))
    c = registry_files.clean(registry_files.map_headers(d, "directorships")[0], "directorships").where("error IS NOT NULL")
    v = V.entity_accounts(spark, sf).select(F.col("cin").alias("CIN"), F.when(F.col("cin").endswith("7"), "novpa").otherwise(F.col("vpa")).alias("Settlement VPA"))
    e = registry_files.clean(registry_files.map_headers(v, "accounts")[0], "accounts").where("error IS NOT NULL")
    return c.select("error").union(e.select("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("registry_upsert")
def upsert(spark, sf):
    """A table of even companies, then a batch of multiples of three sent twice with different names."""
    c = V.companies(spark, sf)
    table = c.where("no % 2 = 0").select("cin", "name", "status")
    b = c.where("no % 3 = 0").select("cin", F.concat(F.lit("new "), "name").alias("name"), F.lit("Active").alias("status"), F.col("no").alias("o"))
    batch = b.unionByName(b.select("cin", F.concat(F.lit("last "), "name").alias("name"), "status", (F.col("o") + 1_000_000_000).alias("o")))
    return registry_files.upsert(table, batch, ("cin",), "o")


@query("registry_upsert_directors")
def upsert_directors(spark, sf):
    d = V.directorships(spark, sf).select("din").distinct()
    n = F.col("din").cast("int")
    have = d.where(n % 2 == 0).select("din", F.when(n % 4 == 0, F.concat(F.lit("old "), "din")).alias("name"), F.lit(0).alias("disqualified"), F.lit(None).cast("string").alias("disqualified_note"))
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    named = d.where(n % 3 == 0).select("din", twice).select("din", "seq", F.concat(F.when(F.col("seq") == 1, "zzz ").otherwise("dir "), "din").alias("name"))
    dis = d.where(n % 11 == 0).select("din", twice).select("din", "seq", F.lit(None).cast("string").alias("name"), F.when(F.col("seq") == 1, "z. 999").otherwise("s.164(2)").alias("note"))
    return registry_files.upsert_directors(have, named, dis)


@query("registry_identifiers")
def identifiers(spark, sf):
    c = V.companies(spark, sf)
    raw = F.when(F.col("no") % 6 == 0, F.concat(F.lit("AAB-"), F.lpad((F.col("no") % 10000).cast("string"), 4, "0"))).when(F.col("no") % 6 == 1, F.lit("junk")).otherwise(F.concat(F.lit(" "), F.lower("cin")))
    din = F.when(F.col("no") % 3 == 0, F.concat(F.col("no").cast("string"), F.lit(".0"))).when(F.col("no") % 3 == 1, F.concat(F.lit("p"), F.col("no").cast("string"))).otherwise(F.concat(F.lit("1234567"), F.col("no").cast("string")))
    x = c.select("no", R.normal_cin(raw).alias("cin"), R.normal_din(din).alias("din")).withColumn("f", R.cin_facts(F.col("cin")))
    return x.select("no", "cin", "din", "f.valid", "f.kind", F.coalesce("f.listed", F.lit(False)).alias("listed"), F.coalesce("f.state", F.lit("")).alias("state"), F.coalesce("f.year", F.lit(0)).alias("year"), F.coalesce("f.type", F.lit("")).alias("type"))


@query("registry_status_severity")
def severity(spark, sf):
    return V.companies(spark, sf).groupBy("status", F.coalesce(R.status_severity(F.col("status")), F.lit("")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def flagged_vpas(spark, sf) -> DataFrame:
    st = P.account_status(V.entity_accounts(spark, sf), P.first_seen_vpas(V.payments(spark, sf)), stored_alerts(spark, sf).where(LIVE))
    return V.entity_accounts(spark, sf).join(st.where("flagged").select("vpa"), "vpa", "left_semi").select("cin", "vpa")


@query("company_boards")
def boards(spark, sf):
    d, c = V.directorships(spark, sf), V.companies(spark, sf)
    now = F.col("ceased_on").isNull() | (F.col("ceased_on") > F.lit(V.AS_OF).cast("date"))
    load = G.director_load(d, c, V.AS_OF)
    return d.join(load.select("din", "current_n"), "din").select("cin", "din", now.alias("is_current"), "disqualified", "current_n")


@query("registry_address_farms")
def farms(spark, sf):
    return G.address_counts(V.companies(spark, sf))


@query("registry_common_control")
def control(spark, sf):
    return G.common_control(V.directorships(spark, sf), V.companies(spark, sf), V.AS_OF)


@query("registry_rail_crossover")
def crossover(spark, sf):
    return G.flagged_links(V.companies(spark, sf), V.directorships(spark, sf), V.companies(spark, sf), flagged_vpas(spark, sf), V.AS_OF)


def _applicants(spark, sf) -> DataFrame:
    c = V.companies(spark, sf).select("cin")
    return c.union(c.where("cin LIKE '%1'").select(F.concat(F.lit("Z"), "cin"))).union(c.where("cin LIKE '%2'").select(F.concat(F.lit("L"), F.substring("cin", 2, 30))))


def found(spark, sf) -> DataFrame:
    return G.findings(_applicants(spark, sf), V.companies(spark, sf), V.directorships(spark, sf), flagged_vpas(spark, sf), V.AS_OF)


@query("registry_findings")
def registry_findings(spark, sf):
    return found(spark, sf)


@query("registry_decisions")
def registry_decisions(spark, sf):
    return G.decide(found(spark, sf), _applicants(spark, sf))


@query("merged_onboarding_decision")
def merged(spark, sf):
    """Per settlement account of a company: transaction check and registry report, the stricter one wins."""
    f = cut(found(spark, sf))
    worst = f.where("severity <> 'low'").groupBy("cin").agg(F.min(F.struct(F.when(F.col("severity") == "high", 0).otherwise(1).alias("r"), "code")).alias("m"))
    dec = G.decide(f, _applicants(spark, sf)).join(worst, "cin", "left").select(F.col("cin").alias("key"), "decision", F.col("m.code").alias("first_text"))
    acc = V.entity_accounts(spark, sf).join(vpa_applicants(spark, sf), "vpa").select("cin", "account_id")
    tx = acc.join(onboarding(spark, sf).select("account_id", "decision", "reason"), "account_id").select(F.col("cin").alias("key"), "decision", "reason")
    return G.merge_decisions(tx, dec)
