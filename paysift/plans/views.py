"""The engine's input tables, derived from the driver tables (events, supplier, lineitem, orders, customer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import near_cap, paise
from ..session import prepare, spread, tasks_for

BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
ORDER_BASE_US = 788_918_400_000_000  # 1995-01-01 00:00 UTC
# Merchant categories by supplier key.
CATEGORIES = ("kirana", "restaurant", "pharmacy", "fuel", "electronics", "online_services", "utility_biller", "subscription", "travel", "education")
AS_OF = "2026-09-28"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def account_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many accounts there are (largest user id + 1)."""
    return table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-to-account payments. The one-row total is joined as a scalar subquery."""
    spark = prepare(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("_paysift_events")
    raw = spark.sql(
        """SELECT e.*, (SELECT max(user_id) + 1 FROM _paysift_events) AS n
           FROM (SELECT event_id, ts, user_id, event_type, value FROM _paysift_events) e"""
    )
    p = F.pmod(F.col("user_id") * 31 + F.col("event_id") * 17 + 7, F.col("n"))
    to_no = F.when(p == F.col("user_id"), F.pmod(p + 1, F.col("n"))).otherwise(p)
    fraud = (F.col("event_type") == "error") & (F.col("value") >= 60)
    amount_p = F.when(F.col("event_id") % 11 == 0, F.lit(4_999_900)).otherwise(paise(F.col("value")) * 1000).cast("bigint")
    return (
        raw.withColumn("to_no", to_no)
        .select(
            F.col("event_id").alias("row"),
            (F.lit(BASE_US) + F.floor((_us("ts") - F.lit(BASE_US)) / 3).cast("bigint")).alias("t_us"),
            F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("from_id"),
            F.concat(F.lit("A"), F.col("to_no").cast("string")).alias("to_id"),
            F.concat(F.lit("a"), F.col("user_id").cast("string"), F.lit("@x")).alias("from_vpa"),
            F.concat(F.lit("a"), F.col("to_no").cast("string"), F.lit("@x")).alias("to_vpa"),
            F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("from_state"),
            F.concat(F.lit("S"), (F.col("to_no") % 5).cast("string")).alias("to_state"),
            (amount_p / 100).alias("amount"),
            amount_p.alias("amount_p"),
            F.when(F.col("event_type").isin("view", "click"), "P2M").otherwise("P2P").alias("channel"),
            F.least(F.lit(1.0), F.col("value") / 150).alias("score"),
            F.when(fraud, 1).otherwise(0).alias("is_fraud"),
            F.when(fraud, F.col("event_type")).otherwise("clean").alias("layer"),
            F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("txn_id"),
        )
        .withColumn("near", near_cap(F.col("amount")))
    )


ACCOUNT_CHUNK = 100_000


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = account_total(spark, sf_dir)
    # in chunks, so that neither one row nor one task makes them all
    chunks = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / ACCOUNT_CHUNK))).alias("c")).repartition("c")
    a = chunks.select(F.explode(F.sequence(F.col("c") * ACCOUNT_CHUNK, F.least(F.col("n"), (F.col("c") + 1) * ACCOUNT_CHUNK) - 1)).alias("a"))
    m20, m10 = F.col("a") % 20, F.col("a") % 10
    s = F.col("a").cast("string")
    return a.select(
        F.concat(F.lit("A"), s).alias("account_id"),
        F.concat(F.lit("a"), s, F.lit("@x")).alias("vpa"),
        F.concat(F.lit("S"), (F.col("a") % 5).cast("string")).alias("state"),
        F.concat(F.lit("B"), (F.col("a") % 4).cast("string")).alias("bank"),
        F.when(m20 == 3, "l1_mule").when(m20 == 7, "l2_mule").when(m20 == 5, "victim").otherwise("clean").alias("role"),
        F.when(m10 == 0, "merchant").when(m10 == 1, "supplier").when(m10 == 2, "business").otherwise("individual").alias("kind"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return s.select(
        k.alias("merchant_id"),
        F.element_at(cats, (k % 10 + 1).cast("int")).alias("category"),
        F.col("s_nationkey").cast("bigint").alias("state"),
        F.concat(F.lit("SA"), F.floor(k / 3).cast("string")).alias("settlement_account"),
        F.concat(F.lit("E"), F.floor(k / 2).cast("string")).alias("legal_entity"),
        F.when(k % 5 == 0, F.lit(BASE_US) + (k % 7) * F.lit(86_400_000_000)).otherwise(F.lit(BASE_US - 200 * 86_400_000_000)).alias("onboarded_us"),
        F.when(k % 20 == 3, 1).otherwise(0).alias("is_fraud"),
    )


def _compress(date_us: Column, second: Column) -> Column:
    return F.lit(BASE_US) + F.floor(((date_us - F.lit(ORDER_BASE_US)) + second * F.lit(1_000_000)) / 250).cast("bigint")


def merchant_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant payments; equal times are ordered by the listed line columns (`tie`)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    second = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(86400))
    # the smaller tables meet first, so that a line moves once
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = li.count()
    if tasks_for(spark, rows):
        li, oc = spread(li, rows, "l_orderkey"), spread(oc, rows, "o_orderkey")
    return (
        li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_suppkey").alias("merchant_id"),
            F.col("o_custkey").alias("payer_id"),
            F.col("c_nationkey").cast("bigint").alias("payer_state"),
            F.floor((paise(F.col("l_extendedprice")) * (100 - paise(F.col("l_discount"))) + 50) / 100).cast("bigint").alias("amount_p"),
            _compress(_us("o_orderdate"), second).alias("t_us"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("tie"),
            F.when((F.col("l_suppkey") % 20 == 3) & (F.col("l_linenumber") == 1), 1).otherwise(0).alias("is_fraud"),
        )
        .withColumn("amount", F.col("amount_p") / 100)
    )


def collects(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_paysift_supplier")
    table(spark, sf_dir, "orders").createOrReplaceTempView("_paysift_orders")
    o = spark.sql("SELECT o.*, (SELECT count(*) FROM _paysift_supplier) AS n FROM _paysift_orders o")
    k = F.col("o_orderkey")
    req = _compress(_us("o_orderdate"), F.pmod(k * 7919, F.lit(86400)))
    outcome = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "declined").otherwise("expired")
    return o.select(
        k.alias("request_id"),
        F.pmod(k, F.col("n")).alias("merchant_id"),
        F.col("o_custkey").alias("payer_id"),
        req.alias("requested_us"),
        (req + (k % 30 + 1) * 60 * F.lit(1_000_000)).alias("resolved_us"),
        outcome.alias("outcome"),
        (k % 2).cast("int").alias("known_payer"),
        F.when((F.pmod(k, F.col("n")) % 20 == 3) & (k % 4 == 0), 1).otherwise(0).alias("is_fraud"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    inc = F.make_date((2000 + k % 27).cast("int"), (1 + k % 12).cast("int"), F.lit(1))
    return s.select(
        cin_of(k).alias("cin"),
        F.col("s_name").alias("name"),
        F.when(k % 7 == 0, "Strike Off").when(k % 7 == 1, "Dormant").otherwise("Active").alias("status"),
        F.concat(F.lit("Office "), (k % 13).cast("string"), F.lit(", M.G. Road, Pune")).alias("address"),
        inc.alias("incorporated_on"),
        F.round(F.col("s_acctbal") * 100, 2).alias("paid_up_capital"),
        F.least(F.lit(2026), F.year(inc) + (k % 20).cast("int")).alias("last_annual_return"),
        k.alias("no"),
    )


def cin_of(k: Column) -> Column:
    return F.concat(
        F.lit("U"), (10000 + k % 5).cast("string"), F.lit("MH"), (2000 + k % 24).cast("string"), F.lit("PTC"), F.lpad(k.cast("string"), 6, "0")
    )


def directorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k, d = F.col("s_suppkey"), F.col("d")
    return (
        s.select(k, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"))).alias("d"))
        .where((k * 7 + d) % 20 == 0)
        .select(
            cin_of(k).alias("cin"),
            F.lpad(d.cast("string"), 8, "0").alias("din"),
            F.when((k + d) % 9 == 0, F.make_date(F.lit(2020), F.lit(1), F.lit(1))).alias("ceased_on"),
            F.when(d % 11 == 0, 1).otherwise(0).alias("disqualified"),
        )
    )


def entity_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("_paysift_events")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_paysift_supplier")
    s = spark.sql("SELECT s.s_suppkey, (SELECT max(user_id) + 1 FROM _paysift_events) AS n FROM _paysift_supplier s")
    k = F.col("s_suppkey")
    return s.select(cin_of(k).alias("cin"), F.concat(F.lit("a"), F.pmod(k, F.col("n")).cast("string"), F.lit("@x")).alias("vpa"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, tie-heavy scored set: quality label against document length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("row"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s")
    )
