"""Registered queries: merchant detectors, holds, settlement, calibration, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rupees
from ..operators import merchant as Mr
from ..operators.metrics import percentiles
from ..params import DAY, HOUR, P10
from ..session import cut
from . import views as V

QUERIES = {}
START = V.BASE_US
T0, T1 = START + P10.test_days[0] * DAY, START + P10.test_days[1] * DAY


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


_STORED: dict[tuple, DataFrame] = {}


def stored_payments(spark: SparkSession, sf: str) -> DataFrame:
    """The merchant payments as later steps read them: the tables are joined and written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf, "payments")
    if key not in _STORED:
        _STORED[key] = cut(V.merchant_payments(spark, sf).drop("amount")).withColumn("amount", F.col("amount_p") / 100)
    return _STORED[key]


def bars(spark, sf):
    return Mr.category_p99(stored_payments(spark, sf), V.merchants(spark, sf), START)


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = cut(_alerts(spark, sf))
    return _STORED[key]


def _alerts(spark, sf):
    return Mr.merchant_alerts(stored_payments(spark, sf), V.collects(spark, sf), V.merchants(spark, sf), cut(bars(spark, sf)), START)


@query("category_p99")
def cat_p99(spark, sf):
    return bars(spark, sf).select("category", F.round("cat_p99", 6).alias("cat_p99"))


@query("merchant_alerts")
def alerts(spark, sf):
    return _alerts(spark, sf)


@query("ticket_anomaly_d1")
def d1(spark, sf):
    return Mr.d1_alerts(Mr.first_payments(stored_payments(spark, sf)), V.merchants(spark, sf), bars(spark, sf))


@query("above_bar_payments")
def above(spark, sf):
    f = Mr.first_payments(stored_payments(spark, sf))
    return Mr.above_bar(f, V.merchants(spark, sf), bars(spark, sf)).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_p").alias("amount_p"))


@query("shared_settlement_d4")
def d4(spark, sf):
    return Mr.d4_alerts(V.merchants(spark, sf), START)


@query("settlement_holds")
def hold(spark, sf):
    return Mr.holds(stored_alerts(spark, sf))


def _days(spark, sf) -> int:
    """Days from the start to the last payment or collect request: the length of the settlement calendar."""
    last = stored_payments(spark, sf).agg(F.max("t_us").alias("t")).union(V.collects(spark, sf).agg(F.max("resolved_us"))).agg(F.max("t")).first()[0]
    return 1 if last is None else max(1, (last - START) // DAY + 1)


def _status(spark, sf):
    return Mr.batch_status(V.merchants(spark, sf), Mr.holds(stored_alerts(spark, sf)), START, _days(spark, sf))


@query("settlement_assignment")
def settle(spark, sf):
    s = Mr.settlements(stored_payments(spark, sf), Mr.settle_days(_status(spark, sf)), START)
    return s.groupBy("merchant_id", "day", "settled_us", "was_held").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount_p").alias("amount_p"))


@query("settlement_batch_log")
def log(spark, sf):
    return Mr.batch_log(stored_payments(spark, sf), _status(spark, sf), START)


@query("merchant_day_stats")
def stats(spark, sf):
    p = stored_payments(spark, sf)
    return Mr.day_stats(Mr.first_payments(p), V.collects(spark, sf), p, V.merchants(spark, sf), bars(spark, sf), START)


@query("merchant_calibration")
def calibration(spark, sf):
    return Mr.calibrated(cut(stats(spark, sf)), V.merchants(spark, sf))


@query("collect_outcomes_pivot")
def outcomes(spark, sf):
    c = V.collects(spark, sf).groupBy("merchant_id", "known_payer").pivot("outcome", ["approved", "declined", "expired"]).count()
    return c.na.fill(0)


@query("merchant_directory")
def directory(spark, sf):
    """Merchants, flagged first by first alert time, then by inflow."""
    inflow = stored_payments(spark, sf).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount_p").alias("inflow_p"))
    al = stored_alerts(spark, sf).groupBy("merchant_id").agg(F.array_join(F.sort_array(F.collect_set("detector")), ",").alias("detectors"), F.min("t_us").alias("first_alert_us"))
    held = Mr.batch_log(stored_payments(spark, sf), _status(spark, sf), START).where("held").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("held_batches"), F.sum("amount_p").alias("held_p"))
    m = V.merchants(spark, sf)
    shared = m.groupBy("settlement_account").agg((F.count(F.lit(1)) - 1).alias("shared_settlement"))
    x = m.join(shared, "settlement_account").join(inflow, "merchant_id", "left").join(al, "merchant_id", "left").join(held, "merchant_id", "left")
    x = x.na.fill(0, ["payments", "inflow_p", "held_batches", "held_p"]).na.fill("", ["detectors"])
    return x.select("merchant_id", "category", "payments", rupees(F.col("inflow_p")).alias("inflow"), "detectors", "first_alert_us", "held_batches", rupees(F.col("held_p")).alias("held_amount"), "shared_settlement").orderBy(
        F.col("first_alert_us").asc_nulls_last(), F.col("inflow").desc(), "merchant_id")


@query("recent_merchant_payments")
def recent(spark, sf):
    """The latest 150 payments over all merchants (a top-k report)."""
    p = V.merchant_payments(spark, sf)
    return p.orderBy(F.col("t_us").desc(), F.col("tie").desc()).limit(150).select("merchant_id", "payer_id", "t_us", "amount_p")


@query("merchant_onboarding_decision")
def onboarding(spark, sf):
    m = V.merchants(spark, sf)
    applicants = m.select(F.col("merchant_id").alias("application"), "settlement_account", F.when(F.col("merchant_id") % 3 == 0, F.lit("E-new")).otherwise(F.col("legal_entity")).alias("legal_entity"))
    return Mr.onboarding_decision(applicants, m, stored_alerts(spark, sf))


@query("first_alert_per_merchant")
def first_alert(spark, sf):
    a = stored_alerts(spark, sf).where(F.col("t_us") < T1)
    return a.groupBy("merchant_id").agg(F.min("t_us").alias("first_alert_us"), F.array_join(F.sort_array(F.collect_set("detector")), ",").alias("detectors"))


def active_merchants(spark, sf):
    """Merchants with a fraud payment or a fraud collect in the test days, with the first one's time."""
    p = stored_payments(spark, sf).where((F.col("t_us") >= T0) & (F.col("t_us") < T1) & (F.col("is_fraud") == 1)).select("merchant_id", "t_us")
    c = V.collects(spark, sf).where((F.col("requested_us") >= T0) & (F.col("requested_us") < T1) & (F.col("is_fraud") == 1)).select("merchant_id", F.col("requested_us").alias("t_us"))
    return p.union(c).groupBy("merchant_id").agg(F.min("t_us").alias("first_fraud_us"))


@query("active_fraud_merchants")
def active(spark, sf):
    return active_merchants(spark, sf)


@query("clean_hold_hours")
def hold_hours(spark, sf):
    spans = Mr.holds(stored_alerts(spark, sf)).join(V.merchants(spark, sf).where("is_fraud = 0").select("merchant_id"), "merchant_id").select(
        "merchant_id", F.greatest(F.col("from_us"), F.lit(START + DAY)).alias("from_us"), F.least(F.col("until_us"), F.lit(T1)).alias("until_us"))
    return Mr.merged_hours(spans)


@query("merchant_evaluation")
def evaluation(spark, sf):
    al = stored_alerts(spark, sf)
    m = V.merchants(spark, sf).select("merchant_id", "is_fraud")
    p = stored_payments(spark, sf)
    test = p.where((F.col("t_us") >= T0) & (F.col("t_us") < T1))
    busy = test.select("merchant_id", F.lit(True).alias("busy")).distinct()
    per = al.where(F.col("t_us") < T1).groupBy("merchant_id").agg(
        F.min("t_us").alias("first_us"), F.max(F.col("t_us") >= T0).alias("in_test"), F.max(F.col("detector") == "D4").alias("has_d4"),
        F.min(F.when(F.col("detector") != "D4", F.col("t_us"))).alias("hold_first_us"), F.max((F.col("t_us") >= T0) & (F.col("detector") != "D4")).alias("hold_in_test"),
        F.max(F.col("detector") != "D4").alias("not_only_d4"))
    x = m.join(per, "merchant_id", "left").join(busy, "merchant_id", "left").join(active_merchants(spark, sf), "merchant_id", "left")
    counted = F.col("first_us").isNotNull() & (F.col("in_test") | (F.col("has_d4") & F.coalesce("busy", F.lit(False))))
    act, fraud = F.col("first_fraud_us").isNotNull(), F.col("is_fraud") == 1
    batch = F.lit(START) + (F.floor((F.col("first_fraud_us") - START) / DAY) + 1) * DAY + P10.batch_hour * HOUR
    x = x.withColumn("counted", counted).withColumn("act", act).withColumn("fraud", fraud).withColumn("to_alert", F.when(act, (F.col("first_us") - F.col("first_fraud_us")) / 1e6)).withColumn(
        "to_hold", F.when(act, (F.col("hold_first_us") - F.col("first_fraud_us")) / 1e6)).withColumn("before", act & (F.col("first_us") < batch))
    clean_day = ~fraud & (F.col("first_us") >= START + DAY) & F.col("not_only_d4")
    g = x.agg(
        F.count(F.when(act, 1)).alias("active"), F.count(F.when(act & F.col("first_us").isNotNull(), 1)).alias("active_flagged"), F.count(F.when(F.col("counted"), 1)).alias("counted"),
        F.count(F.when(F.col("counted") & fraud, 1)).alias("fraud_counted"), F.count(F.when(F.col("before"), 1)).alias("before_first_batch"), F.count(F.when(clean_day, 1)).alias("clean_flagged"),
        F.count(F.when(F.col("hold_in_test"), 1)).alias("hold_counted"), F.count(F.when(act & F.col("hold_first_us").isNotNull(), 1)).alias("hold_found"))
    s = Mr.settlements(test, Mr.settle_days(_status(spark, sf)), START)
    money = s.agg(F.sum(F.when(F.col("is_fraud") == 1, F.col("amount_p"))).alias("fraud_p"), F.sum(F.when((F.col("is_fraud") == 1) & F.col("was_held"), F.col("amount_p")).otherwise(0)).alias("held_fraud_p"),
                  F.sum(F.when((F.col("is_fraud") == 0) & F.col("was_held"), F.col("amount_p")).otherwise(0)).alias("held_genuine_p"))
    j = g.crossJoin(money).join(percentiles(x, "to_alert", {"median_to_alert": 0.5}), F.lit(True), "left").join(percentiles(x, "to_hold", {"median_to_hold": 0.5}), F.lit(True), "left")  # one row each
    return j.select("active", "active_flagged", "counted", "fraud_counted", "before_first_batch", "clean_flagged", "hold_counted", "hold_found", "held_fraud_p", "held_genuine_p",
                    F.round(F.col("active_flagged") / F.col("active"), 9).alias("recall"), F.round(F.col("fraud_counted") / F.col("counted"), 9).alias("precision"),
                    F.round(F.col("held_fraud_p") / F.col("fraud_p"), 9).alias("held_share"), F.round("median_to_alert", 3).alias("median_to_alert"), F.round("median_to_hold", 3).alias("median_to_hold"))
