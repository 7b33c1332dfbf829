"""Wire payments: parsing, validation, the outgoing view, and the outgoing instruction queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_time

WIRE = "txn_id string, payer_vpa string, payee_vpa string, amount_inr double, timestamp string, payer_state string, payee_state string, payer_account_id string, payee_account_id string, channel string, _bad string"
MAX_ATTEMPTS = 6
# HTTP answers in 4xx that are worth another try.
RETRYABLE = (408, 429)


def parse_payments(raw: DataFrame, text: str = "value") -> DataFrame:
    """JSON text -> typed columns plus `error` (null when the payment is valid)."""
    p = F.from_json(F.col(text), WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    x = raw.withColumn("p", p).select("*", "p.*").drop("p")
    when = iso_time(F.col("timestamp"))
    error = (
        F.when(F.col("_bad").isNotNull() | (F.col("txn_id").isNull() & F.col("payer_vpa").isNull() & F.col("amount_inr").isNull()), "not a payment object")
        .when(~F.coalesce(F.length("txn_id").between(1, 64), F.lit(False)), "txn_id must have 1 to 64 characters")
        .when(~F.coalesce(F.length("payer_vpa") >= 3, F.lit(False)) | ~F.coalesce(F.length("payee_vpa") >= 3, F.lit(False)), "a VPA must have 3 or more characters")
        .when(~F.coalesce(F.col("amount_inr") > 0, F.lit(False)), "amount must be above 0")
        .when((F.coalesce(F.trim("timestamp"), F.lit("")) != "") & when.isNull(), "timestamp is not ISO 8601"))
    return x.withColumn("ts", when).withColumn("error", error).drop("_bad")


def dead_letters(parsed: DataFrame, text: str = "value") -> DataFrame:
    """Rejected messages with their whole text, once per (source, position)."""
    bad = parsed.where("error IS NOT NULL").select("source", "position", F.col(text).alias("raw"), "error")
    return bad.groupBy("source", "position").agg(F.min_by("raw", "raw").alias("raw"), F.min_by("error", "raw").alias("error"))


def gateway_view(payments: DataFrame) -> DataFrame:
    """A payment as a gateway would send it: wire names, no label, no layer."""
    s = F.struct(F.col("txn_id"), F.col("from_vpa").alias("payer_vpa"), F.col("to_vpa").alias("payee_vpa"), F.col("amount").alias("amount_inr"), F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                 F.col("from_state").alias("payer_state"), F.col("to_state").alias("payee_state"), F.col("from_id").alias("payer_account_id"), F.col("to_id").alias("payee_account_id"))
    return payments.select(F.col("row"), F.to_json(s).alias("value"))


def next_delivery_state(items: DataFrame, now_us: int) -> DataFrame:
    """Outgoing queue after one attempt per item: delivered, failed (permanent answer or too many tries) or retried later."""
    tried = F.col("attempts") + 1
    permanent = F.coalesce((F.col("http_status") >= 400) & (F.col("http_status") < 500) & ~F.col("http_status").isin(*RETRYABLE), F.lit(False))
    status = F.when(F.col("http_status") < 300, "delivered").when(permanent | (tried >= MAX_ATTEMPTS), "failed").otherwise("pending")
    wait = F.when(status == "pending", F.lit(now_us) + F.pow(F.lit(2), tried).cast("bigint") * 1_000_000)
    return items.withColumn("new_status", status).withColumn("new_attempts", tried).withColumn("next_attempt_us", wait).withColumn("idempotency_key", F.concat(F.lit("outbox-"), F.col("id").cast("string")))


def due_items(items: DataFrame, now_us: int, limit: int = 20) -> DataFrame:
    return items.where((F.col("status") == "pending") & (F.col("next_attempt_us") <= now_us)).orderBy("id").limit(limit)
