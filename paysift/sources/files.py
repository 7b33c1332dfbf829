"""File sources and the canonical edge format. Every reader states its schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_ts
from ..operators.running import global_index

MERCHANTS = "merchant_id string, vpa string, category string, state string, legal_entity string, settlement_account string, onboarded_at string, chain string, is_fraud int, scenario string, campaign string"
M_PAYMENTS = "txn_id string, payer_id string, payer_vpa string, payer_state string, merchant_id string, amount_inr bigint, timestamp string, initiation string, is_fraud int, campaign string"
COLLECTS = "request_id string, merchant_id string, payer_id string, payer_state string, amount_inr bigint, requested_at string, resolved_at string, outcome string, known_payer int, is_fraud int, campaign string"


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names from the header line (only the first line is looked at for them)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _opt(df: DataFrame, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """Payment CSV; a missing channel column means P2P. `row` counts from 0 by file name and place in the file.

    A split of a file is read by one task from front to back, so (file, split, running number) is the file order."""
    d = _text_csv(spark, path)
    d = d.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    d = global_index(d, ["_at"], F.struct("_file", "_split"), "_row", start=0)
    ts = F.col("timestamp").try_cast("timestamp")
    return d.select(
        F.col("_row").alias("row"), F.col("txn_id"), F.unix_micros(ts).alias("t_us"), F.col("sender_id").alias("from_id"), F.col("sender_vpa").alias("from_vpa"), F.col("sender_state").alias("from_state"),
        F.col("recv_id").alias("to_id"), F.col("recv_vpa").alias("to_vpa"), F.col("recv_state").alias("to_state"), F.col("amount_inr").cast("double").alias("amount"), F.col("is_fraud").cast("int").alias("is_fraud"),
        F.col("layer"), _opt(d, "channel", "P2P").alias("channel"))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    d = _text_csv(spark, path)
    return d.select("account_id", "vpa", "state", "bank", "role", _opt(d, "kind").alias("kind"))


def read_merchant_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merchants, payments, collects; missing text becomes ''."""
    def one(name: str, ddl: str) -> DataFrame:
        return spark.read.schema(T._parse_datatype_string(ddl)).option("header", True).csv(f"{folder}/{name}")
    return one("merchants", MERCHANTS).na.fill("", ["chain", "scenario", "campaign"]), one("payments", M_PAYMENTS), one("collects", COLLECTS)


def first_filled(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    """First non-empty of the columns that exist."""
    have = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default))


def dense_ids(df: DataFrame, position: Sequence[str], bucket: Column, keys: Sequence[str], name: str) -> DataFrame:
    """(key, id): 0, 1, 2 … in first-seen order; within a row the columns of `keys` count from left to right.

    Only one row per key is numbered, bucket by bucket."""
    x = df.select(*position, bucket.alias("_bk"), F.posexplode(F.array(*[F.col(k) for k in keys])).alias("_o", "_key"))
    first = x.groupBy("_key").agg(F.min(F.struct(*position, "_o")).alias("_f"), F.min("_bk").alias("_bk"))
    return global_index(first, ["_f"], F.col("_bk"), name, start=0).select(F.col("_key").alias("key"), name)


def with_dense_ids(df: DataFrame, position: Sequence[str], bucket: Column, keys: dict[str, str], name: str) -> DataFrame:
    """Replaces each key column by its dense id column."""
    ids = dense_ids(df, position, bucket, list(keys), name)
    for k, out in keys.items():
        df = df.join(ids.select(F.col("key").alias(k), F.col(name).alias(out)), k)
    return df


EDGE_COLUMNS = ("edge_id", "from_id", "to_id", "timestamp", "amount_sent", "sent_currency", "amount_received", "received_currency", "payment_format", "is_laundering")


def _seconds_from_first_day(t: Column, first: Column) -> Column:
    return F.unix_seconds(t) - F.unix_seconds(F.date_trunc("day", first))


def _with_first(df: DataFrame, position: Sequence[str]) -> DataFrame:
    """Adds the timestamp of the first row, as a one-row join."""
    return df.crossJoin(F.broadcast(df.agg(F.min_by("ts", F.struct(*position)).alias("first_ts"))))


def canonical_edges(raw: DataFrame, row: str = "row") -> DataFrame:
    """Transfers with variant headers -> canonical edges (bank:account keys, seconds since the first midnight)."""
    sent = first_filled(raw, ["Payment Currency", "Sent Currency", "Currency"], "0")
    recv = first_filled(raw, ["Receiving Currency", "Received Currency", "Currency"], "0")
    x = raw.select(
        F.col(row).alias("edge_id"), parse_ts(first_filled(raw, ["Timestamp", "timestamp"])).alias("ts"),
        F.concat(first_filled(raw, ["From Bank", "from_bank", "sender_bank"]), F.lit(":"), first_filled(raw, ["Payer", "From Account", "sender_id", "sender_vpa", "from_id"])).alias("fk"),
        F.concat(first_filled(raw, ["To Bank", "to_bank", "recv_bank"]), F.lit(":"), first_filled(raw, ["Payee", "To Account", "recv_id", "recv_vpa", "to_id"])).alias("tk"),
        first_filled(raw, ["Amount Paid", "Amount Sent", "amount_inr"], "0").cast("double").alias("amount_sent"), sent.alias("sc"),
        first_filled(raw, ["Amount Received", "Amount Paid", "amount_inr"], "0").cast("double").alias("amount_received"), recv.alias("rc"),
        first_filled(raw, ["Payment Format"], "0").alias("pf"), first_filled(raw, ["Is Laundering", "is_fraud"], "0").cast("double").cast("int").alias("is_laundering"))
    return _encoded(x, F.lit(0))


def _encoded(x: DataFrame, offset: Column) -> DataFrame:
    pos, bucket = ["edge_id"], F.floor(F.col("edge_id") / 65_536)
    x = _with_first(x, pos).withColumn("timestamp", _seconds_from_first_day(F.col("ts"), F.col("first_ts")) + offset)
    x = with_dense_ids(x, pos, bucket, {"fk": "from_id", "tk": "to_id"}, "_id")
    x = with_dense_ids(x, pos, bucket, {"sc": "sent_currency", "rc": "received_currency"}, "_id")
    x = with_dense_ids(x, pos, bucket, {"pf": "payment_format"}, "_id")
    return x.select(*EDGE_COLUMNS)


def legacy_edges(raw: DataFrame, row: str = "row") -> DataFrame:
    """Older layout: bank and account joined without a separator, ten seconds added, rows with an error dropped, receiving
    currency numbered before the payment currency, result in time order."""
    x = raw.select(
        F.col(row).alias("edge_id"), F.try_to_timestamp(F.col("Timestamp"), F.lit("yyyy/MM/dd HH:mm")).alias("ts"), F.concat("`From Bank`", "`From Account`").alias("fk"), F.concat("`To Bank`", "`To Account`").alias("tk"),
        F.col("`Amount Paid`").try_cast("double").alias("amount_sent"), F.col("`Payment Currency`").alias("rc"), F.col("`Amount Received`").try_cast("double").alias("amount_received"),
        F.col("`Receiving Currency`").alias("sc"), F.col("`Payment Format`").alias("pf"), F.col("`Is Laundering`").try_cast("int").alias("is_laundering"))
    ok = x.where("ts IS NOT NULL AND amount_sent IS NOT NULL AND amount_received IS NOT NULL AND is_laundering IS NOT NULL")
    e = _encoded(ok, F.lit(10))
    # the receiving side was numbered first, so the two code columns swap names here
    return e.select("edge_id", "from_id", "to_id", "timestamp", "amount_sent", F.col("received_currency").alias("sent_currency"), "amount_received", F.col("sent_currency").alias("received_currency"), "payment_format", "is_laundering").orderBy("timestamp", "edge_id")


def payment_edges(payments: DataFrame) -> DataFrame:
    """Own payments -> canonical edges: clock + 10 s, one currency, P2M flag as the format, the payment's own label."""
    x = payments.select(F.col("row").alias("edge_id"), F.timestamp_micros("t_us").alias("ts"), F.col("from_id").alias("fk"), F.col("to_id").alias("tk"), F.col("amount").alias("amount_sent"),
                        F.col("amount").alias("amount_received"), (F.col("channel") == "P2M").cast("int").alias("payment_format"), F.col("is_fraud").alias("is_laundering"))
    pos, bucket = ["edge_id"], F.floor(F.col("edge_id") / 65_536)
    x = _with_first(x, pos).withColumn("timestamp", _seconds_from_first_day(F.col("ts"), F.col("first_ts")) + 10)
    x = with_dense_ids(x, pos, bucket, {"fk": "from_id", "tk": "to_id"}, "_id")
    return x.withColumn("sent_currency", F.lit(0)).withColumn("received_currency", F.lit(0)).select(*EDGE_COLUMNS)


def labelled_graph(features: DataFrame, classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headerless features (id, step, f…), classes (id, class), edges (a, b) -> nodes with y in {1, 0, -1} and known edges."""
    y = F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0).otherwise(-1)
    nodes = features.join(classes.select("id", y.alias("y")), "id", "left").na.fill(-1, ["y"])
    ids = features.select("id")
    known = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return nodes, known


def write_scores(scores: DataFrame, folder: str, model_id: str, bucket_s: int, window_s: int) -> None:
    """Per-edge scores keyed by payment row, with one metadata record next to them."""
    scores.select("row", "score").write.mode("overwrite").parquet(f"{folder}/scores")
    meta = scores.agg(F.lit(model_id).alias("model_id"), F.lit(bucket_s).alias("bucket_s"), F.lit(window_s).alias("window_s"), F.count(F.lit(1)).alias("edges"))
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def read_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    scores = spark.read.schema("row bigint, score double").parquet(f"{folder}/scores")
    return scores, spark.read.schema("model_id string, bucket_s int, window_s int, edges bigint").parquet(f"{folder}/meta")
