"""Tamper-evident audit chains and case formation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SPLIT, Split
from ..session import cut
from .running import hot_keys, running, with_segment

# The fields that go into a row's hash, in this order, and the first link.
HASHED = ("run_id", "entry_id", "at_us", "sim_us", "action", "actor", "role", "note", "alert_id", "account_id", "case_id", "payload")
GENESIS = "0" * 64


def canonical(cols: Sequence[str] = HASHED) -> Column:
    """One text per row: fields in fixed order, each as its length, a colon and its characters, or a dash for null.

    Different rows have different texts: a dash or a number says how far the field reaches."""
    def field(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[field(c) for c in cols])


def record_hash(cols: Sequence[str], prev: Column | None = None) -> Column:
    body = canonical(cols)
    return F.sha2(body if prev is None else F.concat(prev, body), 256)


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA-256 as two nested hashes over the padded secret."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")

    def keyed(pad: int, message: Column) -> Column:
        return F.sha2(F.concat(F.lit(bytes(b ^ pad for b in key)), message), 256)

    return F.concat(F.lit("sha256="), keyed(0x5C, F.unhex(keyed(0x36, F.encode(body, "UTF-8")))))


def seal(entries: DataFrame) -> DataFrame:
    """Adds prev_hash and hash: one SHA-256 chain per run, in (at_us, entry_id) order.

    A chain is sequential by definition. Runs are sealed in parallel, each as a stream of batches through a task that
    keeps only the last hash, so a long run costs time but no memory.
    """
    x = entries.withColumn("_c", canonical()).repartition("run_id").sortWithinPartitions("run_id", "at_us", "entry_id")
    schema = entries.schema.simpleString()[7:-1] + ",prev_hash:string,hash:string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, GENESIS
        for b in batches:
            prev, own = [], []
            for r, c in zip(b["run_id"], b["_c"]):
                if r != run:
                    run, last = r, GENESIS
                prev.append(last)
                last = hashlib.sha256((last + c).encode()).hexdigest()
                own.append(last)
            yield b.drop(columns="_c").assign(prev_hash=prev, hash=own)

    return x.mapInPandas(fold, schema)


def verify(chain: DataFrame, split: Split = SPLIT) -> DataFrame:
    """Per run: entries checked, whether the chain holds, the first bad entry and why, and unchained rows.

    Every hash is recomputed on its own; the link check needs only the previous entry's hash, read as a running maximum
    of (position, hash), so one long run is checked in parallel segments."""
    live = chain.where("hash IS NOT NULL")
    pos = F.struct("at_us", "entry_id", "hash")
    seg = with_segment(live, ["run_id"], hot_keys(live, ["run_id"], split), "at_us", split)
    x = running(seg, ["run_id"], ["at_us", "entry_id"], maxes={"before": pos}, include_current=False)
    broken = F.col("before.hash").isNotNull() & (F.col("before.hash") != F.col("prev_hash"))
    bad = record_hash(HASHED, F.col("prev_hash")) != F.col("hash")
    why = F.when(broken, "link to previous row broken").when(bad, "content does not match its hash")
    g = x.withColumn("why", why).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("why").isNotNull(), F.struct("at_us", "entry_id", "why"))).alias("first_bad"), F.max(pos).alias("head"))
    loose = chain.groupBy("run_id").agg(F.count(F.when(F.col("hash").isNull(), 1)).alias("unchained"))
    return loose.join(g, "run_id", "left").select(
        "run_id", F.col("first_bad").isNull().alias("ok"), F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("first_bad.entry_id", F.lit(-1)).alias("first_bad_entry"), F.coalesce("first_bad.why", F.lit("")).alias("reason"), "unchained")


def trail(audit: DataFrame, run_id: str | None = None, account_id: str | None = None, alert_id: str | None = None, limit: int = 200) -> DataFrame:
    """Newest entries first, filtered by run, account or alert."""
    for c, v in (("run_id", run_id), ("account_id", account_id), ("alert_id", alert_id)):
        if v is not None:
            audit = audit.where(F.col(c) == v)
    return audit.orderBy(F.col("at_us").desc(), F.col("entry_id").desc()).limit(limit)


def form_cases(events: DataFrame, payments: DataFrame, split: Split = SPLIT) -> DataFrame:
    """(event_no, account_id, case_event): each filed alert joins the first case that holds its account or a counterparty.

    `events` is (event_no, account_id, at_us), numbered in filing order. An event's case is the smallest event it reaches
    over earlier and earlier neighbouring events, so the greedy rule is a label propagation along edges that only go back
    in time; each round also jumps to the label of the label, which keeps the rounds logarithmic in the chain length.
    An account's later event sees its own earlier ones, so its labels only fall and its last event before a moment stands
    for all of them: an event asks each counterparty once, and a running maximum over events and asks answers.
    """
    pair = payments.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), "t_us").groupBy("a", "b").agg(F.min("t_us").alias("since"))
    acc = events.select("account_id").distinct()
    both = pair.where("a <> b").join(acc.withColumnRenamed("account_id", "a"), "a", "left_semi").join(acc.withColumnRenamed("account_id", "b"), "b", "left_semi")
    links = both.select(F.col("a").alias("account_id"), F.col("b").alias("other"), "since").union(both.select("b", "a", "since"))
    own = events.select(F.col("account_id").alias("other"), "event_no", "at_us", F.lit(0).alias("o"))
    asks = events.join(links, "account_id").where("since <= at_us").select("other", "event_no", "at_us", F.lit(0).alias("o")).unionByName(own)
    stream = asks.unionByName(own.withColumn("o", F.lit(1)))
    stream = with_segment(stream, ["other"], hot_keys(stream, ["other"], split), "at_us", split)
    known = running(stream, ["other"], ["event_no", "o"], maxes={"back": F.when(F.col("o") == 1, F.col("event_no"))})
    back = cut(known.where("o = 0 AND back IS NOT NULL").select("event_no", "back"))
    label = cut(events.select("event_no", F.col("event_no").alias("label")))
    while True:  # labels only fall, so this ends
        step = back.join(label.select(F.col("event_no").alias("back"), F.col("label").alias("l")), "back").groupBy("event_no").agg(F.min("l").alias("l"))
        near = label.join(step, "event_no", "left").select("event_no", "label", F.least("label", F.coalesce("l", "label")).alias("n"))
        jump = near.join(near.select(F.col("event_no").alias("n"), F.col("n").alias("nn")), "n").select("event_no", "label", F.least("n", "nn").alias("n"))
        jump = cut(jump)
        changed = not jump.where("n < label").isEmpty()
        label = jump.select("event_no", F.col("n").alias("label"))
        if not changed:
            return events.join(label, "event_no").select("event_no", "account_id", F.col("label").alias("case_event"))
