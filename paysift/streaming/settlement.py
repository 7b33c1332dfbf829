"""Settlement on a stream: money waits per merchant until the batch timer of 06:00 settles it or a hold keeps it back."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import DAY, HOUR, P10, MerchantRules
from .detect import use_rocksdb

#: kind: pay, hold or tick (the clock moves on). `at_us` is when the row becomes known, `t_us` when the payment was made.
EVENTS = "merchant_id bigint, kind string, at_us bigint, t_us bigint, amount_p bigint, is_fraud int, until_us bigint"
#: Groups of merchants that share one state: enough for a thousand tasks, some hundred merchants each where there are 100,000.
GROUPS = 1024
_NO_TIMER = 1 << 31
_COMBINED = "merchant_id bigint, kind string, at_us bigint, batch bigint, payments bigint, amount_p bigint, fraud_p bigint, until_us bigint"
LOG = "merchant_id bigint, batch bigint, held boolean, payments bigint, amount_p bigint, fraud_p bigint, hold_until_us bigint"


def _combined(start_us: int, rules: MerchantRules):
    """Payments of one merchant that become due in the same batch are added up before the shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            # the first batch after the payment's day that is not over when the payment is known
            own = (x["t_us"] - start_us) // DAY + 1
            open_ = -((start_us + rules.batch_hour * HOUR - x["at_us"]) // DAY)
            x = x.assign(batch=own.where(own > open_, open_), payments=(x["kind"] == "pay").astype("int64"), fraud_p=x["amount_p"] * (x["is_fraud"] == 1))
            pays = x[x["kind"] == "pay"].groupby(["merchant_id", "kind", "batch"], as_index=False).agg(
                {"at_us": "max", "payments": "sum", "amount_p": "sum", "fraud_p": "sum", "until_us": "max"})
            out = pd.concat([pays, x[x["kind"] != "pay"]])
            yield out[[c.split(" ")[0] for c in _COMBINED.split(", ")]]

    return run


class Settlement(StatefulProcessor):
    """Keyed by group of merchants: what is due per merchant and batch, the holds, and the last batch that was run.

    A call to the state costs far more than what a merchant needs of it, so a group's state is one value, read and written
    once per call, with one timer for the next batch that any of its merchants waits for.
    """

    def __init__(self, start_us: int, rules: MerchantRules):
        self.start_us, self.rules = start_us, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows of (merchant, batch, payments, amount_p, fraud_p), (merchant, from_us, until_us) and (merchant, batch)
        self.open = handle.getValueState("open", "due binary, holds binary, ran binary, timer bigint")

    def _batch_us(self, batch: int) -> int:
        return self.start_us + batch * DAY + self.rules.batch_hour * HOUR

    def _load(self) -> tuple[dict, dict, dict, int]:
        """Sums by (merchant, batch), ends by (merchant, start), last batches by merchant, and the next timer's batch."""
        if not self.open.exists():
            return {}, {}, {}, _NO_TIMER
        *packed, timer = self.open.get()
        due, holds, ran = (np.frombuffer(x, np.int64).reshape(-1, n).tolist() for x, n in zip(packed, (5, 3, 2), strict=True))
        return {(m, b): tuple(sums) for m, b, *sums in due}, {(m, f): u for m, f, u in holds}, dict(ran), timer

    def _keep(self, due: dict, holds: dict, ran: dict, timer: int) -> None:
        # one timer is out at a time, unless an earlier batch comes up
        first = min((b for _, b in due), default=_NO_TIMER)
        if first < timer:
            self.handle.registerTimer(self._batch_us(first) // 1000)
            timer = first
        tables = ([(*k, *v) for k, v in due.items()], [(*k, u) for k, u in holds.items()], list(ran.items()))
        self.open.update((*(np.array(x, np.int64).tobytes() for x in tables), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))
        x = x[x["merchant_id"].notna() & x["kind"].isin(["pay", "hold"])]
        if not len(x):
            return iter([])
        due, holds, ran, timer = self._load()
        for e in x[x["kind"] == "hold"].itertuples(index=False):
            at = (int(e.merchant_id), int(e.at_us))
            holds[at] = max(int(e.until_us), holds.get(at, 0))
        p = x[x["kind"] == "pay"].groupby(["merchant_id", "batch"], as_index=False)[["payments", "amount_p", "fraud_p"]].sum()
        for e in p.itertuples(index=False):
            m = int(e.merchant_id)
            at = (m, max(int(e.batch), ran[m] + 1) if m in ran else int(e.batch))
            due[at] = tuple(int(a + b) for a, b in zip(due.get(at, (0, 0, 0)), (e.payments, e.amount_p, e.fraud_p), strict=True))
        self._keep(due, holds, ran, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Runs every batch up to the watermark in order; money that a hold keeps back is due again in the next one."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, holds, ran, timer = self._load()
        of_merchant, held = defaultdict(dict), defaultdict(list)
        for (m, b), sums in due.items():
            of_merchant[m][b] = sums
        for (m, f), u in holds.items():
            held[m].append((f, u))
        out, left = [], {}
        for m, own in of_merchant.items():
            waiting = (0, 0, 0)
            batch = min(own, default=None)
            while batch is not None and self._batch_us(batch) <= now:
                waiting = tuple(a + b for a, b in zip(waiting, own.pop(batch, (0, 0, 0)), strict=True))
                at = self._batch_us(batch)
                until = max((u for f, u in held[m] if f <= at), default=0)
                out.append((m, batch, until > at, *waiting, until if until > at else None))
                ran[m] = batch
                waiting = waiting if until > at else (0, 0, 0)
                batch = batch + 1 if waiting[0] else min(own, default=None)
            if waiting[0]:
                own[batch] = tuple(a + b for a, b in zip(own.get(batch, (0, 0, 0)), waiting, strict=True))
            left |= {(m, b): sums for b, sums in own.items()}
        self._keep(left, {k: u for k, u in holds.items() if u > now}, ran, timer if self._batch_us(timer) > now else _NO_TIMER)
        if out:
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in LOG.split(", ")])
            yield frame.assign(hold_until_us=frame["hold_until_us"].astype("Int64"))

    def close(self) -> None:
        pass


def settlement_stream(events: DataFrame, start_us: int, rules: MerchantRules = P10) -> DataFrame:
    """The batch log (LOG) of a stream of EVENTS: one row per merchant and daily batch with money due, held or settled.

    Batches are event-time timers, so they run once the stream's clock has passed 06:00. A payment that becomes known only
    after its batch is due in the next one; a hold counts from the batch at or after its start until it ends. State per
    merchant: sums of the batches not settled yet and the holds still in force; merchants are kept in GROUPS groups.
    """
    use_rocksdb(events.sparkSession)
    small = events.mapInPandas(_combined(start_us, rules), _COMBINED)
    timed = small.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "0 seconds")
    group = F.pmod(F.xxhash64("merchant_id"), F.lit(GROUPS)).alias("group")
    return timed.select("*", group).groupBy("group").transformWithStateInPandas(Settlement(start_us, rules), LOG, "append", "EventTime")
