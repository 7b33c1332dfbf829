"""Alert lifecycle: what raising, holding, lifting and people's actions make of the alerts of an account.

What is absorbing follows from minima: a key is raised once, cleared once and never raised again, and the first freeze of a
live alert closes the account. What is left is the restriction (level and the alert it rests on) and the set of held
alerts: 608 states. Every event is a function on them, so events compose: a hot account's history is cut into segments,
each becomes one table of 608 entries, one short pass over the tables gives every segment's first state, and all segments
are then run at once. Accounts that are not hot start in the empty state and need no tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DETECTORS, R20, SPLIT, Rules, Split
from ..session import cut
from .alerts import detector_order
from .running import SEG, hot_keys, with_segment

#: `detector` is null for a lift, `level` is set for a hold, `score` (the model's) for a raise, `note` for people's actions.
#: (at_us, seq) orders the events of an account and is unique in it.
EVENTS = "account_id string, detector string, kind string, level int, score double, note string, at_us bigint, seq bigint"
ACTIONS = ("clear", "escalate", "freeze")
_RULES = len(DETECTORS) - 1
_STATES = (1 + 3 * len(DETECTORS)) << _RULES
_LIFT, _CLEAR, _LOOK, _STOP = 3 * len(DETECTORS), 3 * len(DETECTORS) + 1, 4 * len(DETECTORS) + 1, 4 * len(DETECTORS) + 2
_STEPS = "account_id string, detector string, kind string, at_us bigint, seq bigint, level_before int, held_before boolean, level_after int, holder int, mask int"


@cache
def _functions() -> np.ndarray:
    """One row per symbol, one column per state: the state after it. A state is (1 + 3 * alert + level - 1, or 0) and a mask of
    held alerts. A lead of the model alone is never held (its restrictions stay on level 1), so the mask has one bit less."""
    out = np.empty((_STOP + 1, _STATES), np.int16)
    for state in range(_STATES):
        by, mask = divmod(state, 1 << _RULES)
        level, holder = (0, -1) if by == 0 else ((by - 1) % 3 + 1, (by - 1) // 3)
        out[_LOOK, state] = state
        out[_STOP, state] = mask
        freed = mask & ~(1 << holder) if 0 <= holder < _RULES else mask
        out[_LIFT, state] = freed if level else state
        for d in range(len(DETECTORS)):
            rest = mask & ~(1 << d)
            out[_CLEAR + d, state] = rest if rest == 0 else (by << _RULES) | rest
            for want in (1, 2, 3):
                out[3 * d + want - 1, state] = state if want <= level else ((1 + 3 * d + want - 1) << _RULES) | (mask | (1 << d) if want >= 2 and d < _RULES else mask)
    return out


def _symbol() -> Column:
    d = (detector_order() - 1).cast("int")
    return F.when(F.col("kind") == "hold", 3 * d + F.col("level") - 1).when(F.col("kind") == "lift", _LIFT).when(F.col("kind") == "clear", d + _CLEAR).when(F.col("kind") == "freeze", _STOP).otherwise(_LOOK).cast("int")


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One table per (account, segment) of a sorted stream."""
    functions, key, table = _functions(), None, None
    for b in batches:
        done = []
        for account, seg, symbol in zip(b["account_id"], b[SEG], b["symbol"]):
            if key != (account, seg):
                if key is not None:
                    done.append((*key, table.tobytes()))
                key, table = (account, seg), np.arange(_STATES, dtype=np.int16)
            table = functions[symbol][table]
        yield pd.DataFrame(done, columns=["account_id", SEG, "table"])
    if key is not None:
        yield pd.DataFrame([(*key, table.tobytes())], columns=["account_id", SEG, "table"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which every segment begins, from the tables in order of time."""
    account, state = None, 0
    for b in batches:
        first = []
        for a, table in zip(b["account_id"], b["table"]):
            if a != account:
                account, state = a, 0
            first.append(state)
            state = int(np.frombuffer(table, np.int16)[state])
        yield b[["account_id", SEG]].assign(entry=first)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every event of a sorted stream with the state before and after it."""
    functions, key, state = _functions().tolist(), None, 0
    for b in batches:
        before, after = [], []
        for account, seg, symbol, entry in zip(b["account_id"], b[SEG], b["symbol"], b["entry"]):
            if key != (account, seg):
                key, state = (account, seg), entry
            before.append(state)
            state = functions[symbol][state]
            after.append(state)
        x, y = np.array(before, np.int32), np.array(after, np.int32)
        lx, ly = x >> _RULES, y >> _RULES
        own = b["d"].to_numpy(np.int32)
        out = b[["account_id", "detector", "kind", "at_us", "seq"]].copy()
        out["level_before"], out["level_after"] = np.where(lx > 0, (lx - 1) % 3 + 1, 0), np.where(ly > 0, (ly - 1) % 3 + 1, 0)
        out["held_before"] = (x >> np.maximum(own, 0)) % 2 * ((own >= 0) & (own < _RULES)) > 0
        out["holder"], out["mask"] = np.where(ly > 0, (ly - 1) // 3, -1), y % (1 << _RULES)
        yield out


def _steps(events: DataFrame, split: Split) -> DataFrame:
    """States before and after the events that count; hot accounts in segments."""
    x = events.withColumn("symbol", _symbol()).withColumn("d", F.coalesce((detector_order() - 1).cast("int"), F.lit(-1)))
    hot = hot_keys(x, ["account_id"], split)
    order = ["account_id", SEG, "at_us", "seq"]
    if hot is None:
        x = x.withColumn(SEG, F.lit(-1).cast("bigint")).withColumn("entry", F.lit(0))
    else:
        x = cut(with_segment(x, ["account_id"], hot, "at_us", split).withColumn(SEG, F.col(SEG).cast("bigint")))
        parts = x.where(F.col(SEG) >= 0).select(*order, "symbol").repartition("account_id", SEG).sortWithinPartitions(*order)
        tables = parts.mapInPandas(_composed, f"account_id string, {SEG} bigint, table binary")
        entry = tables.repartition("account_id").sortWithinPartitions("account_id", SEG).mapInPandas(_entries, f"account_id string, {SEG} bigint, entry int")
        x = x.join(entry, ["account_id", SEG], "left").na.fill(0, ["entry"])
    keep = ["account_id", "detector", "kind", "at_us", "seq", "symbol", "d", SEG, "entry"]
    return x.select(*keep).repartition("account_id", SEG).sortWithinPartitions(*order).mapInPandas(_run, _STEPS)


def lifecycle(events: DataFrame, rules: Rules = R20, split: Split = SPLIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, actions, accounts) after all events.

    alerts: account_id, detector, raised_us, gnn_max, status (open, escalated, held, cleared, frozen, superseded), filed_us (the
    moment it went to a case: held, escalated or frozen). actions: every clear, escalate and freeze with `accepted`, `refused`
    (why not), `override` (a clear against a restriction or a high model score) and `logged` (a clear of a held alert is the
    release of a hold). accounts: level of the restriction in force (0: none), its alert, frozen_us.

    A raise of a cleared key and any raise of a frozen account changes nothing; people's actions need a note and a live
    alert; a hold acts above the level in force; a lift ends what is in force and reopens the alert it rests on.
    Events of unknown kind, without an account or (lifts apart) without a known detector are ignored.
    """
    k = ["account_id", "detector"]
    pos = F.struct("at_us", "seq")
    known = F.col("account_id").isNotNull() & ((F.col("kind") == "lift") | F.col("detector").isin(*DETECTORS))
    model = F.col("detector") == "model_only"
    e = events.select("account_id", F.when(F.col("kind") != "lift", F.col("detector")).alias("detector"), "kind", "level", "score", "note", "at_us", "seq").where(known)
    e = e.withColumn("level", F.when(model, F.least("level", F.lit(1))).otherwise(F.col("level")))
    noted = F.trim(F.coalesce("note", F.lit(""))) != ""
    # what happens once per key and account: minima, so they merge before the shuffle
    raised = e.where("kind = 'raise'").groupBy(*k).agg(F.min(pos).alias("r"))
    later = e.where(F.col("kind").isin("clear", "escalate") & noted).join(raised, k).where(pos > F.col("r"))
    ended = later.groupBy(*k).agg(F.min(F.when(F.col("kind") == "clear", pos)).alias("c"), F.min(F.when(F.col("kind") == "escalate", pos)).alias("esc"))
    births = raised.groupBy("account_id").agg(F.collect_list(F.when(~model, F.col("r"))).alias("rs"))  # at most five
    a = raised.join(ended, k, "left").join(births, "account_id")
    a = a.withColumn("s", F.when(model, F.array_min(F.filter("rs", lambda x: x > F.col("r"))))).drop("rs")
    a = a.withColumn("s", F.when(F.least("c", "esc").isNull() | (F.col("s") < F.least("c", "esc")), F.col("s")))  # only an open lead
    a = a.withColumn("c", F.when(F.col("s").isNull(), F.col("c")))
    a = a.withColumn("x", F.least("c", "s"))
    live = (pos > F.col("r")) & (F.col("x").isNull() | (pos < F.col("x")))
    frozen = e.where((F.col("kind") == "freeze") & noted).join(a, k).where(live).groupBy("account_id").agg(F.min(pos).alias("f"))
    # what comes after the freeze of an account never happens
    a = a.join(frozen, "account_id", "left").where("f IS NULL OR r < f")
    a = cut(a.select(*k, "r", *[F.when(F.col("f").isNull() | (F.col(n) < F.col("f")), F.col(n)).alias(n) for n in ("c", "s")], "f").withColumn("x", F.least("c", "s")))
    in_time = F.col("f").isNull() | (pos < F.col("f"))
    mine = e.where(F.col("kind").isin("hold", *ACTIONS)).join(a, k)
    counts = (
        ((F.col("kind") == "hold") & F.col("level").between(1, 3) & live & in_time) | ((F.col("kind") == "escalate") & noted & live & in_time)
        | ((F.col("kind") == "clear") & noted & (pos == F.col("c"))) | ((F.col("kind") == "freeze") & noted & (pos == F.col("f"))))
    cols = ["account_id", "detector", "kind", "level", "at_us", "seq"]
    lifts = e.where("kind = 'lift'").join(a.select("account_id", "f").distinct(), "account_id").where(in_time)
    steps = cut(_steps(mine.where(counts).select(*cols).unionByName(lifts.select(*cols)), split))

    held_now = (F.col("kind") == "hold") & (F.col("level_after") >= 2) & (F.col("level_after") > F.col("level_before"))
    bits = steps.where(F.col("detector").isNotNull()).groupBy(*k).agg(
        F.max(F.when(held_now | ((F.col("kind") == "escalate") & ~F.col("held_before")), F.struct("at_us", "seq", (F.col("kind") == "escalate").alias("v")))).alias("e"),
        F.min(F.when(held_now | (F.col("kind") == "escalate"), F.col("at_us"))).alias("filed"))
    last = steps.groupBy("account_id").agg(F.max(F.struct("at_us", "seq", "level_after", "holder", "mask")).alias("z"))
    top = e.where("kind = 'raise'").join(a, k).where((F.col("c").isNull() | (pos < F.col("c")))).groupBy(*k).agg(F.max("score").alias("gnn_max"))
    y = a.join(top, k, "left").join(bits, k, "left").join(last, "account_id", "left")
    bit = F.coalesce("z.mask", F.lit(0)).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i if i < _RULES else 0) for i in range(len(DETECTORS))]), detector_order().cast("int"))) > 0
    status = (F.when(F.col("c").isNotNull(), "cleared").when(F.col("s").isNotNull(), "superseded").when(F.col("f").isNotNull(), "frozen")
              .when(bit, "held").when(F.col("e.v"), "escalated").otherwise("open"))
    alerts = y.select(*k, F.col("r.at_us").alias("raised_us"), "gnn_max", status.alias("status"),
                      F.least("filed", F.when(F.col("x").isNull(), F.col("f.at_us"))).alias("filed_us"))

    acts = e.where(F.col("kind").isin(*ACTIONS)).join(a, k, "left")
    raised_by = F.coalesce(F.col("r") < pos, F.lit(False))
    accepted = noted & raised_by & F.coalesce(F.col("x").isNull() | (pos <= F.col("x")), F.lit(False)) & (F.col("f").isNull() | (pos <= F.col("f"))) & (
        (F.col("kind") != "clear") | (pos == F.col("c")))
    acts = acts.withColumn("accepted", F.coalesce(accepted, F.lit(False))).join(
        steps.where(F.col("kind").isin(*ACTIONS)).select("account_id", "at_us", "seq", "level_before", "held_before"), ["account_id", "at_us", "seq"], "left").join(top, k, "left")
    clears = F.col("accepted") & (F.col("kind") == "clear")
    over = clears & ((F.col("level_before") > 0) | (F.col("gnn_max") >= rules.model_threshold))
    actions = acts.select(
        *k, "kind", "at_us", "seq", "accepted", F.when(~noted, "no note").when(~raised_by, "no alert").when(~F.col("accepted"), "closed").alias("refused"),
        F.coalesce(over, F.lit(False)).alias("override"), F.when(clears & F.col("held_before"), "release_hold").when(F.col("accepted"), F.col("kind")).alias("logged"))
    accounts = a.select("account_id", "f").distinct().join(last, "account_id", "left").select(
        "account_id", F.coalesce("z.level_after", F.lit(0)).alias("level"),
        F.when(F.col("z.level_after") > 0, F.element_at(F.array(*[F.lit(d) for d in DETECTORS]), F.col("z.holder") + 1)).alias("held_by"), F.col("f.at_us").alias("frozen_us"))
    return alerts, actions, accounts
