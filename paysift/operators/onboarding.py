"""Onboarding: what an applicant's settlement VPAs have to do with accounts under alert, directly and over one account between.

Flagged accounts are numbered from the highest alert score down, and an account's flagged counterparties are a set of those
numbers, packed by the million: as steps between them where they are few, as a bitmap where they are many, so a set takes
two bytes a member or a bit a number up to its last one, whichever is less. The second hop is the union of the counterparties' sets without
the direct ones and the applicant itself, made set by set where all of an applicant's sets meet; so a hub with many
applicants on one side and many flagged accounts on the other is never written out as pairs. Its lowest number is the
worst account reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, spread
from .profiles import counterparties, legs
from .running import global_index

_BITS = 1 << 20
_BITMAP, _STEPS, _NUMBERS = b"\0", b"\1", b"\2"


def pack(numbers: np.ndarray) -> bytes:
    """A set of numbers below _BITS, given in order: the smallest of bitmap, 16-bit steps, and the numbers themselves."""
    steps = np.diff(numbers, prepend=0)
    narrow = steps.max(initial=0) < 1 << 16
    if len(numbers) * (2 if narrow else 4) > numbers.max(initial=0) // 8:
        bits = np.zeros(numbers.max(initial=0) + 1, bool)
        bits[numbers] = True
        return _BITMAP + np.packbits(bits).tobytes()
    return _STEPS + steps.astype("<u2").tobytes() if narrow else _NUMBERS + numbers.astype("<u4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    kind = packed[:1]
    if kind == _BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))
    return np.cumsum(np.frombuffer(packed, "<u2", offset=1), dtype=np.int64) if kind == _STEPS else np.frombuffer(packed, "<u4", offset=1)


@F.pandas_udf(T.BinaryType())
def _packed(numbers: pd.Series) -> pd.Series:
    return pd.Series([pack(np.asarray(x, np.int64)) for x in numbers], dtype=object)


def _left_over(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers in the sets of an account's counterparties that are in none of its taken sets: how many, and the lowest."""
    reach, taken = np.zeros(_BITS, bool), []
    for b in batches:
        for bits, is_taken in zip(b["bits"], b["taken"]):
            if is_taken:
                taken.append(bits)
            else:
                reach[unpack(bits)] = True
    for bits in taken:  # two at most
        reach[unpack(bits)] = False
    n = int(np.count_nonzero(reach))
    if n:
        yield pd.DataFrame({"account_id": [key[0]], "n": [n], "no": [int(key[1]) * _BITS + int(reach.argmax()) + 1]})


def numbered_by_score(flagged: DataFrame) -> DataFrame:
    """(account_id, score, no): no 1 has the highest score; equal scores in the order of the ids' md5, which spreads them over tasks."""
    h = F.md5("account_id")
    cell = -F.col("score").cast("bigint") * 4096 + F.conv(F.substring(h, 1, 3), 16, 10).cast("bigint")
    return global_index(flagged.where("account_id IS NOT NULL").select("account_id", "score"), [F.col("score").desc(), h, F.col("account_id")], cell, "no")


def onboarding_report(applicants: DataFrame, payments: DataFrame, flagged: DataFrame, strong_score: float = 0.9) -> DataFrame:
    """One row per VPA of `applicants` (vpa, account_id or null if never seen): payments, counterparties, whether it is itself
    flagged, flagged accounts met directly and at the second hop, the worst second-hop account with its alert score and the
    account it is reached over (smallest id), decision and reason. `flagged` is (account_id, score), scores whole numbers."""
    cp = cut(counterparties(payments))
    num = cut(numbered_by_score(flagged))
    me = applicants.where("account_id IS NOT NULL").select("account_id").distinct()
    mine = cp.join(me, "account_id", "left_semi")
    cell = [F.floor((F.col("no") - 1) / _BITS).alias("b"), ((F.col("no") - 1) % _BITS).cast("int").alias("p")]
    near = cp.join(num.select(F.col("account_id").alias("other_id"), "no"), "other_id").select("account_id", *cell)
    near = near.groupBy("account_id", "b").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # at most _BITS numbers
    near = cut(near.select("account_id", "b", F.size("ps").alias("n"), _packed("ps").alias("bits")))
    own = near.join(me, "account_id", "left_semi")
    itself = num.join(me, "account_id", "left_semi").select("account_id", *cell).select("account_id", "b", _packed(F.array("p")).alias("bits"))
    reach = mine.withColumnRenamed("other_id", "via").join(near.withColumnRenamed("account_id", "via"), "via").select("account_id", "b", "bits", F.lit(False).alias("taken"))
    sets = reach.unionByName(own.unionByName(itself, allowMissingColumns=True).select("account_id", "b", "bits", F.lit(True).alias("taken")))
    # every counterparty sends about one set
    rest = spread(sets, mine.count(), "account_id", "b").groupBy("account_id", "b").applyInPandas(_left_over, "account_id string, n long, no long")
    second = rest.groupBy("account_id").agg(F.sum("n").alias("second_hop"), F.min("no").alias("no"))
    second = cut(second.join(num.select("no", F.col("account_id").alias("second_account"), F.col("score").alias("second_score")), "no"))
    via = mine.join(second.select("account_id", "second_account"), "account_id").join(
        cp.select(F.col("account_id").alias("other_id"), F.col("other_id").alias("second_account")), ["other_id", "second_account"], "left_semi")
    via = via.groupBy("account_id").agg(F.min("other_id").alias("via"))
    direct = own.groupBy("account_id").agg(F.sum("n").alias("direct"))
    n = mine.groupBy("account_id").agg(F.count(F.lit(1)).alias("counterparties"))
    rows = legs(payments).join(me, "account_id", "left_semi").groupBy("account_id").agg(F.count(F.lit(1)).alias("txns"), F.max("score").alias("gnn_max"))
    x = applicants.select("vpa", "account_id").distinct()
    for part in (rows, n, direct, second.drop("no"), via, num.select("account_id", F.lit(True).alias("self_flagged"))):
        x = x.join(part, "account_id", "left")
    x = x.na.fill(0, ["txns", "counterparties", "direct", "second_hop"]).na.fill(0.0, ["gnn_max"]).na.fill(False, ["self_flagged"])
    strong = F.col("self_flagged") | (F.col("direct") > 0) | (F.col("gnn_max") >= strong_score)
    why = (F.when(F.col("account_id").isNull(), "not seen in any payment").when(F.col("self_flagged"), "itself under alert")
           .when(F.col("direct") > 0, F.concat(F.lit("direct links to flagged accounts: "), F.col("direct").cast("string"))).when(F.col("gnn_max") >= strong_score, "high model score on a transfer")
           .when(F.col("second_hop") > 0, F.concat(F.lit("second-hop links only: "), F.col("second_hop").cast("string"))).otherwise("no links"))
    return x.select("vpa", "account_id", F.col("account_id").isNotNull().alias("known"), "txns", "counterparties", "self_flagged", "direct", "second_hop", "second_account", "second_score", "via",
                    F.when(strong, "hold").otherwise("approve").alias("decision"), why.alias("reason"))
