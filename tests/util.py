"""Hand-built payment lists."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paysift.functions.scalars import near_cap

T0 = 1_704_067_200_000_000
COLS = "row bigint, t_us bigint, from_id string, to_id string, from_vpa string, to_vpa string, from_state string, to_state string, amount double, channel string, score double, is_fraud int, layer string, txn_id string"


def pay(row, at_s, f, t, amount, channel="P2P", score=0.01, fraud=0):
    return {"row": row, "t_us": T0 + int(at_s * 1_000_000), "from_id": f, "to_id": t, "from_vpa": f + "@x", "to_vpa": t + "@x", "from_state": "Tamil Nadu", "to_state": "Rajasthan",
            "amount": float(amount), "channel": channel, "score": score, "is_fraud": fraud, "layer": "clean", "txn_id": f"T{row}"}


def frame(spark, rows):
    d = spark.createDataFrame([tuple(r[c.split()[0]] for c in COLS.split(", ")) for r in rows], COLS)
    return d.withColumn("amount_p", F.round(F.col("amount") * 100).cast("bigint")).withColumn("near", near_cap(F.col("amount")))


def people(spark, rows, kind="individual"):
    ids = sorted({r["from_id"] for r in rows} | {r["to_id"] for r in rows})
    return spark.createDataFrame([(i, kind, "clean") for i in ids], "account_id string, kind string, role string")


def random_rows(seed, n, accounts, days=4, scores=(0.1, 0.3, 0.5, 0.9)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        f = r.randrange(accounts)
        # account 0 gets a third of everything
        t = 0 if r.random() < 0.33 and f != 0 else (f + 1 + r.randrange(accounts - 1)) % accounts
        out.append(pay(i, r.randrange(days * 86400), f"A{f}", f"A{t}", r.choice([49999, 95000, 20000, 60000, 5000, 1000]), r.choice(["P2P", "P2P", "P2M"]), r.choice(scores)))
    return out
