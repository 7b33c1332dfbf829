"""Read tools for investigators: each answers one question as a DataFrame over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import score_reading
from .operators import models as Md
from .operators import profiles as P


class Tools:
    def __init__(self, payments: DataFrame, accounts: DataFrame, model_edges: DataFrame, weights: Md.Weights):
        self.payments, self.accounts, self.edges, self.weights = payments, accounts, model_edges, weights

    def _account(self, vpa: str) -> DataFrame:
        handles = self.payments.sparkSession.createDataFrame([(vpa,)], "handle string")
        return P.resolve_handles(handles, self.payments, self.accounts)

    def score_transfers(self, legs: DataFrame) -> DataFrame:
        """Scores one or several proposed transfers (row < 0, from_id, to_id, features) on the current graph."""
        s = Md.score_edges(self.edges.select("row", "from_id", "to_id", "features").unionByName(legs), self.weights).where("row < 0")
        return s.withColumn("reading", score_reading(F.col("probability")))

    def account_profile(self, vpa: str) -> DataFrame:
        a = self._account(vpa)
        sent = self.payments.join(a.select(F.col("account_id").alias("from_id")), "from_id", "left_semi")
        # a payment to itself is among those sent
        got = self.payments.where(~F.col("from_id").eqNullSafe(F.col("to_id"))).join(a.select(F.col("account_id").alias("to_id")), "to_id", "left_semi")
        mine = sent.unionByName(got)
        return P.profile(mine).join(a, "account_id").join(self.accounts.select("account_id", "role", "bank"), "account_id", "left")

    def downstream(self, vpa: str, limit: int = 20) -> DataFrame:
        """Earliest outgoing transfers, 1 to 100 of them."""
        a = self._account(vpa).select(F.col("account_id").alias("from_id"))
        out = self.payments.join(a, "from_id", "left_semi")
        return out.orderBy("t_us", "row").limit(max(1, min(limit, 100))).select("to_vpa", "to_state", "amount", "t_us", "layer")

    def watch(self, needle: str = "", limit: int = 25) -> DataFrame:
        """Most recent payments whose state pair contains the text, ignoring case."""
        pair = F.concat("from_state", F.lit(" → "), "to_state")
        x = self.payments.withColumn("state_pair", pair).where(F.lower("state_pair").contains(needle.lower()))
        return x.orderBy(F.col("t_us").desc(), F.col("row").desc()).limit(limit).select("row", "state_pair", "amount", "score")
