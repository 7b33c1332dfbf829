"""Registered queries: account detectors, alerts and the decision layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import detectors as D
from ..params import R20, R21, R22, SPLIT, Rules
from ..session import cut
from . import views as V

FIRING = ("account_id", "t_us", "row", "w_us", "severity", "base_score", "total_p", "out_p", "people", "hits", "bar_p")
OUT = tuple(c for c in A.ALERT_COLUMNS if c not in ("w_us", "bar_p", "out_p", "gnn_max"))
QUERIES = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def _firings(detector: str, rules: Rules):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        _, f = D.primary_firings(V.payments(spark, sf), V.accounts(spark, sf), rules)
        return f.where(F.col("detector") == detector).select(*FIRING)
    return run


for r in (R20, R21):
    tag = "" if r is R20 else "_r21"
    for d in ("inflow_new_payers", "structuring", "pass_through") + (("fan_in_new_payers",) if tag else ()):
        QUERIES[f"{d}_firings{tag}"] = _firings(d, r)


def alert_table(spark: SparkSession, sf: str, rules: Rules = R20) -> DataFrame:
    return A.alert_table(V.payments(spark, sf), V.accounts(spark, sf), rules)


_STORED: dict[tuple, DataFrame] = {}
_PRIMARY: dict[tuple, tuple[DataFrame, A.Hot]] = {}


def stored_alerts(spark: SparkSession, sf: str, rules: Rules = R20) -> DataFrame:
    """The alert table as later queries read it: written once per session, data folder and rule version.

    Versions that differ behind the primary stage only share its result.
    """
    app, shared = spark.sparkContext.applicationId, A.primary_rules(rules)
    if (app, sf, repr(rules)) not in _STORED:
        payments, accounts = V.payments(spark, sf), V.accounts(spark, sf)
        if (app, sf, repr(shared)) not in _PRIMARY:
            _PRIMARY[app, sf, repr(shared)] = A.primary_stage(payments, accounts, shared, SPLIT)[1:]
        _STORED[app, sf, repr(rules)] = cut(A.alert_table(payments, accounts, rules, SPLIT, _PRIMARY[app, sf, repr(shared)]))
    return _STORED[app, sf, repr(rules)]


def _alerts(rules: Rules):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return alert_table(spark, sf, rules).select(*OUT, F.round("gnn_max", 6).alias("gnn_max"))
    return run


for name, r in (("alerts_r20", R20), ("alerts_r21", R21), ("alerts_r22", R22), ("alerts_r20_without_hop", Rules(hop_rule=False))):
    QUERIES[name] = _alerts(r)


@query("alert_evidence_r20")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return A.evidence_table(V.payments(spark, sf), V.accounts(spark, sf), R20)
