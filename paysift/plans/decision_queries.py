"""Registered queries: policy replay, cases, audit chains, investigator tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..operators import alerts as A
from ..operators import audit as Au
from ..operators import models as Md
from ..operators import replay as Rp
from ..operators.running import global_index
from ..params import DAY, HOUR, Rules
from ..session import checkpoint_dir, cut
from ..sources import files
from . import graph_queries, profile_queries
from . import views as V
from .account_queries import stored_alerts

QUERIES = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def policy_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What people do during the policy run: every third account appeals at noon of every day, some appeals are decided in the
    afternoon, some lapse; every eleventh account is frozen after five days. What does not apply changes nothing."""
    last = V.payments(spark, sf).agg(F.floor((F.max("t_us") - V.BASE_US) / DAY).alias("last"))
    n = F.substring("account_id", 2, 18).cast("bigint")
    a = V.accounts(spark, sf).select("account_id", n.alias("n"))
    noon = F.lit(V.BASE_US + 12 * HOUR) + F.col("day") * F.lit(DAY) + F.col("n") * F.lit(1_000_000)
    daily = a.where("n % 3 = 0").crossJoin(F.broadcast(last)).withColumn("day", F.explode(F.expr("sequence(0L, greatest(last, 0L))"))).withColumn("at_us", noon)  # one row
    none = F.lit(None).cast("string").alias("detector")
    decided = F.expr("CASE WHEN n % 6 = 0 THEN 'release' WHEN n % 4 = 3 THEN 'uphold' END")
    appeals = daily.select("account_id", "at_us", F.lit("appeal").alias("action"), none)
    decisions = daily.select("account_id", F.col("at_us") + 5 * HOUR, decided.alias("action"), none).where("action IS NOT NULL")
    frozen = a.where("n % 11 = 4").select("account_id", F.lit(V.BASE_US + 5 * DAY), F.lit("freeze"), none)
    return appeals.union(decisions).union(frozen)


_POLICY: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _policy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _POLICY:
        flags, restr, _ = Rp.replay(V.payments(spark, sf), V.accounts(spark, sf), V.BASE_US, actions=policy_actions(spark, sf))
        _POLICY[key] = (cut(flags), restr)
    return _POLICY[key]


@query("policy_payment_flags")
def flags(spark, sf):
    """Payments blocked, delayed or cancelled when the router and people act, with all detectors on."""
    return _policy(spark, sf)[0]


@query("policy_restrictions")
def restrictions(spark, sf):
    return _policy(spark, sf)[1]


@query("policy_outcome")
def outcome(spark, sf):
    f, r = _policy(spark, sf)
    p = V.payments(spark, sf)
    last = p.agg(F.max("t_us")).first()[0]
    # the run ends with the last day that has a payment
    end = V.BASE_US if last is None else V.BASE_US + ((last - V.BASE_US) // DAY + 1) * DAY
    return Rp.policy_outcome(p, f, r, V.accounts(spark, sf), end)


def filed(spark, sf) -> DataFrame:
    """Alerts that an analyst escalated or froze, numbered in filing order."""
    a = profile_queries.actions(spark, sf).where("note <> '' AND action IN ('escalate', 'freeze')")
    return global_index(a, ["at_us", "account_id", A.detector_order()], F.floor(F.col("at_us") / HOUR), "event_no").select("event_no", "account_id", "detector", "at_us")


@query("cases")
def cases(spark, sf):
    return Au.form_cases(cut(filed(spark, sf).drop("detector")), V.payments(spark, sf))


def audit_entries(spark, sf) -> DataFrame:
    """Audit entries of every operator: the event log, one run per user."""
    e = V.table(spark, sf, "events")
    none = F.lit(None).cast("string")
    u = F.col("user_id").cast("string")
    return e.select(F.concat(F.lit("run-"), u).alias("run_id"), F.col("event_id").alias("entry_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.lit(None).cast("bigint").alias("sim_us"), F.col("event_type").alias("action"),
                    F.concat(F.lit("analyst-"), u).alias("actor"), F.lit("analyst").alias("role"), F.col("props").alias("note"), none.alias("alert_id"), F.concat(F.lit("A"), u).alias("account_id"), none.alias("case_id"), none.alias("payload"))


@query("audit_chain_heads")
def heads(spark, sf):
    c = Au.seal(audit_entries(spark, sf))
    return c.groupBy("run_id").agg(F.max_by("hash", F.struct("at_us", "entry_id")).alias("head"), F.count(F.lit(1)).alias("entries"))


def _tampered(spark, sf) -> DataFrame:
    """A sealed chain with edited notes, removed entries and legacy rows that were never chained."""
    old = F.col("entry_id") < 20
    e = audit_entries(spark, sf)
    c = Au.seal(e.where(~old)).where("entry_id % 1009 <> 5").withColumn("note", F.when(F.col("entry_id") % 997 == 0, F.lit("edited")).otherwise(F.col("note")))
    none = F.lit(None).cast("string")
    return c.unionByName(e.where(old).withColumn("prev_hash", none).withColumn("hash", none))


@query("audit_chain_check")
def check(spark, sf):
    return Au.verify(cut(_tampered(spark, sf)))


@query("audit_trail")
def trail(spark, sf):
    """The newest 200 entries (a report limit)."""
    return Au.trail(audit_entries(spark, sf)).select("run_id", "entry_id", "action", "at_us")


@query("record_hashes")
def hashes(spark, sf):
    return audit_entries(spark, sf).select("entry_id", Au.record_hash(Au.HASHED).alias("hash"))


@query("record_signatures")
def signatures(spark, sf):
    return audit_entries(spark, sf).select("entry_id", Au.signature(Au.canonical(), "demo-secret").alias("signature"))


def _tools(spark, sf) -> tools.Tools:
    e = graph_queries.model_edges(spark, sf)
    return tools.Tools(V.payments(spark, sf), V.accounts(spark, sf), e, Md.load_weights(Md.weights_table(spark)))


@query("tool_account_profile")
def tool_profile(spark, sf):
    return _tools(spark, sf).account_profile("a3@x")


@query("tool_downstream")
def tool_downstream(spark, sf):
    return _tools(spark, sf).downstream("a3@x", 20)


@query("tool_watch")
def tool_watch(spark, sf):
    return _tools(spark, sf).watch("s1")


@query("tool_score_transfers")
def tool_score(spark, sf):
    legs = graph_queries.model_edges(spark, sf).orderBy(F.col("t_us").desc()).limit(5).select((-F.col("row") - 1).alias("row"), "from_id", "to_id", "features")
    return _tools(spark, sf).score_transfers(legs)


@query("restriction_lifecycle")
def lifecycle(spark, sf):
    """Restrictions as the router would set them on the alert table, ended by expiry, appeals and freezes."""
    al = stored_alerts(spark, sf)
    at = al.where("status <> 'superseded'").groupBy("account_id").agg(F.max("created_us").alias("at_us"))
    n = F.substring("account_id", 2, 10).cast("bigint")
    hours = F.element_at(F.array(F.lit(1), F.lit(24), F.lit(72)), F.col("level"))
    r = A.route(al).where("level > 0").join(at, "account_id").select("account_id", "level", "at_us", (F.col("at_us") + hours * HOUR).alias("log_end_us"))
    ap = r.where(n % 3 < 2).select("account_id", (F.col("at_us") + (n % 5 + 1) * HOUR).alias("at_us"), F.when(n % 2 == 0, "release").otherwise("uphold").alias("decision"), F.when(n % 7 < 5, F.col("at_us") + (n % 40 + 2) * HOUR).alias("decided_us"))
    fr = r.where(n % 11 == 4).select("account_id", (F.col("at_us") + 3 * HOUR).alias("at_us"))
    return Rp.lifecycle(r, ap, fr)


@query("score_table_sink")
def score_sink(spark, sf):
    """Scores written with their metadata and joined back by payment row."""
    folder = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    p = V.payments(spark, sf)
    files.write_scores(p.select("row", "score"), folder, "m1", 5, 72 * 3600)
    s, meta = files.read_scores(spark, folder)
    return p.select("row", "is_fraud").join(s, "row").groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("top")).crossJoin(F.broadcast(meta))  # one metadata row
