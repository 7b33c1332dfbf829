"""Registered queries: evaluation of scores and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import prf, rupees, wilson
from ..operators import alerts as A
from ..operators import metrics as M
from ..params import DAY, R20, SPLIT_DAYS, Rules
from . import views as V
from .account_queries import stored_alerts

QUERIES = {}
D0 = V.BASE_US


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def in_split(name: str, c: str = "t_us") -> Column:
    a, b = SPLIT_DAYS[name]
    return (F.col(c) >= D0 + a * DAY) & (F.col(c) < D0 + b * DAY)


def scored(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    p = V.payments(spark, sf)
    if split:
        p = p.where(in_split(split))
    return p.select("row", "t_us", "layer", "amount", "amount_p", F.col("is_fraud").alias("y"), F.col("score").alias("s"))


def r9(*names: str) -> list[Column]:
    return [F.round(n, 9).alias(n) for n in names]


@query("edge_metrics_at_thresholds")
def edge_metrics(spark, sf):
    m = M.at_thresholds(scored(spark, sf, "test"), [0.3, 0.5, 0.7, 0.86, 0.9, 0.95])
    lo, hi = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    rlo, rhi = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("threshold", "tp", "fp", "fn", *r9("precision", "recall", "f1"), lo.alias("p_lo"), hi.alias("p_hi"), rlo.alias("r_lo"), rhi.alias("r_hi"))


@query("threshold_max_f1_grid")
def grid_threshold(spark, sf):
    return M.best_grid_threshold(scored(spark, sf, "val")).select("threshold", "tp", "fp", "fn", *r9("precision", "recall", "f1"))


@query("threshold_pr_curve")
def pr_threshold(spark, sf):
    return M.best_pr_threshold(scored(spark, sf, "val"))


@query("roc_auc_payments")
def auc(spark, sf):
    return M.roc_auc(scored(spark, sf, "test")).select(*r9("roc_auc"), "p", "n")


@query("roc_auc_scored_docs")
def auc_docs(spark, sf):
    return M.roc_auc(V.scored_docs(spark, sf)).select(*r9("roc_auc"), "p", "n")


@query("average_precision_payments")
def ap(spark, sf):
    return M.average_precision(scored(spark, sf, "test")).select(*r9("average_precision"))


@query("average_precision_scored_docs")
def ap_docs(spark, sf):
    return M.average_precision(V.scored_docs(spark, sf)).select(*r9("average_precision"))


@query("precision_at_k_payments")
def p_at_k(spark, sf):
    return M.precision_at_k(scored(spark, sf, "test"), (25, 50, 100, 200), [F.col("s").desc(), F.col("t_us"), F.col("row")])


@query("per_layer_report")
def per_layer(spark, sf):
    t = scored(spark, sf, "test")
    g = t.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("s") >= R20.model_threshold).cast("bigint")).alias("flagged"), F.max("amount").alias("amount_max"))
    return g.join(M.percentiles(t, "amount", {"amount_median": 0.5}, ["layer"]), "layer")


@query("score_histogram")
def hist(spark, sf):
    return M.histogram(scored(spark, sf, "test"))


@query("amount_percentiles_by_channel")
def pct(spark, sf):
    p = V.payments(spark, sf)
    m = M.percentiles(p, "amount", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p999": 0.999}, ["channel"])
    return m.select("channel", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90", "p999")])


@query("amount_rule_baseline")
def amount_rule(spark, sf):
    g = V.payments(spark, sf).agg(
        F.sum(((F.col("amount") >= 450_000) & (F.col("is_fraud") == 1)).cast("bigint")).alias("tp"),
        F.sum(((F.col("amount") >= 450_000) & (F.col("is_fraud") == 0)).cast("bigint")).alias("fp"),
        F.sum(((F.col("amount") < 450_000) & (F.col("is_fraud") == 1)).cast("bigint")).alias("fn"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


@query("dataset_facts")
def facts(spark, sf):
    p = V.payments(spark, sf)
    seen = p.select(F.explode(F.array("from_id", "to_id")).alias("account_id")).union(V.accounts(spark, sf).select("account_id")).distinct()
    f = p.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_fraud").cast("bigint")).alias("fraud_rows"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"),
        F.min(F.when(F.col("is_fraud") == 1, F.col("t_us"))).alias("fraud_from_us"), F.max(F.when(F.col("is_fraud") == 1, F.col("t_us"))).alias("fraud_to_us"),
    )
    return f.crossJoin(seen.agg(F.count(F.lit(1)).alias("accounts")))  # one row each


@query("fraud_profile")
def fraud_profile(spark, sf):
    f = V.payments(spark, sf).where((F.col("is_fraud") == 1) & in_split("test"))
    g = f.agg(F.count(F.lit(1)).alias("payments"), F.max("amount").alias("max_amount"), rupees(F.sum(F.when(F.col("layer") == "error", F.col("amount_p")))).alias("victim_total"),
              rupees(F.sum("amount_p")).alias("all_total"))
    return g.crossJoin(M.percentiles(f, "amount", {"median_amount": 0.5}))  # one row each


@query("clean_accounts_active_in_test")
def clean_active(spark, sf):
    a = V.payments(spark, sf).where(in_split("test")).select(F.explode(F.array("from_id", "to_id")).alias("account_id")).distinct()
    mules = V.accounts(spark, sf).where(A.is_mule(F.col("role"))).select("account_id")
    return a.join(mules, "account_id", "left_anti").agg(F.count(F.lit(1)).alias("clean_accounts"))


@query("txns_last_minute")
def last_minute(spark, sf):
    """Payments in the last minute of the most recent 400 (a top-k report)."""
    p = V.payments(spark, sf).select("t_us", "row")
    last = p.orderBy(F.col("t_us").desc(), F.col("row").desc()).limit(400)
    end = p.agg(F.max("t_us").alias("end_us"))
    return last.crossJoin(F.broadcast(end)).where("t_us > end_us - 60000000").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ alerts against truth


def active_mules(spark: SparkSession, sf: str, split: str | None = "test") -> DataFrame:
    """Mule accounts that a fraud payment touched, with their first fraud money in and out."""
    f = V.payments(spark, sf).where(F.col("is_fraud") == 1)
    if split:
        f = f.where(in_split(split))
    legs = f.select(F.inline(F.array(
        F.struct(F.col("to_id").alias("account_id"), F.col("t_us").alias("in_us"), F.lit(None).cast("bigint").alias("out_us")),
        F.struct(F.col("from_id").alias("account_id"), F.lit(None).cast("bigint").alias("in_us"), F.col("t_us").alias("out_us")))))
    m = V.accounts(spark, sf).where(A.is_mule(F.col("role"))).select("account_id", "role")
    return legs.groupBy("account_id").agg(F.min("in_us").alias("first_in_us"), F.min("out_us").alias("first_out_us")).join(m, "account_id")


def account_hits(spark: SparkSession, sf: str, rules: Rules = R20) -> DataFrame:
    """One row per account that is a mule active in the test days or was alerted in them."""
    al = stored_alerts(spark, sf, rules).where(in_split("test", "created_us"))
    g = al.groupBy("account_id").agg(F.max(F.col("detector") != "model_only").alias("by_rule"), F.max(F.col("detector") == "model_only").alias("by_model"))
    m = active_mules(spark, sf).select("account_id", F.lit(True).alias("mule"))
    return g.join(m, "account_id", "full").select("account_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("by_rule", "by_model", "mule")])


@query("account_level_metrics")
def account_level(spark, sf):
    h = account_hits(spark, sf)
    arms = F.inline(F.array(F.struct(F.lit("rules").alias("arm"), F.col("by_rule").alias("hit")), F.struct(F.lit("model").alias("arm"), F.col("by_model").alias("hit")),
                            F.struct(F.lit("combined").alias("arm"), (F.col("by_rule") | F.col("by_model")).alias("hit"))))
    g = h.select("mule", arms).groupBy("arm").agg(
        F.sum((F.col("hit") & F.col("mule")).cast("bigint")).alias("tp"), F.sum((F.col("hit") & ~F.col("mule")).cast("bigint")).alias("fp"),
        F.sum((~F.col("hit") & F.col("mule")).cast("bigint")).alias("fn"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    plo, phi = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    rlo, rhi = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("arm", "tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"),
                    plo.alias("p_lo"), phi.alias("p_hi"), rlo.alias("r_lo"), rhi.alias("r_hi"))


@query("alerts_by_detector_vs_truth")
def by_detector(spark, sf):
    al = stored_alerts(spark, sf).where(in_split("test", "created_us")).select("detector", "account_id").distinct()
    m = active_mules(spark, sf).select("account_id", F.lit(1).alias("mule"))
    return al.join(m, "account_id", "left").groupBy("detector").agg(F.count(F.lit(1)).alias("alerts"), F.count("mule").alias("mules")).select(
        "detector", "alerts", "mules", F.round(F.col("mules") / F.col("alerts"), 9).alias("precision"))


@query("found_by_role")
def by_role(spark, sf):
    al = stored_alerts(spark, sf).where(in_split("test", "created_us")).select("account_id", F.lit(1).alias("found")).distinct()
    return active_mules(spark, sf).join(al, "account_id", "left").groupBy("role").agg(F.count(F.lit(1)).alias("active"), F.count("found").alias("found"))


def queue(spark: SparkSession, sf: str, rules: Rules = R20) -> DataFrame:
    """The analyst queue: the best alert per account."""
    from pyspark.sql import Window

    al = stored_alerts(spark, sf, rules).where(in_split("test", "created_us"))
    # at most one alert per detector and account, so a group has at most six rows
    w = Window.partitionBy("account_id").orderBy(F.col("score").desc(), "created_us", "created_row", A.detector_order())
    return al.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query("analyst_queue")
def analyst_queue(spark, sf):
    return queue(spark, sf).select("account_id", "detector", "score", "created_us")


@query("queue_precision_at_k")
def queue_at_k(spark, sf):
    m = active_mules(spark, sf).select("account_id", F.lit(1).alias("y"))
    q = queue(spark, sf).join(m, "account_id", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return M.precision_at_k(q, (5, 10, 20, 50), [F.col("score").desc(), F.col("created_us"), F.col("created_row")])


@query("lead_and_time_to_alert")
def lead_times(spark, sf):
    first = stored_alerts(spark, sf).groupBy("account_id").agg(F.min("created_us").alias("alert_us"))
    x = active_mules(spark, sf).join(first, "account_id", "left").select(
        ((F.col("first_out_us") - F.col("alert_us")) / 1e6).alias("lead"), ((F.col("alert_us") - F.col("first_in_us")) / 1e6).alias("to_alert"), "first_out_us")
    g = x.agg(F.count("lead").alias("lead_n"), F.count(F.when(F.col("lead") > 0, 1)).alias("alerted_before_money_left"), F.count("first_out_us").alias("mules_that_forwarded"),
              F.count("to_alert").alias("to_alert_n"))
    a = M.percentiles(x, "lead", {"lead_p10": 0.1, "lead_p50": 0.5, "lead_p90": 0.9})
    b = M.percentiles(x, "to_alert", {"to_alert_p50": 0.5, "to_alert_p90": 0.9})
    j = g.join(a, F.lit(True), "left").join(b, F.lit(True), "left")  # one row each
    return j.select("lead_n", "alerted_before_money_left", "mules_that_forwarded", "to_alert_n", *[F.round(c, 3).alias(c) for c in ("lead_p10", "lead_p50", "lead_p90", "to_alert_p50", "to_alert_p90")])


@query("dashboard_metrics")
def dashboard(spark, sf):
    live = stored_alerts(spark, sf).where("status <> 'superseded'")
    open_ = F.col("status") == "open"
    acc = V.accounts(spark, sf).select("account_id", "role")
    j = live.join(acc, "account_id", "left").join(active_mules(spark, sf, None).select("account_id", F.lit(1).alias("active")), "account_id", "left")
    mule = A.is_mule(F.col("role"))
    g = j.agg(
        *[F.count(F.when(open_ & (F.col("severity") == s), 1)).alias(f"open_{s}") for s in ("critical", "high", "medium", "low")],
        F.count(F.when(open_, 1)).alias("open_alerts"),
        F.count_distinct("account_id").alias("alerted"),
        F.count_distinct(F.when(mule, F.col("account_id"))).alias("mules_alerted_any"),
        F.count_distinct(F.when(F.col("active") == 1, F.col("account_id"))).alias("mules_alerted"),
        F.count_distinct(F.when((F.col("active") == 1) & (F.col("detector") != "model_only"), F.col("account_id"))).alias("mules_alerted_rules"),
    )
    seen = active_mules(spark, sf, None).agg(F.count(F.lit(1)).alias("mules_seen"))
    med = M.percentiles(live.select(((F.col("created_us") - F.col("first_evidence_us")) / 1e6).alias("x")), "x", {"median_time_to_alert": 0.5})
    vol = V.payments(spark, sf).agg(rupees(F.sum("amount_p")).alias("volume"))
    x = g.crossJoin(seen).crossJoin(med).crossJoin(vol)  # one row each
    return x.select("open_critical", "open_high", "open_medium", "open_low", "open_alerts", "mules_seen", "mules_alerted", F.round("median_time_to_alert", 3).alias("median_time_to_alert"), "volume",
                    F.round(F.col("mules_alerted_any") / F.col("alerted"), 9).alias("precision"), F.round(F.col("mules_alerted") / F.col("mules_seen"), 9).alias("recall"),
                    F.round(F.col("mules_alerted_rules") / F.col("mules_seen"), 9).alias("recall_rules"))


@query("false_accounts_per_day")
def false_accounts(spark, sf):
    """Alerted accounts that are not mules, from day 1 on, by first detector and kind."""
    first = stored_alerts(spark, sf).groupBy("account_id").agg(F.min(F.struct("created_us", "created_row", A.detector_order().alias("o"), "detector")).alias("f"))
    a = V.accounts(spark, sf).select("account_id", "role", "kind")
    # the days of the data after the first
    days = max(1, ((V.payments(spark, sf).agg(F.max("t_us")).first()[0] or D0) - D0) // DAY)
    x = first.join(a, "account_id", "left").where(~F.coalesce(A.is_mule(F.col("role")), F.lit(False)) & (F.col("f.created_us") >= D0 + DAY))
    return x.groupBy(F.col("f.detector").alias("detector"), F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("accounts")).withColumn(
        "per_day", F.round(F.col("accounts") / F.lit(days), 9))


@query("rule_and_model_account_sets")
def account_sets(spark, sf):
    """Set algebra over alerted accounts: union, overlap with mules, false accounts."""
    al = stored_alerts(spark, sf).where(in_split("test", "created_us"))
    rules = al.where("detector <> 'model_only'").select("account_id")
    model = al.where("detector = 'model_only'").select("account_id")
    mules = active_mules(spark, sf).select("account_id")
    both = rules.union(model).distinct()
    parts = {"rule_or_model": both, "hit_mules": both.intersect(mules), "false_accounts": both.subtract(mules), "missed_mules": mules.subtract(both)}
    out = None
    for name, d in parts.items():
        x = d.agg(F.count(F.lit(1)).alias("n")).withColumn("set_name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


@query("rule_version_arms")
def arms(spark, sf):
    """The same rows judged under several rule versions."""
    out = None
    for r in (R20, Rules(version="r2.1"), Rules(version="r2.2"), Rules(hop_rule=False)):
        h = account_hits(spark, sf, r)
        hit = F.col("by_rule") | F.col("by_model")
        g = h.agg(F.sum((hit & F.col("mule")).cast("bigint")).alias("tp"), F.sum((hit & ~F.col("mule")).cast("bigint")).alias("fp"), F.sum((~hit & F.col("mule")).cast("bigint")).alias("fn"))
        g = g.withColumn("arm", F.lit(r.version + ("" if r.hop_rule else " - hop")))
        out = g if out is None else out.unionByName(g)
    p, rc, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("arm", "tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(rc, 9).alias("recall"))


@query("arm_pass_fail")
def verdict(spark, sf):
    """Criteria over the arm rows: recall not below r2.0, queue not above its maximum."""
    a = arms(spark, sf).withColumn("queue", F.col("tp") + F.col("fp"))
    base = a.where("arm = 'r2.0'").select(F.col("recall").alias("base_recall"), F.col("queue").alias("base_queue"))
    return a.crossJoin(base).select("arm", F.expr("recall >= base_recall - 1e-9").alias("recall_pass"), F.expr("queue <= base_queue").alias("queue_pass"))


@query("base_rate_projection")
def base_rate(spark, sf):
    """Precision if fraud were rarer, recall and false-positive rate held fixed, with exact intervals."""
    t = scored(spark, sf, "test")
    c = t.agg(
        F.sum(((F.col("s") >= R20.model_threshold) & (F.col("y") == 1)).cast("bigint")).alias("tp"), F.sum(((F.col("s") >= R20.model_threshold) & (F.col("y") == 0)).cast("bigint")).alias("fp"),
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg"))
    c = c.withColumn("ci_r", M.clopper_pearson("tp", "pos")).withColumn("ci_f", M.clopper_pearson("fp", "neg"))
    x = c.select("*", F.explode(F.array(*[F.lit(d) for d in (1, 10, 100, 1000)])).alias("rarer")).withColumn("prev", F.col("pos") / (F.col("pos") + F.col("neg")) / F.col("rarer"))

    def prec(tpr: Column, fpr: Column) -> Column:
        hit = tpr * F.col("prev")
        both = hit + fpr * (1 - F.col("prev"))
        return F.when(both > 0, hit / both).otherwise(F.lit(0.0))

    point = prec(F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg"))
    return x.select("rarer", F.round("prev", 9).alias("prevalence"), F.round(point, 6).alias("precision"),
                    F.round(prec(F.col("ci_r.lo"), F.col("ci_f.hi")), 4).alias("precision_low"), F.round(prec(F.col("ci_r.hi"), F.col("ci_f.lo")), 4).alias("precision_high"))


@query("base_rate_projection_point")
def base_rate_point(spark, sf):
    return base_rate(spark, sf).select("rarer", "prevalence", "precision")

