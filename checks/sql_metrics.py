"""DuckDB oracle text for the evaluation queries."""

from .sql_alerts import BASE, alerts_ctes
from .sql_views import V_ACCOUNTS, V_PAYMENTS, V_SCORED_DOCS, with_

D0, DAY = 1_704_067_200_000_000, 86_400_000_000
TEST = f"t_us >= {D0 + 8 * DAY} AND t_us < {D0 + 10 * DAY}"
VAL = f"t_us >= {D0 + 6 * DAY} AND t_us < {D0 + 8 * DAY}"
TESTC = TEST.replace("t_us", "created_us")
SCORED = "sc AS (SELECT row, t_us, layer, amount, amount_p, is_fraud AS y, score AS s FROM pay WHERE {})".format
MULES = f"""fr AS (SELECT * FROM pay WHERE is_fraud = 1 AND {TEST}), fra AS (SELECT * FROM pay WHERE is_fraud = 1),
mules AS (
  SELECT a.account_id, role, min(i) AS first_in_us, min(o) AS first_out_us FROM (
    SELECT to_id AS account_id, t_us AS i, NULL AS o FROM fr UNION ALL SELECT from_id, NULL, t_us FROM fr) x JOIN v_accounts a ON a.account_id = x.account_id
  WHERE role IN ('l1_mule','l2_mule') GROUP BY 1, 2),
mules_all AS (SELECT DISTINCT a.account_id FROM (SELECT to_id AS account_id FROM fra UNION ALL SELECT from_id FROM fra) x JOIN v_accounts a USING (account_id) WHERE role IN ('l1_mule','l2_mule'))"""
WIL = "round(greatest(0.0, ({k}::DOUBLE/{n} + 1.96*1.96/(2*{n}) - 1.96*sqrt(({k}::DOUBLE/{n})*(1-{k}::DOUBLE/{n})/{n} + 1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n})), 4)"
WIH = "round(least(1.0, ({k}::DOUBLE/{n} + 1.96*1.96/(2*{n}) + 1.96*sqrt(({k}::DOUBLE/{n})*(1-{k}::DOUBLE/{n})/{n} + 1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n})), 4)"


def wil(k: str, n: str, a: str, b: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {WIL.format(k=k, n=n)} END AS {a}, CASE WHEN {n} > 0 THEN {WIH.format(k=k, n=n)} END AS {b}"


PRF = (
    "round(CASE WHEN tp+fp > 0 THEN tp::DOUBLE/(tp+fp) ELSE 0.0 END, 9) AS precision, round(CASE WHEN tp+fn > 0 THEN tp::DOUBLE/(tp+fn) ELSE 0.0 END, 9) AS recall, "
    "round(CASE WHEN tp > 0 THEN 2.0*(tp::DOUBLE/(tp+fp))*(tp::DOUBLE/(tp+fn))/((tp::DOUBLE/(tp+fp))+(tp::DOUBLE/(tp+fn))) ELSE 0.0 END, 9) AS f1"
)
CONF = "SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn"


def P(*ctes: str) -> str:
    return with_(V_PAYMENTS, *ctes)


def A(version: str = "r2.0", *ctes: str, hop: bool = True) -> str:
    return with_(V_PAYMENTS, V_ACCOUNTS, BASE, alerts_ctes(version, hop), MULES, *ctes)


AUC = """SELECT round((sum(pos * (lower_n + (n + 1) / 2.0)) - p * (p + 1) / 2.0) / (p * (tot - p)), 9) AS roc_auc, CAST(p AS BIGINT) AS p, CAST(tot - p AS BIGINT) AS n FROM (
  SELECT g.*, (SELECT count(*) FROM {t} z WHERE z.s < g.s) AS lower_n, (SELECT sum(y) FROM {t}) AS p, (SELECT count(*) FROM {t}) AS tot
  FROM (SELECT s, sum(y) AS pos, count(*) AS n FROM {t} GROUP BY s) g) GROUP BY p, tot"""
AP = """SELECT round(sum((pos / p) * (tp / k)), 9) AS average_precision FROM (
  SELECT g.pos::DOUBLE AS pos, (SELECT sum(y) FROM {t} z WHERE z.s >= g.s)::DOUBLE AS tp, (SELECT count(*) FROM {t} z WHERE z.s >= g.s)::DOUBLE AS k, (SELECT sum(y) FROM {t})::DOUBLE AS p
  FROM (SELECT s, sum(y) AS pos FROM {t} GROUP BY s) g)"""
HITS = """h AS (SELECT account_id, coalesce(by_rule, false) AS by_rule, coalesce(by_model, false) AS by_model, m.account_id IS NOT NULL AS mule FROM
  (SELECT account_id, bool_or(detector <> 'model_only') AS by_rule, bool_or(detector = 'model_only') AS by_model FROM alerts WHERE {c} GROUP BY 1) a FULL JOIN (SELECT account_id FROM mules) m USING (account_id))""".format(c=TESTC)
QUEUE = f"""q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, created_us, created_row,
  list_position(['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'], detector)) AS k FROM alerts WHERE {TESTC}) WHERE k = 1)"""


def _arm(version: str, hop: bool, name: str) -> str:
    return f"SELECT '{name}' AS arm, tp, fp, fn, round(CASE WHEN tp+fp > 0 THEN tp::DOUBLE/(tp+fp) ELSE 0.0 END, 9) AS precision, round(CASE WHEN tp+fn > 0 THEN tp::DOUBLE/(tp+fn) ELSE 0.0 END, 9) AS recall FROM ({A(version, HITS, hop=hop)} SELECT count(*) FILTER ((by_rule OR by_model) AND mule) AS tp, count(*) FILTER ((by_rule OR by_model) AND NOT mule) AS fp, count(*) FILTER (NOT (by_rule OR by_model) AND mule) AS fn FROM h)"


ARMS = " UNION ALL ".join([_arm("r2.0", True, "r2.0"), _arm("r2.1", True, "r2.1"), _arm("r2.2", True, "r2.2"), _arm("r2.0", False, "r2.0 - hop")])

SQL = {
    "edge_metrics_at_thresholds": P(SCORED(TEST)) + f"SELECT threshold, tp, fp, fn, {PRF}, {wil('tp', '(tp+fp)', 'p_lo', 'p_hi')}, {wil('tp', '(tp+fn)', 'r_lo', 'r_hi')} FROM ("
    + CONF + " FROM sc CROSS JOIN (SELECT unnest([0.3,0.5,0.7,0.86,0.9,0.95]::DOUBLE[]) AS threshold) GROUP BY 1)",
    "threshold_max_f1_grid": P(SCORED(VAL)) + f"SELECT threshold, tp, fp, fn, {PRF} FROM (" + CONF
    + " FROM sc CROSS JOIN (SELECT unnest(range(5,100)) / 100.0::DOUBLE AS threshold) GROUP BY 1) ORDER BY f1 DESC, threshold DESC LIMIT 1",
    "threshold_pr_curve": P(SCORED(VAL)) + """SELECT threshold, round(CASE WHEN tp > 0 THEN 2.0*(tp/k)*(tp/p)/((tp/k)+(tp/p)) ELSE 0.0 END, 9) AS f1, CAST(tp AS BIGINT) AS tp, CAST(k AS BIGINT) AS flagged FROM (
  SELECT g.s AS threshold, (SELECT sum(y) FROM sc z WHERE z.s >= g.s)::DOUBLE AS tp, (SELECT count(*) FROM sc z WHERE z.s >= g.s)::DOUBLE AS k, (SELECT sum(y) FROM sc)::DOUBLE AS p FROM (SELECT DISTINCT s FROM sc) g)
  ORDER BY f1 DESC, threshold LIMIT 1""",
    "roc_auc_payments": P(SCORED(TEST)) + AUC.format(t="sc"),
    "roc_auc_scored_docs": with_(V_SCORED_DOCS) + AUC.format(t="v_scored_docs"),
    "average_precision_payments": P(SCORED(TEST)) + AP.format(t="sc"),
    "average_precision_scored_docs": with_(V_SCORED_DOCS) + AP.format(t="v_scored_docs"),
    "precision_at_k_payments": P(SCORED(TEST)) + """SELECT k, CAST(sum(y) FILTER (rn <= k) AS DOUBLE) / k AS precision FROM (SELECT y, row_number() OVER (ORDER BY s DESC, t_us, row) AS rn FROM sc), (SELECT unnest([25,50,100,200]) AS k)
  GROUP BY k HAVING max(rn) >= k""",
    "per_layer_report": P(SCORED(TEST)) + "SELECT layer, count(*) AS rows, count(*) FILTER (s >= 0.86) AS flagged, max(amount) AS amount_max, quantile_cont(amount, 0.5) AS amount_median FROM sc GROUP BY 1",
    "score_histogram": P(SCORED(TEST)) + "SELECT least(CAST(floor(s*10) AS BIGINT), 9) AS bin, CAST(sum(y) AS BIGINT) AS fraud, CAST(sum(1-y) AS BIGINT) AS clean FROM sc GROUP BY 1",
    "amount_percentiles_by_channel": P() + "SELECT channel, round(quantile_cont(amount, 0.1), 4) AS p10, round(quantile_cont(amount, 0.5), 4) AS p50, round(quantile_cont(amount, 0.9), 4) AS p90, round(quantile_cont(amount, 0.999), 4) AS p999 FROM pay GROUP BY 1",
    "amount_rule_baseline": P() + f"SELECT tp, fp, fn, {PRF} FROM (SELECT count(*) FILTER (amount >= 450000 AND is_fraud=1) AS tp, count(*) FILTER (amount >= 450000 AND is_fraud=0) AS fp, count(*) FILTER (amount < 450000 AND is_fraud=1) AS fn FROM pay)",
    "dataset_facts": P(V_ACCOUNTS) + """SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows, min(t_us) AS start_us, max(t_us) AS end_us, min(t_us) FILTER (is_fraud=1) AS fraud_from_us, max(t_us) FILTER (is_fraud=1) AS fraud_to_us,
  (SELECT count(*) FROM (SELECT from_id FROM pay UNION SELECT to_id FROM pay UNION SELECT account_id FROM v_accounts)) AS accounts FROM pay""",
    "fraud_profile": P() + f"SELECT count(*) AS payments, max(amount) AS max_amount, round(CAST(sum(amount_p) FILTER (layer='error') AS DOUBLE)/100, 2) AS victim_total, round(CAST(sum(amount_p) AS DOUBLE)/100, 2) AS all_total, quantile_cont(amount, 0.5) AS median_amount FROM pay WHERE is_fraud=1 AND {TEST}",
    "clean_accounts_active_in_test": P(V_ACCOUNTS) + f"SELECT count(*) AS clean_accounts FROM (SELECT from_id AS account_id FROM pay WHERE {TEST} UNION SELECT to_id FROM pay WHERE {TEST}) WHERE account_id NOT IN (SELECT account_id FROM v_accounts WHERE role IN ('l1_mule','l2_mule'))",
    "txns_last_minute": P() + "SELECT count(*) AS n FROM (SELECT t_us FROM pay ORDER BY t_us DESC, row DESC LIMIT 400) WHERE t_us > (SELECT max(t_us) FROM pay) - 60000000",
    "account_level_metrics": A("r2.0", HITS) + f"SELECT arm, tp, fp, fn, {PRF}, {wil('tp', '(tp+fp)', 'p_lo', 'p_hi')}, {wil('tp', '(tp+fn)', 'r_lo', 'r_hi')} FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS arm, count(*) FILTER (({c}) AND mule) AS tp, count(*) FILTER (({c}) AND NOT mule) AS fp, count(*) FILTER (NOT ({c}) AND mule) AS fn FROM h"
        for n, c in (("rules", "by_rule"), ("model", "by_model"), ("combined", "by_rule OR by_model"))) + ")",
    "alerts_by_detector_vs_truth": A() + f"SELECT detector, count(DISTINCT a.account_id) AS alerts, count(DISTINCT m.account_id) AS mules, round(count(DISTINCT m.account_id)::DOUBLE / count(DISTINCT a.account_id), 9) AS precision FROM alerts a LEFT JOIN mules m ON m.account_id = a.account_id WHERE {TESTC} GROUP BY 1",
    "found_by_role": A() + f"SELECT role, count(*) AS active, count(*) FILTER (account_id IN (SELECT account_id FROM alerts WHERE {TESTC})) AS found FROM mules GROUP BY 1",
    "analyst_queue": A("r2.0", QUEUE) + "SELECT account_id, detector, CAST(score AS INT) AS score, created_us FROM q",
    "queue_precision_at_k": A("r2.0", QUEUE) + """SELECT k, CAST(sum(y) FILTER (rn <= k) AS DOUBLE)/k AS precision FROM (SELECT CASE WHEN account_id IN (SELECT account_id FROM mules) THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY score DESC, created_us, created_row) AS rn FROM q),
  (SELECT unnest([5,10,20,50]) AS k) GROUP BY k HAVING max(rn) >= k""",
    "lead_and_time_to_alert": A("r2.0", "fa AS (SELECT account_id, min(created_us) AS alert_us FROM alerts GROUP BY 1), x AS (SELECT (first_out_us - alert_us)/1e6 AS lead, (alert_us - first_in_us)/1e6 AS to_alert, first_out_us FROM mules LEFT JOIN fa USING (account_id))")
    + """SELECT count(lead) AS lead_n, count(*) FILTER (lead > 0) AS alerted_before_money_left, count(first_out_us) AS mules_that_forwarded, count(to_alert) AS to_alert_n,
  round(quantile_cont(lead, 0.1), 3) AS lead_p10, round(quantile_cont(lead, 0.5), 3) AS lead_p50, round(quantile_cont(lead, 0.9), 3) AS lead_p90, round(quantile_cont(to_alert, 0.5), 3) AS to_alert_p50, round(quantile_cont(to_alert, 0.9), 3) AS to_alert_p90 FROM x""",
    "dashboard_metrics": A("r2.0", "lv AS (SELECT a.*, v.role FROM alerts a LEFT JOIN v_accounts v USING (account_id) WHERE status <> 'superseded')") + """SELECT
  count(*) FILTER (status='open' AND severity='critical') AS open_critical, count(*) FILTER (status='open' AND severity='high') AS open_high, count(*) FILTER (status='open' AND severity='medium') AS open_medium,
  count(*) FILTER (status='open' AND severity='low') AS open_low, count(*) FILTER (status='open') AS open_alerts, (SELECT count(*) FROM mules_all) AS mules_seen,
  count(DISTINCT account_id) FILTER (account_id IN (SELECT account_id FROM mules_all)) AS mules_alerted, round(quantile_cont((created_us - first_evidence_us)/1e6, 0.5), 3) AS median_time_to_alert,
  (SELECT round(CAST(sum(amount_p) AS DOUBLE)/100, 2) FROM pay) AS volume,
  round(count(DISTINCT account_id) FILTER (role IN ('l1_mule','l2_mule'))::DOUBLE / count(DISTINCT account_id), 9) AS precision,
  round(count(DISTINCT account_id) FILTER (account_id IN (SELECT account_id FROM mules_all))::DOUBLE / (SELECT count(*) FROM mules_all), 9) AS recall,
  round(count(DISTINCT account_id) FILTER (detector <> 'model_only' AND account_id IN (SELECT account_id FROM mules_all))::DOUBLE / (SELECT count(*) FROM mules_all), 9) AS recall_rules FROM lv""",
    "false_accounts_per_day": A() + f"""SELECT detector, coalesce(kind, '?') AS kind, count(*) AS accounts, round(count(*) / greatest(1, ((SELECT max(t_us) FROM pay) - {D0}) // {DAY})::DOUBLE, 9) AS per_day FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_us, created_row, list_position(['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'], detector)) AS k FROM alerts) a
  LEFT JOIN v_accounts v USING (account_id) WHERE k = 1 AND coalesce(role, '') NOT IN ('l1_mule','l2_mule') AND created_us >= {D0 + DAY} GROUP BY 1, 2""",
    "rule_and_model_account_sets": A("r2.0", f"b AS (SELECT DISTINCT account_id FROM alerts WHERE {TESTC})") + """SELECT 'rule_or_model' AS set_name, count(*) AS n FROM b
  UNION ALL SELECT 'hit_mules', count(*) FROM b WHERE account_id IN (SELECT account_id FROM mules) UNION ALL SELECT 'false_accounts', count(*) FROM b WHERE account_id NOT IN (SELECT account_id FROM mules)
  UNION ALL SELECT 'missed_mules', count(*) FROM mules WHERE account_id NOT IN (SELECT account_id FROM b)""",
    "rule_version_arms": ARMS,
    "arm_pass_fail": f"WITH arms AS ({ARMS}), b AS (SELECT recall AS br, tp + fp AS bq FROM arms WHERE arm = 'r2.0') SELECT arm, recall >= br - 1e-9 AS recall_pass, tp + fp <= bq AS queue_pass FROM arms, b",
    "base_rate_projection_point": P(SCORED(TEST), "c AS (SELECT count(*) FILTER (s >= 0.86 AND y=1)::DOUBLE AS tp, count(*) FILTER (s >= 0.86 AND y=0)::DOUBLE AS fp, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM sc)")
    + """SELECT rarer, round(prev, 9) AS prevalence, round(CASE WHEN tp/pos*prev + fp/neg*(1-prev) > 0 THEN tp/pos*prev/(tp/pos*prev + fp/neg*(1-prev)) ELSE 0.0 END, 6) AS precision FROM (SELECT *, pos/(pos+neg)/rarer AS prev FROM c, (SELECT unnest([1,10,100,1000]) AS rarer))""",
}
