"""DuckDB oracle text for the merchant queries."""

from .sql_views import V_COLLECTS, V_M_PAYMENTS, V_MERCHANTS, with_

S, DAY, HOUR = 1_704_067_200_000_000, 86_400_000_000, 3_600_000_000
T0, T1 = S + 8 * DAY, S + 10 * DAY
LOCAL = "('kirana','restaurant','pharmacy','fuel')"
CORE = f"""mp AS (SELECT p.*, row_number() OVER (PARTITION BY p.merchant_id, payer_id ORDER BY p.row) = 1 AS first, (p.t_us - {S}) // {DAY} AS day FROM v_m_payments p),
bars AS (SELECT category, quantile_cont(amount, 0.99) AS cat_p99 FROM mp JOIN v_merchants m USING (merchant_id) WHERE m.is_fraud = 0 AND t_us < {S + 6 * DAY} GROUP BY 1),
cand AS (SELECT mp.*, category, state, onboarded_us, cat_p99 FROM mp JOIN v_merchants m USING (merchant_id) JOIN bars USING (category) WHERE first AND amount >= cat_p99),
own AS (SELECT c.row, count(*) AS n, quantile_cont(x.amount, 0.99) AS p99 FROM cand c JOIN mp x ON x.merchant_id = c.merchant_id AND x.t_us >= c.t_us - {7 * DAY} AND x.row < c.row GROUP BY 1),
above AS (SELECT c.* FROM cand c LEFT JOIN own USING (row) WHERE NOT coalesce(c.t_us - onboarded_us >= {30 * DAY} AND n >= 50 AND c.amount < p99, false)),
d1w AS (SELECT a.merchant_id, a.t_us, count(*) AS n FROM above a JOIN above b ON a.merchant_id = b.merchant_id AND b.t_us >= a.t_us - {DAY} AND b.row <= a.row GROUP BY a.merchant_id, a.t_us, a.row),
st AS (SELECT mp.merchant_id, mp.row, mp.t_us, payer_state FROM mp JOIN v_merchants m USING (merchant_id) WHERE first AND category IN {LOCAL} AND payer_state <> m.state),
d2w AS (SELECT a.merchant_id, a.t_us, count(DISTINCT b.payer_state) AS n FROM st a JOIN st b ON a.merchant_id = b.merchant_id AND b.t_us >= a.t_us - {DAY} AND b.row <= a.row GROUP BY a.merchant_id, a.t_us, a.row),
fp AS (SELECT merchant_id, payer_id, min(t_us) AS f FROM mp GROUP BY 1, 2),
sc AS (SELECT c.*, CASE WHEN outcome <> 'approved' THEN 1 ELSE 0 END AS failed FROM v_collects c LEFT JOIN fp USING (merchant_id, payer_id) WHERE known_payer = 0 AND (f IS NULL OR f >= resolved_us)),
d3w AS (SELECT a.merchant_id, a.resolved_us AS t_us, count(*) AS n, sum(b.failed) AS f FROM sc a JOIN sc b ON a.merchant_id = b.merchant_id AND b.resolved_us >= a.resolved_us - {DAY}
  AND (b.resolved_us < a.resolved_us OR (b.resolved_us = a.resolved_us AND b.request_id <= a.request_id)) GROUP BY a.merchant_id, a.resolved_us, a.request_id),
d4 AS (SELECT a.merchant_id, min(greatest(a.onboarded_us, b.onboarded_us, {S})) AS t_us FROM v_merchants a JOIN v_merchants b ON a.settlement_account = b.settlement_account AND a.legal_entity <> b.legal_entity GROUP BY 1),
al AS (
  SELECT merchant_id, 'D1' AS detector, min(t_us) AS t_us FROM d1w WHERE n >= 3 GROUP BY 1 UNION ALL SELECT merchant_id, 'D2', min(t_us) FROM d2w WHERE n >= 4 GROUP BY 1
  UNION ALL SELECT merchant_id, 'D3', min(t_us) FROM d3w WHERE n >= 5 AND f::DOUBLE / n >= 0.85::DOUBLE GROUP BY 1 UNION ALL SELECT merchant_id, 'D4', t_us FROM d4),
hold AS (SELECT a.merchant_id, a.detector, a.t_us AS from_us, a.t_us + CASE WHEN d4.t_us <= a.t_us THEN 72 ELSE 24 END * {HOUR} AS until_us FROM al a LEFT JOIN d4 USING (merchant_id) WHERE detector <> 'D4'),
bs AS (SELECT merchant_id, k AS batch, {S} + k * {DAY} + {6 * HOUR} AS batch_us FROM v_merchants, (SELECT unnest(range(1, 11)) AS k)),
status AS (SELECT bs.*, (SELECT max(until_us) FROM hold h WHERE h.merchant_id = bs.merchant_id AND h.from_us <= batch_us) AS until_us FROM bs),
st2 AS (SELECT *, coalesce(until_us > batch_us, false) AS held FROM status),
settle AS (SELECT merchant_id, batch - 1 AS day, held AS was_held, (SELECT min(batch) FROM st2 z WHERE z.merchant_id = st2.merchant_id AND z.batch >= st2.batch AND NOT z.held) AS settled_batch FROM st2)"""
M = with_(V_MERCHANTS, V_M_PAYMENTS, V_COLLECTS, CORE)
BATCH = f"""SELECT d.merchant_id, b.batch, b.held, CAST(sum(payments) AS BIGINT) AS payments, CAST(sum(amount_p) AS BIGINT) AS amount_p, CAST(sum(fraud_p) AS BIGINT) AS fraud_p, max(CASE WHEN held THEN until_us END) AS hold_until_us
  FROM (SELECT merchant_id, day, count(*) AS payments, sum(amount_p) AS amount_p, sum(CASE WHEN is_fraud = 1 THEN amount_p ELSE 0 END) AS fraud_p FROM mp GROUP BY 1, 2) d
  JOIN settle s ON s.merchant_id = d.merchant_id AND s.day = d.day JOIN st2 b ON b.merchant_id = d.merchant_id AND b.batch >= d.day + 1 AND (settled_batch IS NULL OR b.batch <= settled_batch) GROUP BY 1, 2, 3"""
STATS = f"""SELECT merchant_id, day, CAST(sum(states) AS BIGINT) AS states, CAST(sum(fa) AS BIGINT) AS first_above, CAST(sum(cn) AS BIGINT) AS col_new, CAST(sum(cf) AS BIGINT) AS col_fail FROM (
  SELECT mp.merchant_id, day, count(DISTINCT CASE WHEN first AND payer_state <> m.state THEN payer_state END) AS states, 0 AS fa, 0 AS cn, 0 AS cf FROM mp JOIN v_merchants m USING (merchant_id) GROUP BY 1, 2
  UNION ALL SELECT merchant_id, day, 0, count(*), 0, 0 FROM above GROUP BY 1, 2
  UNION ALL SELECT merchant_id, (resolved_us - {S}) // {DAY}, 0, 0, count(*), sum(failed) FROM sc GROUP BY 1, 2) GROUP BY 1, 2"""
ACTIVE = f"act AS (SELECT merchant_id, min(t) AS first_fraud_us FROM (SELECT merchant_id, t_us AS t FROM mp WHERE is_fraud = 1 AND t_us >= {T0} AND t_us < {T1} UNION ALL SELECT merchant_id, requested_us FROM v_collects WHERE is_fraud = 1 AND requested_us >= {T0} AND requested_us < {T1}) GROUP BY 1)"
SQL = {
    "category_p99": M + "SELECT category, round(cat_p99, 6) AS cat_p99 FROM bars",
    "merchant_alerts": M + "SELECT * FROM al",
    "ticket_anomaly_d1": M + "SELECT * FROM al WHERE detector = 'D1'",
    "above_bar_payments": M + "SELECT merchant_id, count(*) AS n, CAST(sum(amount_p) AS BIGINT) AS amount_p FROM above GROUP BY 1",
    "shared_settlement_d4": M + "SELECT * FROM al WHERE detector = 'D4'",
    "settlement_holds": M + "SELECT * FROM hold",
    "settlement_assignment": M + f"SELECT mp.merchant_id, mp.day, {S} + settled_batch * {DAY} + {6 * HOUR} AS settled_us, was_held, count(*) AS payments, CAST(sum(amount_p) AS BIGINT) AS amount_p FROM mp LEFT JOIN settle s ON s.merchant_id = mp.merchant_id AND s.day = mp.day GROUP BY ALL",
    "settlement_batch_log": M + BATCH,
    "merchant_day_stats": M + STATS,
    "merchant_calibration": M + f", z AS (SELECT s.*, m.category FROM ({STATS}) s JOIN v_merchants m USING (merchant_id) WHERE m.is_fraud = 0 AND day >= 3 AND day < 6) "
    + """SELECT count(*) AS merchant_days, greatest(2, CAST(floor(quantile_cont(first_above, 0.999)) AS BIGINT) + 1) AS d1_count,
  greatest(3, CAST(floor(coalesce(quantile_cont(CASE WHEN category IN ('kirana','restaurant','pharmacy','fuel') THEN states END, 0.999), 0)) AS BIGINT) + 1) AS d2_states,
  greatest(5, CAST(floor(coalesce(quantile_cont(CASE WHEN col_new > 0 THEN col_new END, 0.999), 0)) AS BIGINT) + 1) AS d3_requests,
  least(0.95::DOUBLE, round(coalesce(quantile_cont(CASE WHEN col_new >= 5 THEN col_fail::DOUBLE / col_new END, 0.999), 0) + 0.05::DOUBLE, 3)) AS d3_fail_share FROM z""",
    "collect_outcomes_pivot": with_(V_COLLECTS) + "SELECT merchant_id, known_payer, count(*) FILTER (outcome='approved') AS approved, count(*) FILTER (outcome='declined') AS declined, count(*) FILTER (outcome='expired') AS expired FROM v_collects GROUP BY 1, 2",
    "merchant_directory": M + f""", bl AS ({BATCH}) SELECT m.merchant_id, m.category, coalesce(payments, 0) AS payments, round(coalesce(inflow_p, 0)::DOUBLE / 100, 2) AS inflow, coalesce(detectors, '') AS detectors, first_alert_us,
  coalesce(held_batches, 0) AS held_batches, round(coalesce(held_p, 0)::DOUBLE / 100, 2) AS held_amount, (SELECT count(*) - 1 FROM v_merchants z WHERE z.settlement_account = m.settlement_account) AS shared_settlement
  FROM v_merchants m LEFT JOIN (SELECT merchant_id, count(*) AS payments, sum(amount_p) AS inflow_p FROM mp GROUP BY 1) i USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, string_agg(detector, ',' ORDER BY detector) AS detectors, min(t_us) AS first_alert_us FROM al GROUP BY 1) a USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, count(*) AS held_batches, sum(amount_p) AS held_p FROM bl WHERE held GROUP BY 1) h USING (merchant_id)""",
    "recent_merchant_payments": with_(V_M_PAYMENTS) + "SELECT merchant_id, payer_id, t_us, amount_p FROM v_m_payments ORDER BY row DESC LIMIT 150",
    "merchant_onboarding_decision": M + """, ap AS (SELECT merchant_id AS application, settlement_account, CASE WHEN merchant_id % 3 = 0 THEN 'E-new' ELSE legal_entity END AS legal_entity FROM v_merchants),
  j AS (SELECT application, ap.settlement_account, ap.legal_entity, count(*) AS shared_with, count(*) FILTER (m.legal_entity <> ap.legal_entity) AS other_entities,
    count(*) FILTER (m.merchant_id IN (SELECT merchant_id FROM al)) AS flagged, bool_or(m.merchant_id IN (SELECT merchant_id FROM al WHERE detector <> 'D4')) AS act
    FROM ap JOIN v_merchants m ON m.settlement_account = ap.settlement_account GROUP BY 1, 2, 3)
  SELECT application, settlement_account, legal_entity, shared_with, other_entities, flagged, CASE WHEN act THEN 'hold' WHEN other_entities > 0 THEN 'review' ELSE 'approve' END AS decision,
    CASE WHEN act THEN flagged || ' merchant(s) on this settlement account are under alert.' WHEN other_entities > 0 THEN other_entities || ' merchant(s) under other declared entities share this settlement account.'
      ELSE shared_with || ' merchant(s) under the same declared entity share it.' END AS reason FROM j""",
    "first_alert_per_merchant": M + f"SELECT merchant_id, min(t_us) AS first_alert_us, string_agg(detector, ',' ORDER BY detector) AS detectors FROM al WHERE t_us < {T1} GROUP BY 1",
    "active_fraud_merchants": M + f", {ACTIVE} SELECT * FROM act",
    "clean_hold_hours": M + f""", sp AS (SELECT merchant_id, greatest(from_us, {S + DAY}) AS a, least(until_us, {T1}) AS b FROM hold JOIN v_merchants m USING (merchant_id) WHERE m.is_fraud = 0),
  e AS (SELECT *, max(b) OVER (PARTITION BY merchant_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sp)
  SELECT merchant_id, round(CAST(sum(greatest(0, b - greatest(a, coalesce(seen, a)))) AS DOUBLE) / {HOUR}, 6) AS hours FROM e GROUP BY 1""",
    "merchant_evaluation": M + f""", {ACTIVE}, per AS (SELECT merchant_id, min(t_us) AS first_us, bool_or(t_us >= {T0}) AS in_test, bool_or(detector = 'D4') AS has_d4, min(t_us) FILTER (detector <> 'D4') AS hold_first,
    bool_or(t_us >= {T0} AND detector <> 'D4') AS hold_in_test, bool_or(detector <> 'D4') AS not_only FROM al WHERE t_us < {T1} GROUP BY 1),
  x AS (SELECT m.merchant_id, m.is_fraud, per.*, act.first_fraud_us, m.merchant_id IN (SELECT merchant_id FROM mp WHERE t_us >= {T0} AND t_us < {T1}) AS busy FROM v_merchants m LEFT JOIN per ON per.merchant_id = m.merchant_id LEFT JOIN act ON act.merchant_id = m.merchant_id),
  mon AS (SELECT sum(amount_p) FILTER (is_fraud = 1) AS fp, coalesce(sum(amount_p) FILTER (is_fraud = 1 AND was_held), 0) AS hf, coalesce(sum(amount_p) FILTER (is_fraud = 0 AND was_held), 0) AS hg FROM mp LEFT JOIN settle s ON s.merchant_id = mp.merchant_id AND s.day = mp.day WHERE t_us >= {T0} AND t_us < {T1}),
  g AS (SELECT count(first_fraud_us) AS active, count(*) FILTER (first_fraud_us IS NOT NULL AND first_us IS NOT NULL) AS active_flagged, count(*) FILTER (in_test OR (has_d4 AND busy)) AS counted,
    count(*) FILTER ((in_test OR (has_d4 AND busy)) AND is_fraud = 1) AS fraud_counted, count(*) FILTER (first_us < {S} + ((first_fraud_us - {S}) // {DAY} + 1) * {DAY} + {6 * HOUR}) AS before_first_batch,
    count(*) FILTER (is_fraud = 0 AND first_us >= {S + DAY} AND not_only) AS clean_flagged, count(*) FILTER (hold_in_test) AS hold_counted, count(*) FILTER (first_fraud_us IS NOT NULL AND hold_first IS NOT NULL) AS hold_found,
    round(quantile_cont((first_us - first_fraud_us)/1e6, 0.5), 3) AS median_to_alert, round(quantile_cont((hold_first - first_fraud_us)/1e6, 0.5), 3) AS median_to_hold FROM x)
  SELECT active, active_flagged, counted, fraud_counted, before_first_batch, clean_flagged, hold_counted, hold_found, CAST(hf AS BIGINT) AS held_fraud_p, CAST(hg AS BIGINT) AS held_genuine_p,
    round(active_flagged::DOUBLE/active, 9) AS recall, round(fraud_counted::DOUBLE/counted, 9) AS precision, round(hf::DOUBLE/fp::DOUBLE, 9) AS held_share, median_to_alert, median_to_hold FROM g, mon""",
}
