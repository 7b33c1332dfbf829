"""DuckDB oracle text for scalar rules, file sources, wire payments, registry imports and linkage."""

from .sql_metrics import A, P
from .sql_profiles import LEGS, ONB, SEEN
from .sql_views import V_ACCOUNTS, V_COLLECTS, V_M_PAYMENTS, V_MERCHANTS, V_REGISTRY, with_

S, DAY = 1_704_067_200_000_000, 86_400_000_000
NOW = S + 10 * DAY
IDS = "ids AS (SELECT key, row_number() OVER (ORDER BY min((row, o))) - 1 AS id FROM (SELECT from_id AS key, row, 0 AS o FROM pay UNION ALL SELECT to_id, row, 1 FROM pay) GROUP BY key)"
CLOCK = "(t_us // 1000000) - ((SELECT arg_min(t_us, row) FROM pay) // 86400000000) * 86400 + 10"
GRP = """CASE WHEN length(s) <= 3 THEN '₹' || s ELSE '₹' || (CASE WHEN length(s) <= 5 THEN substr(s, 1, length(s)-3) WHEN length(s) <= 7 THEN substr(s, 1, length(s)-5) || ',' || substr(s, -5, 2)
  WHEN length(s) <= 9 THEN substr(s, 1, length(s)-7) || ',' || substr(s, -7, 2) || ',' || substr(s, -5, 2) ELSE substr(s, 1, length(s)-9) || ',' || substr(s, -9, 2) || ',' || substr(s, -7, 2) || ',' || substr(s, -5, 2) END) || ',' || substr(s, -3) END"""
RAW = """raw AS (SELECT o_orderkey AS row, o_orderdate AS ts, CAST(o_custkey % 7 AS VARCHAR) || CASE WHEN {leg} THEN '' ELSE ':' END || CASE WHEN {leg} OR o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'P' || o_custkey END AS fk,
  CAST(o_orderkey % 5 AS VARCHAR) || CASE WHEN {leg} THEN '' ELSE ':' END || CAST(o_orderkey % 100 AS VARCHAR) AS tk, o_totalprice AS paid, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE round(o_totalprice*2, 2) END AS recd,
  (['Rupee','Dollar','Euro'])[o_orderkey % 3 + 1] AS pc, CASE WHEN o_orderkey % 4 = 0 THEN 'Yen' ELSE 'Rupee' END AS rc, o_orderpriority AS pf, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS il FROM orders {where}),
acc AS (SELECT key, row_number() OVER (ORDER BY min((row, o))) - 1 AS id FROM (SELECT fk AS key, row, 0 AS o FROM raw UNION ALL SELECT tk, row, 1 FROM raw) GROUP BY key),
cur AS (SELECT key, row_number() OVER (ORDER BY min((row, o))) - 1 AS id FROM (SELECT {first} AS key, row, 0 AS o FROM raw UNION ALL SELECT {second}, row, 1 FROM raw) GROUP BY key),
fmt AS (SELECT pf AS key, row_number() OVER (ORDER BY min(row)) - 1 AS id FROM raw GROUP BY 1)"""
EDGES = """SELECT row AS edge_id, a.id AS from_id, b.id AS to_id, CAST(epoch(ts) - epoch(date_trunc('day', (SELECT arg_min(ts, row) FROM raw))) AS BIGINT) + {off} AS timestamp, paid AS amount_sent, c.id AS sent_currency, recd AS amount_received,
  d.id AS received_currency, f.id AS payment_format, il AS is_laundering FROM raw JOIN acc a ON a.key = fk JOIN acc b ON b.key = tk JOIN cur c ON c.key = pc JOIN cur d ON d.key = rc JOIN fmt f ON f.key = pf"""
ERR = """CASE WHEN row % 101 = 0 THEN 'not a payment object' WHEN row % 103 = 0 THEN 'amount must be above 0' WHEN row % 107 = 0 THEN 'a VPA must have 3 or more characters' WHEN row % 109 = 0 THEN 'txn_id must have 1 to 64 characters' WHEN row % 113 = 0 THEN 'timestamp is not ISO 8601' END"""
KEY = "trim(regexp_replace(regexp_replace(regexp_replace(replace(upper({0}), '.', ''), '[^A-Z0-9 ]', ' ', 'g'), '\\b(NO|NUMBER|FLAT|FLOOR|FL|OFFICE|OFF|ROAD|RD|STREET|ST|NEAR|NR|OPP|OPPOSITE|INDIA|IN)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
CINOK = "regexp_matches({0}, '^[LU][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}$')"
REG = f"""cur_d AS (SELECT * FROM v_directorships WHERE ceased_on IS NULL OR ceased_on > DATE '2026-09-28'),
ak AS (SELECT cin, {KEY.format('address')} AS k FROM v_companies),
fv AS (SELECT e.cin, e.vpa FROM v_entity_accounts e JOIN seen s USING (vpa) WHERE s.account_id IN (SELECT account_id FROM alerts WHERE status NOT IN ('cleared', 'superseded'))),
cc AS (SELECT a.cin, b.cin AS other FROM cur_d a JOIN cur_d b ON a.din = b.din AND a.cin <> b.cin GROUP BY 1, 2 HAVING count(DISTINCT a.din) >= 2),
ccn AS (SELECT x.cin, count(*) AS group_n, count(*) FILTER (abs(date_diff('day', a.incorporated_on, b.incorporated_on)) <= 365) AS batch_n FROM cc x JOIN v_companies a ON a.cin = x.cin JOIN v_companies b ON b.cin = x.other GROUP BY 1),
lk AS (SELECT DISTINCT a.cin, f.cin AS other, f.vpa FROM (SELECT cin, cin AS other FROM apl UNION SELECT c.cin, d.cin FROM cur_d c JOIN v_directorships d USING (din) UNION SELECT a.cin, b.cin FROM ak a JOIN ak b USING (k)) a JOIN fv f ON f.cin = a.other),
lkn AS (SELECT cin, count(*) AS n FROM lk GROUP BY 1)"""
APL = "apl AS (SELECT cin FROM v_companies UNION ALL SELECT 'Z' || cin FROM v_companies WHERE cin LIKE '%1' UNION ALL SELECT 'L' || substr(cin, 2) FROM v_companies WHERE cin LIKE '%2')"
FIND = f"""load AS (SELECT din, count(*) FILTER (ceased_on IS NULL OR ceased_on > DATE '2026-09-28') AS cur_n, count(*) FILTER (lower(status) LIKE '%strike%' OR lower(status) LIKE '%struck%') AS st_n, max(disqualified) AS dq FROM v_directorships d LEFT JOIN v_companies c USING (cin) GROUP BY 1),
ok AS (SELECT DISTINCT cin FROM apl WHERE {CINOK.format('cin')}),
cmp AS (SELECT ok.cin, c.cin IS NOT NULL AS here, status, incorporated_on, paid_up_capital, last_annual_return, date_diff('day', incorporated_on, DATE '2026-09-28') AS age FROM ok LEFT JOIN v_companies c USING (cin)),
seat AS (SELECT s.cin, l.*, l.st_n - coalesce((SELECT CASE WHEN lower(status) LIKE '%strike%' THEN 1 ELSE 0 END FROM v_companies c WHERE c.cin = s.cin), 0) AS oth FROM cur_d s JOIN ok USING (cin) JOIN load l USING (din)),
fnd AS (
  SELECT DISTINCT cin, 'medium' AS severity, 'invalid_cin' AS code, 1 AS n FROM apl WHERE NOT {CINOK.format('cin')}
  UNION ALL SELECT cin, 'medium', 'not_in_registry', 1 FROM cmp WHERE NOT here
  UNION ALL SELECT cin, CASE WHEN lower(status) LIKE '%strike off%' THEN 'high' ELSE 'medium' END, 'inactive_status', 1 FROM cmp WHERE here AND lower(status) <> 'active'
  UNION ALL SELECT cin, 'medium', 'young_company', age FROM cmp WHERE here AND age < 180
  UNION ALL SELECT cin, 'low', 'low_paid_up', 1 FROM cmp WHERE here AND paid_up_capital <= 100000
  UNION ALL SELECT cin, 'medium', 'stale_filings', last_annual_return FROM cmp WHERE here AND 2026 - last_annual_return > 2 AND age > 730
  UNION ALL SELECT cin, 'low', 'no_director_data', 1 FROM ok WHERE cin NOT IN (SELECT cin FROM v_directorships)
  UNION ALL SELECT cin, 'medium', 'no_current_directors', 1 FROM ok WHERE cin IN (SELECT cin FROM v_directorships) AND cin NOT IN (SELECT cin FROM cur_d)
  UNION ALL SELECT cin, 'high', 'disqualified_director', count(*) FROM seat WHERE dq = 1 GROUP BY 1
  UNION ALL SELECT cin, 'high', 'over_director_limit', count(*) FROM seat WHERE cur_n > 20 GROUP BY 1
  UNION ALL SELECT cin, 'medium', 'busy_director', count(*) FROM seat WHERE cur_n > 10 AND cur_n <= 20 GROUP BY 1
  UNION ALL SELECT cin, 'medium', 'director_of_struck_off', count(*) FROM seat WHERE oth >= 2 GROUP BY 1
  UNION ALL SELECT cin, CASE WHEN batch_n >= 2 THEN 'medium' ELSE 'low' END, CASE WHEN batch_n >= 2 THEN 'batch_incorporation' ELSE 'common_control' END, CASE WHEN batch_n >= 2 THEN batch_n ELSE group_n END FROM ccn WHERE cin IN (SELECT cin FROM ok)
  UNION ALL SELECT a.cin, CASE WHEN count(*) >= 20 THEN 'high' ELSE 'medium' END, 'address_farm', count(*) FROM ak a JOIN ak b USING (k) WHERE a.cin IN (SELECT cin FROM ok) GROUP BY 1 HAVING count(*) >= 5
  UNION ALL SELECT cin, 'high', 'linked_account_flagged', n FROM lkn WHERE cin IN (SELECT cin FROM ok)),
dcn AS (SELECT a.cin, count(code) AS findings, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END) WHEN 2 THEN 'hold' WHEN 1 THEN 'review' ELSE 'approve' END AS decision FROM (SELECT DISTINCT cin FROM apl) a LEFT JOIN fnd USING (cin) GROUP BY 1)"""
LINK = A("r2.0", LEGS, SEEN, V_REGISTRY, APL, REG)
FINDQ = A("r2.0", LEGS, SEEN, V_REGISTRY, APL, REG, FIND)

SQL = {
    "dense_account_ids": P(IDS) + "SELECT key, id FROM ids",
    "edge_clock_seconds": P() + f"SELECT row AS edge_id, {CLOCK} AS timestamp FROM pay",
    "timestamp_parsing": P() + "SELECT row, CASE WHEN row % 5 < 4 THEN (t_us // 60000000) * 60000000 END AS parsed_us FROM pay",
    "iso_time_normalised": P() + "SELECT row, CASE row % 4 WHEN 0 THEN (t_us // 1000000) * 1000000 - 19800000000 WHEN 3 THEN NULL ELSE (t_us // 1000000) * 1000000 END AS utc_us FROM pay",
    "edge_features": P() + f"SELECT row AS edge_id, round((({CLOCK}) % 86400) / 3600.0::DOUBLE, 9) AS hour_of_day, round(ln(1 + amount), 9) AS log_amount, CASE WHEN channel = 'P2M' THEN 1 ELSE 0 END AS p2m FROM pay",
    "near_cap_flags": P() + "SELECT row, near FROM pay",
    "indian_digit_grouping": P() + f"SELECT k, {GRP} AS text FROM (SELECT k, CAST(CAST(round_even(t, 0) AS BIGINT) AS VARCHAR) AS s FROM (SELECT to_id AS k, CAST(sum(amount_p) AS DOUBLE)/100 AS t FROM pay GROUP BY 1 UNION ALL SELECT CAST(row AS VARCHAR), amount FROM pay))",
    "state_pairs": P() + "SELECT from_state || ' → ' || to_state AS pair, from_state <> to_state AS mismatch, count(*) AS n FROM pay WHERE lower(from_state || ' → ' || to_state) LIKE '%s1%' GROUP BY 1, 2",
    "score_bands": P() + "SELECT CASE WHEN score >= 0.9 THEN 'High mule probability' WHEN score >= 0.6 THEN 'Elevated risk' ELSE 'Nominal' END AS band, CASE WHEN score >= 0.9 THEN 'high mule probability' WHEN score >= 0.6 THEN 'elevated - investigate' WHEN score >= 0.4 THEN 'ambiguous' ELSE 'low' END AS reading, count(*) AS n FROM pay GROUP BY 1, 2",
    "time_buckets": P() + "SELECT t_us // 5000000 AS bucket, count(*) AS n FROM pay GROUP BY 1",
    "z_normalised_edges": P(f"e AS (SELECT sc.scope, row, ln(1+amount) AS x, (t_us - {S})/1e6 AS t FROM pay JOIN (VALUES ('train', 6), ('train_val', 8), ('all', 10)) sc(scope, d) ON t_us < {S} + d * {DAY})")
    + "SELECT scope, row, round((x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w = 0 THEN 1.0 ELSE stddev_samp(x) OVER w END, 6) AS z_x, round((t - avg(t) OVER w) / CASE WHEN stddev_samp(t) OVER w = 0 THEN 1.0 ELSE stddev_samp(t) OVER w END, 6) AS z_t FROM e WINDOW w AS (PARTITION BY scope)",
    "feature_statistics": P() + f"SELECT round(avg(ln(1+amount)), 9) AS mean, round(stddev_samp(ln(1+amount)), 9) AS std, count(*) AS n FROM pay WHERE t_us < {S + 6 * DAY}",
    "payments_csv_source": P() + "SELECT row_number() OVER (ORDER BY row) - 1 AS row, txn_id, (t_us // 1000000) * 1000000 AS t_us, from_id, to_id, amount, 'P2P' AS channel, is_fraud, layer FROM pay",
    "accounts_csv_source": with_(V_ACCOUNTS) + "SELECT account_id, vpa, state, bank, role, kind FROM v_accounts",
    "merchant_folder_source": with_(V_MERCHANTS, V_M_PAYMENTS, V_COLLECTS) + "SELECT merchant_id, category, '' AS chain, '' AS scenario, (SELECT count(*) FROM v_m_payments p WHERE p.merchant_id = m.merchant_id) AS payments, (SELECT count(*) FROM v_collects c WHERE c.merchant_id = m.merchant_id) AS collects FROM v_merchants m",
    "canonical_edges": with_(RAW.format(leg="false", where="", first="pc", second="rc")) + EDGES.format(off=0),
    "legacy_edges": with_(RAW.format(leg="true", where="WHERE o_orderkey % 11 <> 3", first="rc", second="pc")) + EDGES.format(off=10),
    "own_edges": P(IDS) + f"SELECT row AS edge_id, a.id AS from_id, b.id AS to_id, {CLOCK} AS timestamp, amount AS amount_sent, 0 AS sent_currency, amount AS amount_received, 0 AS received_currency, CASE WHEN channel='P2M' THEN 1 ELSE 0 END AS payment_format, is_fraud AS is_laundering FROM pay JOIN ids a ON a.key = from_id JOIN ids b ON b.key = to_id",
    "labelled_graph_source": """SELECT CAST(c_custkey % 49 + 1 AS INT) AS step, CASE WHEN c_custkey % 5 = 4 THEN -1 WHEN c_custkey % 7 = 0 THEN 1 WHEN c_custkey % 7 < 4 THEN 0 ELSE -1 END AS y, count(*) AS nodes, CAST(sum(coalesce(e, 0)) AS BIGINT) AS edges
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS e FROM orders WHERE o_custkey + o_orderkey % 13 IN (SELECT c_custkey FROM customer) GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1, 2""",
    "wire_payment_validation": P() + f"SELECT row AS position, coalesce({ERR}, '') AS error, CASE WHEN {ERR} IS NULL THEN amount END AS amount, CASE WHEN {ERR} IS NULL THEN (t_us // 1000000) * 1000000 END AS ts_us FROM pay",
    "dead_letter_table": P() + f"SELECT 'file' AS source, row AS position, {ERR} AS error FROM pay WHERE {ERR} IS NOT NULL",
    "gateway_wire_view": P() + "SELECT row, txn_id, from_vpa AS payer_vpa, to_vpa AS payee_vpa, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S') AS timestamp, from_state AS payer_state, to_id AS payee_account_id FROM pay",
    "outbox_transitions": f"""SELECT id, http_status, attempts, CASE WHEN http_status < 300 THEN 'delivered' WHEN http_status = 404 OR attempts + 1 >= 6 THEN 'failed' ELSE 'pending' END AS new_status, attempts + 1 AS new_attempts,
  CASE WHEN NOT (http_status < 300 OR http_status = 404 OR attempts + 1 >= 6) THEN {NOW} + CAST(pow(2, attempts + 1) AS BIGINT) * 1000000 END AS next_attempt_us, 'outbox-' || id AS idempotency_key
  FROM (SELECT o_orderkey AS id, ([200,500,404,408,429,503,202])[o_orderkey % 7 + 1] AS http_status, CAST(o_custkey % 6 AS INT) AS attempts FROM orders)""",
    "outbox_due_items": f"SELECT * FROM (SELECT o_orderkey AS id, ([200,500,404,408,429,503,202])[o_orderkey % 7 + 1] AS http_status, CAST(o_custkey % 6 AS INT) AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 'delivered' ELSE 'pending' END AS status, {NOW} + (o_orderkey % 11 - 5) * 1000000 AS next_attempt_us FROM orders) WHERE status = 'pending' AND next_attempt_us <= {NOW} ORDER BY id LIMIT 20",
    "registry_import_companies": with_(V_REGISTRY) + f"SELECT CASE WHEN no % 17 = 0 THEN 'X' || cin ELSE cin END AS cin, name, status, CASE WHEN no % 4 = 3 THEN NULL ELSE strftime(incorporated_on, '%Y-%m-%d') END AS incorporated_on, paid_up_capital, {KEY.format('address')} AS address_key, CAST(last_annual_return AS INT) AS last_annual_return, CASE WHEN no % 17 = 0 THEN 'company id has the wrong form: X' || cin ELSE '' END AS error FROM v_companies",
    "registry_import_report": with_(V_REGISTRY) + "SELECT 'companies' AS kind, count(*) AS read, count(*) FILTER (no % 17 <> 0) AS loaded, count(*) FILTER (no % 17 = 0) AS skipped, 'Extra' AS unmapped FROM v_companies",
    "registry_import_rejects": with_(V_REGISTRY) + "SELECT error, count(*) AS n FROM (SELECT CASE WHEN CAST(din AS INT) % 6 = 0 THEN 'company id has the wrong form: bad' WHEN CAST(din AS INT) % 10 = 0 THEN 'director id is missing' END AS error FROM v_directorships UNION ALL SELECT CASE WHEN cin LIKE '%7' THEN 'payment address has no @: novpa' END FROM v_entity_accounts) WHERE error IS NOT NULL GROUP BY 1",
    "registry_upsert": with_(V_REGISTRY) + "SELECT cin, CASE WHEN no % 3 = 0 THEN 'last new ' || name ELSE name END AS name, CASE WHEN no % 3 = 0 THEN 'Active' ELSE status END AS status FROM v_companies WHERE no % 2 = 0 OR no % 3 = 0",
    "registry_upsert_directors": with_(V_REGISTRY) + "SELECT din, CASE WHEN d % 4 = 0 THEN 'old ' || din WHEN d % 3 = 0 THEN 'dir ' || din END AS name, CASE WHEN d % 11 = 0 THEN 1 ELSE 0 END AS disqualified, CASE WHEN d % 11 = 0 THEN 's.164(2)' END AS disqualified_note FROM (SELECT DISTINCT din, CAST(din AS INT) AS d FROM v_directorships) WHERE d % 2 = 0 OR d % 3 = 0 OR d % 11 = 0",
    "registry_identifiers": with_(V_REGISTRY) + """SELECT no, CASE no % 6 WHEN 0 THEN 'AAB-' || lpad(CAST(no % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'JUNK' ELSE cin END AS cin, CASE no % 3 WHEN 0 THEN CASE WHEN length(CAST(no AS VARCHAR)) < 8 THEN lpad(CAST(no AS VARCHAR), 8, '0') ELSE CAST(no AS VARCHAR) END WHEN 1 THEN 'P' || no ELSE '1234567' || no END AS din,
  no % 6 <> 1 AS valid, CASE no % 6 WHEN 0 THEN 'llp' WHEN 1 THEN 'unknown' ELSE 'company' END AS kind, false AS listed, CASE WHEN no % 6 > 1 THEN substr(cin, 7, 2) ELSE '' END AS state, CASE WHEN no % 6 > 1 THEN CAST(substr(cin, 9, 4) AS INT) ELSE 0 END AS year, CASE WHEN no % 6 > 1 THEN substr(cin, 13, 3) ELSE '' END AS type FROM v_companies""",
    "registry_status_severity": with_(V_REGISTRY) + "SELECT status, CASE status WHEN 'Strike Off' THEN 'high' WHEN 'Dormant' THEN 'medium' ELSE '' END AS severity, count(*) AS n FROM v_companies GROUP BY 1, 2",
    "company_boards": with_(V_REGISTRY) + "SELECT cin, din, ceased_on IS NULL OR ceased_on > DATE '2026-09-28' AS is_current, disqualified, count(*) FILTER (ceased_on IS NULL OR ceased_on > DATE '2026-09-28') OVER (PARTITION BY din) AS current_n FROM v_directorships",
    "registry_address_farms": with_(V_REGISTRY, f"ak AS (SELECT cin, {KEY.format('address')} AS address_key FROM v_companies)") + "SELECT cin, address_key, count(*) OVER (PARTITION BY address_key) AS at_address FROM ak",
    "registry_common_control": LINK + "SELECT cin, group_n, batch_n FROM ccn UNION ALL SELECT cin, 0, 0 FROM cur_d GROUP BY 1 HAVING count(DISTINCT din) >= 2 AND cin NOT IN (SELECT cin FROM ccn)",
    "registry_rail_crossover": LINK + "SELECT cin, n FROM lkn WHERE cin IN (SELECT cin FROM v_companies)",
    "registry_findings": FINDQ + "SELECT cin, severity, code, CAST(n AS BIGINT) AS n FROM fnd",
    "registry_decisions": FINDQ + "SELECT cin, findings, decision FROM dcn",
    "merged_onboarding_decision": A("r2.0", LEGS, SEEN, V_REGISTRY, APL, REG, FIND, ONB) + """, w AS (SELECT cin, arg_min(code, (CASE severity WHEN 'high' THEN 0 ELSE 1 END, code)) AS t FROM fnd WHERE severity <> 'low' GROUP BY 1),
  tx AS (SELECT e.cin AS key, CASE WHEN self_flagged OR direct > 0 OR g >= 0.9 THEN 'hold' ELSE 'approve' END AS d,
    CASE WHEN self_flagged THEN 'itself under alert' WHEN direct > 0 THEN 'direct links to flagged accounts: ' || direct WHEN g >= 0.9 THEN 'high model score on a transfer' WHEN second_hop > 0 THEN 'second-hop links only: ' || second_hop ELSE 'no links' END AS r
    FROM v_entity_accounts e JOIN seen s USING (vpa) JOIN onb ON onb.account_id = s.account_id),
  m AS (SELECT tx.*, dcn.decision AS rd, w.t, CASE d WHEN 'hold' THEN 2 WHEN 'review' THEN 1 ELSE 0 END AS a, CASE dcn.decision WHEN 'hold' THEN 2 WHEN 'review' THEN 1 ELSE 0 END AS b FROM tx LEFT JOIN dcn ON dcn.cin = key LEFT JOIN w ON w.cin = key)
  SELECT key, CASE WHEN b > a THEN rd ELSE d END AS decision, CASE WHEN b > a THEN coalesce('Registry: ' || t, r) WHEN b > 0 AND t IS NOT NULL THEN r || ' Registry: ' || t ELSE r END AS reason FROM m""",
}
