"""DuckDB oracle text for account views, decisions, feedback, orders and sets."""

from .sql_alerts import BASE
from .sql_metrics import A, P
from .sql_views import V_ACCOUNTS, V_PAYMENTS, V_REGISTRY, with_

S, DAY, HOUR = 1_704_067_200_000_000, 86_400_000_000, 3_600_000_000
LEGS = """lg AS (SELECT row, t_us, amount_p, amount, score, to_id AS account_id, from_id AS other_id, 'in' AS dir, from_vpa AS other_vpa, from_state AS other_state FROM pay
  UNION ALL SELECT row, t_us, amount_p, amount, score, from_id, to_id, 'out', to_vpa, to_state FROM pay)"""
SEEN = """seen AS (SELECT vpa, arg_min(id, (t_us, row, o)) AS account_id FROM (SELECT from_vpa AS vpa, from_id AS id, t_us, row, 0 AS o FROM pay UNION ALL SELECT to_vpa, to_id, t_us, row, 1 FROM pay) GROUP BY 1)"""
ORD = "list_position(['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'], detector)"
ACTIONS = f"""ac0 AS (SELECT *, CAST(substr(account_id, 2) AS BIGINT) AS n FROM alerts),
ac AS (SELECT detector, account_id, CASE WHEN n % 4 = 0 THEN 'clear' WHEN n % 4 = 1 THEN CASE WHEN detector = 'pass_through' THEN 'freeze' ELSE 'clear' END WHEN n % 4 = 2 THEN 'escalate' ELSE 'freeze' END AS action,
  created_us + {HOUR} + {ORD} * 1000000 AS at_us, CASE WHEN n % 7 = 0 THEN '' ELSE 'reviewed' END AS note, 'run-' || (n % 3) AS run_id, gnn_max, status AS before FROM ac0)"""
# replayed alert by alert in time order: an action is refused when the alert is closed at that moment
AFTER = """frz AS (SELECT account_id, min(at_us) AS tf FROM ac WHERE action = 'freeze' AND note <> '' AND before <> 'superseded' GROUP BY 1),
aft AS (SELECT a.detector, a.account_id, CASE WHEN before = 'superseded' THEN before WHEN action = 'clear' AND note <> '' AND (tf IS NULL OR at_us < tf) THEN 'cleared' WHEN tf IS NOT NULL THEN 'frozen'
  WHEN action = 'escalate' AND note <> '' THEN 'escalated' ELSE before END AS status, gnn_max FROM ac a LEFT JOIN frz USING (account_id))"""
ROUTE = """SELECT account_id, CASE WHEN lvl > 0 AND cleared THEN lvl - 1 ELSE lvl END AS level, (['alert_only','delay_settlement','hold_outbound','full_hold'])[CASE WHEN lvl > 0 AND cleared THEN lvl - 1 ELSE lvl END + 1] AS action FROM (
  SELECT account_id, cleared, CASE WHEN sev IS NULL THEN 0 WHEN sev <= 1 THEN 0 WHEN sev = 2 THEN CASE WHEN g >= 0.86 THEN 2 ELSE 1 END WHEN g >= 0.86 AND dets >= 2 THEN 3 ELSE 2 END AS lvl FROM (
    SELECT account_id, max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) FILTER (status NOT IN ('cleared','superseded') AND detector <> 'model_only') AS sev,
      count(DISTINCT detector) FILTER (status NOT IN ('cleared','superseded') AND detector <> 'model_only') AS dets, coalesce(max(gnn_max) FILTER (status NOT IN ('cleared','superseded')), 0) AS g,
      bool_or(status = 'cleared') AS cleared FROM {0} GROUP BY 1))"""
ALLEV = """allev AS (SELECT detector, account_id, row FROM evidence UNION ALL SELECT 'hop_from_flagged', to_id, row FROM hop_ev UNION ALL SELECT 'model_only', account_id, row FROM mo)"""
LAB = f"""{ALLEV}, dr AS (SELECT e.row, a.action, a.at_us, a.detector || '|' || a.account_id AS tie FROM allev e JOIN ac a USING (detector, account_id) WHERE note <> ''),
lab AS (SELECT row, CASE WHEN arg_max(action, (at_us, tie)) = 'freeze' THEN 1 ELSE 0 END AS label FROM dr WHERE action IN ('freeze','clear') GROUP BY 1)"""


def trail(d: str, top: int, name: str = "tr") -> str:
    return f"""{name}_g AS (SELECT account_id, other_id AS party, CAST(sum(amount_p) AS BIGINT) AS amount_p, count(*) AS n, max(score) AS top_score FROM lg WHERE dir = '{d}' GROUP BY 1, 2),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY amount_p DESC, party) AS rk, count(*) OVER (PARTITION BY account_id) AS k FROM {name}_g),
{name} AS (SELECT account_id, CASE WHEN k > {top} AND rk >= {top} THEN 'others' ELSE party END AS party, CAST(sum(amount_p) AS BIGINT) AS amount_p, CAST(sum(n) AS BIGINT) AS n, max(top_score) AS top_score FROM {name}_r GROUP BY 1, 2)"""


def win(side: str, w: int) -> str:
    return f"x.t_us >= r.t_us - {w} AND (x.t_us < r.t_us OR (x.t_us = r.t_us AND x.row <= r.row))"


APPL = "ap AS (SELECT DISTINCT s.account_id FROM seen s WHERE vpa IN (SELECT vpa FROM v_entity_accounts))"
CP = "cp AS (SELECT DISTINCT account_id, other_id FROM lg WHERE account_id <> other_id), fl AS (SELECT DISTINCT account_id FROM alerts WHERE status NOT IN ('cleared', 'superseded'))"
ONB = f"""{APPL}, {CP},
dir AS (SELECT cp.account_id, count(*) AS direct FROM cp JOIN fl ON fl.account_id = cp.other_id GROUP BY 1),
sec AS (SELECT a.account_id, count(DISTINCT b.other_id) AS second_hop FROM ap JOIN cp a USING (account_id) JOIN cp b ON b.account_id = a.other_id JOIN fl ON fl.account_id = b.other_id
  WHERE b.other_id <> a.account_id AND NOT EXISTS (SELECT 1 FROM cp z WHERE z.account_id = a.account_id AND z.other_id = b.other_id) GROUP BY 1),
onb AS (SELECT ap.account_id, coalesce((SELECT count(*) FROM lg WHERE lg.account_id = ap.account_id), 0) AS txns, coalesce((SELECT count(*) FROM cp WHERE cp.account_id = ap.account_id), 0) AS counterparties,
  ap.account_id IN (SELECT account_id FROM fl) AS self_flagged, coalesce(direct, 0) AS direct, coalesce(second_hop, 0) AS second_hop, coalesce((SELECT max(score) FROM lg WHERE lg.account_id = ap.account_id), 0.0) AS g
  FROM ap LEFT JOIN dir USING (account_id) LEFT JOIN sec USING (account_id))"""
# the lifecycle once more, event by event
LIFE = f"""lv AS (SELECT account_id, detector, gnn_max, at_us, {ORD} AS d, CASE WHEN detector = 'model_only' THEN 0 WHEN severity = 'critical' THEN CASE WHEN gnn_max >= 0.86 THEN 3 ELSE 2 END
    WHEN severity = 'high' THEN CASE WHEN gnn_max >= 0.86 THEN 2 ELSE 1 END ELSE 0 END AS level
  FROM (SELECT *, created_us AS at_us FROM alerts UNION ALL SELECT *, updated_us FROM alerts WHERE updated_us <> created_us)),
le0 AS (SELECT account_id, 'raise' AS kind, d, 0 AS level, at_us, '' AS note, gnn_max AS g, d + 10 AS seq FROM lv UNION ALL SELECT account_id, 'hold', d, level, at_us, '', 0, d + 20 FROM lv WHERE level > 0
  UNION ALL SELECT account_id, 'lift', 0, 0, at_us + [1, 24, 72][level] * {HOUR}, '', 0, d + 30 FROM lv WHERE level > 0 UNION ALL SELECT account_id, action, {ORD}, 0, at_us, note, 0, {ORD} + 40 FROM ac),
le AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY at_us, seq) AS k FROM le0),
run AS (SELECT account_id, CAST(0 AS BIGINT) AS k, ['', '', '', '', '', ''] AS st, [CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL] AS since, [CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL] AS filed, [0.0::DOUBLE, 0, 0, 0, 0, 0] AS top,
    0 AS lvl, CAST(0 AS BIGINT) AS who, CAST(NULL AS BIGINT) AS fz, '' AS kind, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS at_us, false AS ok, false AS over, '' AS was, true AS born, '' AS note FROM (SELECT DISTINCT account_id FROM le)
  UNION ALL SELECT account_id, k, st2, since2, filed2, top2, CASE WHEN kind = 'clear' AND ok AND lvl > 0 AND NOT list_contains(st2, 'held') THEN 0 ELSE lvl2 END, who2, fz2, kind, d, at_us, ok, over, was, born, note FROM (
    SELECT *, CASE WHEN ok AND kind IN ('raise', 'hold', 'lift', 'clear', 'escalate', 'freeze') THEN list_transform(st, lambda x, i: CASE
        WHEN kind = 'raise' AND i = d THEN 'open' WHEN kind = 'raise' AND i = 6 AND x = 'open' THEN 'superseded' WHEN kind = 'hold' AND i = d AND level >= 2 THEN 'held'
        WHEN kind = 'lift' AND i = who AND x = 'held' THEN 'open' WHEN kind = 'clear' AND i = d THEN 'cleared' WHEN kind = 'escalate' AND i = d AND x <> 'held' THEN 'escalated'
        WHEN kind = 'freeze' AND x IN ('open', 'held', 'escalated') THEN 'frozen' ELSE x END) ELSE st END AS st2,
      CASE WHEN kind = 'raise' AND ok THEN list_transform(since, lambda x, i: CASE WHEN i = d THEN at_us ELSE x END) ELSE since END AS since2,
      CASE WHEN kind = 'raise' THEN list_transform(top, lambda x, i: CASE WHEN i = d AND st[i] <> 'cleared' THEN greatest(x, g) ELSE x END) ELSE top END AS top2,
      CASE WHEN ok AND ((kind = 'hold' AND level >= 2) OR kind IN ('escalate', 'freeze')) THEN list_transform(filed, lambda x, i: CASE WHEN i = d OR (kind = 'freeze' AND st[i] IN ('open', 'held', 'escalated')) THEN coalesce(x, at_us) ELSE x END) ELSE filed END AS filed2,
      CASE WHEN ok AND kind = 'hold' THEN level WHEN ok AND kind IN ('lift', 'freeze') THEN 0 ELSE lvl END AS lvl2, CASE WHEN ok AND kind = 'hold' THEN d ELSE who END AS who2,
      CASE WHEN ok AND kind = 'freeze' THEN at_us ELSE fz END AS fz2, ok AND kind = 'clear' AND (lvl > 0 OR top[d] >= 0.86) AS over
    FROM (SELECT r.account_id, e.k, e.kind, e.d, e.level, e.at_us, e.note, e.g, r.st, r.since, r.filed, r.top, r.lvl, r.who, r.fz, r.st[e.d] AS was, r.st[e.d] <> '' AS born,
        CASE e.kind WHEN 'raise' THEN r.st[e.d] = '' AND r.fz IS NULL WHEN 'hold' THEN r.fz IS NULL AND r.st[e.d] IN ('open', 'held', 'escalated') AND e.level > r.lvl WHEN 'lift' THEN r.lvl > 0
          ELSE trim(e.note) <> '' AND r.st[e.d] IN ('open', 'held', 'escalated') END AS ok
      FROM run r JOIN le e ON e.account_id = r.account_id AND e.k = r.k + 1))),
fin AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY k DESC) = 1),
las AS (SELECT account_id, (['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'])[i] AS detector, since[i] AS raised_us, st[i] AS status, filed[i] AS filed_us FROM fin, (SELECT unnest([1,2,3,4,5,6]) AS i) WHERE st[i] <> '')"""
STOPPED = "blk AS (SELECT DISTINCT row FROM pay JOIN fin ON (fin.account_id = from_id OR fin.account_id = to_id) AND fz < t_us)"
FANDAY = f"""px AS (SELECT *, (t_us - {S}) // {DAY} AS d0 FROM pay WHERE channel = 'P2P' AND t_us < {S + 6 * DAY} AND to_id IN (SELECT account_id FROM v_accounts WHERE kind = 'individual')),
fd AS (SELECT a.to_id, a.d0, coalesce(n, 0) AS n FROM (SELECT DISTINCT to_id, d0 FROM px) a LEFT JOIN (SELECT to_id, d0, count(*) AS n FROM (SELECT from_id, to_id, min(d0) AS d0 FROM px GROUP BY 1, 2) WHERE d0 >= 3 GROUP BY 1, 2) b USING (to_id, d0))"""

SQL = {
    "payments_in_order": P() + "SELECT row, row_number() OVER (ORDER BY t_us, row) AS seq FROM pay",
    "new_payee_flags": P() + "SELECT row, new_payee FROM pay",
    "daily_totals": with_(V_PAYMENTS, BASE) + "SELECT account_id, day, in_p, out_p FROM daily",
    "account_baselines": with_(V_PAYMENTS, BASE) + "SELECT account_id, day, base_p, round(base_ratio, 9) AS base_ratio, active_days FROM base",
    "rolling_inflow_24h": P() + f"SELECT r.row, CAST(sum(x.amount_p) AS BIGINT) AS in_24h_p, count(*) FILTER (x.new_payee AND x.channel = 'P2P') AS new_payers_24h FROM pay r JOIN pay x ON x.to_id = r.to_id AND {win('i', DAY)} GROUP BY 1",
    "rolling_outflow_6h": P(LEGS) + f"SELECT r.row, CAST(coalesce(sum(x.amount_p) FILTER (x.dir='in'), 0) AS BIGINT) AS in_6h_p, CAST(sum(x.amount_p) FILTER (x.dir='out') AS BIGINT) AS out_6h_p, count(*) FILTER (x.dir='out') AS outs_6h, count(DISTINCT x.other_id) FILTER (x.dir='out') AS payees_6h FROM pay r JOIN lg x ON x.account_id = r.from_id AND {win('o', 6 * HOUR)} GROUP BY 1",
    "account_profile": P(LEGS) + """SELECT account_id, count(*) FILTER (dir='in') AS in_n, count(*) FILTER (dir='out') AS out_n, round(coalesce(CAST(sum(amount_p) FILTER (dir='in') AS DOUBLE), 0)/100, 2) AS total_in, round(coalesce(CAST(sum(amount_p) FILTER (dir='out') AS DOUBLE), 0)/100, 2) AS total_out,
  count(DISTINCT other_id) FILTER (dir='in') AS payers, count(DISTINCT other_id) FILTER (dir='out') AS payees, min(t_us) FILTER (dir='in') AS first_in_us, min(t_us) FILTER (dir='out') AS first_out_us, count(*) FILTER (amount BETWEEN 450000 AND 560000) AS band_n,
  CAST(floor((min(t_us) FILTER (dir='out') - min(t_us) FILTER (dir='in'))/1000000.0) AS BIGINT) AS turnaround_s, string_agg(DISTINCT other_state, ',' ORDER BY other_state) AS states FROM lg GROUP BY 1""",
    "vpa_directory": P(SEEN) + "SELECT * FROM seen",
    "handle_resolution": P(V_ACCOUNTS, SEEN) + """SELECT handle, coalesce(CASE WHEN handle IN (SELECT account_id FROM v_accounts UNION SELECT from_id FROM pay UNION SELECT to_id FROM pay) THEN handle END, s.account_id, a.account_id) AS account_id
  FROM (SELECT account_id AS handle FROM v_accounts UNION ALL SELECT vpa FROM v_accounts UNION ALL SELECT 'zz' || vpa FROM v_accounts) h LEFT JOIN seen s ON s.vpa = handle LEFT JOIN v_accounts a ON a.vpa = handle""",
    "payments_with_labels": P(V_ACCOUNTS) + "SELECT coalesce(role, 'unknown') AS role, coalesce(kind, 'individual') AS kind, count(*) AS n FROM (SELECT CASE WHEN row % 97 = 0 THEN 'N' || to_id ELSE to_id END AS account_id FROM pay) LEFT JOIN v_accounts USING (account_id) GROUP BY 1, 2",
    "degree_and_velocity": P(LEGS) + "SELECT account_id, i AS in_degree, o AS out_degree, round(i::DOUBLE/m, 3) AS in_velocity, round(o::DOUBLE/m, 3) AS out_velocity FROM (SELECT *, greatest(max(i) OVER (), max(o) OVER (), 1) AS m FROM (SELECT account_id, count(*) FILTER (dir='in') AS i, count(*) FILTER (dir='out') AS o FROM lg GROUP BY 1))",
    "money_trail_sources": P(LEGS, trail("in", 6)) + "SELECT account_id, party, amount_p, n, round(top_score, 9) AS top_score FROM tr",
    "money_trail_destinations": P(LEGS, trail("out", 5), trail("out", 3, "nx")) + "SELECT tr.account_id, tr.party, tr.amount_p, tr.n, nx.party AS next_party, nx.amount_p AS next_p FROM tr LEFT JOIN nx ON nx.account_id = tr.party",
    "alert_network": A("r2.0", """ce AS (SELECT account_id FROM (SELECT account_id, max((CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, updated_us)) AS w FROM alerts WHERE status NOT IN ('superseded','cleared') GROUP BY 1) ORDER BY w DESC, account_id LIMIT 40),
  pr AS (SELECT from_id, to_id, CAST(sum(amount_p) AS BIGINT) AS amount_p, count(*) AS n, round(max(score), 4) AS top_score, max(t_us) AS last_us, from_id IN (SELECT account_id FROM ce) AS fc, to_id IN (SELECT account_id FROM ce) AS tc FROM pay GROUP BY ALL),
  ou AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN fc THEN from_id ELSE to_id END ORDER BY amount_p DESC, from_id, to_id) AS k FROM pr WHERE (fc OR tc) AND NOT (fc AND tc))""")
    + "SELECT from_id, to_id, amount_p, n, top_score, last_us FROM pr WHERE fc AND tc UNION ALL SELECT from_id, to_id, amount_p, n, top_score, last_us FROM ou WHERE k <= 6",
    "counterparty_sets": P(LEGS) + "SELECT account_id, count(DISTINCT other_id) AS counterparties FROM lg WHERE account_id <> other_id GROUP BY 1",
    "onboarding_check": A("r2.0", LEGS, SEEN, V_REGISTRY, ONB) + """SELECT account_id, txns, counterparties, self_flagged, direct, second_hop, CASE WHEN self_flagged OR direct > 0 OR g >= 0.9 THEN 'hold' ELSE 'approve' END AS decision,
  CASE WHEN self_flagged THEN 'itself under alert' WHEN direct > 0 THEN 'direct links to flagged accounts: ' || direct WHEN g >= 0.9 THEN 'high model score on a transfer' WHEN second_hop > 0 THEN 'second-hop links only: ' || second_hop ELSE 'no links' END AS reason FROM onb""",
    "onboarding_second_hop": A("r2.0", LEGS, SEEN, V_REGISTRY, ONB) + "SELECT account_id, direct, second_hop FROM onb",
    "onboarding_vpas": A("r2.0", LEGS, SEEN, V_REGISTRY, ONB, """fs AS (SELECT account_id, max(score) AS score FROM alerts WHERE status NOT IN ('cleared', 'superseded') GROUP BY 1),
  se AS (SELECT ap.account_id, b.other_id AS second_account, a.other_id AS via, CAST(fs.score AS INT) AS second_score FROM ap JOIN cp a USING (account_id) JOIN cp b ON b.account_id = a.other_id JOIN fs ON fs.account_id = b.other_id
    WHERE b.other_id <> ap.account_id AND NOT EXISTS (SELECT 1 FROM cp z WHERE z.account_id = ap.account_id AND z.other_id = b.other_id)),
  be AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY second_score DESC, md5(second_account), second_account, via) = 1)""")
    + """SELECT v.vpa, s.account_id, s.account_id IS NOT NULL AS known, coalesce(txns, 0) AS txns, coalesce(counterparties, 0) AS counterparties, coalesce(self_flagged, false) AS self_flagged, coalesce(direct, 0) AS direct, coalesce(second_hop, 0) AS second_hop,
  second_account, second_score, via, CASE WHEN self_flagged OR direct > 0 OR g >= 0.9 THEN 'hold' ELSE 'approve' END AS decision,
  CASE WHEN s.account_id IS NULL THEN 'not seen in any payment' WHEN self_flagged THEN 'itself under alert' WHEN direct > 0 THEN 'direct links to flagged accounts: ' || direct WHEN g >= 0.9 THEN 'high model score on a transfer' WHEN second_hop > 0 THEN 'second-hop links only: ' || second_hop ELSE 'no links' END AS reason
  FROM (SELECT DISTINCT vpa FROM v_entity_accounts) v LEFT JOIN seen s USING (vpa) LEFT JOIN onb USING (account_id) LEFT JOIN be USING (account_id)""",
    "account_status": A("r2.0", ACTIONS, LIFE, SEEN, V_REGISTRY).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT v.vpa, s.account_id, s.account_id IS NOT NULL AS seen, coalesce(n, 0) > 0 AS flagged, coalesce(fin.lvl > 0, false) AS held, fin.fz IS NOT NULL AS frozen, coalesce(n, 0) AS live_alerts
  FROM (SELECT DISTINCT vpa FROM v_entity_accounts) v LEFT JOIN seen s USING (vpa) LEFT JOIN (SELECT account_id, count(*) AS n FROM las WHERE status <> 'cleared' GROUP BY 1) c ON c.account_id = s.account_id LEFT JOIN fin ON fin.account_id = s.account_id""",
    "alert_lifecycle": A("r2.0", ACTIONS, LIFE).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT account_id, detector, raised_us, status, filed_us FROM las",
    "action_outcomes": A("r2.0", ACTIONS, LIFE).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT account_id, (['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'])[d] AS detector, kind, at_us, ok AS accepted,
  CASE WHEN trim(note) = '' THEN 'no note' WHEN NOT born THEN 'no alert' WHEN NOT ok THEN 'closed' END AS refused, over AS override, CASE WHEN ok AND kind = 'clear' AND was = 'held' THEN 'release_hold' WHEN ok THEN kind END AS logged FROM run WHERE kind IN ('clear', 'escalate', 'freeze')""",
    "account_restrictions": A("r2.0", ACTIONS, LIFE).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT account_id, lvl AS level, CASE WHEN lvl > 0 THEN (['inflow_new_payers','structuring','fan_in_new_payers','pass_through','hop_from_flagged','model_only'])[who] END AS held_by, fz AS frozen_us FROM fin",
    "evidence_timeline": A("r2.0", ACTIONS) + "SELECT account_id, created_us AS at_us, 'alert' AS kind, detector || ' (' || severity || ')' AS text FROM alerts UNION ALL SELECT account_id, at_us, 'action', 'analyst: ' || action || '. ' || note FROM ac WHERE note <> ''",
    "alert_status_after_actions": A("r2.0", ACTIONS, AFTER) + "SELECT detector, account_id, status, status = 'cleared' AND gnn_max >= 0.86 AS override FROM aft",
    "router_levels": A() + ROUTE.format("alerts"),
    "router_levels_after_actions": A("r2.0", ACTIONS, AFTER, "al2 AS (SELECT a.detector, a.account_id, a.severity, a.gnn_max, aft.status FROM alerts a JOIN aft USING (detector, account_id))") + ROUTE.format("al2"),
    "lead_seconds": A() + "SELECT a.detector, a.account_id, round((min(p.t_us) - a.created_us)/1e6, 6) AS lead_seconds FROM alerts a LEFT JOIN pay p ON p.from_id = a.account_id AND (p.t_us > a.created_us OR (p.t_us = a.created_us AND p.row > a.created_row)) WHERE a.detector IN ('inflow_new_payers','structuring') GROUP BY a.detector, a.account_id, a.created_us",
    "alert_ids": A() + f"SELECT 'ALR-' || lpad(CAST(row_number() OVER (ORDER BY created_us, created_row, {ORD}) AS VARCHAR), 9, '0') AS alert_id, detector, account_id, created_us FROM alerts",
    "alert_order": A() + "SELECT detector, account_id, severity, CAST(score AS INT) AS score, updated_us FROM alerts",
    "alert_explanations": A("r2.0", """fl2 AS (SELECT f.*, row_number() OVER (PARTITION BY detector, account_id ORDER BY t_us DESC, row DESC) AS k FROM fires f)""") + """SELECT detector, account_id,
  CASE detector WHEN 'inflow_new_payers' THEN people || ' new payers sent ' || printf('%.2f', total_p/100.0::DOUBLE) || ' within ' || (w_us // 3600000000) || ' h' WHEN 'structuring' THEN hits || ' transfers near the cap from ' || people || ' payers, ' || printf('%.2f', total_p/100.0::DOUBLE)
    ELSE 'received ' || printf('%.2f', total_p/100.0::DOUBLE) || ', sent ' || printf('%.2f', out_p/100.0::DOUBLE) || ' to ' || people || ' accounts within ' || (w_us // 3600000000) || ' h' END AS reason,
  'people=' || people || '; total=' || printf('%.2f', total_p/100.0::DOUBLE) || '; transfers=' || hits AS facts FROM fl2 WHERE k = 1
  UNION ALL SELECT detector, account_id, CASE detector WHEN 'hop_from_flagged' THEN people || ' accounts under alert sent ' || printf('%.2f', total_p/100.0::DOUBLE) || ' in ' || hits || ' transfers'
    ELSE 'model score of ' || CAST(floor(gnn_max * 100) AS BIGINT) || '% or more on ' || hits || ' transfers, ' || printf('%.2f', total_p/100.0::DOUBLE) END,
  'people=' || people || '; total=' || printf('%.2f', total_p/100.0::DOUBLE) || '; transfers=' || hits FROM alerts WHERE detector IN ('hop_from_flagged', 'model_only')""",
    "turnaround_first_in_first_out": P(LEGS) + "SELECT l.account_id, round((min(t_us) - min(f))/1e6, 6) AS seconds FROM lg l JOIN (SELECT account_id, min(t_us) AS f FROM lg WHERE dir='in' GROUP BY 1) i ON i.account_id = l.account_id AND l.t_us >= f WHERE dir='out' GROUP BY 1",
    "recent_payments": P() + "SELECT row, from_id, to_id, amount, channel FROM pay ORDER BY t_us DESC, row DESC LIMIT 60",
    "downstream_transfers": P() + "SELECT from_id AS account_id, rk, to_vpa, to_state, amount, layer FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY t_us, row) AS rk FROM pay) WHERE rk <= 20",
    "chain_legs": A("r2.0", LEGS) + "SELECT account_id, rk, row, dir FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY t_us, row, dir) AS rk FROM lg WHERE account_id IN (SELECT account_id FROM alerts)) WHERE rk <= 12",
    "chain_request_nodes": A("r2.0", LEGS, SEEN, """cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY t_us, row, dir) AS rk FROM lg WHERE account_id IN (SELECT account_id FROM alerts WHERE status NOT IN ('cleared', 'superseded'))) WHERE rk <= 12),
  nm AS (SELECT cl.account_id AS chain, rk, coalesce(s.account_id, 'ext:' || v) AS node FROM (SELECT *, CASE WHEN row % 5 = 0 THEN 'new' || other_vpa ELSE other_vpa END AS v FROM cl) cl LEFT JOIN seen s ON s.vpa = v)""")
    + "SELECT chain, node, row_number() OVER (PARTITION BY chain ORDER BY min(rk)) AS node_no FROM nm GROUP BY 1, 2",
    "peer_busiest_day_p95": P(V_ACCOUNTS) + f"SELECT kind, round(quantile_cont(b/100.0::DOUBLE, 0.95), 4) AS p95 FROM (SELECT to_id AS account_id, max(s) AS b FROM (SELECT to_id, day, sum(amount_p)::DOUBLE AS s FROM pay WHERE channel='P2P' AND t_us < {S + 6 * DAY} GROUP BY 1, 2) GROUP BY 1) JOIN v_accounts USING (account_id) GROUP BY 1",
    "fan_in_histogram": P(V_ACCOUNTS, FANDAY) + "SELECT n, count(*) AS account_days FROM fd GROUP BY 1",
    "fan_in_p999": P(V_ACCOUNTS, FANDAY) + "SELECT round(quantile_cont(n, 0.999), 6) AS p999 FROM fd",
    "day_split_60_20_20": P() + f"""SELECT i, j, error FROM (SELECT a.day AS i, b.day AS j, round(greatest(abs(a.bf/t - 0.6)/0.6, abs((b.bf - a.bf)/t - 0.2)/0.2, abs((t - b.bf)/t - 0.2)/0.2), 9) AS error
  FROM (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bf, sum(n) OVER ()::DOUBLE AS t FROM (SELECT (t_us - {S}) // {DAY} AS day, count(*) AS n FROM pay GROUP BY 1)) a
  JOIN (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bf FROM (SELECT (t_us - {S}) // {DAY} AS day, count(*) AS n FROM pay GROUP BY 1)) b ON a.day < b.day) ORDER BY error, i, j LIMIT 1""",
    "daily_illicit_ratio": P() + f"SELECT (t_us - {S}) // {DAY} AS day, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS illicit, round(sum(is_fraud)::DOUBLE/count(*), 9) AS ratio FROM pay GROUP BY 1",
    "sample_feed": P() + """SELECT row, is_fraud, from_id, to_id, score, CASE WHEN score >= 0.9 THEN 'High mule probability' WHEN score >= 0.6 THEN 'Elevated risk' ELSE 'Nominal' END AS band FROM (SELECT * FROM pay WHERE is_fraud = 1 ORDER BY row LIMIT 30)
  UNION ALL SELECT row, is_fraud, from_id, to_id, score, CASE WHEN score >= 0.9 THEN 'High mule probability' WHEN score >= 0.6 THEN 'Elevated risk' ELSE 'Nominal' END AS band FROM (SELECT * FROM pay WHERE is_fraud = 0 ORDER BY md5('7|' || row) LIMIT 30)""",
    "stratified_split": P() + "SELECT row, CASE WHEN k*10 <= n*6 THEN 'train' WHEN k*10 <= n*8 THEN 'val' ELSE 'test' END AS part FROM (SELECT row, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || row)) AS k, count(*) OVER (PARTITION BY is_fraud) AS n FROM pay)",
    "score_comparison": P("x AS (SELECT a, b, abs(a - b) AS d FROM (SELECT score AS a, floor(score*100 + 0.5)/100 AS b FROM pay))") + "SELECT round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS flips, round(quantile_cont(d, 0.99), 6) AS p99_diff FROM x",
    "feedback_labels": A("r2.0", ACTIONS, LAB) + "SELECT row, label FROM lab",
    "feedback_report": A("r2.0", ACTIONS, LAB) + """SELECT * FROM (SELECT count(*) AS labelled, count(*) FILTER (label=1) AS fraud_labels, count(*) FILTER (label=is_fraud) AS agree, count(*) FILTER (label<>is_fraud) AS would_flip FROM lab JOIN pay USING (row)),
  (SELECT count(DISTINCT run_id) AS runs, count(*) FILTER (action='freeze') AS freezes, count(*) FILTER (action='freeze' AND role IN ('l1_mule','l2_mule')) AS freezes_on_mules, count(*) FILTER (action='clear') AS clears, count(*) FILTER (action='clear' AND role IN ('l1_mule','l2_mule')) AS clears_on_mules
   FROM ac LEFT JOIN v_accounts USING (account_id) WHERE note <> '')""",
    "relabelled_edges": A("r2.0", ACTIONS, LAB) + "SELECT row, coalesce(label, is_fraud) AS label, coalesce(label, is_fraud) <> is_fraud AS changed FROM pay LEFT JOIN lab USING (row)",
    "decisions_by_detector": A("r2.0", ACTIONS) + "SELECT detector, count(*) FILTER (action='clear') AS clear, count(*) FILTER (action='escalate') AS escalate, count(*) FILTER (action='freeze') AS freeze FROM ac WHERE note <> '' GROUP BY 1",
    "prior_decisions": A("r2.0", ACTIONS) + "SELECT account_id, detector, action, run_id, at_us, rk FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY at_us DESC, detector) AS rk FROM ac WHERE note <> '' AND run_id <> 'run-0') WHERE rk <= 20",
    "store_counts": A("r2.0", ACTIONS) + "SELECT 'alerts.' || status AS what, count(*) AS n FROM alerts GROUP BY 1 UNION ALL SELECT 'decisions.' || action, count(*) FROM ac GROUP BY 1 UNION ALL SELECT 'payments.' || channel, count(*) FROM pay GROUP BY 1",
    "throughput_per_second": P() + "SELECT (t_us // 600000000) * 600000000 AS start_us, count(*) AS n FROM pay GROUP BY 1",
    "duplicates_dropped": P() + "SELECT txn_id, t_us, CASE WHEN row % 10 = 0 THEN 1 ELSE 0 END AS dropped FROM pay",
}
