"""DuckDB oracle text for the account detectors and alerts: plain self-joins, independent of the running-sum plans."""

from .sql_views import V_ACCOUNTS, V_PAYMENTS, with_

DAY = 86_400_000_000
HOUR = 3_600_000_000

BASE = """daily AS (
  SELECT account_id, day, CAST(sum(i) AS BIGINT) AS in_p, CAST(sum(o) AS BIGINT) AS out_p FROM (
    SELECT to_id AS account_id, day, amount_p AS i, 0 AS o FROM pay UNION ALL SELECT from_id, day, 0, amount_p FROM pay) GROUP BY 1, 2),
base AS (
  SELECT d.account_id, d.day, CAST(coalesce(max(b.in_p), 0) AS BIGINT) AS base_p,
    coalesce(CASE WHEN sum(b.in_p) >= 2000000 THEN CAST(sum(b.out_p) AS DOUBLE) / CAST(sum(b.in_p) AS DOUBLE) ELSE 0.0 END, 0.0) AS base_ratio,
    count(b.day) AS active_days
  FROM daily d LEFT JOIN daily b ON b.account_id = d.account_id AND b.day BETWEEN d.day - 7 AND d.day - 1 AND (b.in_p <> 0 OR b.out_p <> 0)
  GROUP BY 1, 2)"""


def _pairs(r_cond: str, x_cond: str, w: int) -> str:
    return (
        f"FROM pay r JOIN pay x ON x.to_id = r.to_id AND x.t_us >= r.t_us - {w} AND (x.t_us < r.t_us OR (x.t_us = r.t_us AND x.row <= r.row)) "
        f"WHERE {r_cond} AND {x_cond} GROUP BY r.to_id, r.t_us, r.row, r.day"
    )


NEW_R, NEW_X = "r.new_payee AND r.channel = 'P2P'", "x.new_payee AND x.channel = 'P2P'"
NEAR_R, NEAR_X = "r.near AND r.channel = 'P2P'", "x.near AND x.channel = 'P2P'"


def _new(name: str, w: int) -> str:
    return (
        f"{name} AS (SELECT r.to_id AS account_id, r.t_us, r.row, r.day, CAST(sum(x.amount_p) AS BIGINT) AS total_p, count(*) AS n, "
        f"count(DISTINCT x.from_id) AS payers, max(x.score) AS top {_pairs(NEW_R, NEW_X, w)})"
    )


def _fires(version: str) -> str:
    rel = version != "r2.0"
    floor = (
        "CASE WHEN active_days >= 5 THEN greatest(2500000, 3 * base_p) ELSE greatest(2500000, CASE kind WHEN 'individual' THEN 2800000 WHEN 'supplier' THEN 9400000 ELSE 0 END) END"
        if rel else "10000000"
    )
    fan = (
        """, f_fan AS (
  SELECT 'fan_in_new_payers' AS detector, n24.account_id, t_us, row, 86400000000 AS w_us, CASE WHEN payers >= 10 THEN 'critical' ELSE 'high' END AS severity,
    72 + 2 * least(payers, 10) AS base_score, top, total_p, 0 AS out_p, payers AS people, n AS hits, 500000 AS bar_p
  FROM n24 LEFT JOIN v_accounts a ON a.account_id = n24.account_id
  WHERE coalesce(kind, 'individual') = 'individual' AND payers >= 5 AND total_p >= 500000)""" if rel else ""
    )
    return f"""{_new('n24', DAY)}, {_new('n72', 3 * DAY)},
f_inflow AS (
  SELECT 'inflow_new_payers' AS detector, account_id, t_us, row, w_us,
    CASE WHEN payers >= 3 OR total_p >= 2 * bar THEN 'critical' ELSE 'high' END AS severity, 78 + 3 * least(payers, 5) AS base_score, top,
    total_p, 0 AS out_p, payers AS people, n AS hits, bar AS bar_p
  FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, row ORDER BY w_us) AS k FROM (
      SELECT n24.*, {DAY} AS w_us, greatest(15000000, 3 * CASE WHEN active_days >= 5 THEN base_p ELSE 0 END) AS bar FROM n24 JOIN base USING (account_id, day)
      UNION ALL
      SELECT n72.*, {3 * DAY} AS w_us, 2 * greatest(15000000, 3 * CASE WHEN active_days >= 5 THEN base_p ELSE 0 END) AS bar FROM n72 JOIN base USING (account_id, day))
    WHERE total_p >= bar AND NOT (payers < 2 AND n < 3))
  WHERE k = 1),
s24 AS (SELECT r.to_id AS account_id, r.t_us, r.row, CAST(sum(x.amount_p) AS BIGINT) AS total_p, count(*) AS n, count(DISTINCT x.from_id) AS payers,
    count(*) FILTER (x.new_payee) AS new_n, max(x.score) AS top {_pairs(NEAR_R, NEAR_X, DAY)}),
f_struct AS (
  SELECT 'structuring' AS detector, account_id, t_us, row, {DAY} AS w_us, CASE WHEN n >= 5 THEN 'critical' ELSE 'high' END AS severity, 74 + 2 * least(n, 8) AS base_score, top,
    total_p, 0 AS out_p, payers AS people, n AS hits, 0 AS bar_p FROM s24 WHERE n >= 3 AND payers >= 2 AND new_n >= 1){fan},
legs AS (SELECT to_id AS account_id, 'i' AS side, row, t_us, amount_p, from_id AS other, score FROM pay UNION ALL SELECT from_id, 'o', row, t_us, amount_p, to_id, score FROM pay),
p_w AS (
  SELECT r.from_id AS account_id, r.t_us, r.row, r.day, w.w_us, CAST(coalesce(sum(x.amount_p) FILTER (x.side = 'i'), 0) AS BIGINT) AS inn,
    CAST(coalesce(sum(x.amount_p) FILTER (x.side = 'o'), 0) AS BIGINT) AS outt, count(*) FILTER (x.side = 'o') AS outs,
    count(DISTINCT x.other) FILTER (x.side = 'o') AS payees, max(x.score) AS top
  FROM pay r CROSS JOIN (VALUES ({HOUR}), ({6 * HOUR}), ({DAY})) w(w_us)
  JOIN legs x ON x.account_id = r.from_id AND x.t_us >= r.t_us - w.w_us AND (x.t_us < r.t_us OR (x.t_us = r.t_us AND x.row <= r.row))
  GROUP BY 1, 2, 3, 4, 5),
f_pass AS (
  SELECT 'pass_through' AS detector, account_id, t_us, row, w_us, CASE WHEN ratio >= 0.85 AND w_us <= {6 * HOUR} THEN 'critical' ELSE 'high' END AS severity,
    70 + CAST(floor(least(ratio, 1.0) * 20) AS INT) AS base_score, top, inn AS total_p, outt AS out_p, payees AS people, outs AS hits, floor_p AS bar_p
  FROM (
    SELECT *, least(CAST(outt AS DOUBLE) / CAST(inn AS DOUBLE), 9.99) AS ratio, row_number() OVER (PARTITION BY account_id, row ORDER BY w_us) AS k
    FROM (SELECT p_w.*, base_p, base_ratio, active_days, {floor} AS floor_p FROM p_w JOIN base USING (account_id, day) LEFT JOIN v_accounts USING (account_id))
    WHERE inn >= floor_p AND outs >= 2 AND payees >= 2 AND outt >= 0.6::DOUBLE * inn)
  WHERE k = 1 AND NOT (active_days >= 5 AND base_ratio >= 0.5 AND inn < 3 * base_p)),
fires AS (SELECT * FROM f_inflow UNION ALL SELECT * FROM f_struct{' UNION ALL SELECT * FROM f_fan' if rel else ''} UNION ALL SELECT * FROM f_pass)"""


def fires(version: str = "r2.0") -> str:
    return with_(V_PAYMENTS, V_ACCOUNTS, BASE, _fires(version))


HITS = """hits AS (
  SELECT 'inflow_new_payers' AS detector, to_id AS account_id, row, t_us, score FROM pay WHERE new_payee AND channel = 'P2P'
  UNION ALL SELECT 'fan_in_new_payers', to_id, row, t_us, score FROM pay WHERE new_payee AND channel = 'P2P'
  UNION ALL SELECT 'structuring', to_id, row, t_us, score FROM pay WHERE near AND channel = 'P2P'
  UNION ALL SELECT 'pass_through', to_id, row, t_us, score FROM pay
  UNION ALL SELECT 'pass_through', from_id, row, t_us, score FROM pay WHERE from_id <> to_id)"""

RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
NAME = "CASE {0} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def alerts_ctes(version: str = "r2.0", hop: bool = True, th: float = 0.86) -> str:
    share = (
        """ AND coalesce((SELECT kind FROM v_accounts a WHERE a.account_id = h.to_id), 'individual') = 'individual' AND (
      SELECT sum(CASE WHEN EXISTS (SELECT 1 FROM prim c WHERE c.account_id = y.from_id AND (c.created_us < h.t_us OR (c.created_us = h.t_us AND c.created_row <= h.row)) AND c.created_us >= y.t_us - 86400000000)
                      THEN y.amount_p ELSE 0 END) >= greatest(610000, 0.5::DOUBLE * sum(y.amount_p))
      FROM pay y WHERE y.to_id = h.to_id AND y.t_us >= h.t_us - 86400000000 AND (y.t_us < h.t_us OR (y.t_us = h.t_us AND y.row <= h.row)))"""
        if version == "r2.2" else ""
    )
    return f"""{_fires(version)}, {HITS},
evidence AS (
  SELECT DISTINCT f.detector, f.account_id, h.row, h.t_us, h.score FROM fires f JOIN hits h ON h.detector = f.detector AND h.account_id = f.account_id
    AND h.t_us >= f.t_us - f.w_us AND (h.t_us < f.t_us OR (h.t_us = f.t_us AND h.row <= f.row))),
ev_agg AS (SELECT detector, account_id, max(score) AS gnn_max, count(*) AS evidence_rows, min(t_us) AS first_evidence_us FROM evidence GROUP BY 1, 2),
prim AS (
  SELECT detector, account_id, min(t_us) AS created_us, arg_min(row, (t_us, row)) AS created_row, max(t_us) AS updated_us, arg_max(row, (t_us, row)) AS updated_row,
    {NAME.format(f'max({RANK})')} AS severity, max(least(99, base_score + CAST(round_even(top * 10, 0) AS INT))) AS score,
    arg_max(total_p, (t_us, row)) AS total_p, arg_max(people, (t_us, row)) AS people, arg_max(hits, (t_us, row)) AS hits
  FROM fires GROUP BY 1, 2),
hh AS (
  SELECT r.row, r.t_us, r.from_id, r.to_id, r.amount_p, r.score, c.created_us, c.created_row,
    CASE WHEN c.created_us > r.t_us OR (c.created_us = r.t_us AND c.created_row > r.row) THEN c.created_us ELSE r.t_us END AS act_us,
    CASE WHEN c.created_us > r.t_us OR (c.created_us = r.t_us AND c.created_row > r.row) THEN c.created_row ELSE r.row END AS act_row
  FROM pay r JOIN prim c ON c.account_id = r.from_id AND c.created_us >= r.t_us - 86400000000),
hop_hits AS (
  SELECT row, t_us, from_id, to_id, amount_p, score, min(act_us) AS act_us, arg_min(act_row, (act_us, act_row)) AS act_row FROM hh GROUP BY ALL),
hop_trig AS (SELECT * FROM hop_hits h WHERE act_us = t_us AND act_row = row{share}),
hop_last AS (SELECT to_id, min(t_us) AS created_us, arg_min(row, (t_us, row)) AS created_row, max(t_us) AS updated_us, arg_max(row, (t_us, row)) AS updated_row FROM hop_trig GROUP BY 1),
hop_ev AS (SELECT l.*, h.row, h.t_us, h.from_id, h.amount_p, h.score FROM hop_last l JOIN hop_hits h ON h.to_id = l.to_id
    AND (h.act_us < l.updated_us OR (h.act_us = l.updated_us AND h.act_row <= l.updated_row))),
hop AS (
  SELECT 'hop_from_flagged' AS detector, to_id AS account_id, created_us, created_row, updated_us, updated_row,
    CASE WHEN sum(amount_p) >= 10000000 THEN 'high' ELSE 'medium' END AS severity,
    least(99, 62 + 4 * count(DISTINCT from_id) + CAST(round_even(max(score) * 10, 0) AS INT)) AS score, max(score) AS gnn_max, count(*) AS evidence_rows,
    min(t_us) AS first_evidence_us, CAST(sum(amount_p) AS BIGINT) AS total_p, count(DISTINCT from_id) AS people, count(*) AS hits
  FROM hop_ev GROUP BY ALL),
ruled AS (
  SELECT detector, account_id, created_us, created_row, updated_us, updated_row, severity, score, gnn_max, evidence_rows, first_evidence_us, total_p, people, hits, 'open' AS status
  FROM prim JOIN ev_agg USING (detector, account_id)
  {"UNION ALL SELECT *, 'open' FROM hop" if hop else ""}),
first_rule AS (SELECT account_id, min(created_us) AS t, arg_min(created_row, (created_us, created_row)) AS r FROM ruled GROUP BY 1),
mo AS (SELECT p.to_id AS account_id, p.row, p.t_us, p.score, p.amount_p, f.t IS NOT NULL AS is_ruled FROM pay p LEFT JOIN first_rule f ON f.account_id = p.to_id
    WHERE p.score >= {th} AND (f.t IS NULL OR p.t_us < f.t OR (p.t_us = f.t AND p.row < f.r))),
alerts AS (
  SELECT * FROM ruled UNION ALL
  SELECT 'model_only', account_id, min(t_us), arg_min(row, (t_us, row)), max(t_us), arg_max(row, (t_us, row)), 'medium', least(99, 45 + CAST(round_even(max(score) * 10, 0) AS INT)),
    max(score), count(*), min(t_us), CAST(sum(amount_p) AS BIGINT), 0, count(*), CASE WHEN bool_or(is_ruled) THEN 'superseded' ELSE 'open' END
  FROM mo GROUP BY account_id)"""


def alerts(version: str = "r2.0", hop: bool = True) -> str:
    return with_(V_PAYMENTS, V_ACCOUNTS, BASE, alerts_ctes(version, hop))


SQL: dict[str, str] = {}
for v in ("r2.0", "r2.1"):
    tag = "" if v == "r2.0" else "_" + v.replace(".", "")
    for d in ("inflow_new_payers", "structuring", "pass_through") + (("fan_in_new_payers",) if tag else ()):
        SQL[f"{d}_firings{tag}"] = fires(v) + (
            "SELECT account_id, CAST(t_us AS BIGINT) AS t_us, row, CAST(w_us AS BIGINT) AS w_us, severity, CAST(base_score AS INT) AS base_score, CAST(total_p AS BIGINT) AS total_p, "
            f"CAST(out_p AS BIGINT) AS out_p, CAST(people AS BIGINT) AS people, CAST(hits AS BIGINT) AS hits, CAST(bar_p AS BIGINT) AS bar_p FROM fires WHERE detector = '{d}'"
        )
OUT = (
    "SELECT detector, account_id, created_us, created_row, updated_us, updated_row, severity, CAST(score AS INT) AS score, round(gnn_max, 6) AS gnn_max, "
    "CAST(evidence_rows AS BIGINT) AS evidence_rows, first_evidence_us, CAST(total_p AS BIGINT) AS total_p, CAST(people AS BIGINT) AS people, CAST(hits AS BIGINT) AS hits, status FROM alerts"
)
for v in ("r2.0", "r2.1", "r2.2"):
    SQL["alerts_" + v.replace(".", "")] = alerts(v) + OUT
SQL["alerts_r20_without_hop"] = alerts("r2.0", hop=False) + OUT
SQL["alert_evidence_r20"] = alerts() + (
    "SELECT detector, account_id, row FROM evidence UNION ALL SELECT 'hop_from_flagged', to_id, row FROM hop_ev "
    "UNION ALL SELECT 'model_only', account_id, row FROM mo"
)
