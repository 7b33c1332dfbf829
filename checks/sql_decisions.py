"""DuckDB oracle text for cases, audit chains and investigator tools."""

from .sql_metrics import A, P
from .sql_profiles import ACTIONS, ORD, ROUTE, STOPPED
from .sql_profiles import LIFE as ALERT_LIFE

def _f(x: str) -> str:
    return f"coalesce(length({x}::VARCHAR) || ':' || {x}, '-')"


CAN = " || ".join([_f("run_id"), _f("entry_id"), _f("at_us"), "'-'", _f("action"), _f("actor"), "'7:analyst'", _f("note"), "'-'", _f("account_id"), "'--'"])
_KEY = b"demo-secret".ljust(64, b"\0")


def _blob(pad: int) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in _KEY) + "'::BLOB"
ENTRIES = """en AS (SELECT 'run-' || user_id AS run_id, event_id AS entry_id, epoch_us(ts) AS at_us, event_type AS action, 'analyst-' || user_id AS actor, props AS note, 'A' || user_id AS account_id FROM events)"""


def chain(where: str) -> str:
    return f"""nb AS (SELECT *, {CAN} AS c, row_number() OVER (PARTITION BY run_id ORDER BY at_us, entry_id) AS k FROM en WHERE {where}),
ch(run_id, k, entry_id, at_us, note, action, actor, account_id, prev_hash, hash) AS (
  SELECT run_id, k, entry_id, at_us, note, action, actor, account_id, repeat('0', 64), sha256(repeat('0', 64) || c) FROM nb WHERE k = 1
  UNION ALL SELECT n.run_id, n.k, n.entry_id, n.at_us, n.note, n.action, n.actor, n.account_id, ch.hash, sha256(ch.hash || n.c) FROM ch JOIN nb n ON n.run_id = ch.run_id AND n.k = ch.k + 1)"""


CHECK = f"""tm AS (SELECT run_id, entry_id, at_us, action, actor, account_id, prev_hash, hash, CASE WHEN entry_id % 997 = 0 THEN 'edited' ELSE note END AS note FROM ch WHERE entry_id % 1009 <> 5),
lk AS (SELECT *, lag(hash) OVER (PARTITION BY run_id ORDER BY at_us, entry_id) AS before, sha256(prev_hash || {CAN}) AS again FROM tm),
rs AS (SELECT run_id, entry_id, at_us, CASE WHEN before IS NOT NULL AND before <> prev_hash THEN 'link to previous row broken' WHEN again <> hash THEN 'content does not match its hash' END AS why FROM lk)"""
CASES = f"""fi AS (SELECT row_number() OVER (ORDER BY at_us, account_id, {ORD}) AS event_no, account_id, at_us FROM ac WHERE note <> '' AND action IN ('escalate','freeze')),
adj AS (SELECT i.event_no AS i, j.event_no AS j FROM fi i JOIN fi j ON j.event_no < i.event_no WHERE i.account_id = j.account_id OR EXISTS (SELECT 1 FROM pay p WHERE p.t_us <= i.at_us AND ((p.from_id = i.account_id AND p.to_id = j.account_id) OR (p.to_id = i.account_id AND p.from_id = j.account_id)))),
rc(i, j) AS (SELECT i, j FROM adj UNION SELECT rc.i, a.j FROM rc JOIN adj a ON a.i = rc.j)"""
H = 3_600_000_000
LIFE = f"""rt AS ({ROUTE.format('alerts')}), at0 AS (SELECT account_id, max(created_us) AS at_us FROM alerts WHERE status <> 'superseded' GROUP BY 1),
r AS (SELECT account_id, level, at_us, at_us + ([1,24,72])[level] * {H} AS log_end, CAST(substr(account_id, 2) AS BIGINT) AS n FROM rt JOIN at0 USING (account_id) WHERE level > 0),
e AS (SELECT *, at_us + (n % 5 + 1) * {H} AS ap, CASE WHEN n % 7 < 5 THEN at_us + (n % 40 + 2) * {H} END AS dec FROM r),
c AS (SELECT account_id, log_end AS t, 'restriction_expired' AS how FROM r UNION ALL SELECT account_id, at_us + 3 * {H}, 'frozen' FROM r WHERE n % 11 = 4 AND at_us + 3 * {H} < log_end
  UNION ALL SELECT account_id, CASE WHEN dec IS NULL OR dec > ap + 24 * {H} THEN ((ap + 24 * {H} + {H} - 1) // {H}) * {H} ELSE dec END, CASE WHEN dec IS NULL OR dec > ap + 24 * {H} THEN 'appeal_sla_release' ELSE 'cleared' END
    FROM e WHERE n % 3 < 2 AND ap < log_end AND (dec IS NULL OR dec > ap + 24 * {H} OR n % 2 = 0))"""
_MEMBERS = "mb AS (SELECT DISTINCT least(event_no, coalesce((SELECT min(j) FROM rc WHERE i = event_no), event_no)) AS case_id, account_id FROM fi)"
SQL = {
    "evidence_pack": A("r2.0", ACTIONS, CASES, _MEMBERS, ALERT_LIFE, STOPPED).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT case_id, count(*) AS transactions, count(*) FILTER (i AND o) AS links, CAST(coalesce(sum(amount_p) FILTER (i AND NOT o AND NOT z), 0) AS BIGINT) AS money_in_p,
    CAST(coalesce(sum(amount_p) FILTER (o AND NOT i AND NOT z), 0) AS BIGINT) AS exited_p, CAST(coalesce(sum(amount_p) FILTER (z), 0) AS BIGINT) AS blocked_p
  FROM (SELECT c.case_id, p.*, p.row IN (SELECT row FROM blk) AS z, EXISTS (SELECT 1 FROM mb WHERE mb.case_id = c.case_id AND mb.account_id = p.to_id) AS i, EXISTS (SELECT 1 FROM mb WHERE mb.case_id = c.case_id AND mb.account_id = p.from_id) AS o FROM (SELECT DISTINCT case_id FROM mb) c, pay p) WHERE i OR o GROUP BY 1""",
    "restriction_lifecycle": A("r2.0", LIFE) + "SELECT account_id, level, at_us, min((t, how))[1] AS ended_us, min((t, how))[2] AS how FROM r JOIN c USING (account_id) GROUP BY 1, 2, 3",
    "score_table_sink": P() + "SELECT is_fraud, count(*) AS n, round(max(score), 6) AS top, 'm1' AS model_id, 5 AS bucket_s, 259200 AS window_s, (SELECT count(*) FROM pay) AS edges FROM pay GROUP BY 1",
    "cases": A("r2.0", ACTIONS, CASES).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT event_no, account_id, least(event_no, coalesce((SELECT min(j) FROM rc WHERE i = event_no), event_no)) AS case_event FROM fi",
    "audit_chain_heads": f"WITH RECURSIVE {ENTRIES}, {chain('true')} SELECT run_id, arg_max(hash, k) AS head, count(*) AS entries FROM ch GROUP BY 1",
    "audit_chain_check": f"""WITH RECURSIVE {ENTRIES}, {chain('entry_id >= 20')}, {CHECK} SELECT e.run_id, b.entry_id IS NULL AS ok, coalesce(n, 0) AS entries, coalesce(b.entry_id, -1) AS first_bad_entry, coalesce(b.why, '') AS reason, u AS unchained
  FROM (SELECT run_id, count(*) FILTER (entry_id < 20) AS u FROM en WHERE NOT (entry_id >= 20 AND entry_id % 1009 = 5) GROUP BY 1) e LEFT JOIN (SELECT run_id, count(*) AS n FROM rs GROUP BY 1) c USING (run_id)
  LEFT JOIN (SELECT * FROM rs WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_us, entry_id) = 1) b USING (run_id)""",
    "audit_trail": f"WITH {ENTRIES} SELECT run_id, entry_id, action, at_us FROM en ORDER BY at_us DESC, entry_id DESC LIMIT 200",
    "record_signatures": f"WITH {ENTRIES} SELECT entry_id, 'sha256=' || sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || ({CAN})::BLOB))) AS signature FROM en",
    "record_hashes": f"WITH {ENTRIES} SELECT entry_id, sha256({CAN}) AS hash FROM en",
    "tool_downstream": P() + "SELECT to_vpa, to_state, amount, t_us, layer FROM pay WHERE from_vpa = 'a3@x' ORDER BY t_us, row LIMIT 20",
    "tool_watch": P() + "SELECT row, from_state || ' → ' || to_state AS state_pair, amount, score FROM pay WHERE lower(from_state || ' → ' || to_state) LIKE '%s1%' ORDER BY t_us DESC, row DESC LIMIT 25",
}
