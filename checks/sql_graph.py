"""DuckDB oracle text for paths, neighbourhoods, graph features and break-even figures."""

from .sql_metrics import TEST, A, P
from .sql_profiles import ACTIONS, LIFE, STOPPED

S, DAY = 1_704_067_200_000_000, 86_400_000_000
TRAIN = f"t_us >= {S} AND t_us < {S + 6 * DAY}"
# plain enumeration, one level after another; the cut to 200 is applied once, at the end
PATHS = """sd AS (SELECT DISTINCT account_id AS seed FROM alerts WHERE status NOT IN ('cleared', 'superseded')),
h1 AS (SELECT seed, [seed, to_id] AS nodes, [(t_us, row)] AS legs FROM sd JOIN pay ON from_id = seed WHERE to_id <> seed),
h2 AS (SELECT seed, list_append(nodes, to_id) AS nodes, list_append(legs, (t_us, row)) AS legs FROM h1 JOIN pay ON from_id = nodes[-1] AND t_us >= legs[-1][1] WHERE NOT list_contains(nodes, to_id)),
h3 AS (SELECT seed, list_append(nodes, to_id) AS nodes, list_append(legs, (t_us, row)) AS legs FROM (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY legs) <= 400) JOIN pay ON from_id = nodes[-1] AND t_us >= legs[-1][1] WHERE NOT list_contains(nodes, to_id)),
pth AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY legs) AS path_no FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) QUALIFY path_no <= 200)"""
CTX = """b AS (SELECT *, t_us // 5000000 AS bkt, max(t_us) OVER (PARTITION BY t_us // 5000000) AS now_us FROM pay),
ends AS (SELECT row, bkt, now_us, from_id AS node FROM b UNION SELECT row, bkt, now_us, to_id FROM b),
near AS (SELECT n.bkt, n.now_us, n.node, x.row AS ctx, x.from_id AS source FROM (SELECT DISTINCT bkt, now_us, node FROM ends UNION SELECT DISTINCT e.bkt, e.now_us, x.from_id FROM ends e JOIN b x ON x.to_id = e.node AND x.bkt <= e.bkt AND x.t_us >= e.now_us - 259200000000) n
  JOIN b x ON x.to_id = n.node AND x.bkt <= n.bkt AND x.t_us >= n.now_us - 259200000000),
one AS (SELECT e.row, e.bkt, ctx, source FROM ends e JOIN near USING (bkt, node)),
two AS (SELECT DISTINCT o.row, n.ctx FROM one o JOIN near n ON n.bkt = o.bkt AND n.node = o.source)"""
PNA = "g AS (SELECT to_id AS account_id, count(*) AS d, avg(ln(1+amount)) AS mean, min(ln(1+amount)) AS min, max(ln(1+amount)) AS max, stddev_pop(ln(1+amount)) AS std FROM pay GROUP BY 1), z AS (SELECT *, ln(1+d) / (SELECT avg(ln(1+d)) FROM g) AS u FROM g)"


SQL = {
    "downstream_paths": A("r2.0", PATHS) + "SELECT seed, path_no, array_to_string(nodes, '>') AS nodes, array_to_string(list_transform(legs, lambda x: x[2]), ',') AS rows FROM pth",
    "downstream_paths_not_stopped": A("r2.0", ACTIONS, LIFE, STOPPED, "opn AS (SELECT * FROM pay WHERE row NOT IN (SELECT row FROM blk))", PATHS.replace("JOIN pay", "JOIN opn").replace("200", "20")).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT seed, path_no, array_to_string(nodes, '>') AS nodes, array_to_string(list_transform(legs, lambda x: x[2]), ',') AS rows, count(*) OVER (PARTITION BY seed) >= 20 AS truncated FROM pth",
    "path_summary": A("r2.0", PATHS) + """SELECT seed, reached, flagged_reached, longest, paths FROM (SELECT seed, count(DISTINCT n) AS reached, count(DISTINCT n) FILTER (n IN (SELECT account_id FROM alerts WHERE status NOT IN ('cleared', 'superseded'))) AS flagged_reached FROM (SELECT seed, unnest(nodes[2:]) AS n FROM pth) GROUP BY 1)
  JOIN (SELECT seed, CAST(max(len(legs)) AS INT) AS longest, count(*) AS paths FROM pth GROUP BY 1) USING (seed)""",
    "path_accounts_by_hop": A("r2.0", PATHS) + "SELECT seed, CAST(hop AS INT) AS hop, count(DISTINCT nodes[hop + 1]) AS accounts FROM pth, (SELECT unnest([1,2,3]) AS hop) WHERE len(nodes) > hop GROUP BY 1, 2",
    "context_edges_two_hop": P(CTX) + "SELECT row, count(*) AS edges, CAST(sum(ctx) AS BIGINT) AS ctx_sum, min(ctx) AS ctx_min, max(ctx) AS ctx_max FROM (SELECT row, ctx FROM one UNION SELECT row, ctx FROM two) GROUP BY 1",
    "recent_in_edges_cap": P() + "SELECT to_id, row, rk FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY t_us DESC, row DESC) AS rk FROM pay) WHERE rk <= 8",
    "bidirectional_edges": P() + "SELECT row, from_id, to_id, 'to' AS direction FROM pay UNION ALL SELECT row, to_id, from_id, 'rev_to' FROM pay",
    "undirected_pairs": P() + "SELECT from_id, to_id FROM pay UNION SELECT to_id, from_id FROM pay",
    "port_numbers": P("f AS (SELECT from_id, to_id, min((t_us, row)) AS f FROM pay GROUP BY 1, 2), k AS (SELECT from_id, to_id, row_number() OVER (PARTITION BY to_id ORDER BY f) - 1 AS in_port, row_number() OVER (PARTITION BY from_id ORDER BY f) - 1 AS out_port FROM f)")
    + "SELECT row, in_port, out_port FROM pay JOIN k USING (from_id, to_id)",
    "time_deltas": P() + "SELECT row, coalesce(t_us - lag(t_us) OVER (PARTITION BY to_id ORDER BY t_us, row), 0) AS in_delta_us, coalesce(t_us - lag(t_us) OVER (PARTITION BY from_id ORDER BY t_us, row), 0) AS out_delta_us FROM pay",
    "neighbour_multi_aggregates": P(PNA) + "SELECT account_id, d, " + ", ".join(f"round({a} * {s}, 6) AS {a}_{n}" for a in ("mean", "min", "max", "std") for n, s in (("id", "1.0::DOUBLE"), ("amp", "u"), ("att", "(1/u)"))) + " FROM z",
    "neighbour_attention_mean": P("a AS (SELECT to_id, ln(1+amount) AS v, CASE WHEN score*2 - ln(1+amount)/10 > 0 THEN score*2 - ln(1+amount)/10 ELSE 0.2::DOUBLE * (score*2 - ln(1+amount)/10) END AS l FROM pay)") + "SELECT to_id AS account_id, round(sum(exp(l) * v) / (sum(exp(l)) + 1), 6) AS attended FROM a GROUP BY 1",
    "neighbour_relation_means": P() + "SELECT to_id AS account_id, round(avg(ln(1+amount)) FILTER (channel='P2M'), 6) AS \"P2M\", round(avg(ln(1+amount)) FILTER (channel='P2P'), 6) AS \"P2P\" FROM pay GROUP BY 1",
    "ego_flags": P() + "SELECT account_id, max(f) AS ego FROM (SELECT from_id AS account_id, is_fraud AS f FROM pay UNION ALL SELECT to_id, is_fraud FROM pay) GROUP BY 1",
    "paid_by_flagged": P() + "SELECT DISTINCT to_id AS account_id FROM pay WHERE from_id IN (SELECT to_id FROM pay GROUP BY 1 HAVING max(score) >= 1.0)",
    "spliced_node_ids": P(f"""kn AS (SELECT key, row_number() OVER (ORDER BY min((row, o))) - 1 AS id FROM (SELECT from_id AS key, row, 0 AS o FROM pay WHERE {TRAIN} UNION ALL SELECT to_id, row, 1 FROM pay WHERE {TRAIN}) GROUP BY 1),
  ts AS (SELECT key, min((row, o)) AS f FROM (SELECT from_id AS key, row, 0 AS o FROM pay WHERE {TEST} UNION ALL SELECT to_id, row, 1 FROM pay WHERE {TEST}) GROUP BY 1)""")
    + "SELECT key, id, true AS known FROM ts JOIN kn USING (key) UNION ALL SELECT key, (SELECT max(id) + 1 FROM kn) + row_number() OVER (ORDER BY f) - 1, false FROM ts WHERE key NOT IN (SELECT key FROM kn)",
    "amounts_permuted_in_test": P(f"""tt AS (SELECT row, amount, row_number() OVER (ORDER BY row) AS k, row_number() OVER (ORDER BY md5('42|' || row), row) AS j FROM pay WHERE {TEST})""")
    + "SELECT p.row, round(ln(1 + coalesce(b.amount, p.amount)), 9) AS log_amount FROM pay p LEFT JOIN tt a ON a.row = p.row LEFT JOIN tt b ON b.j = a.k",
    "positive_class_weight": P() + f"SELECT round((count(*) - sum(is_fraud))::DOUBLE / sum(is_fraud), 9) AS positive_weight FROM pay WHERE t_us < {S + 6 * DAY}",
    "f1_by_time_step": P(f"x AS (SELECT (t_us - {S}) // {DAY} AS day, is_fraud AS y, score >= 0.86 AS hit FROM pay), y2 AS (SELECT 'day ' || day AS part, y, hit FROM x UNION ALL SELECT CASE WHEN day < 5 THEN 'before' ELSE 'after' END, y, hit FROM x)")
    + "SELECT part, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2.0*(tp::DOUBLE/(tp+fp))*(tp::DOUBLE/(tp+fn))/((tp::DOUBLE/(tp+fp))+(tp::DOUBLE/(tp+fn))) ELSE 0.0 END, 9) AS f1 FROM (SELECT part, count(*) FILTER (hit AND y=1) AS tp, count(*) FILTER (hit AND y=0) AS fp, count(*) FILTER (NOT hit AND y=1) AS fn FROM y2 GROUP BY 1)",

}
