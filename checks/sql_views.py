"""DuckDB counterparts of the engine's input tables, as CTE text."""

V_PAYMENTS = """v_n AS (SELECT max(user_id) + 1 AS n FROM events),
v_pay0 AS (SELECT e.*, n, (user_id*31 + event_id*17 + 7) % n AS p FROM events e, v_n),
v_payments AS (
  SELECT event_id AS row, 1704067200000000 + ((epoch_us(ts) - 1704067200000000) // 3) AS t_us,
    'A' || user_id AS from_id, 'A' || (CASE WHEN p = user_id THEN (p+1) % n ELSE p END) AS to_id,
    'a' || user_id || '@x' AS from_vpa, 'a' || (CASE WHEN p = user_id THEN (p+1) % n ELSE p END) || '@x' AS to_vpa,
    'S' || (user_id % 5) AS from_state, 'S' || ((CASE WHEN p = user_id THEN (p+1) % n ELSE p END) % 5) AS to_state,
    CASE WHEN event_id % 11 = 0 THEN 4999900 ELSE CAST(round(value*100) AS BIGINT) * 1000 END AS amount_p,
    CASE WHEN event_type IN ('view','click') THEN 'P2M' ELSE 'P2P' END AS channel,
    least(1.0, value/150) AS score,
    CASE WHEN event_type = 'error' AND value >= 60 THEN 1 ELSE 0 END AS is_fraud,
    CASE WHEN event_type = 'error' AND value >= 60 THEN event_type ELSE 'clean' END AS layer,
    'T' || event_id AS txn_id
  FROM v_pay0),
pay AS (
  SELECT *, amount_p / 100.0::DOUBLE AS amount,
    (CAST(round_even(amount_p / 100.0::DOUBLE, 0) AS BIGINT) BETWEEN 90000 AND 100000
      OR (CAST(round_even(amount_p / 100.0::DOUBLE, 0) AS BIGINT) >= 9999 AND CAST(round_even(amount_p / 100.0::DOUBLE, 0) AS BIGINT) % 1000 = 999)) AS near,
    row_number() OVER (PARTITION BY from_id, to_id ORDER BY t_us, row) = 1 AS new_payee,
    t_us // 86400000000 AS day
  FROM v_payments)"""

V_ACCOUNTS = """v_accounts AS (
  SELECT 'A' || a AS account_id, 'a' || a || '@x' AS vpa, 'S' || (a % 5) AS state, 'B' || (a % 4) AS bank,
    CASE a % 20 WHEN 3 THEN 'l1_mule' WHEN 7 THEN 'l2_mule' WHEN 5 THEN 'victim' ELSE 'clean' END AS role,
    CASE a % 10 WHEN 0 THEN 'merchant' WHEN 1 THEN 'supplier' WHEN 2 THEN 'business' ELSE 'individual' END AS kind
  FROM (SELECT unnest(range(0, max(user_id) + 1)) AS a FROM events))"""

V_MERCHANTS = """v_merchants AS (
  SELECT s_suppkey AS merchant_id,
    (['kirana','restaurant','pharmacy','fuel','electronics','online_services','utility_biller','subscription','travel','education'])[s_suppkey % 10 + 1] AS category,
    CAST(s_nationkey AS BIGINT) AS state, 'SA' || (s_suppkey // 3) AS settlement_account, 'E' || (s_suppkey // 2) AS legal_entity,
    CASE WHEN s_suppkey % 5 = 0 THEN 1704067200000000 + (s_suppkey % 7) * 86400000000 ELSE 1704067200000000 - 200 * 86400000000 END AS onboarded_us,
    CASE WHEN s_suppkey % 20 = 3 THEN 1 ELSE 0 END AS is_fraud
  FROM supplier)"""

V_M_PAYMENTS = """v_m_payments AS (
  SELECT *, row_number() OVER (ORDER BY t_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS row, amount_p / 100.0::DOUBLE AS amount
  FROM (
    SELECT l_suppkey AS merchant_id, o_custkey AS payer_id, CAST(c_nationkey AS BIGINT) AS payer_state,
      (CAST(round(l_extendedprice*100) AS BIGINT) * (100 - CAST(round(l_discount*100) AS BIGINT)) + 50) // 100 AS amount_p,
      1704067200000000 + ((epoch_us(o_orderdate) - 788918400000000) + ((l_orderkey*7919 + CAST(l_linenumber AS BIGINT)*104729) % 86400) * 1000000) // 250 AS t_us,
      CASE WHEN l_suppkey % 20 = 3 AND l_linenumber = 1 THEN 1 ELSE 0 END AS is_fraud,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""

V_COLLECTS = """v_collects AS (
  SELECT o_orderkey AS request_id, o_orderkey % (SELECT count(*) FROM supplier) AS merchant_id, o_custkey AS payer_id,
    1704067200000000 + ((epoch_us(o_orderdate) - 788918400000000) + ((o_orderkey*7919) % 86400) * 1000000) // 250 AS requested_us,
    1704067200000000 + ((epoch_us(o_orderdate) - 788918400000000) + ((o_orderkey*7919) % 86400) * 1000000) // 250 + (o_orderkey % 30 + 1) * 60000000 AS resolved_us,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'declined' ELSE 'expired' END AS outcome,
    CAST(o_orderkey % 2 AS INT) AS known_payer,
    CASE WHEN (o_orderkey % (SELECT count(*) FROM supplier)) % 20 = 3 AND o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_fraud
  FROM orders)"""

V_REGISTRY = """v_companies AS (
  SELECT 'U' || (10000 + s_suppkey % 5) || 'MH' || (2000 + s_suppkey % 24) || 'PTC' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS cin, s_name AS name,
    CASE s_suppkey % 7 WHEN 0 THEN 'Strike Off' WHEN 1 THEN 'Dormant' ELSE 'Active' END AS status,
    'Office ' || (s_suppkey % 13) || ', M.G. Road, Pune' AS address,
    make_date(2000 + s_suppkey % 27, 1 + s_suppkey % 12, 1) AS incorporated_on, round(s_acctbal * 100, 2) AS paid_up_capital,
    least(2026, (2000 + s_suppkey % 27) + s_suppkey % 20) AS last_annual_return, s_suppkey AS no
  FROM supplier),
v_directorships AS (
  SELECT 'U' || (10000 + s_suppkey % 5) || 'MH' || (2000 + s_suppkey % 24) || 'PTC' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS cin,
    lpad(CAST(d AS VARCHAR), 8, '0') AS din, CASE WHEN (s_suppkey + d) % 9 = 0 THEN DATE '2020-01-01' END AS ceased_on,
    CASE WHEN d % 11 = 0 THEN 1 ELSE 0 END AS disqualified
  FROM supplier, (SELECT unnest(range(60)) AS d) WHERE (s_suppkey * 7 + d) % 20 = 0),
v_entity_accounts AS (
  SELECT 'U' || (10000 + s_suppkey % 5) || 'MH' || (2000 + s_suppkey % 24) || 'PTC' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS cin,
    'a' || (s_suppkey % (SELECT max(user_id) + 1 FROM events)) || '@x' AS vpa FROM supplier)"""

V_SCORED_DOCS = """v_scored_docs AS (SELECT d.doc_id AS row, quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
