"""The relations of the adapters in plain SQL, as common table expressions."""

S = """s AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS item, l_returnflag AS model, concat('c', l_linenumber % 3) AS config, l_orderkey % 2 AS seed,
    CASE WHEN l_quantity > 10 + (l_suppkey * 7) % 31 + (l_linenumber % 3) * (l_suppkey % 5) * 2 THEN 'gold'
         WHEN l_discount >= 0.095 THEN '<unparsed>' ELSE concat('w', CAST(round(l_discount * 100) AS INT) % 3) END AS cls,
    CAST(l_quantity AS BIGINT) + 20 * (l_linenumber % 3) AS tok,
    row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber % 3, l_orderkey % 2
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS idx
  FROM lineitem)"""

C = S + """,
c AS (SELECT item, model, config, seed, count(*) AS n, count(*) FILTER (cls = 'gold') AS k, CAST(sum(tok) AS BIGINT) AS tokens,
        count(*) FILTER (cls = '<unparsed>') AS fails FROM s GROUP BY ALL)"""

M = C + """,
cc AS (SELECT item, model, config, seed, cls, count(*) AS cnt, min(idx) AS first_idx FROM s GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS r, lead(cnt) OVER w AS nxt FROM cc
       WINDOW w AS (PARTITION BY item, model, config, seed ORDER BY cnt DESC, first_idx)),
m AS (SELECT c.*, cls AS mode, cls = 'gold' AS mode_ok, coalesce(nxt = cnt, false) AS tie,
        CASE WHEN nxt IS NULL THEN 1.0 ELSE CAST(cnt - nxt AS DOUBLE) / n END AS margin
      FROM rk JOIN c USING (item, model, config, seed) WHERE r = 1)"""

R = """r AS (SELECT o_orderkey AS uid, o_custkey AS example, o_orderpriority AS strategy, o_orderstatus = 'F' AS is_correct,
        CAST(trunc(o_totalprice) AS BIGINT) % 1000 AS tokens FROM orders)"""

L = """l AS (SELECT concat(user_id, '-', event_type) AS uid, event_id AS line_no, event_type = 'error' AS failed, value, user_id, event_type FROM events)"""

T = """t AS (
  SELECT l_orderkey AS item, l_linenumber AS kind, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey % 50 + 1 AS VARCHAR) AS gold,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS idx
  FROM lineitem),
a AS (
  SELECT *, CASE WHEN kind IN (1, 2, 3, 4) THEN CAST(q AS VARCHAR) WHEN kind = 5 THEN NULL
                 WHEN kind = 6 THEN '\\frac{' || q || '}{2}' ELSE q || '.50' END AS answer,
    CASE WHEN kind IN (1, 2, 3, 4) THEN CAST(q AS VARCHAR) WHEN kind = 5 THEN NULL
         WHEN kind = 6 THEN CASE WHEN q % 2 = 0 THEN CAST(q // 2 AS VARCHAR) ELSE (q // 2) || '.5' END ELSE q || '.5' END AS norm
  FROM t)"""
